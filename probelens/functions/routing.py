"""Which outputs a probe writes to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = "prometheus"
LINES = "stdout"


def _lists(outputs: Column, kind: str) -> Column:
    return F.coalesce(F.exists(outputs, lambda o: F.coalesce(o["type"] == kind, F.lit(False))), F.lit(False))


def to_metrics(outputs: Column) -> Column:
    """Metrics are the default: no list, an empty list, or a list that names them."""
    return (F.coalesce(F.size(outputs), F.lit(0)) <= 0) | _lists(outputs, METRICS)


def to_lines(outputs: Column) -> Column:
    """Result lines are written only where asked for."""
    return _lists(outputs, LINES)
