"""The one join the operators use: many rows look up one row each in a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: A column of this name tells that the facts are stored in buckets of their key and it, SALTS of them a key.
SALT = "_salt"


def salt_of(spread_by: list[str], salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    salted: bool = False,
    salts: int = SALTS,
) -> DataFrame:
    """Join `facts` to `table` (unique on `on`).

    A plain join by default. Adaptive execution measures the table when it runs: below the session's broadcast
    limit it is broadcast and `facts` stays where it is; above, the partitions of a hot key are split. Say `salted`
    where the session runs without adaptive execution and one key may hold much of `facts`: the table
    is repeated once per salt and the rows of a key are spread over all salts by a hash of `spread_by`.

    Facts from a bucketed log (`readers.read_bucketed`) stay where they are whatever the table's size: it goes to their buckets.
    """
    if SALT in facts.columns:
        copies = table.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return facts.join(copies.hint("shuffle_hash"), [*on, SALT], how).drop(SALT)
    if not salted:
        return facts.join(table, on, how)
    copies = table.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return facts.withColumn(SALT, salt_of(spread_by, salts)).join(copies, [*on, SALT], how).drop(SALT)
