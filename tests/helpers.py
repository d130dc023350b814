"""Small tables for golden tests."""

from __future__ import annotations

import datetime as dt

from probelens import schemas

T0 = dt.datetime(2024, 1, 1)


def _row(schema, values: dict) -> tuple:
    unknown = set(values) - set(schema.names)
    assert not unknown, unknown
    return tuple(values.get(name) for name in schema.names)


def table(spark, schema, *rows: dict):
    return spark.createDataFrame([_row(schema, r) for r in rows], schema)


def probe(name="default/p", url="https://x.test", expected_status=200, **more) -> dict:
    return {"name": name, "url": url, "interval": 30, "expected_status": expected_status, **more}


def step(name, expected_status=200, contains_text=None, **more) -> dict:
    return {
        "name": name, "url": f"https://x.test/{name}", "method": None, "headers": None, "body": None,
        "expected_status": expected_status, "contains_text": contains_text, **more,
    }


def mcp(min_tool_count=0, required_tools=(), require_tools_capability=True) -> dict:
    return {
        "protocol_version": "2025-11-25", "client_name": "c", "client_version": "1",
        "require_tools_capability": require_tools_capability, "min_tool_count": min_tool_count,
        "required_tools": list(required_tools),
    }


def response(seq=0, status=200, body="", error_kind=None, error=None) -> dict:
    return {
        "seq": seq, "stage": None, "status_code": None if error_kind else status,
        "body": None if error_kind else body, "error_kind": error_kind, "error": error,
    }


def cycle(cycle_id, probe, *responses: dict, at=T0, duration_us=1000) -> dict:
    return {
        "cycle_id": cycle_id, "probe": probe, "started_at": at, "duration_us": duration_us,
        "finished_at": at + dt.timedelta(microseconds=duration_us), "responses": list(responses),
    }


def probes(spark, *rows):
    return table(spark, schemas.PROBES, *rows)


def cycles(spark, *rows):
    return table(spark, schemas.CHECK_CYCLES, *rows)


RESULT = "name STRING, healthy BOOLEAN, status_code INT, last_check_time TIMESTAMP, message STRING, url STRING, expected_status INT, cycle_id STRING, duration_us BIGINT, mode STRING, to_metrics BOOLEAN, to_lines BOOLEAN"


def result(name="default/p", healthy=True, status_code=200, at=T0, message="m", cycle_id="c", duration_us=1000,
           to_metrics=True, to_lines=False) -> tuple:
    return (name, healthy, status_code, at, message, "https://x.test", 200, cycle_id, duration_us, "single",
            to_metrics, to_lines)


def results(spark, *rows):
    return spark.createDataFrame(list(rows), RESULT)


def seconds(n) -> dt.datetime:
    return T0 + dt.timedelta(seconds=n)


def same(left, right) -> bool:
    """Equal as bags of rows, in the columns of the left one."""
    right = right.select(left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
