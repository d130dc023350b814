"""Verdicts: one case per rule and message."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from helpers import T0, cycle, cycles, mcp, probe, probes, response, same, step, table
from probelens import schemas
from probelens.operators import evaluate
from probelens.sources import fixtures as fx

OK_INIT = '{"jsonrpc":"2.0","id":"a","result":{"protocolVersion":"2025-11-25","capabilities":{"tools":{"listChanged":true}}}}'
OK_TOOLS = '{"jsonrpc":"2.0","id":"b","result":{"tools":[{"name":"health.check"},{"name":"search.docs"}]}}'

SINGLE = [
    # probe, response, healthy, status, message
    ({"contains_text": "welcome"}, response(body="welcome demo"), True, 200, "Got expected status 200 and matched response text"),
    ({}, response(body="ok"), True, 200, "Got expected status 200"),
    ({"contains_text": ""}, response(body="ok"), True, 200, "Got expected status 200"),
    ({}, response(status=503), False, 503, "Expected 200 but got 503"),
    ({"expected_status": 204}, response(status=204), True, 204, "Got expected status 204"),
    ({"contains_text": "Hi"}, response(body="hi"), False, 200, 'Response body did not contain "Hi"'),
    ({"contains_text": 'a"b\\c\n'}, response(body=None), False, 200, 'Response body did not contain "a\\"b\\\\c\\n"'),
    ({"contains_text": "a\x01\x7f b\u200b\U000e0001é"}, response(body=None), False, 200, 'Response body did not contain "a\\x01\\x7f b\\u200b\\U000e0001é"'),
    ({}, response(error_kind="transport", error="timeout"), False, 0, "http request failed: timeout"),
    ({}, response(error_kind="build", error="bad url"), False, 0, "failed to build request: bad url"),
    ({}, response(error_kind="read", error="eof"), False, 0, "failed to read response body: eof"),
    ({}, response(error_kind="auth", error='missing credential "x"'), False, 0, 'missing credential "x"'),
]


def run(spark, cases):
    """cases: (probe fields, responses); both input forms must give the same."""
    named = [probe(f"default/p{i}", **fields) for i, (fields, _) in enumerate(cases)]
    logs = [cycle(f"c{i}", f"default/p{i}", *rs) for i, (_, rs) in enumerate(cases)]
    ps, cs = probes(spark, *named), cycles(spark, *logs)
    found = evaluate.check_results(cs, ps)
    with_rows = found.join(cs.where(F.size("responses") > 0).select("cycle_id"), "cycle_id", "left_semi")
    from_rows = evaluate.exchange_results(fx.exchanges_of(cs), ps)
    assert same(with_rows.drop("duration_us", "last_check_time"), from_rows)
    return {r.name: r for r in found.collect()}


def test_single_request_rules(spark):
    found = run(spark, [(fields, [r]) for fields, r, *_ in SINGLE])
    for i, (fields, _, healthy, status, message) in enumerate(SINGLE):
        row = found[f"default/p{i}"]
        assert (row.healthy, row.status_code, row.message) == (healthy, status, message)
        assert row.expected_status == fields.get("expected_status", 200)
        assert row.mode == "single" and row.url == "https://x.test"


def test_journey_rules(spark):
    two = [step("open", contains_text="Sign in"), step("load", expected_status=201)]
    found = run(
        spark,
        [
            ({"journey": two, "expected_status": 204}, [response(0, 200, "Sign in"), response(1, 201)]),
            ({"journey": two}, [response(0, 200, "nope")]),
            ({"journey": two}, [response(0, 200, "Sign in"), response(1, 500)]),
            ({"journey": two}, [response(0, 500), response(1, 500)]),
            ({"journey": two}, [response(0, error_kind="transport", error="refused")]),
            ({"journey": two}, [response(0, 200, "Sign in")]),
            ({"journey": []}, [response(0, 200)]),
        ],
    )
    got = {k[-1]: (r.healthy, r.status_code, r.message, r.expected_status) for k, r in found.items()}
    assert got["0"] == (True, 201, "Synthetic journey succeeded (2 steps)", 204)
    assert got["1"] == (False, 200, 'Step 1 (open) failed: Response body did not contain "Sign in"', 200)
    assert got["2"] == (False, 500, "Step 2 (load) failed: Expected 201 but got 500", 201)
    assert got["3"] == (False, 500, "Step 1 (open) failed: Expected 200 but got 500", 200)
    assert got["4"] == (False, 0, "Step 1 (open) failed: http request failed: refused", 200)
    assert "5" not in got  # a step is missing and none failed
    assert got["6"] == (True, 200, "Got expected status 200", 200)


def calls(init=OK_INIT, tools=OK_TOOLS, init_status=200, note_status=202, tools_status=200):
    return [response(0, init_status, init), response(1, note_status), response(2, tools_status, tools)]


def tools_body(*tools):
    return json.dumps({"result": {"tools": list(tools)}})


INIT_DECODE = "Failed to decode initialize response: "
RESULT_DECODE = "Failed to decode initialize result: unexpected JSON type"
TOOLS_DECODE = "Failed to decode tools/list result: unexpected JSON type"
NO_VERSION = "Initialize response missing protocolVersion"

MCP = [
    (mcp(1, ["health.check"]), calls(), True, 200, "MCP tool validation succeeded (2 tools)"),
    (mcp(0, ["search"]), calls(), False, 200, "tools/list missing required tools: search"),
    (mcp(0, ["z", "a", "z"]), calls(), False, 200, "tools/list missing required tools: a, z, z"),
    (mcp(3), calls(), False, 200, "tools/list returned 2 tools, need at least 3"),
    (mcp(2, ["a"]), calls(tools=tools_body({"name": "a"}, {"name": "a"})), True, 200, "MCP tool validation succeeded (2 tools)"),
    (mcp(2), calls(tools=tools_body({}, {"name": None})), True, 200, "MCP tool validation succeeded (2 tools)"),
    (mcp(1), calls(tools=tools_body(None)), True, 200, "MCP tool validation succeeded (1 tools)"),
    (mcp(0, [""]), calls(tools=tools_body({})), True, 200, "MCP tool validation succeeded (1 tools)"),
    (mcp(), calls(tools='{"result":null}'), True, 200, "MCP tool validation succeeded (0 tools)"),
    (mcp(), calls(tools='{"result":{"tools":null}}'), True, 200, "MCP tool validation succeeded (0 tools)"),
    (mcp(), calls(tools=tools_body({"name": 5})), False, 200, TOOLS_DECODE),
    (mcp(), calls(tools=tools_body(5)), False, 200, TOOLS_DECODE),
    (mcp(), calls(tools=tools_body([])), False, 200, TOOLS_DECODE),
    (mcp(), calls(tools='{"result":{"tools":{}}}'), False, 200, TOOLS_DECODE),
    (mcp(), calls(tools='{"result":[]}'), False, 200, TOOLS_DECODE),
    (mcp(), calls(tools='{"result":7}'), False, 200, TOOLS_DECODE),
    (mcp(), calls(tools="{}"), False, 200, "tools/list response missing result"),
    (mcp(), calls(tools_status=500), False, 500, "tools/list returned HTTP 500"),
    (mcp(), calls(note_status=199), False, 199, "notifications/initialized returned HTTP 199"),
    (mcp(), calls(note_status=300), False, 300, "notifications/initialized returned HTTP 300"),
    (mcp(), calls(note_status=299), True, 200, "MCP tool validation succeeded (2 tools)"),
    (mcp(), calls(init_status=404), False, 404, "initialize returned HTTP 404"),
    (mcp(), calls(init_status=202), False, 202, "initialize returned HTTP 202"),
    (mcp(), calls(init=""), False, 200, INIT_DECODE + "unexpected end of JSON input"),
    (mcp(), calls(init=None), False, 200, INIT_DECODE + "unexpected end of JSON input"),
    (mcp(), calls(init="event: message\ndata: {}\n"), False, 200, INIT_DECODE + "invalid JSON document"),
    (mcp(), calls(init=OK_INIT + " x"), False, 200, INIT_DECODE + "invalid JSON document"),
    (mcp(), calls(init=OK_INIT + "} x"), False, 200, INIT_DECODE + "invalid JSON document"),
    (mcp(), calls(init=OK_INIT + "] x"), False, 200, INIT_DECODE + "invalid JSON document"),
    (mcp(), calls(init=OK_INIT + ",{}"), False, 200, INIT_DECODE + "invalid JSON document"),
    (mcp(), calls(init=f" {OK_INIT}\n"), True, 200, "MCP tool validation succeeded (2 tools)"),
    (mcp(), calls(init="[]"), False, 200, INIT_DECODE + "unexpected JSON type"),
    (mcp(), calls(init="5"), False, 200, INIT_DECODE + "unexpected JSON type"),
    (mcp(), calls(init='{"JSONRPC":"2.0","Result" : {"ProtocolVersion":"1","capabilities":{"TOOLS":{}}}}', tools='{"result":{"tools":[{"NAME":"a"}]}}'), True, 200, "MCP tool validation succeeded (1 tools)"),
    (mcp(), calls(init='{"result":{"protocolVersion":"1"},"RESULT":{"protocolVersion":""}}'), False, 200, "Initialize response missing protocolVersion"),
    (mcp(), calls(init="null"), False, 200, "initialize response missing result"),
    (mcp(), calls(init='{"jsonrpc":2,"result":{}}'), False, 200, INIT_DECODE + "unexpected JSON type"),
    (mcp(), calls(init='{"error":"x"}'), False, 200, INIT_DECODE + "unexpected JSON type"),
    (mcp(), calls(init='{"error":{"code":1.5}}'), False, 200, INIT_DECODE + "unexpected JSON type"),
    (mcp(), calls(init='{"error":{"code":"1"}}'), False, 200, INIT_DECODE + "unexpected JSON type"),
    (mcp(), calls(init='{"error":{"code":7,"message":"no"}}'), False, 200, "initialize returned JSON-RPC error 7: no"),
    (mcp(), calls(init='{"error":{},"result":{}}'), False, 200, "initialize returned JSON-RPC error 0: "),
    (mcp(), calls(init=OK_INIT[:-1] + ',"error":null}'), True, 200, "MCP tool validation succeeded (2 tools)"),
    (mcp(), calls(init='{"result":null}'), False, 200, NO_VERSION),
    (mcp(), calls(init='{"result":{"protocolVersion":""}}'), False, 200, NO_VERSION),
    (mcp(), calls(init='{"result":{"protocolVersion":null}}'), False, 200, NO_VERSION),
    (mcp(), calls(init='{"result":{"protocolVersion":1}}'), False, 200, RESULT_DECODE),
    (mcp(), calls(init='{"result":{"protocolVersion":"1","capabilities":[]}}'), False, 200, RESULT_DECODE),
    (mcp(), calls(init='{"result":"x"}'), False, 200, RESULT_DECODE),
    (mcp(), calls(init='{"result":{"protocolVersion":"1","capabilities":{}}}'), False, 200, "Initialize response did not advertise tools capability"),
    (mcp(), calls(init='{"result":{"protocolVersion":"1"}}'), False, 200, "Initialize response did not advertise tools capability"),
    (mcp(), calls(init='{"result":{"protocolVersion":"1","capabilities":{"tools":null}}}'), True, 200, "MCP tool validation succeeded (2 tools)"),
    (mcp(require_tools_capability=False), calls(init='{"result":{"protocolVersion":"1"}}'), True, 200, "MCP tool validation succeeded (2 tools)"),
    (mcp(), calls(init='{"result":{"protocolVersion":"","protocolVersion":"1","capabilities":{"tools":1}}}'), True, 200, "MCP tool validation succeeded (2 tools)"),
    (mcp(), [response(0, error_kind="transport", error="t")], False, 0, "initialize request failed: http request failed: t"),
    (mcp(), [response(0, 200, OK_INIT), response(1, error_kind="auth", error="a")], False, 0, "notifications/initialized request failed: a"),
    (mcp(), [*calls()[:2], response(2, error_kind="read", error="r")], False, 0, "tools/list request failed: failed to read response body: r"),
    (mcp(), calls()[:2], None, None, None),
    (mcp(), calls()[:1], None, None, None),
]


def test_tool_listing_rules(spark):
    found = run(spark, [({"mcp": spec, "expected_status": 418}, rs) for spec, rs, *_ in MCP])
    for i, (_, _, healthy, status, message) in enumerate(MCP):
        row = found.get(f"default/p{i}")
        if healthy is None:
            assert row is None, i
        else:
            assert (row.healthy, row.status_code, row.message, row.expected_status) == (healthy, status, message, 200), i


def test_precedence_and_config_error(spark):
    both = {"mcp": mcp(), "journey": [step("a")]}
    found = run(
        spark,
        [
            ({**both, "config_error": "Invalid auth config: x", "expected_status": 201}, []),
            (both, calls()),
            ({"journey": [step("a")]}, [response()]),
        ],
    )
    first = found["default/p0"]
    assert (first.healthy, first.status_code, first.message) == (False, 0, "Invalid auth config: x")
    assert first.expected_status == 201
    assert [found[f"default/p{i}"].mode for i in range(3)] == ["config_error", "mcp", "journey"]


def test_rejected_rows_are_kept_apart(spark):
    ps = probes(spark, probe("default/j", journey=[step("a"), step("b")]))
    rows = [("c1", "default/j", 0, 200), ("c1", "default/j", 1, 200), ("c1", "default/j", 2, 500), ("c2", "default/j", 0, 200), ("c3", "default/unknown", 0, 200)]
    ex = table(spark, schemas.EXCHANGES, *[dict(zip(("cycle_id", "probe", "seq", "status_code"), r)) for r in rows])
    cycles_ = evaluate.assemble_cycles(ex, ps)
    assert {r.cycle_id: len(r.responses) for r in cycles_.collect()} == {"c1": 2, "c2": 1}
    assert [r.cycle_id for r in evaluate.check_results(cycles_, ps).collect()] == ["c1"]
    assert [r.cycle_id for r in evaluate.incomplete_cycles(cycles_, ps).collect()] == ["c2"]
    rejected = evaluate.unplanned_exchanges(ex, ps)
    assert {(r.cycle_id, r.seq) for r in rejected.collect()} == {("c1", 2), ("c3", 0)}
    assert ex.count() == rejected.count() + cycles_.select(F.explode("responses")).count()


@pytest.mark.parametrize("unique", [False, True])
def test_exchange_form_equals_assembled_form(spark, unique):
    sf = "/root/testdata/sf0.001"
    ex, ps = fx.conversation_exchanges(spark, sf), fx.conversation_probes(spark, sf)
    given = ex if unique else ex.unionByName(ex)
    assembled = evaluate.journey_results(evaluate.assemble_cycles(given, ps, unique=unique), ps)
    assert same(assembled, evaluate.exchange_results(given, ps, unique=unique))
    assert same(assembled, evaluate.exchange_results(ex, ps))


def test_repeated_rows_do_not_complete_a_cycle(spark):
    ps = probes(spark, probe("default/j", journey=[step("a"), step("b")]))
    row = {"cycle_id": "c", "probe": "default/j", "seq": 0, "status_code": 200}
    ex = table(spark, schemas.EXCHANGES, row, row)
    assert evaluate.exchange_results(ex, ps).isEmpty()


def test_evaluation_of_cycles_does_not_shuffle_them(spark):
    """The only exchanges are those of the probe side."""
    sf = "/root/testdata/sf0.001"
    path = spark.conf.get("spark.checkpoint.dir") + "/cycles-plan"
    fx.event_cycles(spark, sf).write.mode("overwrite").parquet(path)
    ps = probes(spark, probe("default/user-1"))
    plan = evaluate.check_results(spark.read.parquet(path), ps)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert plan.count("Expected ") == 2  # single and journey step: no verdict is computed twice


def test_lost_responses_leave_no_made_up_verdict(spark):
    """Every subset of the three responses, with a failure at each place or none; both forms agree."""
    whole = [[response(0, 503 if bad == 0 else 200, OK_INIT), response(1, 500 if bad == 1 else 202), response(2, 500 if bad == 2 else 200, OK_TOOLS)] for bad in (None, 0, 1, 2)]
    cases = [(bad, keep) for bad in range(4) for keep in range(1, 8)]
    logs = [[r for i, r in enumerate(whole[bad]) if keep >> i & 1] for bad, keep in cases]
    found = run(spark, [({"mcp": mcp()}, rs) for rs in logs])
    for i, (bad, keep) in enumerate(cases):
        decided = 2 if bad == 0 else bad - 1
        there = all(keep >> k & 1 for k in range(decided + 1))
        assert (f"default/p{i}" in found) == there, (bad, keep)
        if there:
            assert found[f"default/p{i}"].healthy == (bad == 0)


def test_a_single_check_reads_the_response_of_its_own_request(spark):
    assert run(spark, [({}, [response(1, 200, "x")])]) == {}


def test_copies_at_equal_times_count_alike_in_both_forms(spark):
    ps = probes(spark, probe())
    copy = {"cycle_id": "c", "probe": "default/p", "cycle_started_at": T0, "seq": 0, "started_at": T0, "finished_at": T0}
    log = table(spark, schemas.EXCHANGES, {**copy, "status_code": 503, "body": "a"}, {**copy, "status_code": 200, "body": "b"}, {**copy, "status_code": 200, "body": "a"})
    direct = evaluate.exchange_results(log, ps)
    assert same(direct, evaluate.check_results(evaluate.assemble_cycles(log, ps), ps))
    assert [r.status_code for r in direct.collect()] == [200]


def test_probes_with_a_config_error_report_by_ticks(spark):
    ps = probes(spark, probe("default/bad", config_error="Invalid auth config: x"), probe("default/ok"))
    ticks = cycles(spark, cycle("t1", "default/bad"), cycle("t2", "default/ok"), cycle("t3", "default/none")).drop("responses")
    none = table(spark, schemas.EXCHANGES)
    found = evaluate.exchange_results(none, ps, ticks=ticks).collect()
    assert [(r.cycle_id, r.healthy, r.message) for r in found] == [("t1", False, "Invalid auth config: x")]
    sent = table(spark, schemas.EXCHANGES, {"cycle_id": "t1", "probe": "default/bad", "seq": 0, "status_code": 200})
    assert evaluate.exchange_results(sent, ps).isEmpty() and evaluate.unplanned_exchanges(sent, ps).count() == 1
    assert [r.cycle_id for r in evaluate.unknown_cycles(cycles(spark, cycle("t1", "default/bad"), cycle("t3", "default/none")), ps).collect()] == ["t3"]
