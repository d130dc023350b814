"""Declarations, validation, probe projection, plans and credential resolution."""

from __future__ import annotations

import datetime as dt

import os

import pytest
from pyspark.sql import functions as F

from helpers import T0, mcp, probe, probes, same, step, table
from probelens import schemas
from probelens.operators import auth, specs
from probelens.operators.joins import lookup_join
from probelens.sources import fixtures as fx


def canary(name="c", namespace="default", created_at=T0, **spec) -> dict:
    full = {f: spec.get(f) for f in schemas.CANARIES["spec"].dataType.names}
    full["url"] = spec.get("url", "https://x.test")
    return {"namespace": namespace, "name": name, "created_at": created_at, "spec": full}


def canaries(spark, *rows):
    return table(spark, schemas.CANARIES, *rows)


def ref(name, key):
    return {"name": name, "key": key}


def auth_spec(kind, basic=None, bearer=None, api_key=None):
    return {"type": kind, "basic": basic, "bearer": bearer, "api_key": api_key}


def test_defaults_fill_only_present_blocks(spark):
    empty_mcp = dict.fromkeys(schemas.CANARIES["spec"].dataType["mcp"].dataType.names)
    step_ = {**step("s"), "expected_status": None}
    rows = canaries(spark, canary("a"), canary("b", mcp=empty_mcp, journey=[step_], method="PUT", interval=7, expected_status=404))
    a, b = specs.spec_defaults(rows, client_name="tool").orderBy("name").select("spec.*").collect()
    assert (a.method, a.interval, a.expected_status, a.mcp, a.journey, a.outputs) == ("GET", 30, 200, None, None, None)
    assert (b.method, b.interval, b.expected_status) == ("PUT", 7, 404)
    assert (b.journey[0].method, b.journey[0].expected_status) == ("GET", 200)
    assert b.mcp.asDict() == {
        "protocol_version": "2025-11-25", "client_name": "tool", "client_version": "0.1.0",
        "require_tools_capability": True, "min_tool_count": None, "required_tools": None,
    }


VIOLATIONS = [
    ({}, []),
    ({"url": ""}, ["url empty"]),
    ({"url": None}, ["url required"]),
    ({"method": "get"}, ["method unknown"]),
    ({"interval": 4}, ["interval below minimum"]),
    ({"interval": 5, "expected_status": 99}, ["expected_status out of range"]),
    ({"expected_status": 599}, []),
    ({"journey": [step("")]}, ["journey.name empty"]),
    ({"journey": [step("a"), {**step("b"), "url": None, "method": "X", "expected_status": 600}]},
     ["journey.url required", "journey.method unknown", "journey.expected_status out of range"]),
    ({"mcp": mcp(-1)}, ["mcp.min_tool_count below minimum"]),
    ({"outputs": [{"type": "stdout"}, {"type": "file"}]}, ["outputs.type unknown"]),
    ({"outputs": [{"type": None}]}, ["outputs.type required"]),
    ({"outputs": []}, []),
    ({"auth": auth_spec("digest")}, ["auth.type unknown"]),
    ({"auth": auth_spec(None)}, ["auth.type required"]),
    ({"auth": auth_spec("basic")}, []),
    ({"auth": auth_spec("bearer", bearer={"token_secret_ref": ref("s", None)})}, ["auth.bearer.token.key required"]),
    ({"auth": auth_spec("bearer", bearer={"token_secret_ref": None})}, ["auth.bearer.token required"]),
    ({"auth": auth_spec("apiKey", api_key={"header_name": "", "value_secret_ref": ref("s", "k")})},
     ["auth.api_key.header_name empty"]),
]


def test_violations(spark):
    rows = canaries(spark, *[canary(str(i), **spec) for i, (spec, _) in enumerate(VIOLATIONS)])
    declared = specs.spec_defaults(rows)
    found = {r.name: r.violations for r in specs.spec_violations(declared).collect()}
    for i, (_, expected) in enumerate(VIOLATIONS):
        assert found[str(i)] == expected, i
    assert specs.valid_canaries(declared).count() + specs.rejected_canaries(declared).count() == len(VIOLATIONS)


def test_probe_set_copies_fields(spark):
    spec = dict(
        url="https://example.com/login", method="POST", headers={"Content-Type": "application/json"},
        mcp=mcp(1, ["search.docs"]), body="{}", interval=30, expected_status=200, contains_text="dashboard",
        outputs=[{"type": "prometheus"}, {"type": "stdout"}],
        journey=[step("open-login", contains_text="Sign in"), step("submit-login", contains_text="Welcome", method="POST")],
    )
    row = specs.probe_set(canaries(spark, canary("sample-ui-login", **spec), canary("bare", outputs=[]))).collect()
    full, bare = row
    assert full.name == "default/sample-ui-login" and full.method == "POST" and full.contains_text == "dashboard"
    assert full.headers == {"Content-Type": "application/json"} and full.mcp.required_tools == ["search.docs"]
    assert [s.method for s in full.journey] == [None, "POST"] and len(full.outputs) == 2
    assert bare.outputs is None


def test_output_routing(spark):
    lists = [None, [], ["prometheus"], ["stdout"], ["stdout", "prometheus"]]
    rows = probes(spark, *[probe(str(i), outputs=None if o is None else [{"type": x} for x in o]) for i, o in enumerate(lists)])
    found = [(r.to_metrics, r.to_lines) for r in specs.output_routing(rows).orderBy("name").collect()]
    assert found == [(True, False), (True, False), (True, False), (False, True), (True, True)]


def test_request_plan(spark):
    basic = {"type": "basic", "username_credential_id": "u", "password_credential_id": "p"}
    key = {"type": "apiKey", "header_name": "x-key", "value_credential_id": "v"}
    full = {n: None for n in schemas.PROBES["auth"].dataType.names}
    rows = probes(
        spark,
        probe("1", method="post", headers={"x-a": "1", "authorization": "no"}, body="b", auth={**full, **basic}),
        probe("2", mcp=mcp(), headers={"accept": "text/plain", "X-KEY": "no"}, auth={**full, **key}),
        probe("3", journey=[step("a", headers={"k v": "1"}), step("b", method="put")], headers={"x": "y"}),
        probe("4", config_error="broken"),
    )
    plan = specs.request_plan(rows, "i", "t").orderBy("probe", "seq").collect()
    one, init, note, tools, a, b = plan
    assert (one.method, one.headers, one.body) == ("POST", {"X-A": "1"}, "b")
    assert (one.auth_header, one.credential_ids) == ("Authorization", ["u", "p"])
    assert [r.stage for r in (init, note, tools)] == ["initialize", "notifications/initialized", "tools/list"]
    assert init.headers == {"Accept": "text/plain", "Content-Type": "application/json"}
    assert init.auth_header == "X-Key" and init.method == "POST"
    assert init.body == (
        '{"jsonrpc":"2.0","id":"i","method":"initialize","params":{"protocolVersion":"2025-11-25","capabilities":{},'
        '"clientInfo":{"name":"c","version":"1"}}}'
    )
    assert note.body == '{"jsonrpc":"2.0","method":"notifications/initialized"}'
    assert tools.body == '{"jsonrpc":"2.0","id":"t","method":"tools/list"}'
    assert (a.method, a.headers, a.url, a.auth_type) == ("GET", {"k v": "1"}, "https://x.test/a", None)
    assert (b.method, b.headers) == ("PUT", {})


def test_planned_checks(spark):
    start, end = F.lit(T0), F.lit(T0 + dt.timedelta(seconds=61))
    rows = probes(spark, {**probe("a"), "interval": 30}, {**probe("b"), "interval": 61}, {**probe("c"), "interval": 1})
    found = specs.planned_checks(rows, start, end).orderBy("name", "check_number").collect()
    assert [(r.planned_at - T0).seconds for r in found if r.name == "a"] == [0, 30, 60]
    assert [r.check_number for r in found if r.name == "b"] == [1]
    assert len([r for r in found if r.name == "c"]) == 61
    assert specs.planned_checks(rows, end, start).isEmpty()
    long = specs.planned_checks(rows.where("name = 'c'"), F.lit(T0), F.lit(T0 + dt.timedelta(seconds=10_000)))
    assert long.select("planned_at").distinct().count() == 10_000
    with pytest.raises(Exception, match="interval below 1 second"):
        specs.planned_checks(probes(spark, {**probe("z"), "interval": 0}), start, end).collect()


def test_current_specs(spark):
    rows = [("a", 1, 1, "create", "u1"), ("a", 2, 2, "update", "u2"), ("b", 1, 3, "create", "u3"), ("b", 1, 4, "delete", None), ("c", 1, 5, "delete", None), ("c", 2, 6, "create", "u6")]
    feed = spark.createDataFrame(rows, "name string, ts int, seq int, op string, url string")
    found = {r.name: r.url for r in specs.current_specs(feed, ["name"], ["ts", "seq"]).collect()}
    assert found == {"a": "u2", "c": "u6"}


BASIC = auth_spec("basic", basic={"username_secret_ref": ref("s", "u"), "password_secret_ref": ref("s", "p")})
RESOLVE = [
    (None, None),
    (BASIC, None),
    (auth_spec("bearer", bearer={"token_secret_ref": ref("s", "u")}), None),
    (auth_spec("apiKey", api_key={"header_name": "X", "value_secret_ref": ref("s", "u")}), None),
    (auth_spec("basic"), "basic auth requires the basic block"),
    (auth_spec("bearer"), "bearer auth requires the bearer block"),
    (auth_spec("apiKey"), "apiKey auth requires the apiKey block"),
    (auth_spec("apiKey", api_key={"header_name": "", "value_secret_ref": ref("s", "u")}), "apiKey auth requires headerName"),
    (auth_spec("oauth"), 'unsupported auth type "oauth"'),
    (auth_spec(None), 'unsupported auth type ""'),
    (auth_spec("bearer", bearer={"token_secret_ref": ref("", "u")}), "resolving bearer token: secret name is required"),
    (auth_spec("bearer", bearer={"token_secret_ref": ref("s", None)}), "resolving bearer token: secret key is required"),
    (auth_spec("bearer", bearer={"token_secret_ref": ref("none", "u")}), 'resolving bearer token: secrets "none" not found'),
    (auth_spec("apiKey", api_key={"header_name": "X", "value_secret_ref": ref("s", "zz")}),
     'resolving apiKey value: secret default/s is missing key "zz"'),
    (auth_spec("basic", basic={"username_secret_ref": ref("s", "zz"), "password_secret_ref": ref("none", "p")}),
     'resolving basic username: secret default/s is missing key "zz"'),
    (auth_spec("basic", basic={"username_secret_ref": ref("s", "u"), "password_secret_ref": ref("none", "p")}),
     'resolving basic password: secrets "none" not found'),
]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_auth_resolution(spark, threshold):
    """Small secrets are broadcast; without broadcast the join gives the same."""
    rows = canaries(spark, *[canary(f"c{i}", auth=a) for i, (a, _) in enumerate(RESOLVE)])
    held = table(
        spark, schemas.SECRETS,
        {"namespace": "default", "name": "s", "data": {"u": "value-u", "p": "value-p"}},
        {"namespace": "other", "name": "none", "data": {"u": "x", "p": "x"}},
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = {r.name: r for r in auth.resolve_auth(rows, held).collect()}
        store = {r.credential_id: r.value for r in auth.credential_store(rows, held, with_values=True).collect()}
        without = auth.credential_store(rows, held).columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for i, (given, error) in enumerate(RESOLVE):
        row = found[f"c{i}"]
        assert row.config_error == (f"Invalid auth config: {error}" if error else None), i
        assert (row.auth is None) == (given is None or error is not None), i
    assert found["c1"].auth.username_credential_id == "default__c1__basic-username"
    assert found["c3"].auth.header_name == "X" and found["c3"].auth.value_credential_id == "default__c3__api-key"
    assert store == {
        "default__c1__basic-username": "value-u", "default__c1__basic-password": "value-p",
        "default__c2__bearer-token": "value-u", "default__c3__api-key": "value-u",
    }
    assert without == ["credential_id", "value_present"]


def test_runtime_auth_errors(spark):
    full = {n: None for n in schemas.PROBES["auth"].dataType.names}
    cases = [
        (None, None),
        ({"type": "bearer", "token_credential_id": "t"}, None),
        ({"type": "bearer", "token_credential_id": "gone"}, 'missing credential "gone"'),
        ({"type": "bearer"}, "missing credential reference"),
        ({"type": "basic", "username_credential_id": "t", "password_credential_id": ""}, "missing credential reference"),
        ({"type": "basic", "username_credential_id": "no", "password_credential_id": ""}, 'missing credential "no"'),
        ({"type": "apiKey", "value_credential_id": "no"}, "apiKey auth is missing headerName"),
        ({"type": "apiKey", "header_name": "X", "value_credential_id": "t"}, None),
        ({"type": "ntlm"}, 'unsupported auth type "ntlm"'),
    ]
    rows = probes(spark, *[probe(str(i), auth=a and {**full, **a}) for i, (a, _) in enumerate(cases)])
    held = table(spark, schemas.CREDENTIALS, {"credential_id": "t", "value": "x"})
    found = {r.name: r.error for r in auth.runtime_auth_errors(rows, held).collect()}
    assert found == {str(i): e for i, (_, e) in enumerate(cases) if e}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_lookup_equals_plain(spark, how):
    """Nearly all rows share one key, as a hot probe would."""
    facts = spark.range(5000).select("id", F.when(F.col("id") % 10 < 8, F.lit(1)).otherwise(F.col("id") % 7).alias("k"))
    side = spark.createDataFrame([(i, f"v{i}") for i in range(4)], "k long, v string")
    plain = lookup_join(facts, side, ["k"], ["id"], how, salted=False)
    salted = lookup_join(facts, side, ["k"], ["id"], how, salted=True)
    assert same(plain, salted)


def test_salted_lookup_spreads_the_hot_key(spark):
    facts = spark.range(20_000).withColumn("k", F.lit(1))
    side = spark.createDataFrame([(1, "v")], "k long, v string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(facts, side, ["k"], ["id"], salted=True)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert sum(sizes) == 20_000 and len(sizes) > 1 and max(sizes) < 15_000


BUILDS = ["check_results", "runtime_auth_errors", "credential_store", "request_plan", "status_history", "metric_exposition"]


def test_building_and_explaining_starts_no_job(spark):
    from probelens.plans.queries import REGISTRY

    spark.sparkContext.setJobGroup("building", "building")
    try:
        for name in BUILDS:
            REGISTRY[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        started = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Reading the schema of a parquet file is a job of Spark's own; it has one task and no stage of ours.
    assert all(len(spark.sparkContext.statusTracker().getJobInfo(j).stageIds) == 1 for j in started)
    files = spark.conf.get("spark.checkpoint.dir")
    assert not any(p.startswith("lookup") for p in os.listdir(files))


def test_secrets_never_reach_probes(spark):
    sf = "/root/testdata/sf0.001"
    rows = auth.probes_with_auth(specs.spec_defaults(fx.canaries(spark, sf)), fx.secrets(spark, sf))
    assert rows.select(F.to_json(F.struct("*")).alias("j")).where(F.col("j").rlike("v-[0-9]+-(token|key|password)")).isEmpty()
