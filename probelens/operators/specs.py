"""Declarations: defaults, validation, flattening to probes, and plans derived from probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelens.functions import jsonrpc, routing
from probelens.functions.text import canonical_header, is_blank, json_line, text_or_empty

# Defaults and limits of a declaration.
DEFAULT_METHOD = "GET"
DEFAULT_INTERVAL = 30
DEFAULT_STATUS = 200
DEFAULT_PROTOCOL_VERSION = "2025-11-25"
DEFAULT_CLIENT_VERSION = "0.1.0"
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD"]
OUTPUT_TYPES = ["prometheus", "stdout"]
AUTH_TYPES = ["basic", "bearer", "apiKey"]
MIN_INTERVAL = 5
STATUS_RANGE = (100, 599)
# Headers a tool-listing request carries unless the probe sets its own.
MCP_HEADERS = {"Content-Type": "application/json", "Accept": "application/json, text/event-stream"}

CLIENT_NAME = "probelens"
CHUNK = 4096


def probe_key(namespace: Column, name: Column) -> Column:
    return F.concat(namespace, F.lit("/"), name)


def _default(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def spec_defaults(canaries: DataFrame, client_name: str = CLIENT_NAME) -> DataFrame:
    """Fill absent fields. Fields of the `mcp` and `journey` blocks are filled only where the block is."""
    spec = F.col("spec")
    journey = F.transform(
        spec["journey"],
        lambda s: s.withField("method", _default(s["method"], DEFAULT_METHOD)).withField(
            "expected_status", _default(s["expected_status"], DEFAULT_STATUS)
        ),
    )
    mcp = spec["mcp"]
    filled_mcp = F.when(
        mcp.isNotNull(),
        mcp.withField("protocol_version", _default(mcp["protocol_version"], DEFAULT_PROTOCOL_VERSION))
        .withField("client_name", _default(mcp["client_name"], client_name))
        .withField("client_version", _default(mcp["client_version"], DEFAULT_CLIENT_VERSION))
        .withField("require_tools_capability", _default(mcp["require_tools_capability"], True)),
    )
    return canaries.withColumn(
        "spec",
        spec.withField("method", _default(spec["method"], DEFAULT_METHOD))
        .withField("interval", _default(spec["interval"], DEFAULT_INTERVAL))
        .withField("expected_status", _default(spec["expected_status"], DEFAULT_STATUS))
        .withField("journey", journey)
        .withField("mcp", filled_mcp),
    )


def _ref_rules(block: Column, fields: dict[str, str]) -> list[tuple[Column, str]]:
    """A present block needs each secret reference, and each reference a key."""
    rules = []
    for field, label in fields.items():
        ref = block[field]
        rules.append((block.isNotNull() & ref.isNull(), f"{label} required"))
        rules.append((ref.isNotNull() & ref["key"].isNull(), f"{label}.key required"))
    return rules


def _rules() -> list[tuple[Column, str]]:
    spec = F.col("spec")
    auth, mcp = spec["auth"], spec["mcp"]
    low, high = STATUS_RANGE

    def any_step(test) -> Column:
        return F.coalesce(F.exists(spec["journey"], lambda s: F.coalesce(test(s), F.lit(False))), F.lit(False))

    def any_output(test) -> Column:
        return F.coalesce(F.exists(spec["outputs"], lambda o: F.coalesce(test(o), F.lit(False))), F.lit(False))

    return [
        (spec["url"].isNull(), "url required"),
        (spec["url"] == "", "url empty"),
        (~spec["method"].isin(METHODS), "method unknown"),
        (spec["interval"] < MIN_INTERVAL, "interval below minimum"),
        (~spec["expected_status"].between(low, high), "expected_status out of range"),
        (any_step(lambda s: s["name"].isNull()), "journey.name required"),
        (any_step(lambda s: s["name"] == ""), "journey.name empty"),
        (any_step(lambda s: s["url"].isNull()), "journey.url required"),
        (any_step(lambda s: s["url"] == ""), "journey.url empty"),
        (any_step(lambda s: ~s["method"].isin(METHODS)), "journey.method unknown"),
        (any_step(lambda s: ~s["expected_status"].between(low, high)), "journey.expected_status out of range"),
        (mcp["min_tool_count"] < 0, "mcp.min_tool_count below minimum"),
        (any_output(lambda o: o["type"].isNull()), "outputs.type required"),
        (any_output(lambda o: ~o["type"].isin(OUTPUT_TYPES)), "outputs.type unknown"),
        (auth.isNotNull() & auth["type"].isNull(), "auth.type required"),
        (~auth["type"].isin(AUTH_TYPES), "auth.type unknown"),
        *_ref_rules(
            auth["basic"],
            {"username_secret_ref": "auth.basic.username", "password_secret_ref": "auth.basic.password"},
        ),
        *_ref_rules(auth["bearer"], {"token_secret_ref": "auth.bearer.token"}),
        (auth["api_key"].isNotNull() & auth["api_key"]["header_name"].isNull(), "auth.api_key.header_name required"),
        (auth["api_key"]["header_name"] == "", "auth.api_key.header_name empty"),
        *_ref_rules(auth["api_key"], {"value_secret_ref": "auth.api_key.value"}),
    ]


def spec_violations(canaries: DataFrame) -> DataFrame:
    """Add `violations`: every broken rule of the (defaulted) spec, in rule order; empty when valid."""
    broken = F.array(*[F.when(test, F.lit(code)) for test, code in _rules()])
    return canaries.withColumn("violations", F.filter(broken, lambda c: c.isNotNull()))


def valid_canaries(canaries: DataFrame) -> DataFrame:
    return spec_violations(canaries).where(F.size("violations") == 0).drop("violations")


def rejected_canaries(canaries: DataFrame) -> DataFrame:
    return spec_violations(canaries).where(F.size("violations") > 0)


def probe_set(canaries: DataFrame) -> DataFrame:
    """One flat probe per declaration, keyed `namespace/name`; `auth` and `config_error` if resolved before."""
    spec = F.col("spec")
    resolved = [c for c in ("auth", "config_error") if c in canaries.columns]
    return canaries.select(
        probe_key(F.col("namespace"), F.col("name")).alias("name"),
        spec["url"].alias("url"),
        spec["method"].alias("method"),
        spec["headers"].alias("headers"),
        spec["body"].alias("body"),
        spec["interval"].alias("interval"),
        spec["expected_status"].alias("expected_status"),
        spec["contains_text"].alias("contains_text"),
        spec["mcp"].alias("mcp"),
        spec["journey"].alias("journey"),
        F.when(F.size(spec["outputs"]) > 0, spec["outputs"]).alias("outputs"),
        *resolved,
    )


def journey_steps(probes: DataFrame) -> DataFrame:
    """One row per journey step; `position` counts from 1."""
    steps = probes.select(F.col("name").alias("probe"), F.posexplode("journey").alias("pos", "step"))
    return steps.select("probe", (F.col("pos") + 1).alias("position"), F.col("step.*"))


def probe_mode(probes: DataFrame) -> DataFrame:
    """Add `mode`: config_error, mcp, journey or single, in this order of precedence."""
    return probes.withColumn("mode", mode_of(F.col("config_error"), F.col("mcp"), F.col("journey")))


def mode_of(config_error: Column, mcp: Column, journey: Column) -> Column:
    return (
        F.when(~is_blank(config_error), F.lit("config_error"))
        .when(mcp.isNotNull(), F.lit("mcp"))
        .when(F.size(journey) > 0, F.lit("journey"))
        .otherwise(F.lit("single"))
    )


def output_routing(probes: DataFrame) -> DataFrame:
    """Add `to_metrics` and `to_lines`."""
    return probes.withColumns(
        {"to_metrics": routing.to_metrics(F.col("outputs")), "to_lines": routing.to_lines(F.col("outputs"))}
    )


def _method(method: Column) -> Column:
    return F.when(is_blank(method), F.lit(DEFAULT_METHOD)).otherwise(F.upper(method))


def _without(headers: Column, names: list[Column]) -> Column:
    lowered = F.array(*[F.lower(n) for n in names])
    return F.map_filter(headers, lambda k, _: ~F.array_contains(lowered, F.lower(k)))


def _mcp_headers(headers: Column) -> Column:
    merged = headers
    for name, value in MCP_HEADERS.items():
        has = F.exists(F.map_keys(headers), lambda k: F.lower(k) == name.lower())
        merged = F.when(has, merged).otherwise(F.map_concat(merged, F.create_map(F.lit(name), F.lit(value))))
    return merged


def request_plan(
    probes: DataFrame,
    initialize_id: str = f"{CLIENT_NAME}-initialize",
    tools_id: str = f"{CLIENT_NAME}-tools-list",
) -> DataFrame:
    """The requests one check sends, in order: 1, one per journey step, or 3 for a tool-listing probe.

    A probe with a config error sends none. Credentials appear as ids only: `auth_header` names the
    header the credential goes into, and a plain header of that name is left out as it would be overwritten.
    """
    no_headers = F.create_map().cast("map<string,string>")

    def request(seq: Column, stage: Column, method: Column, url: Column, headers: Column, body: Column) -> Column:
        return F.struct(
            seq.cast("int").alias("seq"),
            stage.alias("stage"),
            method.alias("method"),
            url.alias("url"),
            F.coalesce(headers, no_headers).alias("headers"),
            text_or_empty(body).alias("body"),
        )

    def rpc_body(method: str, rpc_id: str | None, params: Column | None) -> Column:
        fields = [F.lit("2.0").alias("jsonrpc")]
        if rpc_id is not None:
            fields.append(F.lit(rpc_id).alias("id"))
        fields.append(F.lit(method).alias("method"))
        if params is not None:
            fields.append(params.alias("params"))
        return json_line(F.struct(*fields))

    mcp = F.col("mcp")
    params = F.struct(
        text_or_empty(mcp["protocol_version"]).alias("protocolVersion"),
        no_headers.alias("capabilities"),
        F.struct(
            text_or_empty(mcp["client_name"]).alias("name"), text_or_empty(mcp["client_version"]).alias("version")
        ).alias("clientInfo"),
    )
    bodies = [
        rpc_body(jsonrpc.INITIALIZE, initialize_id, params),
        rpc_body(jsonrpc.NOTIFICATION, None, None),
        rpc_body(jsonrpc.TOOLS, tools_id, None),
    ]
    mcp_headers = _mcp_headers(F.coalesce(F.col("headers"), no_headers))
    rpc_requests = F.array(
        *[
            request(F.lit(i), F.lit(stage), F.lit("POST"), F.col("url"), mcp_headers, body)
            for i, (stage, body) in enumerate(zip(jsonrpc.STAGES, bodies))
        ]
    )
    step_requests = F.transform(
        F.col("journey"),
        lambda s, i: request(i, s["name"], _method(s["method"]), s["url"], s["headers"], s["body"]),
    )
    one_request = F.array(
        request(F.lit(0), F.lit("request"), _method(F.col("method")), F.col("url"), F.col("headers"), F.col("body"))
    )
    mode = F.col("mode")
    requests = (
        F.when(mode == "mcp", rpc_requests).when(mode == "journey", step_requests).when(mode == "single", one_request)
    )
    auth = F.col("auth")
    kind = auth["type"]
    auth_header = F.when(kind.isin("basic", "bearer"), F.lit("Authorization")).when(
        kind == "apiKey", canonical_header(auth["header_name"])
    )
    ids = F.filter(
        F.array(
            auth["username_credential_id"],
            auth["password_credential_id"],
            auth["token_credential_id"],
            auth["value_credential_id"],
        ),
        lambda c: ~is_blank(c),
    )
    planned = probe_mode(probes).select(
        F.col("name").alias("probe"),
        auth_header.alias("auth_header"),
        F.when(auth.isNotNull(), kind).alias("auth_type"),
        F.when(auth.isNotNull(), ids).alias("credential_ids"),
        F.explode(requests).alias("r"),
    )
    canonical = F.transform_keys(F.col("r.headers"), lambda k, _: canonical_header(k))
    headers = F.when(F.col("auth_header").isNull(), canonical).otherwise(
        _without(canonical, [text_or_empty(F.col("auth_header"))])
    )
    return planned.select(
        "probe",
        "r.seq",
        "r.stage",
        "r.method",
        "r.url",
        headers.alias("headers"),
        "r.body",
        "auth_type",
        "auth_header",
        "credential_ids",
    )


def planned_checks(probes: DataFrame, start: Column, end: Column) -> DataFrame:
    """Planned check times in [start, end): one at once, then one per interval.

    This is the ideal grid; a slow check may in practice skip ticks. An interval below one second has no
    grid and raises. Long ranges are exploded in two steps, so no single array holds all times of a probe,
    and the steps between are spread over all tasks: a small probe table makes a very large grid.
    """
    interval = F.col("interval").cast("long")
    checked = F.when(interval >= 1, interval).otherwise(
        F.raise_error(F.concat(F.lit("interval below 1 second: "), F.col("name"))).cast("long")
    )
    begin_us, end_us = F.unix_micros(start), F.unix_micros(end)
    steps = F.ceil((end_us - begin_us) / (checked * 1_000_000)).cast("long")
    per_probe = probes.select("name", checked.alias("_every"), begin_us.alias("_begin"), steps.alias("_n"))
    last = F.col("_n") - 1
    chunks = per_probe.where("_n > 0").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / CHUNK).cast("long")))
    )
    first = F.col("_chunk") * CHUNK
    tasks = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunks.repartition(tasks, "name", "_chunk")
    ticks = spread.withColumn("_tick", F.explode(F.sequence(first, F.least(last, first + CHUNK - 1))))
    at = F.timestamp_micros(F.col("_begin") + F.col("_tick") * F.col("_every") * 1_000_000)
    return ticks.select("name", (F.col("_tick") + 1).alias("check_number"), at.alias("planned_at"))


def current_specs(feed: DataFrame, key: list[str], order: list[str], op: str = "op") -> DataFrame:
    """From create/update/delete events, the last event of each key, without deleted keys.

    An event without a kind is taken as an update. `max_by` is combined before the shuffle, so a key with many events sends one row per map task.
    """
    rest = [c for c in feed.columns if c not in key]
    last = feed.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.where(~F.col("_last")[op].eqNullSafe("delete")).select(*key, *[F.col("_last")[c].alias(c) for c in rest])
