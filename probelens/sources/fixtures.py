"""The canonical tables, derived from the driver's test tables (definitions in FIXTURES.md).

Every fixture is a projection of one table, or a distinct of keys; none groups rows into arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens import schemas

EPOCH_2024 = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _typed(df: DataFrame, schema) -> DataFrame:
    """Columns of the schema in its order; absent ones are null."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def _utc(column: str) -> Column:
    return F.col(column).cast("timestamp")


def _outputs(number: Column) -> Column:
    """Routing by a number modulo 4: absent, metrics, lines, both."""
    metrics, lines = F.struct(F.lit("prometheus").alias("type")), F.struct(F.lit("stdout").alias("type"))
    pick = F.pmod(number, F.lit(4))
    return F.when(pick == 1, F.array(metrics)).when(pick == 2, F.array(lines)).when(pick == 3, F.array(metrics, lines))


def canaries(spark: SparkSession, sf_dir: str, namespace: str | None = None) -> DataFrame:
    """FX1: one declaration per customer, with gaps, violations and all kinds of auth."""
    k = F.col("c_custkey")
    secret = F.concat(F.lit("secret-"), F.col("c_nationkey"))
    url = F.concat(F.lit("https://svc-"), F.col("c_nationkey"), F.lit(".example.test/health"))

    def ref(key: str) -> Column:
        return F.struct(secret.alias("name"), F.lit(key).alias("key"))

    kind = F.pmod(k, F.lit(5))
    auth_type = F.when(kind == 1, "basic").when(kind == 2, "bearer").when(kind == 3, "apiKey").when(kind == 4, "digest")
    auth = F.when(
        kind > 0,
        F.struct(
            auth_type.alias("type"),
            F.when(
                kind == 1,
                F.struct(ref("username").alias("username_secret_ref"), ref("password").alias("password_secret_ref")),
            ).alias("basic"),
            F.when(kind == 2, F.struct(ref("token").alias("token_secret_ref"))).alias("bearer"),
            F.when(
                kind == 3, F.struct(F.lit("x-api-key").alias("header_name"), ref("key").alias("value_secret_ref"))
            ).alias("api_key"),
        ),
    )

    def step(name: str, method: Column, expected: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.concat(url, F.lit("/"), F.lit(name)).alias("url"),
            method.alias("method"),
            F.lit(None).cast("map<string,string>").alias("headers"),
            F.lit(None).cast("string").alias("body"),
            expected.alias("expected_status"),
            F.lit(None).cast("string").alias("contains_text"),
        )

    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("int")
    journey = F.when(
        F.pmod(k, F.lit(13)) == 0, F.array(step("open", no_text, no_number), step("submit", F.lit("post"), F.lit(201)))
    )
    mcp = F.when(
        F.pmod(k, F.lit(11)) == 0,
        F.struct(
            no_text.alias("protocol_version"),
            no_text.alias("client_name"),
            no_text.alias("client_version"),
            F.lit(None).cast("boolean").alias("require_tools_capability"),
            (F.pmod(k, F.lit(3)) - 1).cast("int").alias("min_tool_count"),
            F.array(F.lit("red widget")).alias("required_tools"),
        ),
    )
    method = F.pmod(k, F.lit(4))
    spec = F.struct(
        url.alias("url"),
        F.when(method == 1, "GET").when(method == 2, "POST").when(method == 3, "HEAD").alias("method"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.create_map(F.lit("x-probe-id"), k.cast("string"))).alias("headers"),
        auth.alias("auth"),
        F.when(method == 2, F.concat(F.lit('{"k":'), k, F.lit("}"))).alias("body"),
        F.when(F.pmod(k, F.lit(7)) > 0, (3 + F.pmod(k, F.lit(40))).cast("int")).alias("interval"),
        F.when(F.pmod(k, F.lit(6)) == 5, F.lit(700)).when(F.pmod(k, F.lit(6)) > 0, F.lit(200)).alias("expected_status"),
        no_text.alias("contains_text"),
        mcp.alias("mcp"),
        journey.alias("journey"),
        _outputs(F.floor(k / 4)).alias("outputs"),
    )
    rows = table(spark, sf_dir, "customer").select(
        (F.lit(namespace) if namespace else F.lower("c_mktsegment")).alias("namespace"),
        F.concat(F.lit("canary-"), k).alias("name"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + k * 60).alias("created_at"),
        # A generator, so that the struct is built once per row and not inlined into every rule that reads it.
        F.explode(F.array(spec)).alias("spec"),
    )
    return _typed(rows, schemas.CANARIES)


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: a secret per namespace and nation in use; none in region 4, keys missing in region 3."""
    used = table(spark, sf_dir, "customer").select(
        F.lower("c_mktsegment").alias("namespace"), F.col("c_nationkey").alias("n_nationkey")
    )
    nations = table(spark, sf_dir, "nation").where("n_regionkey <> 4").select("n_nationkey", "n_regionkey")
    present = F.when(
        F.col("n_regionkey") == 3, F.array(F.lit("username"), F.lit("key"))
    ).otherwise(F.array(*[F.lit(x) for x in ("username", "password", "token", "key")]))
    data = F.map_from_arrays(
        present, F.transform(present, lambda x: F.concat(F.lit("v-"), F.col("n_nationkey"), F.lit("-"), x))
    )
    return (
        used.distinct()
        .join(nations, "n_nationkey")
        .select("namespace", F.concat(F.lit("secret-"), "n_nationkey").alias("name"), data.alias("data"))
    )


def _response(seq: Column, stage: Column, status: Column, body: Column, error: Column) -> Column:
    return F.struct(
        seq.cast("int").alias("seq"),
        stage.cast("string").alias("stage"),
        F.when(error.isNull(), status).cast("int").alias("status_code"),
        F.when(error.isNull(), body).alias("body"),
        F.when(error.isNotNull(), F.lit("transport")).alias("error_kind"),
        error.cast("string").alias("error"),
    )


def _user_probe() -> Column:
    return F.concat(F.lit("default/user-"), F.col("user_id"))


def event_cycle_rows(events: DataFrame) -> DataFrame:
    """FX3: one single-request check per event. Takes a table or a stream."""
    kind = F.col("event_type")
    status = F.when(kind == "error", 503).when(kind == "purchase", 201).otherwise(200)
    error = F.when((kind == "signup") & (F.pmod("user_id", F.lit(7)) == 0), F.lit("connection refused"))
    duration = F.round(F.col("value") * 10000).cast("bigint")
    end = _utc("ts")
    response = _response(F.lit(0), F.lit("request"), status, F.col("props"), error)
    rows = events.select(
        F.col("event_id").cast("string").alias("cycle_id"),
        _user_probe().alias("probe"),
        F.timestamp_micros(F.unix_micros(end) - duration).alias("started_at"),
        end.alias("finished_at"),
        duration.alias("duration_us"),
        F.array(response).alias("responses"),
    )
    return _typed(rows, schemas.CHECK_CYCLES)


def event_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cycle_rows(table(spark, sf_dir, "events"))


def event_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3: the probe of every user."""
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").select("user_id").distinct().select(
        _user_probe().alias("name"),
        F.concat(F.lit("https://app.example.test/u/"), u).alias("url"),
        F.lit(30).alias("interval"),
        F.when(F.pmod(u, F.lit(5)) == 0, 201).otherwise(200).alias("expected_status"),
        F.when(F.pmod(u, F.lit(3)) == 0, F.lit('"k": 6')).alias("contains_text"),
        _outputs(u).alias("outputs"),
    )
    return _typed(rows, schemas.PROBES)


def _conversation_probe() -> Column:
    return F.concat(F.lit("default/conv-"), F.pmod("conv_id", F.lit(10)))


def conversation_exchange_rows(turns: DataFrame) -> DataFrame:
    """FX4: one response per turn of a conversation. Takes a table or a stream."""
    at = F.lit(EPOCH_2024) + F.col("conv_id") * 60
    started = at + F.col("turn")
    rows = turns.select(
        F.col("conv_id").cast("string").alias("cycle_id"),
        _conversation_probe().alias("probe"),
        F.timestamp_seconds(at).alias("cycle_started_at"),
        F.col("turn").cast("int").alias("seq"),
        F.col("role").alias("stage"),
        F.timestamp_seconds(started).alias("started_at"),
        F.timestamp_seconds(started + 1).alias("finished_at"),
        F.when(F.length("text") % 7 == 0, 500).otherwise(200).alias("status_code"),
        F.col("text").alias("body"),
    )
    return _typed(rows, schemas.EXCHANGES)


def conversation_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_exchange_rows(table(spark, sf_dir, "conversations"))


def conversation_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: ten declared journeys of 2 to 5 steps; odd steps look for a text."""
    k = F.col("k")
    steps = F.transform(
        F.sequence(F.lit(0), (1 + F.pmod(k, F.lit(4))).cast("int")),
        lambda i: F.struct(
            F.concat(F.lit("turn-"), i).alias("name"),
            F.concat(F.lit("https://chat.example.test/"), i).alias("url"),
            F.lit("GET").alias("method"),
            F.lit(None).cast("map<string,string>").alias("headers"),
            F.lit(None).cast("string").alias("body"),
            F.lit(200).alias("expected_status"),
            F.when(i % 2 == 1, F.lit("th")).alias("contains_text"),
        ),
    )
    numbers = table(spark, sf_dir, "conversations").select(F.pmod("conv_id", F.lit(10)).alias("k")).distinct()
    rows = numbers.select(
        F.concat(F.lit("default/conv-"), k).alias("name"),
        F.lit("https://chat.example.test/").alias("url"),
        F.lit(60).alias("interval"),
        F.lit(204).alias("expected_status"),
        steps.alias("journey"),
    )
    return _typed(rows, schemas.PROBES)


def _brand_number() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")


def _brand_probe() -> Column:
    return F.concat(F.lit("tools/brand-"), _brand_number())


def part_tools() -> Column:
    """FX5: tool names a server lists for one part: its name, its type, the name again for even sizes."""
    size = F.col("p_size")
    tools = F.array(F.col("p_name"), F.lower("p_type"))
    return (
        F.when(size % 10 == 0, F.array().cast("array<string>"))
        .when(size % 2 == 0, F.concat(tools, F.array("p_name")))
        .otherwise(tools)
    )


def _part_responses() -> Column:
    case = F.pmod("p_partkey", F.lit(11))
    initialize = (
        F.when(case == 2, F.lit("service unavailable"))
        .when(case == 3, F.lit('{"jsonrpc":"2.0","id":1,"error":{"code":-32601,"message":"no such method"}}'))
        .when(case == 4, F.lit('{"jsonrpc":"2.0","id":1}'))
        .when(case == 5, F.lit('{"result":{"capabilities":{"tools":{}}}}'))
        .when(case == 6, F.lit('{"result":{"protocolVersion":"2025-11-25","capabilities":{}}}'))
        .when(case == 8, F.lit('{"result":null}'))
        .otherwise(F.lit('{"result":{"protocolVersion":"2025-11-25","capabilities":{"tools":null}}}'))
    )
    listed = F.struct(
        F.lit("2.0").alias("jsonrpc"),
        F.struct(F.transform(part_tools(), lambda t: F.struct(t.alias("name"))).alias("tools")).alias("result"),
    )
    # Some servers answer with an event stream, which is no JSON document.
    stream = F.concat(F.lit("data: "), F.to_json(listed))
    listing = F.when(F.col("p_size") % 17 == 0, stream).otherwise(F.to_json(listed))
    no_error = F.lit(None).cast("string")
    return F.array(
        _response(
            F.lit(0),
            F.lit("initialize"),
            F.when(case == 0, 503).otherwise(200),
            initialize,
            F.when(case == 1, F.lit("connection refused")),
        ),
        _response(
            F.lit(1), F.lit("notifications/initialized"), F.when(case == 7, 500).otherwise(202), F.lit(""), no_error
        ),
        _response(F.lit(2), F.lit("tools/list"), F.lit(200), listing, no_error),
    )


def part_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5: one tool-listing check per part."""
    start = F.lit(EPOCH_2024) + F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("cycle_id"),
        _brand_probe().alias("probe"),
        F.timestamp_seconds(start).alias("started_at"),
        F.timestamp_seconds(start + 1).alias("finished_at"),
        F.lit(1_000_000).alias("duration_us"),
        _part_responses().alias("responses"),
    )
    return _typed(rows, schemas.CHECK_CYCLES)


def part_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5 as one row per response."""
    return exchanges_of(part_cycles(spark, sf_dir))


def part_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5: one server per brand; minimum, capability rule and required tools vary by brand number."""
    b = F.col("b")
    required = (
        F.when(b % 3 == 1, F.array(F.lit("economy")))
        .when(b % 3 == 2, F.array(F.lit("zzz"), F.lit("economy"), F.lit("small ring"), F.lit("economy")))
        .otherwise(F.array().cast("array<string>"))
    )
    mcp = F.struct(
        F.lit("2025-11-25").alias("protocol_version"),
        F.lit("probelens").alias("client_name"),
        F.lit("0.1.0").alias("client_version"),
        (b % 2 == 0).alias("require_tools_capability"),
        (b % 4).cast("int").alias("min_tool_count"),
        required.alias("required_tools"),
    )
    rows = table(spark, sf_dir, "part").select(_brand_number().alias("b")).distinct().select(
        F.concat(F.lit("tools/brand-"), b).alias("name"),
        F.concat(F.lit("https://tools.example.test/"), b).alias("url"),
        F.lit(30).alias("interval"),
        F.lit(0).alias("expected_status"),
        mcp.alias("mcp"),
        _outputs(b).alias("outputs"),
    )
    return _typed(rows, schemas.PROBES)


def exchanges_of(cycles: DataFrame) -> DataFrame:
    """The log form of cycles: one row per response, bodies kept whole."""
    rows = cycles.select(
        "cycle_id", "probe", F.col("started_at").alias("cycle_started_at"), "started_at", "finished_at", F.inline("responses")
    )
    return _typed(rows, schemas.EXCHANGES)


def canary_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1: the first check of every declaration, one millisecond long, without responses."""
    key = F.col("c_custkey")
    start = F.lit(EPOCH_2024) + key * 60
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("first-"), key).alias("cycle_id"),
        F.concat(F.lower("c_mktsegment"), F.lit("/canary-"), key).alias("probe"),
        F.timestamp_seconds(start).alias("started_at"),
        F.timestamp_micros(start * 1_000_000 + 1000).alias("finished_at"),
        F.lit(1000).alias("duration_us"),
    )
    return _typed(rows, schemas.CHECK_CYCLES)


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6: one result per order for the declaration of its customer."""
    s = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("default/canary-"), "o_custkey").alias("name"),
        (s == "F").alias("healthy"),
        F.when(s == "F", 200).when(s == "O", 503).otherwise(0).alias("status_code"),
        _utc("o_orderdate").alias("last_check_time"),
        F.when(s == "F", "Got expected status 200")
        .when(s == "O", "Expected 200 but got 503")
        .otherwise("http request failed: connection refused")
        .alias("message"),
        F.lit("https://shop.example.test/").alias("url"),
        F.lit(200).alias("expected_status"),
        F.col("o_orderkey").alias("cycle_id"),
    )
    return rows


def customer_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6: the current status of every declaration, by account balance."""
    b = F.col("c_acctbal")
    synced = b >= 0
    low = b < 5000
    rows = table(spark, sf_dir, "customer").select(
        F.lit("default").alias("namespace"),
        F.concat(F.lit("canary-"), "c_custkey").alias("name"),
        F.when(synced, F.when(low, "Unhealthy").otherwise("Healthy")).alias("phase"),
        F.when(synced, F.timestamp_seconds(F.lit(EPOCH_2024))).alias("last_check_time"),
        F.when(synced, F.when(low, 503).otherwise(200)).alias("last_status"),
        F.when(synced, F.when(low, "Expected 200 but got 503").otherwise("Got expected status 200")).alias("message"),
    )
    return _typed(rows, schemas.STATUSES)


def spec_feed_rows(orders: DataFrame) -> DataFrame:
    """FX7: one create, update or delete event per order."""
    return orders.select(
        F.concat(F.lit("canary-"), "o_custkey").alias("name"),
        _utc("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority") == "5-LOW", "delete").otherwise("upsert").alias("op"),
        F.concat(F.lit("https://shop.example.test/"), "o_orderkey").alias("url"),
    )


def spec_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec_feed_rows(table(spark, sf_dir, "orders"))


def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX8: every page as a recorded response `r`."""
    r = _response(F.lit(0), F.lit("request"), F.lit(200), F.col("html"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", "url", r.alias("r"))


def declaration_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX9: changes of FX1 and FX2 in three steps (column `step`).

    0: everything is created. 1: declarations are updated (k % 5 = 1) or, later, deleted (k % 7 = 2); secrets are deleted (n % 4 = 1) or lose
    their key `key` (n % 4 = 2); updates older than the creation arrive (k % 9 = 0). 2: some are created again (k % 14 = 2, n % 8 = 1), and
    events of step 0 arrive once more (k % 3 = 0).
    """
    no_spec, no_data = (F.lit(None).cast(schemas.DECLARATION_EVENTS[c].dataType) for c in ("spec", "data"))
    k = F.substring_index("name", "-", -1).cast("long")

    def event(rows: DataFrame, kind: str, op: str, step: int, seconds: int, spec: Column, data: Column, where: Column | None = None, after: int = 0) -> DataFrame:
        chosen = rows if where is None else rows.where(where)
        created = F.col("created_at") if "created_at" in rows.columns else F.lit(None).cast("timestamp")
        return chosen.select(
            F.lit(kind).alias("kind"), "namespace", "name", F.lit(op).alias("op"), F.timestamp_seconds(F.lit(EPOCH_2024 + seconds)).alias("at"),
            (k + after).alias("seq"), created.alias("created_at"), spec.alias("spec"), data.alias("data"), F.lit(step).alias("step"),
        )

    def moved(label: str) -> Column:
        return F.col("spec").withField("url", F.concat(F.lit(f"https://{label}-"), k, F.lit(".example.test/")))

    c, s = canaries(spark, sf_dir), secrets(spark, sf_dir)
    spec, data = F.col("spec"), F.col("data")
    parts = [
        event(c, "canary", "create", 0, 0, spec, no_data),
        event(s, "secret", "create", 0, 0, no_spec, data),
        event(c, "canary", "update", 1, 60, moved("new"), no_data, k % 5 == 1),
        event(c, "canary", "delete", 1, 60, no_spec, no_data, k % 7 == 2, after=1_000_000_000),
        event(c, "canary", "update", 1, -60, moved("old"), no_data, k % 9 == 0),
        event(s, "secret", "delete", 1, 60, no_spec, no_data, k % 4 == 1),
        event(s, "secret", "update", 1, 60, no_spec, F.map_filter("data", lambda key, value: key != "key"), k % 4 == 2),
        event(c, "canary", "create", 2, 120, moved("again"), no_data, k % 14 == 2),
        event(s, "secret", "create", 2, 120, no_spec, data, k % 8 == 1),
        event(c, "canary", "create", 2, 0, spec, no_data, k % 3 == 0),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.DECLARATION_EVENTS], "step")
