"""From recorded responses to check results.

Two inputs, same verdicts:

* `check_cycles` - one row per check with its responses as an array. Evaluation is a projection over a
  probe lookup; nothing is grouped.
* `exchanges` - one row per response. Each row is judged where it lies, its body is dropped, and only
  the small verdicts are grouped per check. This is the way for large logs: bodies never shuffle, and a
  check with very many rows is combined before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelens.functions import jsonrpc, routing
from probelens.functions.verdict import outcome, request_verdict
from probelens.operators.joins import SALT, lookup_join
from probelens.operators.specs import mode_of
from probelens.schemas import CHECK_CYCLES, PROBES

RESULT_COLUMNS = [
    "name",
    "healthy",
    "status_code",
    "last_check_time",
    "message",
    "url",
    "expected_status",
    "cycle_id",
    "duration_us",
    "mode",
    "to_metrics",
    "to_lines",
]
_PROBE_COLUMNS = ["url", "expected_status", "contains_text", "mcp", "journey", "outputs", "config_error"]
_RESPONSE_FIELDS = ["seq", "stage", "status_code", "body", "error_kind", "error"]
# Of copies of a response the first in this order counts, in every form.
ARRIVAL = ["started_at", "finished_at", "status_code", "error_kind", "error", "body_hash"]
VERDICT_ARRIVAL = ["started_at", "finished_at", "tie"]


def _response(position: str | int) -> str:
    """The response to a check's request at a position; null if it is not there."""
    return f"get(filter(responses, x -> x.seq = {position}), 0)"


# Responses of a tool-listing check by stage, in the array form.
_CALLS = [_response(i) for i in range(len(jsonrpc.STAGES))]


@dataclass(frozen=True)
class Mode:
    """How one kind of probe is judged; every field is SQL text (see `functions.verdict`).

    `cycle` judges the array form from `p` (the probe) and `responses`; `row` judges one exchange `r`;
    `last` is the position of the request that completes the check, -1 for a check that sends none. A request
    counts only if all before it were answered: a lost response leaves the check without a verdict. `before_cycle` and `before_row` name
    columns these read more than once, in steps: they are computed ahead, and only for this mode.
    """

    cycle: str
    row: str
    last: str
    before_cycle: tuple[dict[str, str], ...] = ()
    before_row: tuple[dict[str, str], ...] = ()


_CONFIG_ERROR = outcome(False, "0", "p.config_error", "coalesce(p.expected_status, 0)")


def _single(response: str) -> str:
    return request_verdict(response, "p.expected_status", "p.contains_text")


def _step(step: str, index: str, response: str) -> str:
    prefix = f"'Step ' || ({index} + 1) || ' (' || coalesce({step}.name, '') || ') failed: '"
    return request_verdict(response, f"{step}.expected_status", f"{step}.contains_text", prefix)


_JOURNEY_TEXT = "'Synthetic journey succeeded (' || size(p.journey) || ' steps)'"
_JOURNEY_OK = outcome(True, "element_at(_steps, -1).status_code", _JOURNEY_TEXT, "coalesce(p.expected_status, 0)")
_STEPS = f"transform(p.journey, (s, i) -> {_step('s', 'i', 'get(filter(responses, x -> x.seq = i), 0)')})"

# A new kind of probe is one more entry here and one more branch in `mode_of`.
MODES: dict[str, Mode] = {
    "config_error": Mode(cycle=_CONFIG_ERROR, row=_CONFIG_ERROR, last="-1"),
    "mcp": Mode(
        cycle=f"""coalesce({jsonrpc.initialize_failure(_CALLS[0], "_doc0", "p.mcp")},
            CASE WHEN {_CALLS[0]} IS NOT NULL THEN {jsonrpc.notification_failure(_CALLS[1])} END,
            CASE WHEN {_CALLS[0]} IS NOT NULL AND {_CALLS[1]} IS NOT NULL THEN
              coalesce({jsonrpc.tools_failure(_CALLS[2], "_doc2", "_names", "p.mcp")},
                       {jsonrpc.tools_success(_CALLS[2], "_names")}) END)""",
        row=f"""CASE r.seq
            WHEN 0 THEN coalesce({jsonrpc.initialize_failure("r", "_doc", "p.mcp")},
                                 {jsonrpc.outcome(True, "r.status_code", "CAST(NULL AS STRING)")})
            WHEN 1 THEN coalesce({jsonrpc.notification_failure("r")},
                                 {jsonrpc.outcome(True, "r.status_code", "CAST(NULL AS STRING)")})
            WHEN 2 THEN coalesce({jsonrpc.tools_failure("r", "_doc", "_names", "p.mcp")},
                                 {jsonrpc.tools_success("r", "_names")}) END""",
        last=str(len(jsonrpc.STAGES) - 1),
        before_cycle=(
            {f"_body{i}": jsonrpc.usual_keys(f"{_CALLS[i]}.body") for i in (0, 2)},
            {f"_doc{i}": jsonrpc.parse_body(f"_body{i}") for i in (0, 2)},
            {"_names": jsonrpc.tool_names("_doc2")},
        ),
        before_row=(
            {"_body": f"CASE WHEN r.seq IN (0, 2) THEN {jsonrpc.usual_keys('r.body')} END"},
            {"_doc": jsonrpc.parse_body("_body")},
            {"_names": f"CASE WHEN r.seq = 2 THEN {jsonrpc.tool_names('_doc')} END"},
        ),
    ),
    "journey": Mode(
        cycle=f"""coalesce(get(filter(_steps, v -> v IS NULL OR NOT v.healthy), 0),
            CASE WHEN forall(_steps, v -> v IS NOT NULL) THEN {_JOURNEY_OK} END)""",
        row=_step("get(p.journey, r.seq)", "r.seq", "r"),
        last="size(p.journey) - 1",
        before_cycle=({"_steps": _STEPS},),
    ),
    "single": Mode(cycle=_single(_response(0)), row=_single("r"), last="0"),
}


def _by_mode(field: str, modes: tuple[str, ...]) -> Column:
    branches = " ".join(f"WHEN '{name}' THEN {getattr(MODES[name], field)}" for name in modes)
    return F.expr(f"CASE mode {branches} END")


def _staged(df: DataFrame, field: str, modes: tuple[str, ...]) -> DataFrame:
    """Add the columns the modes compute ahead; null for rows of other modes."""
    for name in modes:
        for columns in getattr(MODES[name], field):
            df = df.withColumns(
                {c: F.expr(f"CASE WHEN mode = '{name}' THEN {text} END") for c, text in columns.items()}
            )
    return df


def _probe_side(probes: DataFrame) -> DataFrame:
    """Probe definition as one struct `p` plus its mode and routing, keyed `probe`."""
    types = dict(probes.dtypes)
    columns = [F.col(c) if c in types else _absent(c) for c in _PROBE_COLUMNS]
    p = probes.select(F.col("name").alias("probe"), F.struct(*columns).alias("p"))
    return p.withColumns(
        {
            "mode": mode_of(F.col("p.config_error"), F.col("p.mcp"), F.col("p.journey")),
            "to_metrics": routing.to_metrics(F.col("p.outputs")),
            "to_lines": routing.to_lines(F.col("p.outputs")),
        }
    )


def _absent(column: str) -> Column:
    return F.lit(None).cast(PROBES[column].dataType).alias(column)


def _without_salt(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c != SALT]


def cycles_with_probes(cycles: DataFrame, probes: DataFrame) -> DataFrame:
    """Attach to every check cycle its probe: struct `p`, `mode`, `to_metrics`, `to_lines`."""
    return lookup_join(cycles, _probe_side(probes), on=["probe"], spread_by=["cycle_id"])


ALL_MODES = tuple(MODES)


def evaluate_cycles(cycles: DataFrame, probes: DataFrame, modes: tuple[str, ...] = ALL_MODES) -> DataFrame:
    """Verdict of every cycle; `healthy` is null where responses are missing and none failed.

    `modes` limits what is evaluated to the kinds known to be in `probes`.
    """
    staged = _staged(cycles_with_probes(cycles, probes), "before_cycle", modes)
    # A generator keeps later filters on the verdict from being evaluated a second time below it.
    return staged.select(
        F.col("probe").alias("name"),
        F.col("finished_at").alias("last_check_time"),
        "p.url",
        "cycle_id",
        "duration_us",
        "mode",
        "to_metrics",
        "to_lines",
        F.inline(F.array(_by_mode("cycle", modes))),
    ).select(RESULT_COLUMNS)


def check_results(cycles: DataFrame, probes: DataFrame, modes: tuple[str, ...] = ALL_MODES) -> DataFrame:
    """The result log: one uniform row per complete cycle, whatever the kind of its probe."""
    return evaluate_cycles(cycles, probes, modes).where(F.col("healthy").isNotNull())


def with_auth_errors(cycles: DataFrame, failing: DataFrame) -> DataFrame:
    """Cycles as they are without the credentials that are missing: of a probe in `failing` (name, error, see
    `auth.runtime_auth_errors`), the first request failed with that error and there is no other response."""
    errors = failing.select(F.col("name").alias("probe"), F.col("error").alias("_auth_error"))
    found = lookup_join(cycles, errors, on=["probe"], spread_by=["cycle_id"], how="left")
    failed = "array(named_struct('seq', 0, 'stage', 'request', 'status_code', 0, 'body', CAST(NULL AS STRING), 'error_kind', 'auth', 'error', _auth_error))"
    responses = F.when(F.col("_auth_error").isNotNull(), F.expr(failed).cast(cycles.schema["responses"].dataType)).otherwise(F.col("responses"))
    return found.withColumn("responses", responses).select(_without_salt(cycles))


def incomplete_cycles(cycles: DataFrame, probes: DataFrame) -> DataFrame:
    """Cycles without a verdict: a response is missing and none before it failed."""
    return evaluate_cycles(cycles, probes).where(F.col("healthy").isNull()).select("cycle_id", "name", "mode")


def results_of_mode(cycles: DataFrame, probes: DataFrame, mode: str) -> DataFrame:
    """The result log of one kind of probe; the filter reaches the probe table before the join."""
    chosen = probes.where(mode_of(*[_column_or_null(probes, c) for c in ("config_error", "mcp", "journey")]) == mode)
    return check_results(cycles, chosen, (mode,))


def _column_or_null(probes: DataFrame, column: str) -> Column:
    return F.col(column) if column in probes.columns else _absent(column)


def config_error_results(cycles: DataFrame, probes: DataFrame) -> DataFrame:
    return results_of_mode(cycles, probes, "config_error")


def single_results(cycles: DataFrame, probes: DataFrame) -> DataFrame:
    return results_of_mode(cycles, probes, "single")


def journey_results(cycles: DataFrame, probes: DataFrame) -> DataFrame:
    return results_of_mode(cycles, probes, "journey")


def mcp_results(cycles: DataFrame, probes: DataFrame) -> DataFrame:
    return results_of_mode(cycles, probes, "mcp")


def mcp_stages(cycles: DataFrame, probes: DataFrame) -> DataFrame:
    """The stages of every tool-listing check on their own; a null column means the stage passed.

    `initialize_reply` and `tools_reply` cover transport and envelope, `initialize`, `notification` and
    `tools` the whole stage.
    """
    joined = cycles_with_probes(cycles, probes).where("mode = 'mcp'")
    staged = _staged(joined, "before_cycle", ("mcp",))
    init, note, tools = _CALLS
    stages = {
        "initialize_reply": jsonrpc.reply_failure(init, "_doc0", jsonrpc.INITIALIZE),
        "initialize": jsonrpc.initialize_failure(init, "_doc0", "p.mcp"),
        "notification": jsonrpc.notification_failure(note),
        "tools_reply": jsonrpc.reply_failure(tools, "_doc2", jsonrpc.TOOLS),
        "tools": jsonrpc.tools_failure(tools, "_doc2", "_names", "p.mcp"),
        "tool_count": "size(_names)",
    }
    return staged.select(
        "cycle_id", F.col("probe").alias("name"), *[F.expr(text).alias(name) for name, text in stages.items()]
    )


def _planned(exchanges: DataFrame, probes: DataFrame) -> DataFrame:
    """Exchanges with their probe, limited to requests the probe sends."""
    side = _probe_side(probes).withColumn("_last", _by_mode("last", ALL_MODES))
    joined = lookup_join(exchanges, side, on=["probe"], spread_by=["cycle_id", "seq"])
    return joined.where((F.col("seq") >= 0) & (F.col("seq") <= F.col("_last")))


def unplanned_exchanges(exchanges: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows no planned request explains: unknown probe, or a position beyond the plan."""
    side = _probe_side(probes).select("probe", _by_mode("last", ALL_MODES).alias("_last"))
    joined = lookup_join(exchanges, side, on=["probe"], spread_by=["cycle_id", "seq"], how="left")
    beyond = F.col("_last").isNull() | (F.col("seq") > F.col("_last")) | (F.col("seq") < 0)
    return joined.where(beyond).select(_without_salt(exchanges))


def first_arrivals(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the order; copies combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, "_first.*")


CYCLE = ["cycle_id", "probe"]


def assemble_cycles(
    exchanges: DataFrame, probes: DataFrame, unique: bool = False, keys: list[str] = CYCLE
) -> DataFrame:
    """One `check_cycles` row per check, responses in request order.

    Only planned requests take part, so an array is no longer than the plan in its probe's row;
    `unplanned_exchanges` gives the others. A feed may deliver a row many times: the first arrival
    counts, and copies are dropped before the shuffle. Say `unique` for a log that holds every request
    once, to save that step.
    """
    rows = _planned(exchanges, probes).select(*keys, "started_at", "finished_at", *_RESPONSE_FIELDS)
    if not unique:
        rows = first_arrivals(rows.withColumn("body_hash", F.xxhash64("body")), [*keys, "seq"], ARRIVAL)
    return (
        rows.groupBy(*keys)
        .agg(
            F.min("started_at").alias("started_at"),
            F.max("finished_at").alias("finished_at"),
            F.array_sort(F.collect_list(F.struct(*_RESPONSE_FIELDS))).alias("responses"),
        )
        .select(
            *keys,
            "started_at",
            "finished_at",
            (F.unix_micros("finished_at") - F.unix_micros("started_at")).alias("duration_us"),
            "responses",
        )
    )


def request_verdicts(exchanges: DataFrame, probes: DataFrame) -> DataFrame:
    """Judge every planned exchange in place; the body does not leave this projection."""
    rows = _planned(exchanges, probes)
    staged = _staged(rows.withColumn("r", F.struct(*_RESPONSE_FIELDS)), "before_row", ALL_MODES)
    judged = staged.withColumn("v", _by_mode("row", ALL_MODES))
    return judged.select(
        "cycle_id",
        "probe",
        "cycle_started_at",
        "seq",
        "started_at",
        "finished_at",
        "mode",
        "to_metrics",
        "to_lines",
        F.col("p.url").alias("url"),
        F.col("p.expected_status").alias("probe_expected_status"),
        F.col("_last").alias("last_seq"),
        "v",
        F.struct("status_code", "error_kind", "error", F.xxhash64("body").alias("body_hash")).alias("tie"),
    )


def evaluate_exchanges(exchanges: DataFrame, probes: DataFrame, unique: bool = False) -> DataFrame:
    """Verdict of every check straight from its exchange rows; `healthy` is null where rows are missing.

    Copies of a row count once, as in `assemble_cycles`; `unique` saves the step.
    """
    rows = request_verdicts(exchanges, probes)
    if not unique:
        rows = first_arrivals(rows, [*CYCLE, "seq"], VERDICT_ARRIVAL)
    return combine_verdicts(rows, CYCLE)


def combine_verdicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Verdicts of requests (each once) to verdicts of checks.

    The first failing request decides, if all before it were answered. Without one, the check is healthy if
    all planned requests are there. What is grouped combines before the shuffle: minima, maxima and a set of
    positions no longer than the plan.
    """
    failed = F.when(~F.col("v.healthy"), F.struct("seq", "v"))
    grouped = rows.groupBy(*keys).agg(
        F.min(failed).alias("_failed"),
        F.max(F.struct("seq", "v")).alias("_end"),
        F.collect_set("seq").alias("_seqs"),
        F.max(
            F.struct("last_seq", "mode", "to_metrics", "to_lines", "url", "probe_expected_status")
        ).alias("_p"),
        F.min("started_at").alias("_started"),
        F.max("finished_at").alias("last_check_time"),
    )
    complete = F.size("_seqs") > F.col("_p.last_seq")
    answered = F.size(F.filter("_seqs", lambda s: s < F.col("_failed.seq"))) == F.col("_failed.seq")
    journey_text = F.format_string("Synthetic journey succeeded (%d steps)", F.col("_p.last_seq") + 1)
    is_journey = F.col("_p.mode") == "journey"
    success = F.struct(
        F.lit(True).alias("healthy"),
        F.col("_end.v.status_code").alias("status_code"),
        F.when(is_journey, journey_text).otherwise(F.col("_end.v.message")).alias("message"),
        F.when(is_journey, F.coalesce("_p.probe_expected_status", F.lit(0)))
        .otherwise(F.col("_end.v.expected_status"))
        .alias("expected_status"),
    )
    v = F.when(F.col("_failed").isNull(), F.when(complete, success)).otherwise(F.when(answered, F.col("_failed.v")))
    return grouped.withColumn("_v", v).select(
        F.col("probe").alias("name"),
        "_v.healthy",
        "_v.status_code",
        "last_check_time",
        "_v.message",
        "_p.url",
        "_v.expected_status",
        "cycle_id",
        (F.unix_micros("last_check_time") - F.unix_micros("_started")).alias("duration_us"),
        "_p.mode",
        "_p.to_metrics",
        "_p.to_lines",
    )


def exchange_results(
    exchanges: DataFrame, probes: DataFrame, unique: bool = False, ticks: DataFrame | None = None
) -> DataFrame:
    """The result log straight from exchange rows; same rows as assembling cycles first.

    A probe with a configuration error sends nothing, so no exchange tells of its checks. `ticks` does: one row
    (cycle_id, probe, started_at, finished_at, duration_us) per check; each of such a probe gives a result.
    """
    found = evaluate_exchanges(exchanges, probes, unique).where(F.col("healthy").isNotNull())
    return found if ticks is None else found.unionByName(tick_results(ticks, probes))


def tick_results(ticks: DataFrame, probes: DataFrame) -> DataFrame:
    """One unhealthy result per tick of a probe that has a configuration error; other ticks give none."""
    none = F.lit(None).cast(CHECK_CYCLES["responses"].dataType)
    return config_error_results(ticks.withColumn("responses", none), probes)


def unknown_cycles(cycles: DataFrame, probes: DataFrame) -> DataFrame:
    """Cycles whose probe is not in the set; they have no result."""
    names = probes.select(F.col("name").alias("probe"))
    return lookup_join(cycles, names, on=["probe"], spread_by=["cycle_id"], how="left_anti").select(_without_salt(cycles))
