"""Verdicts on the three recorded responses of a tool-listing check.

Bodies are read as VARIANT: it alone tells a JSON null from a missing key, which the rules need. As in
`verdict`, functions take and give SQL text. Each `*_failure` gives a verdict, or null where the stage
passed or has no response. `doc` is a body from `parse_body`, in a column of its own.
"""

from __future__ import annotations

from probelens.functions.text import literal
from probelens.functions.verdict import error_text, status_of
from probelens.functions.verdict import outcome as any_outcome

# The stages in the order of the calls, and the status a JSON-RPC answer must have.
INITIALIZE = "initialize"
NOTIFICATION = "notifications/initialized"
TOOLS = "tools/list"
STAGES = [INITIALIZE, NOTIFICATION, TOOLS]
OK = 200


def outcome(healthy: bool, status_code: str, message: str) -> str:
    return any_outcome(healthy, status_code, message, str(OK))


# The keys that are read. A decoder takes them in any case.
KEYS = ["jsonrpc", "error", "code", "message", "result", "protocolVersion", "capabilities", "tools", "name"]


def usual_keys(body: str) -> str:
    """The body with these keys in their usual case. A quoted text before a colon is always a key; a body without
    an unusual one is not rewritten."""
    names = "|".join(KEYS)
    unusual = f'"(?!(?:{names})")(?i:{names})"\\s*:'
    text = body
    for key in KEYS:
        old, new = f'"(?i:{key})"(\\s*:)', f'"{key}"$1'
        text = f"regexp_replace({text}, {literal(old)}, {literal(new)})"
    return f"CASE WHEN {body} RLIKE {literal(unusual)} THEN {text} ELSE {body} END"


def parse_body(body: str) -> str:
    """The body as VARIANT below key `v`; null unless the text is exactly one JSON document.

    The variant parser accepts text after the document. Inside an object or an array such text breaks
    the syntax, unless it starts with the bracket that closes it, which can hold for only one of them.
    """
    one = f"json_array_length('[' || {body} || ']') = 1"
    return f"CASE WHEN {one} THEN try_parse_json('{{\"v\":' || {body} || '}}') END"


def _at(doc: str, path: str, kind: str = "variant") -> str:
    return f"try_variant_get({doc}, '{path}', '{kind}')"


def _absent(value: str) -> str:
    """Missing or a JSON null: what every typed field accepts."""
    return f"({value} IS NULL OR is_variant_null({value}))"


def _object_or_absent(doc: str, path: str = "$") -> str:
    """A shallow cast; naming the type of a value would walk through all of it."""
    return f"({_absent(_at(doc, path))} OR {_at(doc, path, 'map<string,variant>')} IS NOT NULL)"


def _scalar_or_absent(doc: str, path: str, kind: str) -> str:
    """Casts would coerce (5 to '5'), so scalars are told apart by their type name."""
    value = _at(doc, path)
    return f"({_absent(value)} OR schema_of_variant({value}) = '{kind}')"


def _decodes_as_reply(doc: str) -> str:
    return f"""({doc} IS NOT NULL AND {_object_or_absent(doc, "$.v")}
      AND {_scalar_or_absent(doc, "$.v.jsonrpc", "STRING")}
      AND ({_absent(_at(doc, "$.v.error"))}
           OR ({_object_or_absent(doc, "$.v.error")}
               AND {_scalar_or_absent(doc, "$.v.error.code", "BIGINT")}
               AND {_scalar_or_absent(doc, "$.v.error.message", "STRING")})))"""


def _decode_reason(body: str, doc: str) -> str:
    """Stable reason; the wording of a decoder is not reproduced."""
    return (
        f"CASE WHEN trim(coalesce({body}, '')) = '' THEN 'unexpected end of JSON input' "
        f"WHEN {doc} IS NULL THEN 'invalid JSON document' ELSE 'unexpected JSON type' END"
    )


def reply_failure(response: str, doc: str, stage: str) -> str:
    """No response, HTTP status, undecodable body, error object, no result: the first that holds."""
    status = status_of(response)
    code, text = _at(doc, "$.v.error.code", "bigint"), _at(doc, "$.v.error.message", "string")

    def message(start: str, rest: str) -> str:
        return f"{literal(start)} || {rest}"

    return f"""
    CASE
      WHEN {response} IS NULL THEN NULL
      WHEN {response}.error_kind IS NOT NULL
        THEN {outcome(False, "0", message(f"{stage} request failed: ", error_text(response)))}
      WHEN {status} <> {OK} THEN {outcome(False, status, message(f"{stage} returned HTTP ", status))}
      WHEN NOT {_decodes_as_reply(doc)}
        THEN {outcome(False, status, message(f"Failed to decode {stage} response: ", _decode_reason(f"{response}.body", doc)))}
      WHEN NOT {_absent(_at(doc, "$.v.error"))}
        THEN {outcome(False, status, message(f"{stage} returned JSON-RPC error ", f"coalesce({code}, 0) || ': ' || coalesce({text}, '')"))}
      WHEN {_at(doc, "$.v.result")} IS NULL THEN {outcome(False, status, literal(f"{stage} response missing result"))}
    END"""


def initialize_failure(response: str, doc: str, mcp: str) -> str:
    decodes = (
        f"({_object_or_absent(doc, '$.v.result')} "
        f"AND {_scalar_or_absent(doc, '$.v.result.protocolVersion', 'STRING')} "
        f"AND {_object_or_absent(doc, '$.v.result.capabilities')})"
    )
    version = _at(doc, "$.v.result.protocolVersion", "string")
    # Any value of the key counts, a JSON null too.
    no_tools = f"{_at(doc, '$.v.result.capabilities.tools')} IS NULL"

    def failed(text: str) -> str:
        return outcome(False, str(OK), literal(text))

    return f"""
    coalesce({reply_failure(response, doc, INITIALIZE)},
    CASE
      WHEN {response} IS NULL THEN NULL
      WHEN NOT {decodes} THEN {failed("Failed to decode initialize result: unexpected JSON type")}
      WHEN coalesce({version}, '') = '' THEN {failed("Initialize response missing protocolVersion")}
      WHEN coalesce({mcp}.require_tools_capability, false) AND {no_tools}
        THEN {failed("Initialize response did not advertise tools capability")}
    END)"""


def notification_failure(response: str) -> str:
    status = status_of(response)
    broken = f"{literal(f'{NOTIFICATION} request failed: ')} || {error_text(response)}"
    return f"""
    CASE
      WHEN {response} IS NULL THEN NULL
      WHEN {response}.error_kind IS NOT NULL THEN {outcome(False, "0", broken)}
      WHEN {status} NOT BETWEEN 200 AND 299
        THEN {outcome(False, status, f"{literal(f'{NOTIFICATION} returned HTTP ')} || {status}")}
    END"""


def tool_names(doc: str) -> str:
    """Names in listed order, repeats kept, `""` for a nameless tool; null if the list does not decode."""
    tools = _at(doc, "$.v.result.tools", "array<variant>")
    well_formed = f"forall({tools}, t -> {_object_or_absent('t')} AND {_scalar_or_absent('t', '$.name', 'STRING')})"
    return f"""
    CASE
      WHEN NOT {_object_or_absent(doc, "$.v.result")} THEN NULL
      WHEN {_absent(_at(doc, "$.v.result.tools"))} THEN CAST(array() AS ARRAY<STRING>)
      WHEN coalesce({well_formed}, false)
        THEN transform({tools}, t -> coalesce({_at("t", "$.name", "string")}, ''))
    END"""


def tools_failure(response: str, doc: str, names: str, mcp: str) -> str:
    status, least = status_of(response), f"coalesce({mcp}.min_tool_count, 0)"
    missing = f"filter({mcp}.required_tools, r -> NOT array_contains({names}, r))"
    undecoded = literal(f"Failed to decode {TOOLS} result: unexpected JSON type")
    few = f"{literal(f'{TOOLS} returned ')} || size({names}) || ' tools, need at least ' || {least}"
    lacking = f"{literal(f'{TOOLS} missing required tools: ')} || array_join(array_sort({missing}), ', ')"
    return f"""
    coalesce({reply_failure(response, doc, TOOLS)},
    CASE
      WHEN {response} IS NULL THEN NULL
      WHEN {names} IS NULL THEN {outcome(False, status, undecoded)}
      WHEN size({names}) < {least} THEN {outcome(False, status, few)}
      WHEN size({missing}) > 0 THEN {outcome(False, status, lacking)}
    END)"""


def tools_success(response: str, names: str) -> str:
    text = f"'MCP tool validation succeeded (' || size({names}) || ' tools)'"
    return f"CASE WHEN {response} IS NOT NULL THEN {outcome(True, status_of(response), text)} END"
