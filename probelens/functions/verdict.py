"""Verdict on one recorded response.

The functions here take SQL expressions as text and give one back, for use with `F.expr` or in a SELECT.
One text is parsed at once, where a tree of Column calls of this size would take a second to build. A
response is an expression of a struct with `seq`, `status_code`, `body`, `error_kind` and `error`; a verdict
is a struct of `healthy`, `status_code`, `message` and `expected_status`. There is no Python per row: the
same expressions serve rows, arrays and streams.
"""

from __future__ import annotations

from probelens.functions.text import literal, quoted_sql

# Prefix of the message by the place where the request broke. An auth error carries none.
ERROR_PREFIX = {
    "build": "failed to build request: ",
    "transport": "http request failed: ",
    "read": "failed to read response body: ",
}


def error_text(response: str) -> str:
    """Text of a request that got no usable response."""
    kinds = " ".join(f"WHEN {literal(kind)} THEN {literal(prefix)}" for kind, prefix in ERROR_PREFIX.items())
    return f"(CASE {response}.error_kind {kinds} ELSE '' END || coalesce({response}.error, ''))"


def status_of(response: str) -> str:
    return f"coalesce({response}.status_code, 0)"


def outcome(healthy: bool, status_code: str, message: str, expected: str) -> str:
    return (
        f"named_struct('healthy', {str(healthy).lower()}, 'status_code', CAST({status_code} AS INT), "
        f"'message', {message}, 'expected_status', CAST({expected} AS INT))"
    )


def request_verdict(response: str, expected_status: str, contains_text: str, failure_prefix: str = "''") -> str:
    """First of: no response, wrong status, text not found; else healthy. Null without a response row.

    A broken request reports status 0 even when a status line had arrived. `failure_prefix` goes before
    the message of a failure. Without a text to look for, null or empty, the body is not read.
    """
    expected, status, wanted = f"coalesce({expected_status}, 0)", status_of(response), f"coalesce({contains_text}, '')"

    def failure(code: str, text: str) -> str:
        return outcome(False, code, f"{failure_prefix} || {text}", expected)

    return f"""
    CASE
      WHEN {response} IS NULL THEN NULL
      WHEN {response}.error_kind IS NOT NULL THEN {failure("0", error_text(response))}
      WHEN {status} <> {expected} THEN {failure(status, f"'Expected ' || {expected} || ' but got ' || {status}")}
      WHEN {wanted} = '' THEN {outcome(True, status, f"'Got expected status ' || {status}", expected)}
      WHEN NOT contains(coalesce({response}.body, ''), {wanted})
        THEN {failure(status, f"'Response body did not contain ' || {quoted_sql(wanted)}")}
      ELSE {outcome(True, status, f"'Got expected status ' || {status} || ' and matched response text'", expected)}
    END"""
