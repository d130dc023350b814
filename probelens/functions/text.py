"""String helpers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escapes of a quoted string in messages (character, written form).
QUOTE_ESCAPES = [
    ("\\", "\\\\"),
    ('"', '\\"'),
    ("\n", "\\n"),
    ("\r", "\\r"),
    ("\t", "\\t"),
    ("\a", "\\a"),
    ("\b", "\\b"),
    ("\f", "\\f"),
    ("\v", "\\v"),
]

# Characters that JSON output writes as \u escapes.
JSON_ESCAPES = [
    ("<", "\\u003c"),
    (">", "\\u003e"),
    ("&", "\\u0026"),
    ("\u2028", "\\u2028"),
    ("\u2029", "\\u2029"),
]


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# Characters that don't print, besides those with an escape of their own: written as numbers.
_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def _numbered(text: str) -> str:
    """SQL text: what doesn't print as \\x01, \\u200b or \\U000e0001; other texts are not taken apart."""
    pattern, utf16 = literal(_UNPRINTABLE), "hex(encode(c, 'UTF-16BE'))"
    written = (
        f"CASE WHEN NOT c RLIKE {pattern} THEN c WHEN length(hex(c)) = 2 THEN {literal(chr(92) + 'x')} || lower(hex(c)) "
        f"WHEN length({utf16}) = 4 THEN {literal(chr(92) + 'u')} || lower({utf16}) "
        f"ELSE {literal(chr(92) + 'U')} || lower(hex(encode(c, 'UTF-32'))) END"
    )
    each = f"array_join(transform(regexp_extract_all({text}, '(?s).', 0), c -> {written}), '')"
    return f"CASE WHEN {text} RLIKE {pattern} THEN {each} ELSE {text} END"


def quoted(text: Column) -> Column:
    """The text in double quotes with escapes, as messages show it."""
    one = F.transform(F.array(_replace_all(text, QUOTE_ESCAPES)), lambda t: F.concat(F.lit('"'), _printable(t), F.lit('"')))
    return F.get(one, F.lit(0))


def _printable(text: Column) -> Column:
    """The Column form of `_numbered`."""

    def written(c: Column) -> Column:
        utf16 = F.hex(F.encode(c, "UTF-16BE"))
        return (
            F.when(~c.rlike(_UNPRINTABLE), c)
            .when(F.length(F.hex(c)) == 2, F.concat(F.lit("\\x"), F.lower(F.hex(c))))
            .when(F.length(utf16) == 4, F.concat(F.lit("\\u"), F.lower(utf16)))
            .otherwise(F.concat(F.lit("\\U"), F.lower(F.hex(F.encode(c, "UTF-32")))))
        )

    each = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), written), "")
    return F.when(text.rlike(_UNPRINTABLE), each).otherwise(text)


def literal(text: str) -> str:
    """The text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted_sql(text: str) -> str:
    """`quoted` for an expression given as SQL text."""
    for old, new in QUOTE_ESCAPES:
        text = f"replace({text}, {literal(old)}, {literal(new)})"
    return f"get(transform(array({text}), t -> '\"' || {_numbered('t')} || '\"'), 0)"


def json_line(value: Column) -> Column:
    """Compact JSON of a struct; nulls are kept, markup characters are escaped."""
    return _replace_all(F.to_json(value, {"ignoreNullFields": "false"}), JSON_ESCAPES)


def rfc3339(ts: Column) -> Column:
    """UTC time with as many fraction digits as needed, e.g. 2024-01-01T00:00:07.5Z."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(full, r"\.?0+$", ""), F.lit("Z"))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def is_blank(text: Column) -> Column:
    """Null and the empty string mean the same in every optional text field."""
    return text_or_empty(text) == ""


def canonical_header(key: Column) -> Column:
    """Header name in its usual spelling; a name that is no plain token stays as it is."""
    words = F.transform(
        F.split(key, "-"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.right(w, F.length(w) - 1))),
    )
    return F.when(key.rlike(r"^[!#$%&'*+\-.^_`|~0-9A-Za-z]+$"), F.array_join(words, "-")).otherwise(key)
