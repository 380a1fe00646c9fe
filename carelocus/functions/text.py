"""Text Column builders for search terms, display values and evidence.

Everything here is a built-in expression or a higher-order function over
arrays (transform / filter / exists), evaluated inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from carelocus.sources import dims


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_literal(value) -> str:
    """Spark SQL literal text of a Python constant (str, int, float, bool, list, dict -> named_struct)."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, int):
        return f"{value}"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in value.items()) + ")"
    if isinstance(value, (list, tuple)):
        if not value:
            return "CAST(array() AS array<string>)"
        if any(v is None for v in value) and all(v is None or isinstance(v, str) for v in value):
            return "array(" + ", ".join("CAST(NULL AS STRING)" if v is None else sql_literal(v) for v in value) + ")"
        return "array(" + ", ".join(sql_literal(v) for v in value) + ")"
    raise TypeError(type(value))


def const(value) -> Column:
    """A constant Column built from one SQL literal (one JVM call however large)."""
    return F.expr(sql_literal(value))


def lit_array(values: Sequence[str]) -> Column:
    return const(list(values))


def contains_any(text, needles: Sequence[str]) -> Column:
    """True when any constant needle is a substring of `text` (NULL text -> false).

    An OR-chain of substring tests: generated code, no lambda; meant for short
    constant lists (long lists use one regex alternation instead)."""
    t = _c(text)
    out = None
    for n in needles:
        out = t.contains(n) if out is None else out | t.contains(n)
    return F.coalesce(out, F.lit(False))


def strip_ws(c) -> Column:
    """Remove leading and trailing whitespace of any kind (tabs, newlines, ...);
    Spark's trim() removes only blanks."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def clean_term(t: Column) -> Column:
    """One search term: lower-case, collapse whitespace, strip, keep [a-z0-9 /+-].

    A NULL element is rendered as the text 'none', as a string conversion of a
    missing JSON value would be.
    """
    s = F.regexp_replace(F.lower(F.coalesce(t.cast("string"), F.lit("None"))), r"(?U)\s+", " ")
    return F.regexp_replace(F.trim(s), r"[^a-z0-9 /+-]", "")


def clean_terms(terms, limit: int = dims.KEYWORD_LIMIT) -> Column:
    """H4: clean each term, drop short ones, ordered de-duplication, keep the first `limit`."""
    cleaned = F.transform(F.coalesce(_c(terms), F.array().cast("array<string>")), clean_term)
    kept = F.filter(cleaned, lambda x: F.length(x) >= dims.MIN_TERM_LENGTH)
    return F.slice(F.array_distinct(kept), 1, limit)


def has_value(c) -> Column:
    """Not NULL, not blank, and not a textual marker of a missing value."""
    s = strip_ws(_c(c).cast("string"))
    return F.coalesce((F.length(s) > 0) & ~F.lower(s).isin(*dims.MISSING_MARKERS), F.lit(False))


def value_if_present(c) -> Column:
    return F.when(has_value(c), _c(c))


def humanize_camel_case(c) -> Column:
    """Split lowerUpper boundaries with a blank and upper-case the first character."""
    s = F.regexp_replace(_c(c), "([a-z])(?=[A-Z])", "$1 ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


# Label words rewritten in evidence text (whole-word, case-insensitive).
_LABEL_WORDS = [("capability_name", "Capability"), ("standardized_service_name", "Service"),
                ("specialty_name", "Specialty")]
_EDGE_BRACKETS = "[]{}()"
_EDGE_PUNCT = ",;:.\"'"


def _strip_chars(s: Column, chars: str) -> Column:
    cls = "".join("\\" + ch for ch in chars)
    return F.regexp_replace(s, f"^[{cls}]+|[{cls}]+$", "")


def clean_evidence_text(c) -> Column:
    """Collapse whitespace, drop a leading `key:` prefix, rename label words,
    strip bracket then punctuation characters from both ends, humanize camelCase."""
    s = F.trim(F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), r"(?U)\s+", " "))
    s = F.regexp_replace(s, r"""(?U)^["']?\w+["']?\s*:\s*["']?""", "")
    for word, label in _LABEL_WORDS:
        s = F.regexp_replace(s, rf"(?iU)\b{word}\b", label)
    s = _strip_chars(_strip_chars(s, _EDGE_BRACKETS), _EDGE_PUNCT)
    return humanize_camel_case(s)


_PHONE = r"\+?\d[\d\s().-]{7,}\d"


def clean_phone(c) -> Column:
    """The first phone-like run of digits, else the first 40 characters."""
    text = strip_ws(F.coalesce(_c(c).cast("string"), F.lit("")))
    found = F.regexp_extract(text, _PHONE, 0)
    return F.when(found != "", strip_ws(found)).otherwise(F.substring(text, 1, dims.CONTACT_FALLBACK_CHARS))


def truthy_text(v: Column, path: str = "$") -> Column:
    """The value at a path of a VARIANT as text; NULL where the value counts as missing: it is not there, null, false,
    a zero, an empty text, an empty list or an empty object. A text like "false" or "0" is a value."""
    node = F.try_variant_get(v, path, "variant")
    kind, text = F.schema_of_variant(node), F.try_variant_get(v, path, "string")
    number = ~kind.isin("STRING", "BOOLEAN") & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT")
    missing = (
        (text == "")
        | ((kind == "BOOLEAN") & (text == "false"))
        | (kind.startswith("ARRAY") & (text == "[]"))
        | (kind.startswith("OBJECT") & (text == "{}"))
        | (number & (F.try_variant_get(v, path, "double") == 0))
    )
    return F.when(~F.coalesce(missing, F.lit(False)), text)


def keep_last_of_repeated_keys(spark: SparkSession) -> None:
    """Of a key that a JSON object repeats, VARIANT parsing keeps the last value (Spark's default refuses the object).

    A setting of the session, read when an expression is planned; jobs that parse planner responses or evidence set it.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strict_json(text: Column) -> Column:
    """The one JSON value that is the whole text, as VARIANT; NULL for anything else.

    `try_parse_json` stops after the first value. Inside a list that ends with a
    mark of our own, whatever follows the value breaks the list.
    """
    end = "\u2403"
    parsed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f', "{end}"]'))), "$", "array<variant>")

    def whole(items: Column) -> Column:
        return F.when((F.size(items) == 2) & (F.try_variant_get(F.get(items, 1), "$", "string") == end), F.get(items, 0))

    return F.get(F.transform(F.array(parsed), whole), 0)  # the lambda binds the parsed list once
