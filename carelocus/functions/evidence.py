"""Evidence extraction as Column expressions.

A facility's semi-structured text (JSON list, JSON object, dict-like text or a
plain comma list) becomes an ordered array of display items, and each result
gets up to three "label: excerpt" snippets. Everything runs as higher-order
functions on the row's own arrays — no UDF, no explode, no shuffle — and only
on the top results, so the cost is bounded by k per search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelocus.functions.text import clean_evidence_text, keep_last_of_repeated_keys, strict_json, strip_ws, truthy_text
from carelocus.sources import dims

STRUCTURED_FIELDS = {"specialties", "standardized_services", "parsed_capability"}


def _first_truthy(v: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[truthy_text(v, f"$.{k}") for k in keys])


def _clean_nonempty(items: Column) -> Column:
    return F.filter(F.transform(items, clean_evidence_text), lambda s: s != "")


def _dict_like(text: Column) -> Column:
    """First `key: value` found for the name keys, in key then pattern order."""
    norm = F.replace(F.replace(text, F.lit("&#x27;"), F.lit("'")), F.lit("&quot;"), F.lit('"'))
    found = []
    for k in dims.EVIDENCE_NAME_KEYS:
        for pat in (rf'(?i)"{k}"\s*:\s*"([^"]+)"', rf"(?i)'{k}'\s*:\s*'([^']+)'", rf"(?i){k}\s*:\s*([^,}}]+)"):
            found.append(F.nullif(F.regexp_extract(norm, pat, 1), F.lit("")))
    return F.coalesce(*found)


def with_evidence_items_many(df: DataFrame, outputs: dict[str, str]) -> DataFrame:
    """S7 for several fields ({source column: output column}), one field after the
    other: batching the fields into one projection pushes the generated code of
    the text clean-up past the JVM's 64 KB method limit."""
    for source, out in outputs.items():
        df = with_evidence_items(df, source, out)
    return df


def with_evidence_items(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add `out` = ordered display items of the evidence field `source`.

    JSON list -> its elements (objects give their first name-like key); JSON
    object -> its first name-like key; else a `key: value` found in the text;
    else the comma-separated parts. Values that count as missing (null, false, 0,
    empty) are skipped as elements and as names; of a repeated key the last value
    counts. Intermediate values are staged as columns so no large sub-expression
    is repeated.
    """
    keep_last_of_repeated_keys(df.sparkSession)
    outputs = {source: out}
    def names(out):
        return f"{out}__t", f"{out}__v", f"{out}__d"

    staged = df.withColumns({names(o)[0]: strip_ws(F.coalesce(F.col(src).cast("string"), F.lit("")))
                             for src, o in outputs.items()})
    staged = staged.withColumns({names(o)[1]: strict_json(F.col(names(o)[0])) for o in outputs.values()})
    staged = staged.withColumns({names(o)[2]: F.coalesce(clean_evidence_text(_dict_like(F.col(names(o)[0]))),
                                                         F.lit("")) for o in outputs.values()})

    def items(out: str) -> Column:
        t, v, d = (F.col(x) for x in names(out))
        kind = F.schema_of_variant(v)
        elements = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        from_list = _clean_nonempty(F.transform(elements, lambda e: F.when(
            F.schema_of_variant(e).startswith("OBJECT"), _first_truthy(e, dims.EVIDENCE_NAME_KEYS))
            .otherwise(truthy_text(e))))
        from_object = _clean_nonempty(F.array(_first_truthy(v, dims.EVIDENCE_NAME_KEYS)))
        parts = F.split(F.regexp_replace(t, r"^[\[\]]+|[\[\]]+$", ""), r"""["']?\s*,\s*["']?""")
        return (
            F.when(t == "", F.array().cast("array<string>"))
            .when(kind.startswith("ARRAY"), from_list)
            .when(kind.startswith("OBJECT"), from_object)
            .when(d != "", F.array(d))
            .otherwise(_clean_nonempty(parts))
        )

    temps = [x for o in outputs.values() for x in names(o)]
    return staged.withColumns({o: items(o) for o in outputs.values()}).drop(*temps)


def excerpt(value: Column, keyword: Column) -> Column:
    """Cleaned window of 36 characters before / 84 after the first hit, with '...' marks."""
    pos0 = F.instr(F.lower(value), F.lower(keyword)) - 1
    n = F.length(value)
    start = F.greatest(F.lit(0), pos0 - dims.EXCERPT_BEFORE)
    end = F.least(n, pos0 + dims.EXCERPT_AFTER)
    body = clean_evidence_text(F.substring(value, start + 1, end - start))
    return F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), body,
                    F.when(end < n, F.lit("...")).otherwise(F.lit("")))


def _snippet_texts(field: str, items: str | None, keywords: str) -> Column:
    """Per keyword hit (keyword order): a structured match (up to 3 items joined by
    ', ') or an excerpt of the raw text."""
    val = F.coalesce(F.col(field), F.lit(""))

    def text_for(k: Column) -> Column:
        window = excerpt(val, k)
        if items is None:
            return window
        matched = F.slice(F.filter(F.col(items), lambda it: F.lower(it).contains(F.lower(k))),
                          1, dims.STRUCTURED_MATCHES)
        return F.when(F.size(matched) > 0, F.array_join(matched, ", ")).otherwise(window)

    hits = F.filter(F.col(keywords), lambda k: F.lower(val).contains(F.lower(k)))
    return F.transform(hits, text_for)


def _pairs(texts: str) -> Column:
    return F.transform(F.col(texts), lambda e: F.struct(
        e.alias("e"), F.regexp_replace(F.lower(e), r"(?U)\W+", "").alias("n")))


def _kept_snippets(pairs: str, label: str) -> Column:
    """De-duplicated inside the field by alphanumeric form, empty ones skipped, labelled."""
    p = F.col(pairs)
    kept = F.filter(p, lambda x, i: (x["e"] != "") & ~F.exists(
        F.slice(p, 1, i), lambda y: (y["e"] != "") & (y["n"] == x["n"])))
    return F.transform(kept, lambda x: F.concat(F.lit(label + ": "), x["e"]))


def with_field_snippets(df: DataFrame, field: str, items: str | None, keywords: str, label: str,
                        out: str) -> DataFrame:
    """`out` = snippets of one field."""
    texts, pairs = f"{out}__x", f"{out}__p"
    return (df.withColumn(texts, _snippet_texts(field, items, keywords))
            .withColumn(pairs, _pairs(texts))
            .withColumn(out, _kept_snippets(pairs, label))
            .drop(texts, pairs))


def with_evidence(df: DataFrame, keywords: Column, out: str = "evidence") -> DataFrame:
    """All snippets of each row in field order, first three kept (each stage is one
    projection over all four fields)."""
    kw = f"{out}__kw"
    item_cols = {n: f"{out}__it_{n}" for n, _ in dims.EVIDENCE_FIELDS if n in STRUCTURED_FIELDS}
    staged = with_evidence_items_many(df.withColumn(kw, keywords), item_cols)
    fields = [(n, label, f"{out}__sn_{n}") for n, label in dims.EVIDENCE_FIELDS]
    staged = staged.withColumns({f"{sn}__x": _snippet_texts(n, item_cols.get(n), kw) for n, _, sn in fields})
    staged = staged.withColumns({f"{sn}__p": _pairs(f"{sn}__x") for _, _, sn in fields})
    staged = staged.withColumns({sn: _kept_snippets(f"{sn}__p", label) for _, label, sn in fields})
    temps = [kw, *item_cols.values()] + [x for _, _, sn in fields for x in (sn, f"{sn}__x", f"{sn}__p")]
    return (staged.withColumn(out, F.slice(F.concat(*[F.col(sn) for _, _, sn in fields]), 1,
                                           dims.EVIDENCE_PER_RESULT))
            .drop(*temps))
