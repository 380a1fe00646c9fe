"""Filter audit, fingerprints and source divergence against plain brute force."""

import hashlib
import itertools
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from odd_rows import nothing, odd  # noqa: F401

from carelocus.llm import filter_audit, source_divergence, syncmers
from carelocus.llm.common import read

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ filter audit
def audit(rows, good, toxic):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    sets = defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        words = WORD.findall(t)
        failed = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t))
        sets[part or ""].append((i, failed + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and first[t] < i)))
    out = []
    for part, docs in sets.items():
        shapley, block = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = docs
            for k, f in enumerate(order):
                gone = [(i, b) for i, b in alive if f in b]
                alive = [x for x in alive if f not in x[1]]
                shapley[f] += len(gone)
                late = sum(f in b and bool(set(order[:k]) & set(b)) for _, b in docs)
                block.append(((part, order, k + 1, len(alive), len(gone), late, sum(b == f for _, b in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)), f))
        out += [(*row, shapley[f]) for row, f in block]
    return sorted(out)


def test_filter_audit(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, 0, 1), (10, None, 1), (None, 1, 1), (777, 1, 1)], "doc_id long, quality int, toxic int")
    again = odd.unionByName(odd.filter("doc_id in (9, 12)"))  # rows that repeat an id
    want = audit([(r.doc_id, r.text, r.source) for r in again.collect()], {1}, {9, 10})
    assert sorted(map(tuple, filter_audit.filter_audit(again, labels).collect())) == want
    assert filter_audit.filter_audit(nothing, labels).count() == 0
    assert {r.good_lost + r.toxic_lost for r in filter_audit.filter_audit(odd, labels.filter("false")).collect()} == {0}


def test_transducer_measures_each_text():
    texts = ["", " ", "a", "Ab ab Ab", "é字😀 é字😀\x85x", "\t\n", "x" * 700 + " " + "x" * 699 + "y " + "x" * 700, "A#b $ |" * 40, "one two", "two one", "ends "]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    m = filter_audit.measures(np.frombuffer(b"".join(data), np.uint8), offsets)
    words = [WORD.findall(t) for t in texts]
    assert m["n_words"].tolist() == [len(w) for w in words] and m["n_distinct"].tolist() == [len(set(w)) for w in words]
    assert m["n_chars"].tolist() == [len(t) for t in texts]
    assert m["n_capitals"].tolist() == [sum("A" <= c <= "Z" for c in t) for t in texts] and m["n_symbols"].tolist() == [sum(c in "#$%&*|" for c in t) for t in texts]


def test_hash_table_compares_words_of_equal_hashes(monkeypatch):
    """All words in one chain of slots, with one hash: their bytes alone tell them apart."""
    make = filter_audit.Spans.__init__

    def clash(self, *args):
        make(self, *args)
        self.hash = np.zeros_like(self.hash)

    monkeypatch.setattr(filter_audit.Spans, "__init__", clash)
    words = ["ab", "ab", "ac", "abcdefgh", "abcdefgi", "abcdefghi", "abcdefghj", "abcdefgh", "z" * 300, "z" * 299 + "y", "z" * 300]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    assert filter_audit.measures(data, np.array([0, len(data)]))["n_distinct"].tolist() == [len(set(words))]


# ------------------------------------------------------------------ fingerprints
def xx(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_fingerprint(text):
    k, s, inner = syncmers.K, syncmers.S, syncmers.INNER
    h = [xx([x]) for x in re.findall(r"[^\x20\x09-\x0D⺀-￿]{1,4}|[⺀-￿]", text)]
    subs = [-(1 << 63)] * (inner - 1) + [xx([a, b]) for a, b in zip([0, *h], h, strict=False)]
    out, last = [], -1
    for i in range(len(h)):
        window = subs[i : i + inner]
        if min(window) in (window[0], window[-1]):
            key = xx([window[j] for j in sorted({*range(0, inner, s), inner - 1})]) >> 36
            out.append((key * 16 + i - last) & 0xFFFFFFFF)
            assert i - last <= inner and k == inner + s - 1
            last = i
    return out


def dice(a, b):
    return 1.0 if not a and not b else 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))


def plain_fingerprints(rows):
    """(id, n_chars, sha, fingerprint, edited, near_edited, near_next) with ids in descending order, null last."""
    place = {}
    for i, t in rows:
        place.setdefault(i, []).append(t or "")
    ids = sorted((i for i in place if i is not None), reverse=True) + ([None] if None in place else [])
    out = []
    for n, i in enumerate(ids):
        need = max(len(t) for t in place[i]) // 3
        following = place[ids[(n + 1) % len(ids)]]
        start = min(t[:need] for t in following)
        after = [plain_fingerprint(t) for t in following if t[:need] == start]
        assert len({tuple(a) for a in after}) == 1
        for t in place[i]:
            third = len(t) // 3
            edited = t[: len(t) - third] + start[:third]
            own, new = plain_fingerprint(t), plain_fingerprint(edited)
            text = lambda a: "".join(f"{x:08x}" for x in a)
            out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(own), text(new), dice(own, new), dice(own, after[0])))
    return sorted(out, key=repr)


def test_fingerprints(spark, odd, nothing):
    again = odd.unionByName(odd.filter("doc_id in (8, 10)"))
    got = sorted(map(tuple, syncmers.fingerprints(again).collect()), key=repr)
    assert got == plain_fingerprints([(r.doc_id, r.text) for r in again.collect()])
    assert syncmers.fingerprints(nothing).count() == 0
    single = syncmers.fingerprints(odd.filter("doc_id = 13")).first()
    assert single.near_next == 1
    one = spark.createDataFrame([("b", "x y", 1), (None, "only one", 2)], "doc_id string, text string, _k int")
    assert sorted(map(tuple, syncmers.fingerprints(one).collect()), key=repr) == plain_fingerprints([("b", "x y"), (None, "only one")])


@pytest.mark.parametrize("joins", ["broadcast", "shuffle"])
def test_fingerprints_of_documents(spark, joins):
    docs = read(spark, SF, "documents")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if joins == "shuffle" else before)
    try:
        got = sorted(map(tuple, syncmers.fingerprints(docs).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == plain_fingerprints([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[5] > 0.5 for r in got) >= 0.97 * len(got) and all(r[5] >= r[6] or r[6] == 1 for r in got)


# ------------------------------------------------------------------ source divergence
def divergences(rows, least=10):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[group].update(terms)
        df[group[0]].update(set(terms))

    def f(a, b):
        return (a - b) * (a - b) // (a + b)

    out = []
    for lang in {g[0] for g in groups}:
        kept, sources = [t for t, d in df[lang].items() if d >= least], [s for g, s in groups if g == lang]

        def p(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        own, whole = {s: p(n[lang, s]) for s in sources}, p(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(f(own[s][t], own[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(own[s][t], whole[t]), t.encode()) for t in kept if n[lang, s][t] and own[s][t] > whole[t])[:10]
            out += [(lang, s, part, o.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, o) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [5, 1 << 14])
def test_source_divergence(spark, block):
    docs = read(spark, SF, "documents")
    odd_ones = [(None, "en", None), ("", None, None), ("words Words élan 字", "xx", "only"), ("ÉLAN élan [x]", "en", "src1"), ("the " * 3000, "en", "src0"), ("", "yy", "a"), (None, "yy", "b")]
    docs = docs.select("text", "lang", "source").unionByName(spark.createDataFrame(odd_ones, "text string, lang string, source string")).withColumn("n", docs["text"])
    got = sorted(map(tuple, source_divergence.source_divergence(docs, block_terms=block).collect()))
    assert got == divergences([(r.text, r.lang, r.source) for r in docs.collect()])
    assert {x for x in got if x[0] == "yy"} == {("yy", "a", "pair", "b", 0, 1), ("yy", "b", "pair", "a", 0, 1)}


def test_source_divergence_of_odd_rows(odd, nothing):
    twice = odd.unionByName(odd).unionByName(odd)
    for least in (1, 3, 1000):
        got = sorted(map(tuple, source_divergence.source_divergence(twice, min_documents=least).collect()))
        assert got == divergences([(r.text, r.lang, r.source) for r in twice.collect()], least)
    assert source_divergence.source_divergence(nothing).count() == 0


def test_runs_and_probabilities_are_exact():
    starts, values = source_divergence.run_length(np.array([1, 2, 3, 7]), np.array([4, 4, 5, 4]), 10)
    assert starts.tolist() == [0, 1, 3, 4, 7, 8] and values.tolist() == [0, 4, 5, 0, 4, 0]
    assert [x.tolist() for x in source_divergence.run_length(np.zeros(0, np.int64), np.zeros(0, np.int64), 3)] == [[0], [0]]
    large = np.array([0, 5 * 10**12, 10**13])
    assert source_divergence.probabilities(large, 2 * 10**13, 1000).tolist() == [1 + 10**9 * (int(c) + 2) // (2 * 10**13 + 2000) for c in large]
