import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from odd_rows import nothing, odd  # noqa: F401

from carelocus.llm import language_id, minhash, quality, suffix_tree, toxicity
from carelocus.llm.common import read

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts(odd, nothing):
    for r, (doc, text) in zip(sorted(quality.quality(odd).collect(), key=lambda r: (r.doc_id is None, r.doc_id)), sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda x: (x[0] is None, x[0])), strict=True):
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        assert (r.doc_id, r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (doc, len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality.quality(nothing).count() == 0


def js(p, q):
    half = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * math.log2(a / m) for a, m in zip(x, half, strict=True) if a > 0)
    return math.sqrt(max((part(p) + part(q)) / 2, 0))


def test_quality_distances_and_verdicts(spark, odd):
    """Against plain Python: histograms, references that lean on the whole corpus, distances and `kept`."""
    docs = read(spark, SF, "documents").select("doc_id", "text", "lang").unionByName(odd.select((odd.doc_id + 10**6).alias("doc_id"), "text", "lang"))
    few = docs.filter("lang = 'es'").limit(3).selectExpr("doc_id + 2000000 as doc_id", "text", "'rare' as lang")  # a language of three documents
    rows = docs.unionByName(few).collect()
    hists, own = {}, defaultdict(list)
    for n, (_, text, lang) in enumerate(rows):
        text, words = text or "", WORD.findall(text or "")
        counts = [sum(unicodedata.category(c) == "Lu" for c in text), sum(c in "0123456789" for c in text), sum(c in ".,;:!?'\"()-" for c in text), sum(c in "#*$%&|<>" for c in text)]
        chars = sum(map(len, words))
        counts += [len(text) - chars, max(chars - sum(counts), 0)]
        common = Counter(w.lower() for w in words if w.lower() in quality.COMMON_WORDS)
        found = [common[w] for w in quality.COMMON_WORDS]
        found.append(len(words) - sum(found))
        hists[n] = ([x / sum(counts) for x in counts] if sum(counts) else None, [x / len(words) for x in found] if words else None, len(text), len(words), lang)
        if len(text) >= 200 and len(words) >= 50:
            own[lang].append(hists[n][:2])
    every = [h for hs in own.values() for h in hs]
    mean = [[sum(x) / len(every) for x in zip(*(h[k] for h in every), strict=True)] for k in range(2)]

    def reference(lang, k):
        hs = own[lang] if lang else []
        return [round((sum(h[k][i] for h in hs) + 50 * m) / (len(hs) + 50), 9) for i, m in enumerate(mean[k])]

    got = sorted(quality.quality(spark.createDataFrame([(n, t, x) for n, (_, t, x) in enumerate(rows)], "doc_id long, text string, lang string")).collect())
    assert [r.doc_id for r in got] == list(range(len(rows)))
    for r in got:
        chars, words, n_chars, n_words, lang = hists[r.doc_id]
        want = (js(chars, reference(lang, 0)) if n_chars >= 200 else None, js(words, reference(lang, 1)) if n_words >= 50 else None)
        for a, b in zip((r.char_distance, r.word_distance), want, strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)
        diverges = (want[0] or 0) > 0.25 or ((want[0] or 0) > 0.14 and (want[1] or 0) > 0.28)
        assert r.kept == (not r.base_failed and not diverges)


def test_quality_keeps_good_documents(spark):
    rows = quality.quality(read(spark, "/root/testdata/sf0.01", "documents")).join(read(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.3 * len(bad)


def test_language(spark, odd, nothing):
    rows = language_id.identify(read(spark, "/root/testdata/sf0.01", "documents")).join(read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[0].score == 0
    assert language_id.identify(nothing).count() == 0


def test_codes_are_apart():
    for n in (2, 4, 7, 20):
        code = language_id.code_matrix(n)
        assert min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= (1 if n == 2 else 2 if n == 3 else 4)


def test_toxicity(spark, odd, nothing):
    clean = ["the cat sat on the mat near a house number %d" % i for i in range(200)]
    toxic = [c + " you wretched villain" for c in clean]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*clean, *toxic])] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(400)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(400) if rows[i].held_out]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].predicted == int(i >= 200) for i in held) and rows[900].score == rows[901].score
    assert all(r.score == 0 for r in toxicity.toxicity(odd, labels.filter("toxic = 0")).collect())
    assert toxicity.toxicity(nothing, labels).count() == 0


def plain_kneser_ney(rows, level):
    """(p, words, heads): p(c, word before or None, word or "?") of the pruned models, counted and summed plainly."""
    split = [(re.findall(r"[^\W_]+", t.lower()), y) for t, y in rows]
    seen, texts, pair_texts = ([Counter(), Counter()] for _ in range(3))
    for words, y in split:
        pairs = list(zip([None, *words], words, strict=False))
        seen[y].update(pairs)
        texts[y].update(set(words))
        pair_texts[y].update(set(pairs))
    vocabulary, every = set(texts[0]) | set(texts[1]), set(seen[0]) | set(seen[1])
    n = [sum(y == c for _, y in split) for c in (0, 1)]

    def estimate(counts):
        one, two = (sum(v == k for v in counts.values()) for k in (1, 2))
        return one / (one + 2 * two) if one and two else 0.5

    def g(part, whole):
        total = 0
        for xs in (part, [w - x for x, w in zip(part, whole, strict=True)]):
            total += sum(x * math.log(x / (sum(xs) * w / sum(whole))) for x, w in zip(xs, whole, strict=True) if x)
        return 2 * total

    after = [Counter(w for _, w in seen[0]), Counter(w for _, w in seen[1]), Counter(w for _, w in every)]
    d, d_pair = [estimate(x) for x in after], [estimate(x) for x in seen]
    mass = [sum(min(x, d[c]) for x in after[c].values()) for c in range(3)]
    shared = lambda w: (max(after[2][w] - d[2], 0) + mass[2] / (len(vocabulary) + 1)) / after[2].total()
    own = lambda c, w: (max(after[c][w] - d[c], 0) + mass[c] * shared(w)) / after[c].total()
    kept = [w for w in vocabulary if g([texts[0][w], texts[1][w]], n) > level]
    factor = [(1 - sum(own(c, w) for w in kept)) / (1 - sum(shared(w) for w in kept)) for c in (0, 1)]
    word = lambda c, w: own(c, w) if w in kept else factor[c] * shared(w)
    apart = {e for e in every if g([pair_texts[0][e], pair_texts[1][e]], [texts[0][e[1]], texts[1][e[1]]]) > level}

    def full(c, v, w):
        history = {e: k for e, k in seen[c].items() if e[0] == v}
        if not history:
            return word(c, w)
        return (max(seen[c][v, w] - d_pair[c], 0) + sum(min(k, d_pair[c]) for k in history.values()) * word(c, w)) / sum(history.values())

    def p(c, v, w):
        if (v, w) in apart:
            return full(c, v, w)
        mine = [x for h, x in apart if h == v]
        return word(c, w) * (1 - sum(full(c, v, x) for x in mine)) / (1 - sum(word(c, x) for x in mine))

    return p, vocabulary, kept, apart


def test_toxicity_models(spark):
    """Every probability of the pruned models against plain counting; those of a history sum to 1."""
    draw = random.Random(5)
    rows = []
    for i in range(120):
        words = [draw.choice("abcdefghij") + draw.choice("xyz") for _ in range(draw.randint(1, 30))]
        if i % 3 == 0:
            words += ["vile", draw.choice(["ax", "vile"]), "by", "cz"]
        rows.append((" ".join(words), int(i % 3 == 0)))
    rows += [("by cz", 0)] * 9
    for level in (toxicity.LEVELS[0], 3.0):
        p, vocabulary, kept, apart = plain_kneser_ney(rows, level)
        assert kept and apart
        for c in (0, 1):
            for v in [None, "vile", "by", "?", *(h for h, _ in apart)]:
                assert math.isclose(sum(p(c, v, w) for w in [*vocabulary, "?"]), 1)
        model = toxicity.ClassModels(toxicity.counted(spark.createDataFrame(rows, "_text string, _toxic int"), level), level)
        assert (len(model.words), len(model.pairs)) == (len(kept), len(apart))
        gap = lambda v, w: math.log(p(1, v, w) / p(0, v, w))
        texts = [t for t, _ in rows] + ["vile unknown vile by", "", "Unknown"]
        for text, x in zip(texts, model.evidence(texts), strict=True):
            words = [w if w in vocabulary else "?" for w in text.lower().split()]
            assert math.isclose(x, sum(map(gap, [None, *words], words)) / len(words) if words else gap("?", "?"), rel_tol=1e-9, abs_tol=1e-12)


def test_toxicity_sample(spark):
    """Of each class the rows of the smallest hashes, up to so many rows and characters."""
    docs = spark.createDataFrame([(i, "w" * (1 + i % 7)) for i in range(200)], "doc_id long, text string")
    known = docs.selectExpr("doc_id AS _id", "CAST(doc_id % 2 AS int) AS _toxic", "xxhash64(doc_id) AS _order")
    order = sorted(known.collect(), key=lambda r: r._order)
    got = {r._id for r in toxicity.sampled(docs, known, "doc_id", "text", 60, 6, 100).collect()}
    for c in (0, 1):
        want, so_far = set(), 0
        for r in [r for r in order if r._toxic == c][:60]:
            if r._id % 7 < 6:
                so_far += 1 + r._id % 7
                want |= {r._id} if so_far <= 100 else set()
        assert want and want == {i for i in got if i % 2 == c}


def brute_components(texts, k_words=4):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + k_words]) for k in range(len(w) - k_words + 1)} if len(w) >= k_words else ({tuple(w)} if w else set())
    least = {i: i for i in texts}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= (least[a], least[b]) != (low, low)
            least[a] = least[b] = low
    return {i: (len(sets[i]), least[i]) for i in texts}


def test_near_duplicates(spark, odd, nothing):
    docs = read(spark, SF, "documents")
    want = brute_components({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()} == want
    rows = {r.doc_id: r for r in minhash.near_duplicates(odd).collect()}
    assert rows[10].component_id == rows[11].component_id == 10 and not rows[11].kept and rows[0].kept and not rows[None].kept
    assert minhash.near_duplicates(nothing).count() == 0


def test_chain_of_near_copies(spark):
    """Long posting lists with many components: copies that drift away from the first one."""
    base = [f"w{i}" for i in range(80)]
    texts, now = {}, list(base)
    for i in range(150):
        now = list(now)
        now[(i * 7) % 80] = f"x{i}"
        texts[i] = " ".join(now if i % 3 else [*base[:40], *(f"y{i}_{k}" for k in range(8)), *base[48:]])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()} == brute_components(texts)


def test_units_of_a_long_list_are_bounded(spark):
    """All pairs of different components meet once, in units of about two blocks, though most classes are minor."""
    size, part = 3000, [0 if i % 10 == 0 else i for i in range(3000)]
    rows = [(7, i, part[i], part[i] == 0, size, sum(p > 0 for p in part)) for i in range(size)] + [(8, i, i, i == 0, 40, 39) for i in range(40)]
    units = defaultdict(list)
    for r in minhash.block_units(spark.createDataFrame(rows, "token long, a long, part long, major boolean, size long, n_minor long")).collect():
        units[r.token, r.low, r.high].append(r)
    assert max(map(len, units.values())) < 2.5 * minhash.BLOCK
    met = Counter()
    for (token, low, high), unit in units.items():
        home, there = [r for r in unit if r.own == low], [r for r in unit if r.own == high]
        met.update((token, *sorted((x.a, y.a))) for x in home for y in there if x.part != y.part and (low != high or y.a > x.a))
    want = {(7, a, b) for a, b in itertools.combinations(range(size), 2) if part[a] != part[b]} | {(8, a, b) for a, b in itertools.combinations(range(40), 2)}
    assert met.keys() == want and set(met.values()) == {1}


def test_shared_passage_over_blocks(spark):
    """Hundreds of texts that share a passage but are no near-duplicates, some of them in near copies, over several blocks."""
    passage = [f"w{i}" for i in range(60)]
    texts = {i: [*passage, *(f"r{i}_{k}" for k in range(30 + i % 3))] for i in range(560)}
    for i in range(560, 700):
        texts[i] = [*texts[i - 430][:-1], f"z{i}"]
    docs = {i: " ".join(w) for i, w in texts.items()}
    got = minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


@pytest.mark.parametrize("block", [50, 100_000])
def test_suffix_tree_base(spark, odd, block):
    rows = {r.doc_id: r for r in suffix_tree.score(odd, block_tokens=block, bucket_tokens=200).collect()}
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    tokens = {i: [*WORD.findall(t.translate({c: c + 32 for c in range(65, 91)})), None] for i, t in texts.items()}
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = defaultdict(int)
    for i, w in tokens.items():
        for x in w:
            counts[x] += not held[i]
    n, v = sum(counts.values()), sum(c > 0 for c in counts.values())
    import math

    for i, w in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score <= 0 and sum(r.n_states) == len(w)


def test_suffix_tree_beats_its_base(spark, nothing):
    rows = suffix_tree.score(read(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").collect()
    assert sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)
    assert suffix_tree.score(nothing).count() == 0
