import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from odd_rows import nothing, odd  # noqa: F401

from carelocus.llm import common, packing, sentencepiece_codec, token_counts
from carelocus.llm.common import tokenizer_path

PIECES, WORDS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def noise(alphabet, n, longest, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(longest))) for _ in range(n)]


def test_codec_is_the_library(sp):
    enc = sentencepiece_codec.Encoder(sentencepiece_codec.PieceModel(PIECES))
    texts = noise("ab cdeth  \n\n\t▁éñ😀字ß0123<s>…\x00ing", 2000, 60) + noise(" a", 500, 90) + noise("aabth", 500, 300) + noise("abcdefghij", 3, 9000) + [" " * n for n in (1, 15, 16, 31, 64, 500)]
    ids, at = enc.encode(texts)
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]]
        assert own.tolist() == sp.encode(t)
        assert enc.model.decode_bytes(own, np.array([0, len(own)]))[0].decode() == sp.decode(own.tolist())
    r = random.Random(1)
    for _ in range(200):
        own = [r.randrange(262) for _ in range(r.randrange(12))]
        assert enc.model.decode_bytes(np.array(own, np.int64), np.array([0, len(own)]))[0].decode() == sp.decode(own)


def test_codec_and_counts_on_odd_rows(odd, nothing, sp):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    trips = {r.doc_id: r for r in sentencepiece_codec.round_trip(odd, PIECES).collect()}
    counts = {r.doc_id: r for r in token_counts.token_counts(odd, PIECES, chunk_chars=100, overlap_chars=8).collect()}
    assert set(trips) == set(counts) == set(texts)
    for i, t in texts.items():
        ids = sp.encode(t)
        assert (trips[i].n_tokens, trips[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert trips[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert (counts[i].n_tokens, counts[i].n_bytes, counts[i].over_limit) == (len(ids), len(t.encode()), len(ids) > 4096)
    assert sentencepiece_codec.round_trip(nothing, PIECES).count() == token_counts.token_counts(nothing, PIECES).count() == 0
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, PIECES), PIECES).collect()
    assert {r.doc_id: r.text for r in back} == {i: sp.decode(sp.encode(t)) for i, t in texts.items()}


def test_spliced_counts(sp):
    own = token_counts.Counter(PIECES)
    for t in noise("abth ", 300, 300) + noise("abth", 100, 300, 1):
        assert own.count([t], 20, 5)[0] == len(sp.encode(t))


def test_chunks_are_the_library():
    tok = packing.ChunkTokenizer(WORDS)
    for t in noise("ab c'st  \n\t\x01c\u0301\u0345\u03a3\u03c2\u0391 e\u0301\u0130\u0301\U0001F6001.!<|endoftext|>", 1500, 60) + ["a<|endoftext|>b <|startoftext|>"]:
        ids, at = tok.encode([t, t])
        assert ids[: at[1]].tolist() == ids[at[1] :].tolist() == tok.tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("weights", [None, {None: 5.0, "src": 1.0}])
def test_packing_is_whole(odd, weights):
    tok = packing.ChunkTokenizer(WORDS)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packing.pack(odd.repartition(3), WORDS, end_id=2, window=64, weights=weights).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids, at = np.array([*tok.tok.encode(texts[i], add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for w, own in windows.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or (at & (at - 1) == 0 and w >= max(windows) - 6)


def test_mixture_holds_in_every_window():
    totals = [7000, 2000, 1000]
    plan = packing.Schedule(totals, [float(t) for t in totals], 100)
    served = plan.served(plan.begin(np.arange(plan.n_windows + 1)))
    assert (np.diff(served, axis=0) >= 0).all() and (served[-1] == totals).all()
    assert abs(np.diff(served, axis=0) - [70, 20, 10]).max() <= 1


@pytest.mark.parametrize("totals", [[60_000, 25_000, 9, 1], [40_001], [500] * 300])
def test_borders_of_far_rows_are_bounded(totals):
    plan = packing.Schedule(totals, [t / sum(totals) for t in totals], 64)
    all_marks = plan.served(plan.begin(np.arange(plan.n_windows + 1)))
    rng = np.random.default_rng(5)
    for s in {0, len(totals) - 1}:
        cuts = np.unique(np.concatenate([[0, totals[s]], rng.integers(0, totals[s] + 1, min(totals[s], 60))]))
        first, n = cuts[:-1], np.diff(cuts)
        order = rng.permutation(len(first))
        order = order[np.isin(order, [0, len(first) // 2, len(first) - 1])] if s == 0 else order  # rows far apart in the queue
        borders = packing.Borders(plan)
        built = []
        served = plan.served
        plan.served = lambda position: built.append(len(position)) or served(position)
        got = sorted(tuple(int(x) for x in piece) for found in borders.pieces(s, first[order], n[order]) for piece in zip(*found, strict=True))
        plan.served = served
        want = []
        for row, k in enumerate(order.tolist()):
            for w in range(plan.n_windows):
                a, z = max(first[k], all_marks[w, s]), min(first[k] + n[k], all_marks[w + 1, s])
                if z > a:
                    ahead = (all_marks[w + 1, :s] - all_marks[w, :s]).sum()
                    want.append((row, int(a - first[k]), int(z - a), w, int(ahead + a - all_marks[w, s])))
        assert got == sorted(want)
        touched = {w // borders.step for _, _, _, w, _ in want}
        assert len(built) <= 2 * len(touched) + 2 and max(built) <= borders.step + 1
        assert len(borders.blocks) <= borders.keep


def test_caches_of_another_operator_are_dropped(monkeypatch):
    monkeypatch.setattr(common, "_holder", [])
    dropped = []
    for owner in ("a", "a", "b", "a"):
        common.hold(owner, lambda owner=owner: dropped.append(owner))
    assert dropped == ["a", "b"]


def test_packing_nothing(nothing):
    assert packing.pack(nothing, WORDS).count() == 0


@pytest.mark.parametrize("cached", [packing.CACHED_CHUNKS, 50])
def test_words_of_chunks_are_the_library(monkeypatch, cached):
    monkeypatch.setattr(packing, "CACHED_CHUNKS", cached)
    monkeypatch.setattr(packing, "CACHED_WORDS", cached)
    own = packing.ChunkTokenizer(WORDS)
    assert own.by_chunk and own.by_word
    latin = "".join(map(chr, range(256))) + "  ''sstrelvmdABC<|endoftext|>" * 4
    texts = noise(latin, 3000, 14) + noise(latin + "İK̀Σ中😀　 ", 2000, 14, 1)
    texts += ["", " ", "x<|endoftext|>y <|ENDOFTEXT|>", "Straße's WE'LL ÀÉ²½", "µªº" * 500]
    for i in range(0, len(texts), 100):
        ids, at = own.encode(texts[i : i + 100])
        for j, t in enumerate(texts[i : i + 100]):
            assert ids[at[j] : at[j + 1]].tolist() == own.tok.encode(t, add_special_tokens=False).ids
