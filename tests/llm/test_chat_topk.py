import itertools
import math

import numpy as np
import pytest

from carelocus.llm import chat, topk
from carelocus.llm.common import read


def legal(roles):
    state = chat.START
    for r in roles:
        if r not in chat.NEXT[state]:
            return False
        state = r
    return state == 2


def brute_cost(codes):
    """Least cost over all labels, merges and single insertions before each turn."""
    best = math.inf
    for labels in itertools.product(range(3), repeat=len(codes)):
        base = sum(chat.RELABEL for a, b in zip(labels, codes, strict=True) if a != b)
        for how in itertools.product(("new", "merge", 0, 1, 2), repeat=len(codes)):
            roles, cost = [], base
            for role, h in zip(labels, how, strict=True):
                if h == "merge":
                    if not roles or roles[-1] != role:
                        break
                    cost += chat.MERGE
                    continue
                if h != "new":
                    roles.append(h)
                    cost += chat.INSERT
                roles.append(role)
            else:
                for tail in ((), (2,), (1, 2)):
                    if legal([*roles, *tail]):
                        best = min(best, cost + chat.INSERT * len(tail))
    return best


@pytest.mark.parametrize("codes", [c for n in (1, 2, 3) for c in itertools.product((-1, 0, 1, 2), repeat=n)])
def test_repair_is_cheapest(codes):
    states = chat.border_states([chat.stretch_costs(list(codes))])
    cost = chat.stretch_costs(list(codes))[chat.START, states[-1]] + chat.close_cost(states[-1])
    assert cost == brute_cost(codes)
    halves = chat.border_states([chat.stretch_costs(list(codes[:1])), chat.stretch_costs(list(codes[1:]))])
    assert halves[-1] == states[-1]


def test_chats_end_to_end(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, "user", "a"), (1, 2, "user", "b"), (2, 0, None, None), (None, 0, "user", "x"), (None, 0, "user", "x"), *((3, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(400))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    out = chat.format_chats(df)
    text = {r.conv_id: r.text for r in chat.rendered(out).collect()}
    assert text[3] == "<|end|>\n".join(f"<|{'user' if i % 2 == 0 else 'assistant'}|>\n{i}" for i in range(400)) + "<|end|>\n"
    assert text[None] == "<|user|>\nx<|end|>\n<|assistant|>\nx<|end|>\n" and text[2].endswith("<|end|>\n")
    shown = [r for r in out.filter("conv_id = 1").collect() if r.action == "insert"]
    assert {r.role for r in shown} <= {"user", "assistant"}
    assert chat.format_chats(df.filter("false")).count() == 0


def brute_top(rows, every, k):
    fine = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in fine:
        if q % every == 0:
            scores = sorted((-int(sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=False))), i) for i, b in fine if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=8) * r.choice([0.1, 1, 5])).tolist()) for i in range(400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (None, [1.0] * 8), (405, [0.0] * 8), (406, []), (407, rows[3][1]), (408, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, squared int, q string")
    for block in (16, 2048):
        got = {}
        for x in sorted(topk.top_k(df, query_every=10, block=block, query_block=7).collect(), key=lambda x: (x.query_id, x.rank)):
            got.setdefault(x.query_id, []).append((x.vec_id, x.score))
        assert got == brute_top(rows, 10, 5)
    assert topk.top_k(df.filter("false")).count() == 0


def test_top_k_on_the_table(spark):
    df = read(spark, "/root/testdata/sf0.001", "embeddings")
    got = {}
    for x in sorted(topk.top_k(df).collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert got == brute_top([(r.vec_id, r.embedding) for r in df.collect()], 50, 5)


@pytest.mark.parametrize("shape", ["roles differ", "roles equal"])
def test_turns_of_one_number_stand_alike_in_any_number_of_stretches(spark, shape):
    role = (lambda i: ("user", "assistant", "system", None)[i * 7 % 4]) if shape == "roles differ" else (lambda i: "user")
    df = spark.createDataFrame([(1, i % 20, role(i), f"text {i % 50}") for i in range(120)], "conv_id long, turn long, role string, text string")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            rows = chat.format_chats(df.repartition(n)).orderBy("part", "place").collect()
            found.append(([(r.turn, r.fragment.split("|>\n")[-1].strip()) for r in rows if r.turn is not None], sum(r.action == "insert" for r in rows), sum("merge" in r.action for r in rows), sum("relabel" in r.action for r in rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0][0] == found[1][0] == found[2][0]  # one order of turns
    cost = [chat.INSERT * i + chat.MERGE * m + chat.RELABEL * r for _, i, m, r in found]
    assert cost[0] == pytest.approx(cost[1]) == pytest.approx(cost[2])  # and repairs of the same, least cost


def test_large_components_are_exact(spark):
    base = 3 * 10**6
    rows = [(0, [base / 256 * 256, base / 256 * 256])] + [(i, [base, base + i]) for i in (1, 2, 3, 4)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(df).orderBy("rank").collect()]
    q = [256 * base, 256 * base]
    assert got == [(k + 1, i, q[0] * 256 * base + q[1] * 256 * (base + i)) for k, i in enumerate((4, 3, 2, 1))]
    close = spark.createDataFrame([(i, [5e6, 5e6 + (i % 7) / 256, float(i % 3) / 256]) for i in range(200)], "vec_id long, embedding array<double>")
    ints = [[math.floor(256 * x) for x in v] for v in ([5e6, 5e6 + (i % 7) / 256, float(i % 3) / 256] for i in range(200))]
    want = []
    for q in range(0, 200, 50):
        order = sorted((-sum(a * b for a, b in zip(ints[q], ints[i], strict=True)), i) for i in range(200) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(close).collect()) == want
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e8])], "vec_id long, embedding array<double>"))
