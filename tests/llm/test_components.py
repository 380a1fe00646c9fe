import random

from carelocus.llm import components as cp


def brute(edges):
    least = {}
    for a, b in edges:
        least.setdefault(a, a)
        least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def found(spark, edges):
    return sorted(map(tuple, cp.components(spark.createDataFrame(edges, "a long, b long")).collect()))


def counted(monkeypatch):
    rounds, star = [], cp.star
    monkeypatch.setattr(cp, "star", lambda edges, large: rounds.append(large) or star(edges, large))
    return rounds


def test_components_of_chains_hubs_and_repeats(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(500, 501 + i) for i in range(60)] + [(560, 7)]
    loose = [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)]
    edges = chain + hub + loose + chain[:5] + [(b, a) for a, b in hub[:5]]
    want = brute([e for e in edges if e[0] != e[1]])
    assert found(spark, edges) == sorted(want.items())


def test_stars_are_not_contracted_again(spark, monkeypatch):
    rounds = counted(monkeypatch)
    stars = [(1, 2), (3, 1), (10, 11), (10, 10), (2, 1)]
    assert found(spark, stars) == [(1, 1), (2, 1), (3, 1), (10, 10), (11, 10)]
    assert found(spark, []) == []
    assert rounds == []


def test_a_link_between_stars_takes_one_round(spark, monkeypatch):
    rounds = counted(monkeypatch)
    edges = [(1, 2), (1, 3), (10, 11), (10, 12), (3, 12)]
    assert found(spark, edges) == sorted(brute(edges).items())
    assert len(rounds) <= 4
