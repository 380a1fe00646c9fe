"""Longest-match dictionary join (S3-S5) against a plain-Python version."""

import json
import random
from collections import Counter

from carelocus.operators.dictionary import DICTIONARY_SCHEMA, standardize_terms

ENTRIES = [
    ("equipment", "2 D Echo", "2D Echocardiograph", "Imaging Equipment", False),
    ("equipment", "echo  machine", "Echocardiograph", "Imaging Equipment", None),
    ("equipment", "bed", "Hospital Bed", "Medical Furniture", False),
    ("equipment", "24 hour holter", "Holter Monitor", "Diagnostic Equipment", False),
    ("equipment", "holter", "Holter Recorder", None, False),
    ("equipment", "parking", "Parking", None, True),
    ("equipment", "bed parking", "Bed Parking", None, True),
    ("equipment", "BED", "A Bed", "Medical Furniture", True),
    ("services", "test", "Test", "Diagnostic", False),
    ("services", "intestinal resection", "Bowel Resection", "Surgery", False),
]


def brute(text, entries, kind):
    try:
        terms = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if not isinstance(terms, list):
        return None
    table = {}
    for k, variant, canonical, category, excluded in entries:
        if k == kind:
            table.setdefault(" ".join(variant.lower().split()), []).append((bool(excluded), canonical, category or ""))
    out = []
    for term in (" ".join(t.lower().split()) for t in terms):
        words, best = term.split(), None
        for n in range(len(words), 0, -1):
            spots = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
            if hits := [g for g in spots if g in table]:
                best = min(table[hits[0]])
                break
        name = " ".join(w.capitalize() for w in words) if best is None else "|".join(x for x in best[1:] if x)
        if term and not (best and best[0]) and name not in out:
            out.append(name)
    return out


def results(spark, rows, kind="equipment", entries=ENTRIES, **more):
    raw = spark.createDataFrame(rows, "unique_id string, equipment string")
    words = spark.createDataFrame(entries, DICTIONARY_SCHEMA)
    got = standardize_terms(raw, words, kind, "equipment", "names", **more).collect()
    return Counter((r.unique_id, r.names) for r in got)


def test_named_terms(spark):
    terms = ["2 D Echo machine", "24 hour holter monitor", "Embedding station", "old holter", "Bed  parking", "2 BED ward", "bed"]
    got = results(spark, [("a", json.dumps(terms))])
    want = ["2D Echocardiograph|Imaging Equipment", "Holter Monitor|Diagnostic Equipment", "Embedding Station", "Holter Recorder", "Hospital Bed|Medical Furniture"]
    assert got == Counter([("a", json.dumps(want, separators=(",", ":")))])
    services = results(spark, [("a", '["Intestinal resection", "Testosterone therapy", "blood test"]')], kind="services", unknown=None)
    assert services == Counter([("a", '["Bowel Resection|Surgery","Test|Diagnostic"]')])


def test_equals_brute_force_on_skewed_lists(spark):
    rng = random.Random(3)
    words = "2 d echo machine bed parking 24 hour holter monitor embedding".split()
    rows = [(f"f{i % 90}", json.dumps([" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(rng.randint(0, 6))])) for i in range(200)]
    rows += [("hot", '["echo machine","echo machine"," "]')] * 100 + [("a", None), ("a", None), ("b", "no json"), ("c", "{}"), ("d", "[]"), (None, '["bed"]')]
    want = Counter()
    for i, text in rows:
        names = brute(text, ENTRIES, "equipment")
        want[i, None if names is None else json.dumps(names, separators=(",", ":"))] += 1
    assert results(spark, rows) == want
    assert results(spark, rows[:0]) == Counter()
    assert results(spark, [("a", '["bed"]')], entries=ENTRIES[8:]) == Counter([("a", '["Bed"]')])
