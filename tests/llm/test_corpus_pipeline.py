"""Every stage of the corpus pipeline, and the whole, on rows with null and repeated ids."""

from collections import Counter

import corpus_pipeline
from test_documents import brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in a is that it for on was with as by this at are from be".split()
CLEAN = [" ".join([*(f"{WORDS[(k * 7 + i) % 20]} thing{i}x{k}" for k in range(40)), "near the house."]) for i in range(60)]
JUNK = "too short"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def rows_of(df):
    assert df.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_quality_stage_judges_rows(spark):
    rows = [*enumerate(CLEAN), (None, CLEAN[0] + " again"), (None, JUNK), (5, JUNK), (70, None)]
    got = rows_of(corpus_pipeline.quality_rules(spark, table(spark, rows), ""))
    assert got == Counter([*enumerate(CLEAN), (None, CLEAN[0] + " again")])


def test_toxic_stage_judges_rows(spark, tmp_path):
    clean = [(i, f"the cat sat on the mat near a house number {i}") for i in range(200)]
    toxic = [(200 + i, t + " you wretched villain") for i, t in clean]
    spark.createDataFrame([(i, int(i >= 200)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = [(None, "the cat sat on a mat"), (None, None)]
    rows = [*clean, *toxic, *more, (None, toxic[3][1]), (7, toxic[7][1])]
    assert rows_of(corpus_pipeline.toxic_content(spark, table(spark, rows), str(tmp_path))) == Counter([*clean, *more])


def test_near_duplicate_stage_keeps_one_row_a_group(spark):
    near = CLEAN[1] + " indeed"
    rows = [(9, CLEAN[0]), (4, CLEAN[0]), (4, CLEAN[0]), (None, CLEAN[0]), (6, CLEAN[1]), (6, near), (6, CLEAN[2]), (None, CLEAN[3]), (None, CLEAN[3]), (None, None), (3, ""), (3, "")]
    groups = {}
    for k, (_, c) in brute_components({k: t for k, (_, t) in enumerate(rows)}, corpus_pipeline.SHINGLE).items():
        groups.setdefault(c, []).append(k)
    want = Counter((rows[k][0], rows[k][1]) for g in groups.values() for k in [min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))])
    assert rows_of(corpus_pipeline.near_duplicates(spark, table(spark, rows).coalesce(1), "")) == want


def test_run_keeps_rows_without_an_id(spark, tmp_path):
    rows = [*enumerate(CLEAN), (None, CLEAN[59] + " and others"), (None, CLEAN[4]), (3, CLEAN[3]), (2, JUNK)]
    rows[59] = (59, JUNK)
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).filter("start = 0").collect())
    assert out == Counter([*range(59), None])


def test_row_keys_move_no_texts(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/docs")
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        rows = corpus_pipeline.keyed(spark.read.parquet(f"{tmp_path}/docs"))
        assert len({r._row for r in rows.collect()}) == 40
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
