"""A3/A4 sinks: overwrite with schema replacement and create-or-replace."""

from carelocus.sources.tables import create_or_replace, overwrite_table


def test_overwrite_replaces_schema(spark):
    overwrite_table(spark.createDataFrame([(1, "a")], "id int, v string"), "sink_t")
    overwrite_table(spark.createDataFrame([(2, 3.5, True)], "id int, x double, flag boolean"), "sink_t")
    t = spark.table("sink_t")
    assert t.columns == ["id", "x", "flag"] and t.count() == 1


def test_create_or_replace(spark):
    create_or_replace(spark.createDataFrame([(1,)], "id int"), "ctas_t")
    create_or_replace(spark.createDataFrame([("a", 2)], "k string, n int"), "ctas_t")
    assert [tuple(r) for r in spark.table("ctas_t").collect()] == [("a", 2)]
