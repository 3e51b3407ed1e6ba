import pytest
from pyspark.sql import functions as F

from docweave.operators import examples, retrieval


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<int>")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_packed_keeps_everything_or_fails(spark):
    evidence = F.array(arr(2, 3), arr(4))
    assert one(spark, examples.packed(arr(1), evidence, arr(5), arr(6), 6)) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="over the limit"):
        one(spark, examples.packed(arr(1), evidence, arr(5), arr(6), 5))


def test_regions_and_labels(spark):
    assert one(spark, examples.raw_regions(arr(1), arr(2, 3), arr(4), arr(5))) == [-1, -2, -2, -3, -2]
    assert one(spark, examples.suffix_labels(F.lit(2), arr(7, 8))) == [-100, -100, 7, 8]


def test_required_joins(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, 0.5)], "k int, score double")
    with pytest.raises(Exception, match="no score"):
        examples.with_scores(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="no payload"):
        examples.with_payload(a, b, ["k"]).collect()
    assert examples.with_payload(a.where("k = 1"), b, ["k"]).count() == 1


def test_moving_average(spark):
    value = lambda *x: one(spark, examples.moving_average(F.array(*[F.lit(float(v)) for v in x]).cast("array<double>"), 0.5))
    assert value() is None and value(3) == 3.0 and value(4, 2, 0) == 1.5


def test_summary_bundles(spark):
    s = spark.createDataFrame([(1, "a b\n\n c "), (2, " ")], "node_id int, raw_output string")
    r = examples.summary_bundles(s.where("node_id = 1")).first()
    assert (r["node_sum_text"], r["node_sum_tokens"]) == ("a b; c", ["MEM_A_B", "MEM_C"])
    with pytest.raises(Exception, match="empty summary"):
        examples.summary_bundles(s).collect()


def test_links_and_names(spark):
    r = spark.createDataFrame([("a", [(1, 2)]), ("b", [])], "id string, l array<struct<src:int,dst:int>>")
    assert [tuple(x) for x in examples.flatten_links(r, "l", ["id"]).collect()] == [("a", 1, 2)]
    assert examples.name_list(" q, k ,,") == ["q", "k"]
    assert one(spark, retrieval.summary_text(F.lit(" "), F.lit("s"))) == "s" and one(spark, retrieval.summary_text(F.lit("T"), F.lit("s"))) == "T s"
