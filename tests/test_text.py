import pytest
from pyspark.sql import functions as F

from docweave.functions import metrics
from docweave.functions import text as T


def value(spark, column, **row):
    cols = [F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in row.items()]
    return spark.range(1).select(*cols).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw,want", [(None, ""), (" a\t b\x1cc ", "a b c"), ("x  y", "x y")])
def test_compact(spark, raw, want):
    assert value(spark, T.compact(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "text,title,want",
    [
        ("3.1.2", "Results", False),
        ("write a@b.org now", "Results", False),
        ("- short item", "Results", False),
        ("", "Results", False),
        ("Department of Physics", "Section 2", False),
        ("Department of Physics", "Results", True),
        ("A, B, C, D, E", ":::", False),
        ("A, B, C, D, E", "Data", True),
        ("x $^{1}$ y", "Section 1", False),
    ],
)
def test_routable(spark, text, title, want):
    assert value(spark, T.is_routable(F.lit(text), F.lit(title))) is want


def test_answer_precedence(spark):
    kind = "struct<unanswerable:boolean,extractive_spans:array<string>,free_form_answer:string,yes_no:boolean,evidence:array<string>>"
    rows = [
        ((True, ["a"], None, None, None), ("unanswerable", "unanswerable")),
        ((None, ["Foo", "foo", " Bar"], "x", None, None), ("Foo ; Bar", "extractive")),
        ((False, [" "], " x  y ", True, None), ("x y", "free_form")),
        ((None, None, "", False, None), ("no", "yes_no")),
        ((None, [], None, None, None), ("unanswerable", "unanswerable")),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"i int, a {kind}")
    a, k = T.normalized_answer(F.col("a"))
    assert [(r["text"], r["kind"]) for r in df.select("i", a.alias("text"), k.alias("kind")).orderBy("i").collect()] == [r[1] for r in rows]


def test_evidence(spark):
    assert value(spark, T.evidence_texts(F.col("e")), e=["FLOAT SELECTED: t", "A", "a", " "]) == ["A"]


def test_memory_tokens(spark):
    assert value(spark, T.memory_tokens(F.array().cast("array<string>"))) == ["MEM_EMPTY"]
    assert value(spark, T.memory_tokens(F.col("t")), t=["a b", "A-B"]) == ["MEM_A_B"]
    assert value(spark, T.memory_tokens(F.col("t")), t=["x MEM_one, MEM_two", "REL_a"]) == ["MEM_ONE", "MEM_TWO", "MEM_REL_A"]
    assert value(spark, T.token_phrase(F.col("t")), t=["MEM_A_B", "REL_C"]) == "A B ; C"


@pytest.mark.parametrize("raw,want", [("- results.", "RESULTS"), ("method-details", "METHOD_DETAILS"), ("foo", None), (None, None)])
def test_link_label(spark, raw, want):
    assert value(spark, T.link_label(F.lit(raw).cast("string"))) == want


def test_penalties(spark):
    out = "a b c d e f g"
    assert value(spark, T.long_phrase_penalty(F.lit(out))) == 2.0
    assert value(spark, T.long_output_penalty(F.lit("a\nb\nc\nd\ne\nf"))) == 1.0
    assert value(spark, T.leakage_penalty(F.lit("Summary: x\nwrite one phrase per line"))) == 3.5
    assert value(spark, T.leakage_penalty(F.lit("A\rSummary: y"))) == 0.0
    assert value(spark, T.redundancy_penalty(F.lit("a b\nA-B\nc"))) == pytest.approx(1 / 3)


@pytest.mark.parametrize("a,b,want", [("", "", 1.0), ("a", "x", 0.0), ("x x y", "x y y", 2 / 3), (None, "", 1.0)])
def test_token_f1(spark, a, b, want):
    assert value(spark, metrics.token_f1(F.lit(a).cast("string"), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize("a,b,want", [([], [], 1.0), ([1], [], 0.0), ([1, 2], [2, 3], 0.5), ([1, 1], [1], 1.0)])
def test_set_f1(spark, a, b, want):
    arr = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<int>")
    assert value(spark, metrics.set_f1(arr(a), arr(b))) == pytest.approx(want)


def test_no_references(spark):
    f1, em = metrics.best_answer(F.lit("x"), F.array().cast("array<string>"))
    assert value(spark, f1) == 0.0 and value(spark, em) == 0.0


def test_losses(spark):
    x = [F.lit(float(v)) for v in (3, 1, 2, 1)]
    import math

    assert value(spark, metrics.preference_loss(*x)) == pytest.approx(math.log(1 + math.exp(-0.1)))
    assert value(spark, metrics.preference_loss(F.lit(-1e4), F.lit(1e4), F.lit(0.0), F.lit(0.0))) == pytest.approx(2000.0)
