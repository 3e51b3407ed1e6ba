import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.models import plugins
from docweave.operators import documents, graph
from docweave.operators.flatten import PAPER_TABLES, Encoding, Flat, flatten, positions
from docweave.plans import pipeline
from docweave.session import hash_sample, sized_join
from docweave.sources import jsonl, papers
from docweave.streaming import incremental

A = {"id": "p1", "title": "T", "full_text": [{"section_name": "S", "paragraphs": ["one two", None, " "]}, None, {"section_name": "", "paragraphs": ["three"]}], "qas": [{"question": "q?", "question_id": "", "answers": [{"annotation_id": "", "worker_id": "w", "answer": {"free_form_answer": "x", "evidence": ["one  two", None]}}, {"annotation_id": "z", "answer": None}]}]}
B = {"title": "U", "full_text": {"section_name": ["S"], "paragraphs": [["four"], ["five", "six"]]}, "qas": {"question": ["a", "b"], "question_id": ["k"], "answers": [{"answer": [{"yes_no": True}, None], "annotation_id": [""], "worker_id": []}]}}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("papers")
    (d / "a.jsonl").write_text(json.dumps(A) + "\n\n" + json.dumps(B) + "\n")
    (d / "m.json").write_text(json.dumps({"p1": {**A, "id": "own"}, "p2": B, "bad": 3}))
    (d / "l.json").write_text(json.dumps([A, B]))
    return d


def test_both_encodings(spark, loaded):
    p = papers.read_jsonl(spark, str(loaded / "a.jsonl"))
    assert p.count() == 2
    s = [(r["section_index"], r["section_title"]) for r in documents.sections(p).orderBy("paper_seq", "section_index").collect()]
    assert s == [(0, "S"), (2, "Section 3"), (0, "S"), (1, "Section 2")]
    n = documents.nodes(p).orderBy("paper_seq", "node_id").collect()
    assert [r["text"] for r in n] == ["one two", "three", "four", "five", "six"]
    assert [r["paragraph_frac"] for r in n] == [0.0, 1.0, 0.0, 0.5, 1.0]
    a = [(r["question_id"], r["annotation_id"], r["normalized_answer"]) for r in documents.answers(p).orderBy("paper_seq", "question_index", "answer_index").collect()]
    assert a == [("q0", "q0_a0", "x"), ("q0", "z", "unanswerable"), ("k", "", "yes"), ("k", "k_a1", "unanswerable")]


def test_json_documents(spark, loaded):
    m = {r["id"]: r["paper_id"] for r in papers.read_json(spark, str(loaded / "m.json")).collect()}
    assert m == {"own": "p1", "p2": "p2"}
    assert papers.read_json(spark, str(loaded / "l.json")).count() == 2
    assert papers.resolve("dev", [str(loaded)], pattern="{split}.json") is None
    assert papers.resolve("dev", [str(loaded)], pattern="m.json", spark=spark) == f"{loaded}/m.json"


def test_sequences_over_files(spark, tmp_path):
    """Several files, several parts, missing lines: numbers from 1 without holes, a limit is exact."""
    lines = [{**A, "id": f"p{i:03}"} for i in range(40)]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(x) + "\n\n" for x in lines[:25]) + "broken\n")
    (tmp_path / "b.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines[25:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        p = papers.read_jsonl(spark, f"file:{tmp_path}/*.jsonl")
        assert p.rdd.getNumPartitions() > 2
        assert [(r["paper_seq"], r["id"]) for r in p.orderBy("paper_seq").select("paper_seq", "id").collect()] == [(i + 1, x["id"]) for i, x in enumerate(lines)]
        assert documents.prefix(p, 7, "paper_seq").count() == 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for k in (0, 1):
        (tmp_path / f"l{k}.json").write_text(json.dumps([7, *lines[2 * k : 2 * k + 2]]))
    got = papers.read_json(spark, str(tmp_path / "*.json"))
    assert sorted((r["paper_seq"], r["id"]) for r in got.select("paper_seq", "id").collect()) == [(i + 1, f"p{i:03}") for i in range(4)]
    assert papers.read_json(spark, str(tmp_path / "l0.json")).where("paper_seq <= 1").count() == 1


def brute(paper):
    """The rows of p5 for one paper, in plain Python."""
    out = []
    ft, qs = paper["full_text"], paper["qas"]
    if isinstance(ft, list):
        secs = [(i, s["paragraphs"]) for i, s in enumerate(ft) if s]
    else:
        n, ps = ft["section_name"], ft["paragraphs"]
        secs = [(i, ps[i] if i < len(ps) else None) for i in range(max(len(n), len(ps)))]
    for i, ps in secs:
        out.append(("section", i, -1, -1))
        out += [("paragraph", i, j, -1) for j, x in enumerate(ps or []) if x is not None]
    if isinstance(qs, list):
        for i, q in enumerate(qs):
            if q:
                out.append(("question", i, -1, -1))
                for j, a in enumerate(q["answers"] or []):
                    if a:
                        out.append(("answer", i, j, -1))
                        for kind, f in (("span", "extractive_spans"), ("evidence", "evidence")):
                            out += [(kind, i, j, k) for k, x in enumerate((a["answer"] or {}).get(f) or []) if x is not None]
    else:
        for i in range(len(qs["question"])):
            out.append(("question", i, -1, -1))
            b = qs["answers"][i] if i < len(qs["answers"]) else {}
            for j, a in enumerate(b.get("answer") or []):
                out.append(("answer", i, j, -1))
                for kind, f in (("span", "extractive_spans"), ("evidence", "evidence")):
                    out += [(kind, i, j, k) for k, x in enumerate((a or {}).get(f) or []) if x is not None]
    return sorted(out)


def test_flatten_against_brute_force(spark, loaded):
    p = papers.read_jsonl(spark, str(loaded / "a.jsonl")).withColumn("piece", F.lit("clash"))
    got = {}
    for r in positions(p, "paper_seq", PAPER_TABLES).collect():
        got.setdefault(r["paper_seq"], []).append(tuple(r)[1:])
    assert sorted(map(sorted, got.values())) == sorted([brute(A), brute(B)])
    q = flatten(p, "paper_seq", PAPER_TABLES["question"]).orderBy("paper_seq", "question").collect()
    assert [(r["question_text"], r["question_id"]) for r in q] == [("q?", ""), ("a", "k"), ("b", None)]


def test_flatten_empty_and_null(spark):
    d = spark.createDataFrame([(1, None), (2, []), (3, [["x", None], None, []]), (3, [["y"]])], "k long, a array<array<string>>")
    t = Flat(("i", "j"), {"v": "string"}, (Encoding((("a[][]", False),), {"v": "a[][]"}),))
    assert sorted(map(tuple, flatten(d, "k", t).collect())) == [(3, 0, 0, "x"), (3, 0, 0, "y")]
    assert flatten(d.where("k > 9"), "k", t).count() == 0


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "id string, skip_reason string, record_seq long")
    jsonl.write_kept_and_skipped(df, str(tmp_path / "k"), str(tmp_path / "s"))
    assert jsonl.read(spark, str(tmp_path / "k"), "id string, record_seq long").count() == 1
    jsonl.write(df, str(tmp_path / "all"))
    jsonl.write(df, str(tmp_path / "all"), append=True)
    assert jsonl.count_lines(spark, str(tmp_path / "all")) == 4 and jsonl.count_lines(spark, str(tmp_path / "all"), 3) == 3
    assert "null" in "".join(p.read_text() for p in (tmp_path / "all").glob("*.json"))
    assert jsonl.done_ids(spark, [str(tmp_path / "all"), str(tmp_path / "none")]).count() == 2
    assert jsonl.done_ids(spark, [f"file:{tmp_path}/all", f"file:{tmp_path}/none"]).count() == 2
    assert jsonl.done_ids(spark, [f"file:{tmp_path}/none"]).count() == 0
    with pytest.raises(FileNotFoundError):
        jsonl.require([f"file:{tmp_path}/none"], "stage", spark)
    jsonl.require([f"file:{tmp_path}/all"], "stage", spark)
    (tmp_path / "odd").write_text('{"id": "a"}\n{"x": 1}\n')
    with pytest.raises(Exception, match="has no id.*odd"):
        jsonl.done_ids(spark, [str(tmp_path / "odd")]).collect()
    assert jsonl.jobs(["a"], ["b"]) == [("a", "b")]
    with pytest.raises(ValueError):
        jsonl.jobs(["a"], [])
    jsonl.save_document({"a": np.float32(1.5), "b": np.arange(2)}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1.5, "b": [0, 1]}


def test_append_is_once_per_key(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, v int").write.parquet(str(src))
    for k in (0, 1):
        stream = spark.readStream.schema("id string, v int").parquet(str(src))
        incremental.append_new(stream, str(tmp_path / "out"), str(tmp_path / f"c{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_long_texts_are_embedded_whole():
    long = "same " * 256
    a, b = plugins.HashingEmbedder().embed([long, long + "other words at the end"])
    assert a.tolist() != b.tolist()
    a, b = plugins.HashingEmbedder(most=256).embed([long, long + "other words at the end"])
    assert a.tolist() == b.tolist()


def test_plugins(spark):
    texts = spark.createDataFrame([("a b",), ("a b",), (None,), ("c",)], "text string")
    v = plugins.embed_texts(texts, plugins.HashingEmbedder(8)).collect()
    assert len(v) == 2 and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-5 for r in v)

    class Fixed:
        def generate(self, prompts, seed=None):
            return ["results" if "previous" in p else "nothing" for p in prompts]

    out = plugins.label_with_retries(texts.where("text IS NOT NULL"), Fixed(), lambda p, bad: "previous " + p, column="text").collect()
    assert {(r["link_label"], r["attempts"]) for r in out} == {("RESULTS", 2)}
    logits = np.zeros((1, 3, 4))
    assert plugins.sequence_log_probs(logits, np.array([[-100, 1, 2]]))[0] == pytest.approx(-2 * np.log(4))
    batch = plugins.pad_pairs([[1], [1, 2]], [[3], [4, 9]], 0, 9)
    assert batch["input_ids"].tolist() == [[1, 3, 9, 0], [1, 2, 4, 9]] and batch["labels"].tolist() == [[-100, 3, 9, -100], [-100, -100, 4, 9]]
    assert plugins.max_length(10**6, 512) == 512 and plugins.max_length(None, None) == 0


def test_pipeline(spark, loaded):
    p = pipeline.prepare(papers.read_jsonl(spark, str(loaded / "a.jsonl")))
    assert p.records.count() == 4 and p.edges.count() == 6
    scores, seeds = pipeline.retrieve(p, plugins.HashingEmbedder())
    assert scores.count() == 2 + 3 and seeds.count() == scores.count()  # once per question
    assert pipeline.route(p, scores).count() == 2 * 2 + 2 * 3  # for all annotations
    assert pipeline.link(p, plugins.ExtractiveGenerator()).count() == 6
    guess = p.records.select("id", F.lit("x").alias("prediction"), F.array(F.lit(1)).alias("node_ids"))
    rows, means = pipeline.evaluate(p, guess)
    assert rows.count() == 2 and means.first()["answer_f1"] == 0.5
    assert pipeline.prepare(papers.read_jsonl(spark, str(loaded / "a.jsonl")), keep_unanswerable=False).records.count() == 2


def test_sequence(spark):
    df = spark.range(500).selectExpr("id * 7 % 500 AS k").repartition(5)
    got = papers.with_sequence(df, "k").orderBy("record_seq").collect()
    assert [(r["k"], r["record_seq"]) for r in got] == [(i, i + 1) for i in range(500)]


def test_salted_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(300)] + [("b", 1), ("c", 2)], "k string, v int")
    small = spark.createDataFrame([("hot", 1.0), ("b", 2.0)], "k string, x double")
    for most in (10, 0):
        assert sorted(map(tuple, sized_join(big, small, ["k"], max_broadcast_rows=most).collect())) == sorted([("hot", i, 1.0) for i in range(300)] + [("b", 1, 2.0)])
        assert sized_join(big, small, ["k"], "left", most).count() == 302


def test_labels_parse_alike(spark):
    """The form for single texts and the Column form agree."""
    from docweave.functions import text as T

    outputs = ["RESULTS .", "- results.", "method-details", "'OTHER'", " 1) Other; ", "foo", "", None, "(evaluation)", "[ RESULTS ]"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(outputs)], "i int, x string")
    got = {r["i"]: r["label"] for r in df.select("i", T.link_label(F.col("x")).alias("label")).collect()}
    assert [got[i] for i in range(len(outputs))] == [plugins.parse_label(x) for x in outputs]


def test_sample_is_stable(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS x")
    a, b = ({r["id"] for r in hash_sample(f, ["id"], 50).collect()} for f in (df.repartition(3), df.repartition(11, "x")))
    assert a == b and 30 <= len(a) <= 50


def test_links_without_ends(spark):
    nodes = spark.createDataFrame([("p", 1, "t", "a"), ("p", 2, "t", "b")], "paper_seq string, node_id int, section_title string, text string")
    links = spark.createDataFrame([("p", 1, 2), ("p", 2, 9)], "paper_seq string, src int, dst int")
    assert graph.with_endpoints(links, nodes).count() == 1
    assert graph.with_endpoints(links.where("dst = 2"), nodes, strict=True).count() == 1
    with pytest.raises(Exception, match="is no node"):
        graph.with_endpoints(links, nodes, strict=True).collect()
