"""Operators with exact results against brute force, and their edge cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.llm import consensus, overlap, packing, splitting, topn

SCORES = "record_id string, paper_id string, node_id int, score double, rank int"


def brute_top(rows, n):
    best = {}
    for g, p, i, s in rows:
        if s is not None and not math.isnan(s):
            k = (g, p, i)
            best[k] = max(best.get(k, -math.inf), s)
    groups = defaultdict(list)
    for (g, p, i), s in best.items():
        groups[g].append((-s, p is not None, p or "", i is not None, i or 0, p, i))
    return {(g, x[5], x[6]) for g, v in groups.items() for x in sorted(v, key=lambda t: t[:5])[:n]}


def test_top_n(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice(["p", "q", None]), rng.choice([*range(30), None]), rng.choice([0.0, -0.0, 0.5, 0.5, rng.random(), None, float("nan")])) for _ in range(3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCORES).repartition(7)
    got = topn.top_n_per_group(df, "record_id", ["paper_id", "node_id"], "score", 12)
    assert got.columns == ["record_id", "paper_id", "node_id", "score"]
    out = [(r[0], r[1], r[2]) for r in got.collect()]
    assert len(out) == len(set(out)) and set(out) == brute_top(rows, 12)


def test_top_n_edges(spark):
    empty = spark.createDataFrame([], SCORES)
    assert topn.top_n_per_group(empty, "record_id", ["paper_id", "node_id"], "score").count() == 0
    assert topn.seed_candidates(empty).count() == 0
    one = spark.createDataFrame([("a", "p", i, 1.0, 0) for i in (3, 1, 2, 1)], SCORES)
    assert [x["node_id"] for x in topn.seed_candidates(one, 2).first()["seed_candidates"]] == [1, 2]
    with pytest.raises(ValueError):
        topn.top_n_per_group(one, "record_id", ["paper_id"], "score", 0)


REFS = "paper_id string, question_id string, annotation_id string, worker_id string, answer_type string, normalized_answer string, evidence_node_ids array<int>, has_text_evidence boolean, submitted_at timestamp"


def refs(spark, rows):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    return spark.createDataFrame([("p", q, a, w, "free_form", x, e, True, t + timedelta(days=d) if d is not None else None) for q, a, w, x, e, d in rows], REFS).withColumn("votes", F.lit("clash"))


def test_consensus_findings(spark):
    rows = [("q1", "a", " W1 ", "Foo; bar", [1, 1, 2], 1), ("q1", "b", "w2", "bar ; FOO!", [2], 1), ("q1", "c", "w3", "other", None, 1), ("q1", "d", None, "other", [9], 1), ("q1", "e", "w1", None, [9], 5), ("q1", "f", "w3", "zz", [3], 0)]
    rows += [(f"r{i}", "a", w, "x" if w != "bad" else f"y{i}", [1], 1) for i in range(12) for w in ("u", "v", "bad")]
    rows += [("few", "a", "u", "x", [1], 1), ("few", "b", "v", "x", [1], 1), ("blank", "a", " ", "x", None, None)]
    made = consensus.consensus(refs(spark, rows + rows[:3]))
    got = {tuple(r) for r in consensus.findings(made).collect()}
    want = {("answer", "p::q1", "bar ; foo"), ("evidence", "p::q1", "2"), ("annotator", "bad", "")}
    want |= {("answer", f"p::r{i}", "x") for i in range(12)} | {("evidence", f"p::r{i}", "1") for i in range(12)}
    assert got == want
    rel = {r["worker"]: r for r in made["annotators"].collect()}
    assert rel["bad"]["reliability"] < 0.6 < rel["u"]["reliability"]
    assert all(r["low"] <= r["reliability"] <= r["high"] for r in rel.values())
    q = {(r["question_id"], r["answer"]): r["q"] for r in made["answers"].collect()}
    assert q["r0", "x"] > 0.8 and abs(sum(v for (i, _), v in q.items() if i == "q1") - 1) < 1e-9


def test_wide_and_packed_updates_agree(spark):
    rng = random.Random(8)
    rows = [(f"q{i}", "a", f"w{j}", rng.choice("xxxyz"), [x for x in range(4) if rng.random() < (0.8 if x < 2 else 0.1)] or None, j) for i in range(25) for j in range(rng.randint(1, 7))]
    df = refs(spark, rows + [(None, "b", "w1", "x", [1], 1)])
    packed, wide = consensus.consensus(df, max_iterations=2), consensus.consensus(df, max_annotators=2, max_iterations=2)
    assert isinstance(consensus.fit(df, max_votes=3, max_iterations=0), consensus.WideConsensus) and isinstance(consensus.fit(df), consensus.Consensus)
    keys = {"answers": ["question_id", "answer"], "evidence": ["question_id", "node"], "annotators": ["worker"], "judged": ["worker"]}
    for name, key in keys.items():
        x, y = ({tuple(r[k] for k in key): r.asDict() for r in m[name].collect()} for m in (packed, wide))
        assert x.keys() == y.keys() and x
        for k in x:
            for c, v in x[k].items():
                assert v == pytest.approx(y[k][c], abs=1e-9), (name, k, c)
    assert {tuple(r) for r in consensus.findings(packed).collect()} == {tuple(r) for r in consensus.findings(wide).collect()}


def test_consensus_parameters_by_brute_force(spark):
    """One update of the answers by plain loops."""
    rows = [("q1", "a", "u", "x", None, 1), ("q1", "a", "v", "x", None, 1), ("q1", "a", "w", "y", None, 1), ("q2", "a", "u", "z", None, 1), ("q2", "a", "w", "t", None, 1)]
    made = consensus.consensus(refs(spark, rows), max_iterations=1)
    share = {("q1", "x"): 2 / 3, ("q1", "y"): 1 / 3, ("q2", "z"): 0.5, ("q2", "t"): 0.5}
    right = {"u": 2 / 3 + 0.5, "v": 2 / 3, "w": 1 / 3 + 0.5}
    wrong = {"u": 1 / 3 + 0.5, "v": 1 / 3, "w": 2 / 3 + 0.5}
    psi = lambda x: float(consensus._digamma(np.array(x)))
    votes = {"q1": [("u", "x"), ("v", "x"), ("w", "y")], "q2": [("u", "z"), ("w", "t")]}
    for r in made["answers"].collect():
        s = {}
        for answer in {a for _, a in votes[r["question_id"]]}:
            s[answer] = sum(psi(right[w] + 4) if a == answer else psi(wrong[w] + 0.5) for w, a in votes[r["question_id"]])
        z = sum(math.exp(v) for v in s.values())
        assert r["q"] == pytest.approx(math.exp(s[r["answer"]]) / z, abs=1e-9)
    assert share and {r["worker"] for r in made["annotators"].collect()} == {"u", "v", "w"}


def test_disputed(spark):
    rows = [(f"r{i}", "a", w, "x" if w not in ("b1", "b2") else f"y{i}{w}", [1], 1) for i in range(20) for w in ("u", "v", "t", "b1", "b2")]
    rows += [("odd", "a", w, a, [1], 1) for w, a in (("u", "x"), ("b1", "z"), ("b2", "z"))]
    made = consensus.consensus(refs(spark, rows))
    assert {(r["subject"], r["found_value"]) for r in consensus.disputed(made).collect()} == {("p::odd", "x"), ("p::odd", "z")}
    assert ("answer", "p::odd", "z") in {tuple(r) for r in consensus.findings(made).collect()}


def test_consensus_empty(spark):
    made = consensus.consensus(refs(spark, []))
    assert consensus.findings(made).count() == 0 and made["annotators"].count() == 0


def test_agreement(spark):
    same = consensus.counted_votes(refs(spark, [(f"q{i}", "a", w, f"x{i % 2}", [], 1) for i in range(6) for w in "uv"]))
    assert consensus.agreement(same).first()["alpha"] == pytest.approx(1.0)


def test_digamma(spark):
    r = spark.createDataFrame([(1.0,), (0.5,), (10.0,)], "x double").select(consensus.digamma(F.col("x"))).collect()
    assert [x[0] for x in r] == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890], abs=1e-8)


RECORDS = "record_seq long, split string, source string, query struct<question:string>, shard string"


def test_overlap_against_brute_force(spark):
    rng = random.Random(2)
    names = ["TayNet", "KOR-7", "KOR-8", "Balmex Corpus", "VelQA"]
    forms = ["Does {a} beat {b}?", "By how many points does {a} beat {b} in the final run?", "Please say, by how many points does {a} beat {b} in the final run?", "by how many points does {a} beat {b} in the final runn?", "Which parser errors does {a} make on {b}?", "On {b}, which parser errors does {a} make?", "What parser  errors does {a} make on {b}", "Who checked the annotations of {a}?", "who checked the annotations of {a}"]
    rows = []
    for i in range(260):
        q = rng.choice(forms).format(a=rng.choice(names), b=rng.choice(names))
        q = rng.choice([q, q, q.lower(), q.upper()])
        rows.append((i, rng.choice(["train", "TRAIN ", "dev", "Test", None]), "s", (rng.choice([q, q, q, q, None, "", "??"]),), "clash"))
    want = set()
    for a in rows:
        for b in rows:
            if a[1] and b[1] and a[1].strip().lower() == "train" != b[1].strip().lower() and a[3][0] and b[3][0]:
                x, y = overlap.parse(a[3][0]), overlap.parse(b[3][0])
                if x and y and overlap.same_question(y, x):
                    want.add((b[0], a[0]))
    df = spark.createDataFrame(rows, RECORDS)
    got = [(r["eval_seq"], r["train_seq"]) for r in overlap.record_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    small = overlap.question_pairs(overlap._sided(df), block_rows=3)
    assert {tuple(r)[:2] for r in small.collect()} == {tuple(r)[:2] for r in overlap.question_pairs(overlap._sided(df)).collect()}
    assert overlap.overlap_report(df).agg(F.sum("records")).first()[0] == sum(1 for r in rows if r[1] and r[1].strip().lower() != "train" and r[3][0] is not None)


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Which layer of KOR-7 is frozen?", "What layer of KOR-7 is frozen?", True),
        ("Which layer of KOR-7 is frozen?", "Which layer of KOR-8 is frozen?", False),
        ("Does TayNet beat VelQA?", "Does VelQA beat TayNet?", False),
        ("Why does TayNet fail on VelQA and KorNet does not?", "Why does KorNet not fail on VelQA and TayNet does?", True),
        ("Why does TayNet fail on VelQA and KorNet does not?", "Why does KorNet fail on VelQA and TayNet does not?", False),
        ("Why does TayNet drop the reader?", "Does TayNet drop the reader?", False),
        ("How many annotators labelled the classifer part of KOR-7?", "How many annotators labelled the classifier part of KOR-7?", True),
        ("How many annotators labelled the reader part of KOR-7?", "How many annotators labelled the router part of KOR-7?", False),
        ("Are the labels of VelQA used by the reader of TayNet?", "Does the reader of TayNet use the labels of VelQA?", True),
    ],
)
def test_same_question(a, b, same):
    assert overlap.same_question(overlap.parse(a), overlap.parse(b)) is same


def pairs_of(spark, *asked):
    rows = [(2 * i + k, split, "s", (q,), "") for i, two in enumerate(asked) for k, (split, q) in enumerate(zip(("train", "dev"), two))]
    return {(r["train_seq"], r["eval_seq"]) for r in overlap.record_pairs(spark.createDataFrame(rows, RECORDS)).collect()}


def test_names_shown_on_one_side(spark):
    asked = [("How does bert compare with GPT?", "How does BERT compare with GPT?"), ("Which tables does the Foo Parser read?", "Which tables does the Foo parser read?"), ("Why does elmo beat VelQA?", "Why does Elmo beat velqa?")]
    assert pairs_of(spark, *asked) >= {(0, 1), (2, 3), (4, 5)}


def test_names_in_another_letter_case(spark):
    asked = [("HOW DO THEY TURN TABLES INTO INPUT FOR CLOSTIPE?", "How do they turn tables into input for Clostipe?"), ("which parser of the velqa corpus beats hessulrus?", "Which parser of the VelQA Corpus beats Hessulrus?"), ("which parser does hessulrus beat on clostipe?", "Which parser does Clostipe beat on Hessulrus?")]
    assert pairs_of(spark, *asked) == {(0, 1), (2, 3)}


def test_long_question_with_a_frequent_name(spark):
    rare = " ".join(f"{a}{b}ol" for a in "bdfgk" for b in ("ami", "emo", "iru", "osa", "uvo", "ylo"))
    q = f"Which layers of Clostipe read {rare} well?"
    usual = [(f"What does Clostipe do with {w}?",) * 2 for w in ("tables", "graphs", "labels", "notes")]
    assert (0, 1) in pairs_of(spark, (q, q.lower()), *usual)


def test_fm_index():
    rng = random.Random(4)
    texts = [[rng.randint(1, 6) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    index = overlap.FmIndex(texts)
    for _ in range(200):
        q = [rng.randint(1, 7) for _ in range(rng.randint(1, 4))]
        text, place = index.locate(*index.search(q))
        got = sorted(zip(text.tolist(), place.tolist()))
        assert got == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - len(q) + 1) if t[k : k + len(q)] == q]
    assert overlap.FmIndex([]).search([1]) == (0, 0)


def test_merged_spans():
    assert overlap.merged_spans([1, 2, 3, 4], [1, 2, 9, 4], [(0, 0)]) == (3, 2)
    assert overlap.merged_spans([1, 2, 3, 4], [3, 4, 1, 2], [(1, 3), (2, 0)]) == (4, 2)
    assert overlap.merged_spans([5, 5, 1], [1, 5, 7], [(2, 0)]) == (2, 1)
    assert overlap.merged_spans([1], [2], []) == (0, 0)


def test_index_decides_the_candidates(monkeypatch):
    q = "Which layer of KOR-7 is frozen while training on VelQA?"
    route, fixed = overlap.parse(q)["route"], "which|0|6"
    rows = pa.table({"question": [q], "route": [route], "key": ["\t".join([fixed, *sorted(route[:2])])]})
    assert overlap._match(None, rows, rows).num_rows == 1
    monkeypatch.setattr(overlap.FmIndex, "locate", lambda self, lo, hi: (np.zeros(0, int), np.zeros(0, int)))
    assert overlap._match(None, rows, rows).num_rows == 0


def test_hyphens_and_short_slips(spark):
    asked = [("Does KOR-7 beat VelQA on Balmex-Wiki runs?", "Does KOR\u20107 beat VelQA on Balmex\u2010Wiki runs?"), ("How do they turn tables of KOR-7 into Vel input?", "How do tey turn tables of KOR-7 into Vel input?")]
    assert pairs_of(spark, *asked) == {(0, 1), (2, 3)}


def test_hot_question_in_blocks_and_classes(spark):
    rows = [(i, "train" if i % 3 else "dev", "s", ("Does KOR-7 beat VelQA?" if i % 5 else f"Does KOR-7 beat Vel{i}?",), "") for i in range(200)]
    df = spark.createDataFrame(rows, RECORDS)
    got = {(r["eval_seq"], r["train_seq"]) for r in overlap.record_pairs(df, block=7).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == "dev" and b[1] == "train" and a[3] == b[3]}
    assert got == want
    pairs, members = (x.collect() for x in overlap.question_classes(df))
    of = defaultdict(set)
    for r in members:
        of[r["side"], r["representative"]].add(r["record_seq"])
    assert {(a, b) for r in pairs for a in of["eval", r["eval_representative"]] for b in of["train", r["train_representative"]]} == want
    assert len(members) == len(rows) and sum(r["eval_copies"] * r["train_copies"] for r in pairs) == len(want)


def test_broadcasts_are_bounded(spark, monkeypatch):
    """Finding pairs broadcasts no texts, whose sum no count of rows bounds; a few wide rows aren't broadcast."""
    sides, join = [], overlap.sized_join
    monkeypatch.setattr(overlap, "sized_join", lambda big, small, *a, **k: sides.append(small) or join(big, small, *a, **k))
    rows = [(i, "train" if i % 2 else "test", "s", (f"Which corpus does the parser number {i // 2} of Norrus read?",), "") for i in range(20)]
    got = {(r["eval_seq"], r["train_seq"]) for r in overlap.record_pairs(spark.createDataFrame(rows, RECORDS), block=1).collect()}
    assert {(i, i + 1) for i in range(0, 20, 2)} <= got
    assert sides and {kind for x in sides for _, kind in x.dtypes} <= {"bigint", "int"}
    big, wide = spark.createDataFrame([("k", 1)], "k string, v int"), spark.createDataFrame([("k", "x" * 3000)], "k string, w string")
    for most, hinted in ((4000, True), (2000, False)):
        made = join(big, wide, ["k"], max_broadcast_bytes=most)
        assert made.count() == 1 and ("strategy=broadcast" in made._jdf.queryExecution().logical().toString()) is hinted


def test_overlap_empty(spark):
    assert overlap.record_pairs(spark.createDataFrame([], RECORDS)).count() == 0


LIMIT = 120


def texts():
    rng = random.Random(5)
    words = ["alpha", "beta.", "gamma", "delta!", "x" * 40, "zwei。", "2 Method", "\n", "\n\n", "- item", "?"]
    out = ["", " ", "a" * 500, "a. " * 300, "\n" * 300, "中" * 90 + "。" + "文" * 130, "Intro\n\n" + "w " * 100 + "\n\nMethod\n\n" + "One two. " * 40]
    return out + [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(200)]


def test_split_round_trip():
    for t in texts():
        for overlap_size in (0, 15, 60):
            pieces = splitting.split_text(t, LIMIT, overlap_size) if len(t) > LIMIT else []
            if not pieces:
                continue
            assert "".join(t[a + o : b] for a, b, o, _ in pieces) == t
            assert all(0 < b - a <= LIMIT and 0 <= o <= overlap_size for a, b, o, _ in pieces)
            if overlap_size:  # the stated overlap, but where a sentence leaves no room
                for (c, *_), (a, b, o, _) in zip(pieces, pieces[1:]):
                    room = min(overlap_size, LIMIT - (b - a - o), a + o - c - 1)
                    assert room // 2 <= o <= room
            assert all(t[a : a + o] == t[c : d][-o:] for (c, d, *_), (a, _, o, _) in zip(pieces, pieces[1:]) if o)


def test_tree_and_filling():
    part = "Some words of a sentence here. " * 3
    text = "".join(f"# Head {i}\n\n## Sub {i}\n\n{part}\n\n- entry one\n  - nested\n- entry two\n\n" for i in range(6))
    tree = splitting._tree(text, 0, len(text), 60, 90)
    assert [text[a : a + 8] for a, *_ in tree[3]] == [f"# Head {i}" for i in range(6)]
    assert [text[a : a + 3] for a, *_ in tree[3][0][3]] == ["# H", "## "]
    assert splitting._entries("- a\n  - b\n- c\n", 0, 14) == [(0, 10), (10, 14)]
    long = "One two three four five. " * 200
    pieces = splitting.split_text(long, LIMIT, 30)
    assert sum(b - a for a, b, *_ in pieces) / len(pieces) / LIMIT > 0.8 and min(b - a for a, b, *_ in pieces) > LIMIT / 2


def test_cut_class():
    assert splitting.cut_class("a" * 121, LIMIT) == "forced"
    assert splitting.cut_class("a" * 100 + ". " + "b" * 100, LIMIT) == "natural"
    assert splitting.cut_class("a" * 100 + ".b" + "b" * 100, LIMIT) == "forced"
    assert splitting.cut_class("中" * 100 + "。" + "文" * 100, LIMIT) == "natural"


def test_split_table(spark):
    rows = [("nodes", "p", 1, "short"), ("nodes", "p", 2, None), ("nodes", None, 3, "One two. " * 40), ("nodes", None, 3, "One two. " * 40)]
    df = spark.createDataFrame(rows, "tbl string, paper_id string, node_id int, text string").withColumn("piece", F.lit("clash"))
    got = splitting.split_items(df, LIMIT, 20).collect()
    assert {r["node_id"] for r in got} == {3} and {r["cut_class"] for r in got} == {"natural"} and not any(r["forced_cut"] for r in got)
    assert splitting.split_items(df.limit(0), LIMIT, 20).count() == 0
    with pytest.raises(ValueError):
        splitting.split_items(df, LIMIT, LIMIT)


def test_fill_is_feasible_and_tight():
    rng = random.Random(6)
    for cap in (10, 100, 2048):
        for n in (0, 1, 50, 700):
            sizes = [rng.randint(1, cap) for _ in range(n)]
            made = packing.fill(sizes, cap)
            assert sorted(i for c in made for i in c) == list(range(n))
            assert all(sum(sizes[i] for i in c) <= cap for c in made)
    sizes = [rng.randint(20, 700) for _ in range(2000)]
    assert len(packing.fill(sizes, 2048)) <= -(-sum(sizes) // 2048) + 2
    # each container is the fullest with its longest item
    sizes = [rng.randint(1, 30) for _ in range(9)]
    first = packing.fill(sizes, 40)[0]
    rest = [s for s in sizes]
    rest.remove(max(rest))
    sums = {0}
    for s in rest:
        sums |= {x + s for x in sums}
    assert sum(sizes[i] for i in first) == max(x for x in sums if x + max(sizes) <= 40) + max(sizes)


def test_pack_table(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, "  "), (4, "x " * 25), (None, "y"), (5, "中文a­b！")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("id", F.lit(9))
    got = packing.pack(df, capacity=10).collect()
    assert sum(r["n_tokens"] for r in got) == 3 + 3 + 25 + 1 + 4
    assert sorted((r["piece"], r["first_token"], r["n_tokens"]) for r in got if r["id"] == 4) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    by = defaultdict(int)
    for r in got:
        by[r["container"]] += r["n_tokens"]
    assert max(by.values()) <= 10
    assert packing.pack(df.limit(0)).count() == 0 and packing.fill_report(packing.pack(df, capacity=10), 10).first()["tokens"] == 36
    assert packing.pack(df, capacity=10, block_items=2).count() == len(got)


@pytest.mark.parametrize("text,n", [("", 0), ("a-b", 3), ("don't", 3), ("中文字", 3), ("abc中1", 3), ("a​b", 1), ("​", 0), ("é2 ½", 2), ("a b", 2), ("...", 3), ("Ω日x", 3)])
def test_token_count(spark, text, n):
    assert spark.range(1).select(packing.token_count(F.lit(text))).first()[0] == n
