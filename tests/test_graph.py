import random
import re

import pytest
from pyspark.sql import functions as F

from docweave.operators import checks, graph, match, preference, retrieval, routing


def nodes(spark, n, paper=1):
    return spark.createDataFrame([(paper, i + 1, 0, i, "T", f"text {i}") for i in range(n)], "paper_seq long, node_id int, section_index int, paragraph_index int, section_title string, text string")


@pytest.mark.parametrize("n,want", [(0, 0), (1, 0), (3, 4), (6, 10)])
def test_chain(spark, n, want):
    assert graph.chain(nodes(spark, n)).count() == want


def test_dedupe_prefers_scores(spark):
    e = spark.createDataFrame([(1, 1, 2, "paragraph_next", None, 0), (1, 1, 2, "paragraph_next", 0.5, 1), (1, 1, 2, "paragraph_next", 0.5, 2)], "paper_seq long, src int, dst int, edge_type string, score double, seq int")
    assert [(r["score"], r["seq"]) for r in graph.dedupe(e).collect()] == [(0.5, 1)]


def test_pointers(spark):
    e = graph.normalized_pointers(graph.chain(nodes(spark, 5)))
    c = graph.pointer_candidates(e, 4)
    assert c.count() == 8
    assert graph.pointer_links(c, 1).count() == 5
    with pytest.raises(ValueError):
        graph.pointer_candidates(e, 0)


def test_min_max_equal_and_bad(spark):
    s = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, 0.0), ("b", 2, 2.0)], "record_id string, node_id int, score double")
    assert {(r["record_id"], r["node_id"]): r["norm_score"] for r in retrieval.min_max(s).collect()} == {("a", 1): 0.0, ("a", 2): 0.0, ("b", 1): 0.0, ("b", 2): 1.0}
    with pytest.raises(Exception, match="finite"):
        retrieval.min_max(s.withColumn("score", F.lit(float("nan")))).collect()


def tiers(evidence, paragraphs):
    same = [i for i, p in paragraphs if p == evidence]
    if same:
        return same
    inside = [i for i, p in paragraphs if evidence in p or p in evidence]
    if inside:
        return inside
    e = set(evidence.split())
    j = {i: len(e & set(p.split())) / len(e | set(p.split())) for i, p in paragraphs}
    best = max(j.values(), default=0)
    return [i for i in j if j[i] == best and best >= 0.6]


def test_match_against_model(spark):
    rng = random.Random(3)
    words = list("abcdefgh")
    paras = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(25)]
    ev = [rng.choice(paras) for _ in range(6)] + [" ".join(rng.choices(words + ["zz", "yy"], k=rng.randint(2, 7))) for _ in range(40)]
    n = spark.createDataFrame([(1, i, p) for i, p in enumerate(paras)], "paper_seq long, node_id int, text string")
    e = spark.createDataFrame([(1, 0, 0, i, t) for i, t in enumerate(ev)], "paper_seq long, question_index int, answer_index int, evidence_pos int, norm string")
    got = {}
    for r in match.tiered(e, n).collect():
        got.setdefault(r["norm"], set()).add(r["node_id"])
    want = {t: set(x) for t in ev if (x := tiers(t, list(enumerate(paras))))}
    assert got == want


def model_route(seeds, edges, nodes, fixed_count, count, hops, prior, start_weight, per_seed):
    """An independent model of the routing of one record."""
    base = seeds[:fixed_count]
    best = {}
    states = [(i, i, [i], [], 0.0) for i in base]
    for depth in range(1, hops + 1):
        grown = []
        for cur, root, line, path, score in states:
            for k, s, d, logit in edges:
                if s != cur or d in line:
                    continue
                ps = score + logit + prior * nodes[d][1]
                grown.append((d, root, line + [d], path + [k], ps))
                if d not in base:
                    v = nodes[d][0] + ps / depth
                    if d not in best or v > best[d][0]:
                        best[d] = (v, depth, root, "frontier")
        states = grown
    for i in seeds[fixed_count:]:
        v = nodes[i][0] + start_weight * nodes[i][1]
        if i not in best or v > best[i][0]:
            best[i] = (v, 0, i, "seed_tail")
    out, used = list(base), {}
    for _ in range(min(count, max(0, len(nodes) - len(base)))):
        free = [i for i in best if i not in out and (best[i][3] != "frontier" or per_seed <= 0 or used.get(best[i][2], 0) < per_seed)]
        if not free:
            break
        pick = min(free, key=lambda i: (-best[i][0], best[i][1], i))
        out.append(pick)
        if best[pick][3] == "frontier":
            used[best[pick][2]] = used.get(best[pick][2], 0) + 1
    return out


@pytest.mark.parametrize("per_seed", [0, 1])
def test_route_against_model(spark, per_seed):
    rng = random.Random(7)
    seeds, edges, node_rows, want = [], [], [], {}
    for rec in range(8):
        n = rng.randint(3, 12)
        ns = {i: (rng.random(), rng.random()) for i in range(n)}
        es = sorted({(s, d) for s, d in ((rng.randrange(n), rng.randrange(n)) for _ in range(3 * n)) if s != d})
        es = [(k, s, d, rng.random()) for k, (s, d) in enumerate(es)]
        order = rng.sample(range(n), rng.randint(1, n))
        want[rec] = model_route(order, es, ns, 3, 3, 2, 0.3, 0.4, per_seed)
        seeds += [(rec, i, r + 1) for r, i in enumerate(order)] + [(rec, 99, 1)]
        edges += [(rec, *e) for e in es]
        node_rows += [(rec, i, *v) for i, v in ns.items()]
    r = routing.route(
        spark.createDataFrame(seeds, "record_id int, idx int, rank int"),
        spark.createDataFrame(edges, "record_id int, edge_idx int, src_idx int, dst_idx int, logit double"),
        spark.createDataFrame(node_rows, "record_id int, idx int, start_logit double, norm double"),
        fixed_count=3, count=3, edge_prior=0.3, start_weight=0.4, per_seed=per_seed,
    )
    got = {}
    for x in r.orderBy("record_id", "place").collect():
        got.setdefault(x["record_id"], []).append(x["idx"])
    assert got == want


def test_preference_ties(spark):
    c = spark.createDataFrame([("t", i, 1.0, 0.5, 0.0, 0.4) for i in range(3)], "id string, cand int, reward double, relevance double, leakage double, min_score double")
    r = preference.gates(preference.pairs(c)).first()
    assert (r["chosen_index"], r["rejected_index"], r["skip_reason"]) == (0, 2, "margin")


def test_checks(spark):
    key = "paper_seq long, node_id int"
    n = spark.createDataFrame([(1, 1, "paragraph"), (1, 2, "list")], f"{key}, node_type string")
    s = spark.createDataFrame([(1, 1, "x"), (1, 1, ""), (1, 9, "y")], f"{key}, node_sum_text string")
    got = {r["rule"]: r["n"] for r in checks.summary_integrity(n, s, ["paper_seq", "node_id"]).collect()}
    assert got == {"duplicate_summary": 1, "unknown_node": 1, "missing_summary": 1, "node_type": 1, "blank_summary": 1}
    with pytest.raises(ValueError, match="duplicate"):
        checks.require_none(checks.summary_integrity(n, s, ["paper_seq", "node_id"]))
    with pytest.raises(ValueError):
        checks.no_truncation(10)
    with pytest.raises(ValueError):
        checks.budgets(5, 5, 8, 16, 16, 2)


def test_similar_shuffles_by_paper_only(spark):
    """Word sets against brute force; neither words nor pairs of texts are shuffled."""
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices("abcdefg", k=rng.randint(0, 7)))
    evidence = [(i % 6, text()) for i in range(90)] + [(1, None), (2, "  ")]
    nodes = [(i % 6, i, text().upper()) for i in range(90)] + [(1, 99, None)]
    e, n = spark.createDataFrame(evidence, "paper_seq int, norm string"), spark.createDataFrame(nodes, "paper_seq int, node_id int, text string")
    want = set()
    for p, x in set(evidence):
        scores = {}
        for q, i, y in nodes:
            s, t = set((x or "").split()), set((y or "").lower().split())
            if p == q and s & t and len(s & t) / len(s | t) >= 0.6:
                scores[i] = len(s & t) / len(s | t)
        want |= {(p, x, i) for i, j in scores.items() if j == max(scores.values())}
    made = match.similar(e, n)
    assert want and sorted(map(tuple, made.collect())) == sorted(want)
    plan = made._jdf.queryExecution().executedPlan().toString()
    keys = {k for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan) for k in re.findall(r"(\w+)#", x)}
    assert keys == {"paper_seq"}
