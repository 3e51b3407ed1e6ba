"""Queries over nodes and records: edges, pointers, retrieval, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import checks, documents, examples, graph, retrieval, routing
from docweave.session import table

K = "paper_id"


def _nodes(spark, d):
    return table(spark, d, "nodes")


def chain_edges(spark, d):
    return graph.chain(_nodes(spark, d), K)


def _doubled(spark, d):
    """Edges entered twice, with another score and without one."""
    e = graph.chain(_nodes(spark, d), K)
    score = F.when(F.col("src") % 3 == 0, F.lit(None).cast("double")).otherwise(F.lit(1.0) / F.col("dst"))
    return e.withColumn("seq", F.lit(0)).unionByName(e.withColumn("score", score).withColumn("seq", F.lit(1)))


def edges_dedup(spark, d):
    return graph.dedupe(_doubled(spark, d), K).select(K, "src", "dst", "edge_type", "score", "seq")


def adjacency_rank(spark, d):
    return graph.adjacency(_doubled(spark, d).where("seq = 1"), K).select(K, "src", "dst", "edge_type", "edge_rank")


def pointer_topk(spark, d):
    e = graph.normalized_pointers(_doubled(spark, d))
    return graph.pointer_candidates(e, 1, 4, K).select(K, "src", "dst", "edge_type", "score", "rank")


def pointer_links(spark, d):
    e = graph.pointer_candidates(graph.normalized_pointers(graph.chain(_nodes(spark, d), K)), 4, 4, K)
    return graph.pointer_links(e, 4, K).groupBy(K).agg(F.count("*").alias("n_links"), F.countDistinct("src").alias("n_src"))


def link_endpoints(spark, d):
    n = _nodes(spark, d)
    e = graph.with_endpoints(graph.chain(n, K), n, K)
    prompt = T.link_prompt(F.col("src_title"), F.col("src_text"), F.col("dst_title"), F.col("dst_text"))
    return e.where("trim(src_text) <> '' AND trim(dst_text) <> ''").select(K, "src", "dst", "edge_type", F.md5(prompt).alias("prompt_md5"))


def link_phrases(spark, d):
    out = F.element_at(F.array(*[F.lit(x) for x in ("- results.", "method-details", "1) Other", "foo  bar", "", "* EVALUATION;")]), (F.col("src") % 6 + 1).cast("int"))
    e = graph.labelled_links(graph.chain(_nodes(spark, d), K).withColumn("raw_output", out))
    return e.select(K, "src", "dst", "link_label", "link_phrase", F.array_join("link_tokens", " ").alias("tokens"))


def message_means(spark, d):
    v = _nodes(spark, d).select(K, "node_id", F.array(F.char_length("text").cast("float"), (F.col("node_id") % 7).cast("float")).alias("vector"))
    return graph.mean_by_destination(graph.chain(_nodes(spark, d), K), v, K).withColumn("mean", F.round("mean", 6))


def _scores(spark, d):
    """Finite scores of each record for the nodes of its own paper, each node once."""
    s = table(spark, d, "node_scores").where("score IS NOT NULL AND NOT isnan(score) AND paper_id = split_part(record_id, '::', 1)")
    return s.groupBy("record_id", "paper_id", "node_id").agg(F.max("score").alias("score"))


def _all_scores(spark, d):
    """Finite scores of each record for nodes of any paper, each node once."""
    s = table(spark, d, "node_scores").where("score IS NOT NULL AND NOT isnan(score)")
    return s.groupBy("record_id", "paper_id", "node_id").agg(F.max("score").alias("score"))


def score_minmax(spark, d):
    return retrieval.min_max(_all_scores(spark, d)).select("record_id", "paper_id", "node_id", "norm_score")


def score_topk(spark, d):
    return retrieval.top_k(_all_scores(spark, d), 12, "record_id", "paper_id", "node_id").select("record_id", "paper_id", "node_id", "rank")


def embedding_topk(spark, d):
    e = table(spark, d, "embeddings").where("label IS NOT NULL")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query"))
    s = e.join(q, "label").select(F.col("label").alias("record_id"), F.col("vec_id").alias("node_id"), retrieval.dot(F.col("query"), F.col("embedding")).alias("score"))
    return retrieval.top_k(s, 12).select("record_id", "node_id", F.round("score", 6).alias("score"), "rank")


def _routing(spark, d):
    n = documents.document_order(_nodes(spark, d), K).select(K, "node_id", "node_idx")
    s = retrieval.min_max(_scores(spark, d))
    nodes = s.join(n, [K, "node_id"]).select("record_id", K, "node_id", F.col("node_idx").cast("int").alias("idx"), (F.col("score") * 0.5).alias("start_logit"), F.col("norm_score").alias("norm"), "score")
    e = graph.chain(_nodes(spark, d), K)
    at = lambda p: n.select(K, F.col("node_id").alias(p), F.col("node_idx").alias(f"{p}_idx"))
    e = e.join(at("src"), [K, "src"]).join(at("dst"), [K, "dst"])
    prev = (F.col("edge_type") == "paragraph_prev").cast("int")
    e = e.select(K, (F.col("src_idx") * 2 + prev).cast("int").alias("edge_idx"), F.col("src_idx").cast("int").alias("src_idx"), F.col("dst_idx").cast("int").alias("dst_idx"), F.when(prev == 1, 0.1).otherwise(0.3).alias("logit"))
    own = lambda c: nodes.select("record_id", K, F.col("idx").alias(c))
    edges = own("src_idx").join(e, [K, "src_idx"]).join(own("dst_idx"), ["record_id", K, "dst_idx"], "left_semi").drop(K)
    seeds = retrieval.ranked(nodes).where("rank <= 16").select("record_id", "idx", "rank")
    return seeds, edges, nodes


def frontier_2hop(spark, d):
    seeds, edges, nodes = _routing(spark, d)
    base = routing.valid_seeds(seeds, nodes).where("seed_rank <= 5")
    return routing.frontier(base, edges, nodes, 2, 0.2).select("record_id", "current", "root", "depth", (F.col("score") + 0.0).alias("score"), F.array_join("path", ",").alias("path"))


def seed_tail(spark, d):
    seeds, _, nodes = _routing(spark, d)
    tail = routing.valid_seeds(seeds, nodes).where("seed_rank > 5")
    return routing.seed_tail(tail, nodes, 0.5, 0.25).select("record_id", "current", (F.col("score") + 0.0).alias("score"))


def route_select(spark, d):
    r = routing.route(*_routing(spark, d), edge_prior=0.2, start_weight=0.5)
    return r.select("record_id", "idx", "place", "source", "depth", "root")


def route_capped(spark, d):
    r = routing.route(*_routing(spark, d), edge_prior=0.2, start_weight=0.5, per_seed=1)
    return r.select("record_id", "idx", "place", "source", "depth", "root")


def route_edges(spark, d):
    seeds, edges, nodes = _routing(spark, d)
    r = routing.route(seeds, edges, nodes, edge_prior=0.2)
    return routing.route_edges(r, edges).select("record_id", "edge_idx", "src_idx", "dst_idx", "root", "round")


def route_seed_only(spark, d):
    seeds, _, nodes = _routing(spark, d)
    return routing.seed_only(seeds, nodes, 8)


def reading_order(spark, d):
    return routing.reading_order(routing.route(*_routing(spark, d), edge_prior=0.2, start_weight=0.5), 8)


def sampled_route(spark, d):
    seeds, edges, nodes = _routing(spark, d)
    base = routing.valid_seeds(seeds, nodes).where("seed_rank <= 5")
    return routing.sampled(routing.frontier(base, edges, nodes, 2, 0.2), 3).select("record_id", "current", "place", (F.round("log_prob", 6) + 0.0).alias("log_prob"), (F.round("entropy", 6) + 0.0).alias("entropy"))


def link_integrity(spark, d):
    """Links of every second source only, some without tokens, some to nodes that aren't there."""
    e = graph.chain(_nodes(spark, d), K).where("src % 2 = 0")
    dst = F.when(F.col("src") % 10 == 0, F.col("dst") + 100_000).otherwise(F.col("dst"))
    tokens = F.when(F.col("src") % 4 == 0, F.array(F.lit("MEM_X")))
    return checks.link_integrity(e.withColumn("dst", dst).withColumn("link_tokens", tokens), _nodes(spark, d), K)


def assembled_records(spark, d):
    seeds, edges, nodes = _routing(spark, d)
    a = examples.assembled(nodes, edges, seeds)
    return a.select("record_id", F.size("nodes").alias("n_nodes"), F.coalesce(F.size("edges"), F.lit(0)).alias("n_edges"), F.array_join(F.transform("seeds", lambda x: x["idx"]), ",").alias("seeds"))


def _ids(c):
    return F.transform(T.words(T.compact(c)), lambda w: F.length(w))


def reader_inputs(spark, d):
    """Prefix, evidence of the gold nodes in document order, query and target, in words."""
    r = table(spark, d, "records").where("gold_evidence_node_ids IS NOT NULL")
    gold = r.select("record_seq", "paper_id", F.explode(F.array_distinct("gold_evidence_node_ids")).alias("node_id"))
    n = documents.document_order(_nodes(spark, d), K).select(K, "node_id", "node_idx", _ids(F.col("text")).alias("ids"))
    e = gold.join(n, [K, "node_id"]).groupBy("record_seq").agg(F.array_sort(F.collect_list(F.struct("node_idx", "ids"))).alias("e"))
    row = r.join(e, "record_seq").select("record_seq", _ids(F.col("doc_meta.title")).alias("p"), F.transform("e", lambda x: x["ids"]).alias("e"), _ids(F.col("query.question")).alias("q"), _ids(F.col("target_answer.normalized_answer")).alias("t"))
    seq = examples.packed(F.col("p"), F.col("e"), F.col("q"), F.col("t"), 100_000)
    return row.select("record_seq", F.array_join(seq, " ").alias("ids"), F.array_join(examples.raw_regions(F.col("p"), F.flatten("e"), F.col("q"), F.col("t")), " ").alias("regions"), F.size(examples.suffix_labels(F.size("p"), F.col("t"))).alias("n_labels"))


def summary_bundles(spark, d):
    s = table(spark, d, "node_summaries").where(T.compact(F.col("node_sum_raw_output")) != "").drop("node_sum_text", "node_sum_tokens")
    b = examples.summary_bundles(s, "node_sum_raw_output")
    return b.select(K, "node_id", "node_sum_text", "node_sum_tokens_text")


def summary_scores(spark, d):
    """Questions of evidence tasks against the vectors of labelled embeddings stand-ins."""
    e = table(spark, d, "embeddings")
    vec = e.select(F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("vector"))
    pairs = e.select(F.col("label").alias("id"), F.col("vec_id").cast("string").alias("passage")).join(e.groupBy(F.col("label").alias("id")).agg(F.min("vec_id").cast("string").alias("question")), "id")
    out = retrieval.mean_scores(retrieval.question_scores(pairs, vec))
    return out.select("id", F.round("raw_score", 6).alias("raw_score"), "n")


def score_average(spark, d):
    """Moving average of a record's scores in node order."""
    s = _scores(spark, d).groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "score"))), lambda x: x["score"]).alias("s"))
    return s.select("record_id", F.round(examples.moving_average(F.col("s"), 0.5), 9).alias("average"))


QUERIES = {f.__name__: f for f in (assembled_records, reader_inputs, summary_bundles, summary_scores, score_average, chain_edges, edges_dedup, adjacency_rank, pointer_topk, pointer_links, link_endpoints, link_phrases, message_means, score_minmax, score_topk, embedding_topk, frontier_2hop, seed_tail, route_select, route_capped, route_edges, route_seed_only, reading_order, sampled_route, link_integrity)}

_EDGES = """
WITH ord AS (SELECT *, row_number() OVER w - 1 AS idx, lead(node_id) OVER w AS nx, lag(node_id) OVER w AS pv FROM nodes WINDOW w AS (PARTITION BY paper_id ORDER BY section_index, paragraph_index, node_id)),
edg AS (
  SELECT paper_id, node_id AS src, nx AS dst, 'paragraph_next' AS edge_type, 1.0::DOUBLE AS score, 'next paragraph in document order' AS relation_text FROM ord WHERE nx IS NOT NULL
  UNION ALL SELECT paper_id, node_id, pv, 'paragraph_prev', 1.0, 'previous paragraph in document order' FROM ord WHERE pv IS NOT NULL),
dbl AS (SELECT *, 0 AS seq FROM edg UNION ALL SELECT paper_id, src, dst, edge_type, CASE WHEN src % 3 = 0 THEN NULL ELSE 1.0::DOUBLE / dst END, relation_text, 1 FROM edg)
"""
_ROUTE = (
    _EDGES
    + """, sc0 AS (SELECT record_id, paper_id, node_id, max(score) AS score FROM node_scores WHERE score IS NOT NULL AND NOT isnan(score) AND paper_id = split_part(record_id, '::', 1) GROUP BY ALL),
sc AS (SELECT *, (score - min(score) OVER g) / greatest(max(score) OVER g - min(score) OVER g, 1e-6) AS norm FROM sc0 WINDOW g AS (PARTITION BY record_id)),
nd AS (SELECT record_id, sc.paper_id, sc.node_id, CAST(idx AS INTEGER) AS idx, sc.score * 0.5 AS start_logit, norm, sc.score FROM sc JOIN ord USING (paper_id, node_id)),
ee AS (SELECT a.record_id, CAST(a.idx * 2 + (edge_type = 'paragraph_prev')::INT AS INTEGER) AS edge_idx, a.idx AS src_idx, b.idx AS dst_idx, CASE WHEN edge_type = 'paragraph_prev' THEN 0.1::DOUBLE ELSE 0.3::DOUBLE END AS logit
  FROM edg JOIN nd a ON a.paper_id = edg.paper_id AND a.node_id = src JOIN nd b ON b.record_id = a.record_id AND b.paper_id = edg.paper_id AND b.node_id = dst),
sd AS (SELECT record_id, idx, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, node_id) AS seed_rank FROM nd QUALIFY seed_rank <= 16),
fx AS (SELECT * FROM sd WHERE seed_rank <= 5),
h1 AS (SELECT fx.record_id, dst_idx AS cur, fx.idx AS root, [fx.idx, dst_idx] AS line, [edge_idx] AS path, logit + 0.2 * norm AS ps, [seed_rank, edge_idx] AS met, start_logit, 1 AS depth
  FROM fx JOIN ee ON ee.record_id = fx.record_id AND ee.src_idx = fx.idx JOIN nd ON nd.record_id = fx.record_id AND nd.idx = dst_idx),
h2 AS (SELECT h1.record_id, dst_idx AS cur, root, list_append(line, dst_idx) AS line, list_append(path, edge_idx) AS path, ps + logit + 0.2 * nd.norm AS ps, list_append(met, edge_idx) AS met, nd.start_logit, 2 AS depth
  FROM h1 JOIN ee ON ee.record_id = h1.record_id AND ee.src_idx = cur JOIN nd ON nd.record_id = h1.record_id AND nd.idx = dst_idx WHERE NOT list_contains(line, dst_idx)),
fr AS (SELECT record_id, cur AS current, root, path, depth, start_logit + ps / depth AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)
  WHERE (record_id, cur) NOT IN (SELECT (record_id, idx) FROM fx)
  QUALIFY row_number() OVER (PARTITION BY record_id, cur ORDER BY start_logit + ps / depth DESC, depth, met) = 1),
"""
)


def _picked(start: float, cap: int) -> str:
    cap_sql = f"QUALIFY source <> 'frontier' OR row_number() OVER (PARTITION BY record_id, root, source ORDER BY score DESC, depth, current) <= {cap}" if cap else ""
    return (
        _ROUTE
        + f"""cd AS (SELECT * FROM (SELECT *, 'frontier' AS source FROM fr UNION ALL
    SELECT sd.record_id, sd.idx, sd.idx, [], 0, start_logit + {start} * norm, 'seed_tail' FROM sd JOIN nd USING (record_id, idx) WHERE seed_rank > 5)
  QUALIFY row_number() OVER (PARTITION BY record_id, current ORDER BY score DESC, source) = 1),
fc AS (SELECT record_id, count(*) AS f FROM fx GROUP BY ALL), nc AS (SELECT record_id, count(*) AS n FROM nd GROUP BY ALL),
al AS (SELECT * FROM cd {cap_sql}),
pk AS (SELECT al.*, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, depth, current) AS pl FROM al),
rt AS (SELECT record_id, idx, CAST(seed_rank AS INTEGER) AS place, 'fixed' AS source, 0 AS depth, idx AS root, CAST([] AS INTEGER[]) AS path FROM fx
  UNION ALL SELECT record_id, current, CAST(pl + f AS INTEGER), source, depth, root, path FROM pk JOIN fc USING (record_id) JOIN nc USING (record_id) WHERE pl <= least(3, n - f))
"""
    )


_ALL_SCORES = "WITH a AS (SELECT record_id, paper_id, node_id, max(score) AS score FROM node_scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)"
SQL = {
    "chain_edges": _EDGES + "SELECT * FROM edg",
    "edges_dedup": _EDGES + "SELECT paper_id, src, dst, edge_type, score, seq FROM dbl QUALIFY row_number() OVER (PARTITION BY paper_id, src, dst, edge_type ORDER BY score DESC NULLS LAST, seq) = 1",
    "adjacency_rank": _EDGES + "SELECT paper_id, src, dst, edge_type, CAST(row_number() OVER (PARTITION BY paper_id, src ORDER BY CASE edge_type WHEN 'paragraph_next' THEN 0 ELSE 1 END, -coalesce(score, 0), dst) AS INTEGER) AS edge_rank FROM dbl WHERE seq = 1",
    "pointer_topk": _EDGES
    + """, cp AS (SELECT *, coalesce(score, 0) AS s, CASE edge_type WHEN 'paragraph_next' THEN 0 ELSE 1 END AS pr FROM dbl QUALIFY row_number() OVER (PARTITION BY paper_id, src ORDER BY pr, -s, dst) <= 4),
bs AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY paper_id, src, dst ORDER BY pr, -s) = 1)
SELECT paper_id, src, dst, edge_type, s AS score, CAST(row_number() OVER (PARTITION BY paper_id, src ORDER BY pr, -s, dst) AS INTEGER) AS rank FROM bs QUALIFY rank <= 1""",
    "pointer_links": _EDGES + "SELECT paper_id, count(*) AS n_links, count(DISTINCT src) AS n_src FROM edg GROUP BY ALL",
    "score_minmax": _ALL_SCORES + " SELECT record_id, paper_id, node_id, (score - min(score) OVER g) / greatest(max(score) OVER g - min(score) OVER g, 1e-6) AS norm_score FROM a WINDOW g AS (PARTITION BY record_id)",
    "score_topk": _ALL_SCORES + " SELECT record_id, paper_id, node_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY score DESC, paper_id, node_id) AS INTEGER) AS rank FROM a QUALIFY rank <= 12",
    "embedding_topk": """
WITH q AS (SELECT label, arg_min(embedding, vec_id) AS query FROM embeddings WHERE label IS NOT NULL GROUP BY ALL),
s AS (SELECT label AS record_id, vec_id AS node_id, list_inner_product(query::DOUBLE[], embedding::DOUBLE[]) AS score FROM embeddings JOIN q USING (label))
SELECT record_id, node_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY record_id ORDER BY s.score DESC, node_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 12""",
    "frontier_2hop": _ROUTE.rstrip().rstrip(",") + " SELECT record_id, current, root, depth, score + 0.0 AS score, array_to_string(path, ',') AS path FROM fr",
    "seed_tail": _ROUTE.rstrip().rstrip(",") + " SELECT sd.record_id, sd.idx AS current, start_logit + 0.75 * norm + 0.0 AS score FROM sd JOIN nd USING (record_id, idx) WHERE seed_rank > 5",
    "route_select": _picked(0.5, 0) + "SELECT record_id, idx, place, source, depth, root FROM rt",
    "route_capped": _picked(0.5, 1) + "SELECT record_id, idx, place, source, depth, root FROM rt",
    "route_edges": _picked(0.0, 0)
    + """, us AS (SELECT record_id, place, root, depth, unnest(path) AS edge_idx, generate_subscripts(path, 1) AS step FROM rt),
f1 AS (SELECT * FROM us QUALIFY row_number() OVER (PARTITION BY record_id, edge_idx ORDER BY place, step) = 1)
SELECT record_id, edge_idx, src_idx, dst_idx, root, depth AS round FROM f1 JOIN ee USING (record_id, edge_idx)""",
    "route_seed_only": _ROUTE.rstrip().rstrip(",") + " SELECT record_id, idx, CAST(row_number() OVER (PARTITION BY record_id ORDER BY idx) AS INTEGER) AS read_order FROM sd WHERE seed_rank <= 8",
    "reading_order": _picked(0.5, 0) + "SELECT record_id, idx, CAST(row_number() OVER (PARTITION BY record_id ORDER BY idx) AS INTEGER) AS read_order FROM rt WHERE place <= 8",
    "message_means": _EDGES
    + """, v AS (SELECT paper_id, node_id AS src, 0 AS dim, CAST(length(text) AS DOUBLE) AS x FROM nodes UNION ALL SELECT paper_id, node_id, 1, node_id % 7 FROM nodes)
SELECT paper_id, dst, dim, round(avg(x), 6) AS mean FROM edg JOIN v USING (paper_id, src) GROUP BY ALL""",
}
_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_C = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '{_WS}+', ' ', 'g'))"
SQL["link_endpoints"] = (
    _EDGES
    + f"""SELECT e.paper_id, src, dst, edge_type, md5(array_to_string(['{T.LINK_PROMPT}', 'Labels: {", ".join(T.LINK_PHRASES)}', '', 'Source paragraph:', coalesce(nullif({_C("a.section_title")}, ''), 'Unknown'), {_C("a.text")}, '',
  'Destination paragraph:', coalesce(nullif({_C("b.section_title")}, ''), 'Unknown'), {_C("b.text")}], chr(10))) AS prompt_md5
FROM edg e JOIN nodes a ON a.paper_id = e.paper_id AND a.node_id = src JOIN nodes b ON b.paper_id = e.paper_id AND b.node_id = dst WHERE trim(a.text) <> '' AND trim(b.text) <> ''"""
)
_CASES = {0: ("RESULTS", "reports results or findings"), 1: ("METHOD_DETAILS", "explains method or features"), 2: ("OTHER", "continues related content"), 3: (None, "foo bar"), 4: (None, ""), 5: ("EVALUATION", "gives evaluation setup or metrics")}
SQL["link_phrases"] = (
    _EDGES
    + f""", ph AS (SELECT *, CASE src % 6 {" ".join(f"WHEN {k} THEN '{v[0]}'" if v[0] else f"WHEN {k} THEN NULL" for k, v in _CASES.items())} END AS link_label,
  trim(CASE edge_type WHEN 'paragraph_next' THEN 'next paragraph ' ELSE 'previous paragraph ' END || CASE src % 6 {" ".join(f"WHEN {k} THEN '{v[1]}'" for k, v in _CASES.items())} END) AS link_phrase FROM edg)
SELECT paper_id, src, dst, link_label, link_phrase, 'MEM_' || regexp_replace(upper(link_phrase), '[^A-Z0-9_]+', '_', 'g') AS tokens FROM ph"""
)

SQL["assembled_records"] = (
    _ROUTE.rstrip().rstrip(",")
    + """ SELECT nc.record_id, CAST(n AS INTEGER) AS n_nodes, CAST(coalesce(m, 0) AS INTEGER) AS n_edges, seeds
FROM (SELECT record_id, count(*) AS n FROM nd GROUP BY ALL) nc LEFT JOIN (SELECT record_id, count(*) AS m FROM ee GROUP BY ALL) USING (record_id)
LEFT JOIN (SELECT record_id, string_agg(idx, ',' ORDER BY seed_rank) AS seeds FROM sd GROUP BY ALL) USING (record_id)"""
)
_W = lambda x: f"list_transform(list_filter(string_split({_C(x)}, ' '), lambda w: w <> ''), lambda w: length(w))"
SQL["reader_inputs"] = (
    _EDGES
    + f""", g AS (SELECT record_seq, paper_id, unnest(list_distinct(gold_evidence_node_ids)) AS node_id FROM records WHERE gold_evidence_node_ids IS NOT NULL),
e AS (SELECT record_seq, flatten(list({_W("text")} ORDER BY idx)) AS e FROM g JOIN ord USING (paper_id, node_id) GROUP BY ALL),
r AS (SELECT record_seq, {_W("doc_meta.title")} AS p, e, {_W('"query".question')} AS q, {_W("target_answer.normalized_answer")} AS t FROM records JOIN e USING (record_seq))
SELECT record_seq, array_to_string(list_concat(list_concat(p, e), list_concat(q, t)), ' ') AS ids,
  array_to_string(list_concat(list_concat(list_transform(p, lambda x: -1), list_transform(e, lambda x: -2)), list_concat(list_transform(q, lambda x: -3), list_transform(t, lambda x: -2))), ' ') AS regions,
  CAST(len(p) + len(t) AS INTEGER) AS n_labels FROM r"""
)
SQL["summary_scores"] = """WITH q AS (SELECT label, arg_min(embedding, vec_id) AS query FROM embeddings GROUP BY ALL)
SELECT label AS id, round(avg(list_inner_product(query::DOUBLE[], embedding::DOUBLE[])), 6) AS raw_score, count(*) AS n FROM embeddings JOIN q USING (label) GROUP BY ALL"""
SQL["sampled_route"] = (
    _ROUTE
    + """u AS (SELECT *, (CAST('0x' || md5('42:' || record_id || ':' || current)[:12] AS BIGINT) + 0.5) / 281474976710656.0 AS u FROM fr),
k AS (SELECT *, score - ln(-ln(u)) AS key, max(score) OVER (PARTITION BY record_id) AS top FROM u),
r AS (SELECT *, row_number() OVER w AS place, sum(exp(score - top)) OVER v AS rest, sum(exp(score - top) * (score - top)) OVER v AS mean FROM k
  WINDOW w AS (PARTITION BY record_id ORDER BY key DESC, current), v AS (PARTITION BY record_id ORDER BY key DESC, current ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT record_id, current, CAST(place AS INTEGER) AS place, round(score - top - ln(rest), 6) + 0.0 AS log_prob, round(ln(rest) - mean / rest, 6) + 0.0 AS entropy FROM r WHERE place <= 3"""
)
SQL["link_integrity"] = (
    _EDGES
    + """, l AS (SELECT paper_id, src, CASE WHEN src % 10 = 0 THEN dst + 100000 ELSE dst END AS dst, src % 4 = 0 AS has FROM edg WHERE src % 2 = 0)
SELECT 'links' AS rule, count(*) AS n FROM l UNION ALL SELECT 'empty_link_tokens', count(*) FROM l WHERE NOT has UNION ALL SELECT 'unknown_source', 0
UNION ALL SELECT 'unknown_destination', count(*) FROM l ANTI JOIN (SELECT paper_id, node_id AS dst FROM nodes) USING (paper_id, dst)
UNION ALL SELECT 'no_candidates', count(*) FROM (SELECT paper_id, node_id AS src FROM nodes WHERE paper_id IN (SELECT paper_id FROM nodes GROUP BY paper_id HAVING count(*) > 1)) ANTI JOIN l USING (paper_id, src)"""
)
SQL["score_average"] = _ROUTE.rstrip().rstrip(",") + " SELECT record_id, round(list_reduce(list(score ORDER BY node_id), lambda a, x: 0.5::DOUBLE * a + 0.5::DOUBLE * x), 9) AS average FROM sc0 GROUP BY ALL"
