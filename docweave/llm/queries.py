"""The pN queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.llm import abuse, consensus, defects, leakage, overlap, packing, splitting, topn
from docweave.session import table


def p1_found(spark, d):
    top = topn.top_n_per_group(table(spark, d, "node_scores"), "record_id", ["paper_id", "node_id"], "score", 12)
    return top.select("record_id", "paper_id", "node_id")


def p1_seed_candidates(spark, d):
    return topn.seed_candidates(table(spark, d, "node_scores"), 12).selectExpr("record_id", "size(seed_candidates) AS n", "seed_candidates[0].node_id AS best_node", "seed_candidates[0].score AS best_score")


def p2_found(spark, d):
    return consensus.findings(consensus.consensus(table(spark, d, "answer_refs")))


def p2_annotators(spark, d):
    return consensus.consensus(table(spark, d, "answer_refs"))["annotators"]


def p2_disputed(spark, d):
    return consensus.disputed(consensus.consensus(table(spark, d, "answer_refs")))


def p2_agreement(spark, d):
    return consensus.agreement(consensus.counted_votes(table(spark, d, "answer_refs")))


def p3_found(spark, d):
    pairs = overlap.record_pairs(table(spark, d, "records"))
    return pairs.selectExpr("least(eval_seq, train_seq) AS record_a", "greatest(eval_seq, train_seq) AS record_b").distinct()


def p3_report(spark, d):
    return overlap.overlap_report(table(spark, d, "records"))


def p3_class_pairs(spark, d):
    return overlap.question_classes(table(spark, d, "records"))[0]


def p3_members(spark, d):
    return overlap.question_classes(table(spark, d, "records"))[1]


def p4_found(spark, d):
    tasks = defects.task_pairs(table(spark, d, "evidence_tasks"))
    summaries = defects.summary_pairs(table(spark, d, "node_summaries"), table(spark, d, "nodes"))
    return defects.defects(tasks.unionByName(summaries))


def p4_rates(spark, d):
    return p4_found(spark, d).groupBy("tbl", "defect").count().withColumnRenamed("count", "n")


def p6_pieces(spark, d):
    nodes = splitting.split_items(splitting.node_items(table(spark, d, "nodes")), 1200, 150)
    raw = splitting.split_items(splitting.document_items(table(spark, d, "raw_records")), 16000, 800)
    return nodes.unionByName(raw)


def p6_round_trip(spark, d):
    made = splitting.reassembled(p6_pieces(spark, d))
    return made.selectExpr("tbl", "paper_id", "node_id", "n_chars", "digest", "longest <= IF(tbl = 'nodes', 1200, 16000) AS within_limit")


def p6_found(spark, d):
    return p6_pieces(spark, d).where("piece = 0").select("tbl", "paper_id", "node_id", "cut_class")


def p7_containers(spark, d):
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", 2048)


def p7_fill(spark, d):
    return packing.fill_report(p7_containers(spark, d))


def p7_found(spark, d):
    return p7_containers(spark, d).where("divided AND piece = 0").selectExpr("id AS doc_id")


def p8_leaks(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p8_found(spark, d):
    return p8_leaks(spark, d).select("doc_id", "item_id")


def _abuse_scores(spark, d):
    documents = table(spark, d, "documents")
    return abuse.score_documents(documents, abuse.fit(abuse.labelled_sample(documents, table(spark, d, "doc_labels"))), ("source",))


def p9_scores(spark, d):
    return _abuse_scores(spark, d)


def p9_found(spark, d):
    return abuse.found(_abuse_scores(spark, d)).distinct()


def p9_rates(spark, d):
    return abuse.rates(_abuse_scores(spark, d))


def p2_answered(spark, d):
    """Votes that count per annotator, as the model has them."""
    return p2_annotators(spark, d).select("worker", "answered")


def p3_identical(spark, d):
    """Of the pairs found those with the very same question."""
    pairs = overlap.record_pairs(table(spark, d, "records")).where("eval_question = train_question AND longest_span = 1")
    return pairs.select("eval_seq", "train_seq", "eval_split", "eval_source", "train_source")


def p3_records(spark, d):
    """Evaluation records per split and source, as the report has them."""
    return p3_report(spark, d).select("split", "source", "records")


def p4_blank(spark, d):
    """Of the empty ones found those without a letter or digit."""
    found = p4_found(spark, d).where("defect = 'empty'")
    tasks = table(spark, d, "evidence_tasks").selectExpr("'evidence_tasks' AS tbl", "cast(task_id AS string) AS row_key", "answer AS text")
    summaries = table(spark, d, "node_summaries").selectExpr("'node_summaries' AS tbl", "concat_ws('::', paper_id, node_id) AS row_key", "node_sum_raw_output AS text")
    both = found.join(tasks.unionByName(summaries), ["tbl", "row_key"])
    return both.where(F.col("text").isNull() | ~F.col("text").rlike(r"[\p{L}\p{N}]")).select("tbl", "row_key")


def p7_placed(spark, d):
    """Per document its tokens in containers, its pieces, and whether they follow each other; containers within their capacity."""
    packed = p7_containers(spark, d)
    per = packed.groupBy("id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"), F.count_if(F.col("first_token") != F.col("piece") * 2048).alias("misplaced"))
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("t")).where("t > 2048").agg(F.count("*").alias("over"))
    return per.crossJoin(F.broadcast(over)).selectExpr("id AS doc_id", "tokens", "pieces", "misplaced", "over")  # one row


def p8_verbatim(spark, d):
    """Of the leaks found those whose document has the item's passage letter by letter."""
    documents, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_passages").select("item_id", F.col("text").alias("passage"))
    both = p8_found(spark, d).join(documents, "doc_id").join(F.broadcast(items), "item_id")  # the stated query set
    return both.where("contains(text, passage)").select("doc_id", "item_id")


def p9_scored(spark, d):
    """Documents scored per source, and scores that are none."""
    odd = " OR ".join(f"{c} IS NULL OR {c} < 0 OR {c} > 1" for c in abuse.CATEGORIES)
    return p9_scores(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.expr(odd)).alias("odd"))


QUERIES = {f.__name__: f for f in (p1_found, p1_seed_candidates, p2_found, p2_annotators, p2_disputed, p2_agreement, p3_found, p3_report, p3_class_pairs, p3_members, p4_found, p4_rates, p6_found, p6_pieces, p6_round_trip, p7_found, p7_containers, p7_fill, p8_found, p8_leaks, p9_found, p9_scores, p9_rates, p2_answered, p3_identical, p3_records, p4_blank, p7_placed, p8_verbatim, p9_scored)}

_TOP = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, paper_id, node_id) AS rn FROM (
    SELECT record_id, paper_id, node_id, max(score) AS score FROM node_scores
    WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL))
WHERE rn <= 12"""

_WORDS = r"""
len(regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '\p{Cf}', '', 'g'), '([\x{4E00}-\x{9FFF}])', ' x ', 'g'),
  '[\p{L}\p{N}]+|[^\p{L}\p{N}\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]'))"""

_VOTES = r"""
v0 AS (
  SELECT paper_id, question_id, lower(regexp_replace(worker_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS worker, submitted_at, annotation_id,
    list_distinct(coalesce(evidence_node_ids, [])) AS nodes,
    array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(normalized_answer, ';'),
      lambda x: trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'))), lambda x: x <> ''))), ' ; ') AS answer
  FROM answer_refs WHERE normalized_answer IS NOT NULL),
v AS (
  SELECT * FROM v0 WHERE worker IS NOT NULL AND worker <> ''
  QUALIFY row_number() OVER (PARTITION BY paper_id, question_id, worker ORDER BY submitted_at DESC NULLS LAST, annotation_id DESC NULLS LAST, answer DESC) = 1)"""

_FINDINGS = f"""
WITH {_VOTES},
w AS (SELECT *, count(*) OVER (PARTITION BY paper_id, question_id) AS n FROM v),
c AS (SELECT paper_id, question_id, answer, any_value(n) AS n, count(*) AS votes FROM w WHERE n >= 3 GROUP BY ALL),
e AS (SELECT paper_id, question_id, node, any_value(n) AS n, count(*) AS marks FROM (SELECT *, unnest(nodes) AS node FROM w WHERE n >= 3) GROUP BY ALL),
j AS (SELECT w.worker, w.answer, c.answer AS theirs, w.n, c.votes - CASE WHEN w.answer = c.answer THEN 1 ELSE 0 END AS others
      FROM w JOIN c USING (paper_id, question_id)),
k AS (SELECT worker, count(*) AS n, count(*) FILTER (answer = theirs) AS same FROM j WHERE 2 * others > n - 1 GROUP BY worker)
SELECT 'answer' AS finding, paper_id || '::' || question_id AS subject, answer AS found_value FROM c WHERE 2 * votes > n
UNION ALL SELECT 'evidence', paper_id || '::' || question_id, CAST(node AS VARCHAR) FROM e WHERE 2 * marks > n
UNION ALL SELECT 'annotator', worker, '' FROM k WHERE n >= 10 AND 2 * same < n"""

_ALPHA = f"""
WITH {_VOTES},
p AS (SELECT *, sum(k) OVER (PARTITION BY paper_id, question_id) AS n FROM (SELECT paper_id, question_id, answer, count(*) AS k FROM v GROUP BY ALL)),
q AS (SELECT * FROM p WHERE n >= 2),
s AS (SELECT sum(x * x) AS sq FROM (SELECT CAST(sum(k) AS DOUBLE) AS x FROM q GROUP BY answer))
SELECT CAST(sum(k) AS BIGINT) AS votes,
  1 - sum(CAST(k AS DOUBLE) * (n - k) / (n - 1)) / ((CAST(sum(k) AS DOUBLE) * sum(k) - (SELECT sq FROM s)) / (sum(k) - 1)) AS alpha FROM q"""

SQL = {
    "p2_found": _FINDINGS,
    "p2_agreement": _ALPHA,
    "p1_found": f"SELECT record_id, paper_id, node_id FROM ({_TOP})",
    "p1_seed_candidates": f"""SELECT record_id, CAST(count(*) AS INTEGER) AS n, arg_min(node_id, rn) AS best_node, max(score) AS best_score
        FROM ({_TOP}) GROUP BY record_id""",
    "p6_found": r"""
SELECT tbl, paper_id, node_id, CASE WHEN list_max(list_transform(regexp_split_to_array(
    regexp_replace(regexp_replace(text, '([.!?])([\s\p{Z}])', '\1' || chr(10), 'g'), '([。！？])', '\1' || chr(10), 'g'),
    '[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]'), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')))) > top THEN 'forced' ELSE 'natural' END AS cut_class
FROM (SELECT 'nodes' AS tbl, paper_id, node_id, text, 1200 AS top FROM nodes
      UNION ALL SELECT 'raw_records', paper_id, 0, raw_document_text, 16000 FROM raw_records)
WHERE length(text) > top""",
    "p3_members": """SELECT record_seq, side, min(record_seq) OVER (PARTITION BY side, question) AS representative FROM (
        SELECT record_seq, query.question AS question, CASE WHEN lower(trim(split)) = 'train' THEN 'train' ELSE 'eval' END AS side
        FROM records WHERE split IS NOT NULL AND query.question IS NOT NULL)""",
    "p6_round_trip": """SELECT *, true AS within_limit FROM (
        SELECT 'nodes' AS tbl, paper_id, node_id, length(text) AS n_chars, md5(text) AS digest FROM nodes WHERE length(text) > 1200
        UNION ALL SELECT 'raw_records', paper_id, 0, length(raw_document_text), md5(raw_document_text) FROM raw_records WHERE length(raw_document_text) > 16000)""",
    "p2_answered": f"WITH {_VOTES} SELECT worker, count(*) AS answered FROM v GROUP BY worker",
    "p3_identical": r"""WITH r AS (SELECT record_seq, lower(trim(split)) AS split, source, "query".question AS q FROM records WHERE split IS NOT NULL AND regexp_matches("query".question, '[\p{L}\p{N}]'))
SELECT e.record_seq AS eval_seq, t.record_seq AS train_seq, e.split AS eval_split, e.source AS eval_source, t.source AS train_source FROM r e JOIN r t USING (q) WHERE e.split <> 'train' AND t.split = 'train'""",
    "p3_records": """SELECT lower(trim(split)) AS split, source, count(*) AS records FROM records WHERE split IS NOT NULL AND lower(trim(split)) <> 'train' AND "query".question IS NOT NULL GROUP BY ALL""",
    "p4_blank": r"""SELECT tbl, row_key FROM (SELECT 'evidence_tasks' AS tbl, CAST(task_id AS VARCHAR) AS row_key, answer AS text FROM evidence_tasks
        UNION ALL SELECT 'node_summaries', paper_id || '::' || node_id, node_sum_raw_output FROM node_summaries) WHERE text IS NULL OR NOT regexp_matches(text, '[\p{L}\p{N}]')""",
    "p7_placed": f"""SELECT doc_id, n AS tokens, CAST(ceil(n / 2048.0) AS BIGINT) AS pieces, 0 AS misplaced, 0 AS over FROM (SELECT doc_id, {_WORDS} AS n FROM documents) WHERE n > 0""",
    "p8_verbatim": "SELECT doc_id, item_id FROM documents d JOIN eval_passages e ON contains(d.text, e.text)",
    "p9_scored": "SELECT source, count(*) AS documents, 0 AS odd FROM documents GROUP BY source",
    "p7_found": f"SELECT doc_id FROM documents WHERE {_WORDS} > 2048",
}
