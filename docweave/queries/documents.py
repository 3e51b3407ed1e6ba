"""Queries over papers: sections, nodes, answers, evidence, records, rendered texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import checks, documents, graph, match
from docweave.queries.nested import _BASE as NESTED
from docweave.session import table


def _papers(spark, d):
    return table(spark, d, "papers")


def sections(spark, d):
    return documents.sections(_papers(spark, d)).select("paper_seq", "section_index", "section_title", F.coalesce(F.size("paragraphs"), F.lit(-1)).alias("n"))


def nodes_routable(spark, d):
    return documents.nodes(_papers(spark, d)).withColumn("paragraph_frac", F.round("paragraph_frac", 6))


def answers_normalized(spark, d):
    return documents.answers(_papers(spark, d)).select("paper_seq", "question_index", "answer_index", "question_id", "annotation_id", "worker_id", "normalized_answer", "answer_type", F.array_join("evidence", "\n").alias("evidence"))


def _matching(spark, d):
    p = _papers(spark, d)
    return match.evidence_rows(documents.answers(p)), documents.nodes(p)


def evidence_exact(spark, d):
    return match.exact(*_matching(spark, d))


def evidence_contained(spark, d):
    return match.contained(*_matching(spark, d))


def evidence_similar(spark, d):
    return match.similar(*_matching(spark, d))


def evidence_tiered(spark, d):
    return match.tiered(*_matching(spark, d))


def evidence_match(spark, d):
    p = _papers(spark, d)
    return match.evidence_nodes(documents.answers(p), documents.nodes(p)).withColumn("node_ids", F.array_join("node_ids", ","))


def question_records(spark, d):
    p = _papers(spark, d)
    r = documents.question_records(p, match.evidence_nodes(documents.answers(p), documents.nodes(p)))
    return r.select("paper_seq", "id", "doc_meta.title", "query.question", "target_answer.normalized_answer", F.size("answer_refs").alias("n_refs"), F.array_join("gold_evidence_node_ids", ",").alias("gold"), F.size("gold_evidence_sets").alias("n_gold_sets"))


def record_meta(spark, d):
    p = _papers(spark, d)
    n = documents.nodes(p)
    r = documents.question_records(p, match.evidence_nodes(documents.answers(p), n))
    return documents.record_meta(r, n, graph.chain(n))


def raw_documents(spark, d):
    return documents.raw_documents(_papers(spark, d))


def linearized_documents(spark, d):
    p = _papers(spark, d)
    return documents.linearized_documents(p, documents.nodes(p))


def segments(spark, d):
    return documents.segments(documents.nodes(_papers(spark, d)))


def split_names(spark, d):
    r = table(spark, d, "records")
    return r.groupBy(documents.split_name(F.col("split")).alias("split_name")).agg(F.count("*").alias("n"))


def record_prefix(spark, d):
    return documents.prefix(table(spark, d, "records"), 100, "record_seq").select("record_seq", "id")


def summary_integrity(spark, d):
    return checks.summary_integrity(table(spark, d, "nodes"), table(spark, d, "node_summaries"), ["paper_id", "node_id"])


def score_coverage(spark, d):
    return checks.score_coverage(table(spark, d, "records"), table(spark, d, "node_scores"))


def gold_in_nodes(spark, d):
    return checks.gold_coverage(table(spark, d, "records"), table(spark, d, "nodes"))


def seed_coverage(spark, d):
    r = table(spark, d, "records").select(F.col("id").alias("record_id"), "paper_id", F.explode_outer("query.seed_candidates").alias("s"))
    return checks.seed_coverage(r, r.where("s IS NOT NULL").select("record_id", "paper_id", "s.node_id"), table(spark, d, "nodes"))


def record_integrity(spark, d):
    return checks.record_integrity(table(spark, d, "records"), table(spark, d, "raw_records"))


def overlength(spark, d):
    rows = table(spark, d, "nodes").select(F.concat_ws("::", "paper_id", F.col("node_id").cast("string")).alias("id"), F.char_length("text").alias("chars"))
    return checks.overlength(rows, "chars", 1200)[1].withColumn("first_ids", F.array_join("first_ids", ","))


def paper_keys(spark, d):
    r = table(spark, d, "records")
    key = T.paper_key(F.lit(None).cast("string"), F.col("doc_meta.paper_id"), F.col("id"), F.struct("record_seq", "id"))
    return r.select("record_seq", key.alias("paper_key"))


def node_prompts(spark, d):
    n = table(spark, d, "nodes").where(T.compact(F.col("text")) != "")
    return n.select("paper_id", "node_id", F.md5(T.node_prompt(F.col("section_title"), F.col("text"))).alias("prompt_md5"))


def reader_segments(spark, d):
    n = table(spark, d, "nodes")
    return n.select("paper_id", "node_id", F.md5(T.evidence_segment(F.col("section_title"), F.col("node_id"), F.col("text"))).alias("evidence_md5"))


def record_segments(spark, d):
    r = table(spark, d, "records")
    return r.select("record_seq", T.prefix_segment(F.col("doc_meta.title"), F.lit(None).cast("string")).alias("prefix"), T.query_segment(F.col("query.question")).alias("query"), T.target_segment(F.col("target_answer.normalized_answer")).alias("target"))


QUERIES = {f.__name__: f for f in (sections, nodes_routable, answers_normalized, evidence_exact, evidence_contained, evidence_similar, evidence_tiered, evidence_match, question_records, record_meta, raw_documents, linearized_documents, segments, split_names, record_prefix, summary_integrity, score_coverage, gold_in_nodes, seed_coverage, record_integrity, overlength, paper_keys, node_prompts, reader_segments, record_segments)}

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def compact(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def distinct_ci(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda w: lower(w)), lower(v)) = i)"


_SPANS = distinct_ci(f"list_filter(list_transform(coalesce(answer.extractive_spans, []), lambda s: {compact('s')}), lambda s: s <> '')")
_EVIDENCE = distinct_ci(f"list_filter(list_transform(coalesce(answer.evidence, []), lambda s: {compact('s')}), lambda s: s <> '' AND NOT starts_with(s, 'FLOAT SELECTED'))")

DOCS = (
    NESTED
    + rf""", sect AS (SELECT paper_seq, a AS section_index, coalesce(nullif({compact("section_name")}, ''), 'Section ' || (a + 1)) AS section_title, paragraphs FROM sec),
par1 AS (SELECT paper_seq, section_index, section_title, y - 1 AS paragraph_index, {compact("paragraphs[y]")} AS t
  FROM (SELECT *, unnest(range(1, len(paragraphs) + 1)) AS y FROM sect)),
par2 AS (SELECT *, len(string_split(t, ' ')) AS n, regexp_full_match({compact("section_title")}, '(?:(?:::+)(?:\s*:::+)*)|Section \d+') AS holder,
  NOT regexp_matches(t, '[.!?;:]') AS bare, len(t) - len(replace(t, ',', '')) AS commas FROM par1 WHERE t <> ''),
nod AS (SELECT paper_seq, row_number() OVER w AS node_id, 'paragraph' AS node_type, section_index, paragraph_index, section_title, t AS text,
    CASE WHEN count(*) OVER (PARTITION BY paper_seq) > 1 THEN (row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY paper_seq) - 1, 1) ELSE 0.0 END AS paragraph_frac, n AS token_hint
  FROM par2 WHERE NOT regexp_matches(t, '^\d+(?:\.\d+)+(?:[A-Za-z]+)?$') AND NOT regexp_matches(t, '\b[\w.+-]+@[\w.-]+\.[A-Za-z]{{2,}}\b')
    AND NOT ((starts_with(t, '— ') OR starts_with(t, '- ')) AND n <= 8) AND NOT (holder AND contains(t, '$^{{') AND n <= 40)
    AND NOT (holder AND n <= 24 AND bare AND regexp_matches(lower(t), 'department of|university|institute|faculty of|school of'))
    AND NOT (holder AND n <= 16 AND commas >= 4 AND bare)
  WINDOW w AS (PARTITION BY paper_seq ORDER BY section_index, paragraph_index)),
q1 AS (SELECT paper_seq, a AS question_index, {compact("question_text")} AS question, coalesce(nullif(question_id, ''), 'q' || a) AS question_id, answers, cols FROM que),
ans1 AS (
  SELECT paper_seq, question_index, question_id, question, y - 1 AS answer_index, coalesce(nullif(answers[y].annotation_id, ''), question_id || '_a' || (y - 1)) AS annotation_id,
    coalesce(answers[y].worker_id, '') AS worker_id, answers[y].answer AS answer
  FROM (SELECT *, unnest(range(1, len(answers) + 1)) AS y FROM q1) WHERE answers[y] IS NOT NULL
  UNION ALL
  SELECT paper_seq, question_index, question_id, question, y - 1, CASE WHEN y <= coalesce(len(cols.annotation_id), 0) THEN coalesce(cols.annotation_id[y], '') ELSE question_id || '_a' || (y - 1) END,
    coalesce(cols.worker_id[y], ''), cols.answer[y]
  FROM (SELECT *, unnest(range(1, len(cols.answer) + 1)) AS y FROM q1)),
ans2 AS (SELECT *, {_SPANS} AS spans, {compact("answer.free_form_answer")} AS free, {_EVIDENCE} AS evidence FROM ans1),
ans3 AS (SELECT *, CASE WHEN coalesce(answer.unanswerable, false) THEN 'unanswerable' WHEN len(spans) > 0 THEN array_to_string(spans, ' ; ') WHEN free <> '' THEN free
    WHEN answer.yes_no THEN 'yes' WHEN NOT answer.yes_no THEN 'no' ELSE 'unanswerable' END AS normalized_answer,
  CASE WHEN coalesce(answer.unanswerable, false) THEN 'unanswerable' WHEN len(spans) > 0 THEN 'extractive' WHEN free <> '' THEN 'free_form' WHEN answer.yes_no IS NOT NULL THEN 'yes_no' ELSE 'unanswerable' END AS answer_type FROM ans2),
evr AS (SELECT paper_seq, question_index, answer_index, z - 1 AS evidence_pos, lower(evidence[z]) AS norm FROM (SELECT *, unnest(range(1, len(evidence) + 1)) AS z FROM ans3)),
ev AS (SELECT DISTINCT paper_seq, norm FROM evr),
np AS (SELECT paper_seq, node_id, lower(text) AS p_norm FROM nod),
exa AS (SELECT ev.*, node_id FROM ev JOIN np ON ev.paper_seq = np.paper_seq AND norm = p_norm),
con AS (SELECT ev.*, node_id FROM ev JOIN np ON ev.paper_seq = np.paper_seq AND (contains(p_norm, norm) OR contains(norm, p_norm))),
tok AS (SELECT paper_seq, norm, unnest(list_distinct(string_split(norm, ' '))) AS w, len(list_distinct(string_split(norm, ' '))) AS ne FROM ev),
ptok AS (SELECT paper_seq, node_id, unnest(list_distinct(string_split(p_norm, ' '))) AS w, len(list_distinct(string_split(p_norm, ' '))) AS np FROM np),
sim1 AS (SELECT tok.paper_seq, norm, node_id, count(*) / (any_value(ne) + any_value(np) - count(*)) AS j FROM tok JOIN ptok USING (paper_seq, w) GROUP BY ALL HAVING j >= 0.6),
sim AS (SELECT paper_seq, norm, node_id FROM sim1 QUALIFY rank() OVER (PARTITION BY paper_seq, norm ORDER BY j DESC) = 1),
tie AS (
  SELECT *, 1 AS tier FROM exa
  UNION ALL SELECT *, 2 FROM con WHERE (paper_seq, norm) NOT IN (SELECT (paper_seq, norm) FROM exa)
  UNION ALL SELECT *, 3 FROM sim WHERE (paper_seq, norm) NOT IN (SELECT (paper_seq, norm) FROM con)),
mat AS (SELECT paper_seq, question_index, answer_index, list(node_id ORDER BY pos, node_id) AS node_ids FROM (
    SELECT evr.paper_seq, question_index, answer_index, node_id, min(evidence_pos) AS pos FROM evr JOIN tie USING (paper_seq, norm) GROUP BY ALL) GROUP BY ALL),
ref AS (SELECT ans3.*, coalesce(node_ids, []) AS ids FROM ans3 LEFT JOIN mat USING (paper_seq, question_index, answer_index)),
met AS (SELECT paper_seq, coalesce(nullif(id, ''), nullif(paper_id, ''), '') AS paper_id, {compact("title")} AS title, {compact("abstract")} AS abstract FROM papers),
rec AS (SELECT ref.paper_seq, met.paper_id || '::' || question_id || '::' || annotation_id AS id, title, question, normalized_answer,
    count(*) OVER g AS n_refs, ids, count(*) FILTER (len(ids) > 0) OVER g AS n_gold_sets
  FROM ref JOIN met USING (paper_seq) WINDOW g AS (PARTITION BY ref.paper_seq, question_index))
"""
)

SQL = {
    "sections": DOCS + "SELECT paper_seq, CAST(section_index AS INTEGER) AS section_index, section_title, CAST(coalesce(len(paragraphs), -1) AS INTEGER) AS n FROM sect",
    "nodes_routable": DOCS + "SELECT paper_seq, CAST(node_id AS INTEGER) AS node_id, node_type, CAST(section_index AS INTEGER) AS section_index, CAST(paragraph_index AS INTEGER) AS paragraph_index, section_title, text, round(paragraph_frac, 6) AS paragraph_frac, CAST(token_hint AS INTEGER) AS token_hint FROM nod",
    "answers_normalized": DOCS + "SELECT paper_seq, CAST(question_index AS INTEGER) AS question_index, CAST(answer_index AS INTEGER) AS answer_index, question_id, annotation_id, worker_id, normalized_answer, answer_type, array_to_string(evidence, chr(10)) AS evidence FROM ans3",
    "evidence_exact": DOCS + "SELECT paper_seq, norm, CAST(node_id AS INTEGER) AS node_id FROM exa",
    "evidence_contained": DOCS + "SELECT paper_seq, norm, CAST(node_id AS INTEGER) AS node_id FROM con",
    "evidence_similar": DOCS + "SELECT paper_seq, norm, CAST(node_id AS INTEGER) AS node_id FROM sim",
    "evidence_tiered": DOCS + "SELECT paper_seq, norm, CAST(node_id AS INTEGER) AS node_id, tier FROM tie",
    "evidence_match": DOCS + "SELECT paper_seq, CAST(question_index AS INTEGER) AS question_index, CAST(answer_index AS INTEGER) AS answer_index, array_to_string(node_ids, ',') AS node_ids FROM mat",
    "question_records": DOCS + "SELECT paper_seq, id, title, question, normalized_answer, CAST(n_refs AS INTEGER) AS n_refs, array_to_string(ids, ',') AS gold, CAST(n_gold_sets AS INTEGER) AS n_gold_sets FROM rec",
    "record_meta": DOCS
    + """, cnt AS (SELECT paper_seq, count(*) AS nn, count(DISTINCT section_index) AS ns FROM nod GROUP BY ALL)
SELECT id, paper_seq, 3 AS graph_schema_version, nn AS num_nodes, ns AS num_sections, nn AS num_paragraphs, CASE WHEN nn > 1 THEN 2 * (nn - 1) ELSE 0 END AS num_routing_links,
  CAST(len(ids) AS INTEGER) AS num_gold_evidence, len(ids) > 0 AS has_text_evidence, n_gold_sets > 0 AS has_text_evidence_refs FROM rec JOIN cnt USING (paper_seq)""",
    "raw_documents": DOCS
    + """SELECT paper_seq, array_to_string(flatten(list(parts ORDER BY a)), chr(10) || chr(10)) AS raw_document_text FROM (
  SELECT paper_seq, a, list_concat(list_filter([coalesce(section_name, '')], lambda x: x <> ''), list_transform(coalesce(paragraphs, []), lambda x: coalesce(x, ''))) AS parts FROM sec) GROUP BY paper_seq""",
    "linearized_documents": DOCS
    + f""", bod AS (SELECT paper_seq, section_index, list_concat(['Section: ' || {compact("any_value(section_title)")}], list(text ORDER BY paragraph_index)) AS parts FROM nod GROUP BY ALL),
al AS (SELECT paper_seq, flatten(list(parts ORDER BY section_index)) AS parts FROM bod GROUP BY ALL)
SELECT paper_seq, array_to_string(list_concat(list_filter([CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN abstract <> '' THEN 'Abstract: ' || abstract END], lambda x: x IS NOT NULL), parts), chr(10) || chr(10)) AS linearized_context
FROM met JOIN al USING (paper_seq)""",
    "segments": DOCS
    + """, ch AS (SELECT *, coalesce(lag(section_index) OVER (PARTITION BY paper_seq ORDER BY node_id) <> section_index, true) AS changed FROM nod)
SELECT paper_seq, CAST(node_id AS INTEGER) AS node_id, 1 AS part, 'paragraph' AS segment_type, text FROM ch
UNION ALL SELECT paper_seq, CAST(node_id AS INTEGER), 0, 'section_header', 'Section: ' || trim(section_title) FROM ch WHERE changed""",
    "split_names": """SELECT CASE lower(trim(split)) WHEN 'train' THEN 'train' WHEN 'validation' THEN 'validation' WHEN 'dev' THEN 'validation' WHEN 'eval' THEN 'validation' WHEN 'test' THEN 'test' END AS split_name,
  count(*) AS n FROM records GROUP BY 1""",
    "record_prefix": "SELECT record_seq, id FROM records WHERE record_seq <= 100",
    "summary_integrity": """
WITH n AS (SELECT paper_id, node_id, count(*) AS nn, count(*) FILTER (coalesce(node_type, '') <> 'paragraph') AS bad FROM nodes GROUP BY ALL),
s AS (SELECT paper_id, node_id, count(*) AS ns, count(*) FILTER (coalesce(node_sum_text, '') = '') AS blank FROM node_summaries GROUP BY ALL),
b AS (SELECT * FROM n FULL JOIN s USING (paper_id, node_id))
SELECT 'duplicate_summary' AS rule, count(*) FILTER (ns > 1) AS n FROM b UNION ALL SELECT 'unknown_node', count(*) FILTER (nn IS NULL) FROM b
UNION ALL SELECT 'missing_summary', count(*) FILTER (ns IS NULL) FROM b UNION ALL SELECT 'node_type', CAST(sum(coalesce(bad, 0)) AS BIGINT) FROM b UNION ALL SELECT 'blank_summary', CAST(sum(coalesce(blank, 0)) AS BIGINT) FROM b""",
    "score_coverage": """
WITH h AS (SELECT record_id AS id, count(*) FILTER (score IS NULL OR isnan(score)) AS bad FROM node_scores GROUP BY ALL),
b AS (SELECT * FROM (SELECT DISTINCT id FROM records) LEFT JOIN h USING (id))
SELECT 'no_scores' AS rule, count(*) FILTER (bad IS NULL) AS n FROM b UNION ALL SELECT 'bad_score', CAST(sum(coalesce(bad, 0)) AS BIGINT) FROM b""",
    "gold_in_nodes": """WITH g AS (SELECT DISTINCT g.*, n.node_id AS known FROM (SELECT id, paper_id, unnest(gold_evidence_node_ids) AS node_id FROM records) g LEFT JOIN nodes n USING (paper_id, node_id))
SELECT 'gold_checked' AS rule, count(*) AS n FROM g UNION ALL SELECT 'gold_unknown', count(*) FROM g WHERE known IS NULL""",
    "seed_coverage": """WITH r AS (SELECT DISTINCT id FROM records),
s AS (SELECT id, paper_id, unnest("query".seed_candidates).node_id AS node_id FROM records),
v AS (SELECT id, count(n.node_id) AS valid FROM s LEFT JOIN nodes n USING (paper_id, node_id) GROUP BY ALL)
SELECT 'no_seeds' AS rule, count(*) FILTER (valid IS NULL) AS n FROM r LEFT JOIN v USING (id) UNION ALL SELECT 'no_valid_seed', count(*) FILTER (valid = 0) FROM r LEFT JOIN v USING (id)""",
    "record_integrity": """WITH c AS (SELECT count(*) FILTER (trim(coalesce(id, '')) = '') AS blank_id, count(*) FILTER (trim(coalesce("query".question, '')) = '') AS blank_question,
  count(*) FILTER (trim(coalesce(target_answer.normalized_answer, '')) = '') AS blank_answer, count(*) FILTER (coalesce(len("query".seed_candidates), 0) = 0) AS no_seeds FROM records),
p AS (SELECT trim(raw_document_text) = '' OR raw_document_text IS NULL AS blank, raw_records.paper_id IS NULL AS none FROM (SELECT DISTINCT paper_id FROM records) LEFT JOIN raw_records USING (paper_id))
SELECT rule, n FROM (UNPIVOT c ON COLUMNS(*) INTO NAME rule VALUE n)
UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT id FROM records GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'no_document', count(*) FILTER (none) FROM p UNION ALL SELECT 'blank_document', count(*) FILTER (blank AND NOT none) FROM p""",
    "overlength": """WITH r AS (SELECT paper_id || '::' || node_id AS id, length(text) AS chars FROM nodes)
SELECT count(*) AS total, count(*) FILTER (chars > 1200) AS dropped, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM r WHERE chars > 1200 ORDER BY id LIMIT 5)) AS first_ids FROM r""",
    "paper_keys": "SELECT record_seq, coalesce(nullif(doc_meta.paper_id, ''), nullif(split_part(id, '::', 1), '')) AS paper_key FROM records",
    "node_prompts": f"""SELECT paper_id, node_id, md5(array_to_string([{", ".join("'" + x + "'" for x in T.NODE_PROMPT)}, '', 'Section title:', coalesce(nullif({compact("section_title")}, ''), 'Unknown'), '', 'Paragraph node:', {compact("text")}], chr(10))) AS prompt_md5
FROM nodes WHERE {compact("text")} <> ''""",
    "reader_segments": "SELECT paper_id, node_id, md5('<evidence>Section: ' || trim(coalesce(section_title, '')) || chr(10) || 'Paragraph ' || node_id || chr(10) || coalesce(text, '') || '</evidence>') AS evidence_md5 FROM nodes",
    "record_segments": """SELECT record_seq, '<prefix>' || CASE WHEN trim(coalesce(doc_meta.title, '')) <> '' THEN 'Title: ' || trim(doc_meta.title) ELSE '' END || '</prefix>' AS prefix,
  '<query>' || coalesce("query".question, '') || '</query>' AS "query", '<target>' || coalesce(target_answer.normalized_answer, '') || '</target>' AS target FROM records""",
}
