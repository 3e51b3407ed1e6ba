"""Queries over scores: metrics, preference data, text functions, resume, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import metrics
from docweave.functions import text as T
from docweave.operators import preference
from docweave.queries.documents import WS, compact
from docweave.session import table


def _predictions(spark, d):
    """The first record of each question against the references of all its annotators.

    The prediction is the normalized answer with a word less at its end.
    """
    r = metrics.first_per_question(table(spark, d, "records"))
    refs = table(spark, d, "answer_refs").where("normalized_answer IS NOT NULL").groupBy("paper_id", "question_id")
    refs = refs.agg(F.collect_set("normalized_answer").alias("answers"), F.collect_set(F.coalesce("evidence_node_ids", F.array().cast("array<int>"))).alias("sets"))
    guess = F.regexp_replace(F.coalesce("target_answer.normalized_answer", F.lit("")), " [^ ]+$", "")
    return r.join(refs, ["paper_id", "question_id"]).select("paper_id", "question_id", guess.alias("prediction"), F.coalesce("gold_evidence_node_ids", F.array().cast("array<int>")).alias("evidence"), "answers", "sets")


def question_first(spark, d):
    return metrics.first_per_question(table(spark, d, "records")).select("paper_id", "question_id", "record_seq")


def token_f1(spark, d):
    p = _predictions(spark, d).select("paper_id", "question_id", "prediction", F.explode("answers").alias("answer"))
    a, b = F.col("prediction"), F.col("answer")
    return p.select("paper_id", "question_id", "answer", F.round(metrics.token_f1(a, b), 9).alias("f1"), metrics.exact_match(a, b).alias("em"))


def set_f1(spark, d):
    t = table(spark, d, "answer_refs")
    r = table(spark, d, "records").select("paper_id", "question_id", "record_seq", "gold_evidence_node_ids")
    return r.join(t, ["paper_id", "question_id"]).select("record_seq", "annotation_id", F.round(metrics.set_f1(F.col("gold_evidence_node_ids"), F.col("evidence_node_ids")), 9).alias("f1"))


def _scored(spark, d):
    f1, em = metrics.best_answer(F.col("prediction"), F.col("answers"))
    e1, ee = metrics.best_evidence(F.col("evidence"), F.col("sets"))
    return _predictions(spark, d).select("paper_id", "question_id", f1.alias("answer_f1"), em.alias("answer_em"), e1.alias("evidence_f1"), ee.alias("evidence_em"))


def best_scores(spark, d):
    return _scored(spark, d).select("paper_id", "question_id", *[F.round(c, 9).alias(c) for c in ("answer_f1", "answer_em", "evidence_f1", "evidence_em")])


def eval_metrics(spark, d):
    m = metrics.prediction_metrics(_scored(spark, d))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def efficiency_avg(spark, d):
    r = table(spark, d, "records")
    stats = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("seeds").alias("k"), F.size("query.seed_candidates").cast("double").alias("v")), F.when(F.col("gold_evidence_node_ids").isNotNull(), F.struct(F.lit("gold").alias("k"), F.size("gold_evidence_node_ids").cast("double").alias("v"))))))
    out = metrics.efficiency_means(r.select(stats.alias("stats")))
    return out.select("metric", F.round("value", 6).alias("value"))


def preference_tasks(spark, d):
    t = table(spark, d, "evidence_tasks").join(table(spark, d, "nodes").select("paper_id", "node_id", F.col("text").alias("t")), ["paper_id", "node_id"]).where("trim(t) <> ''")
    rows = t.select(F.col("task_id").alias("seq"), T.node_prompt(F.col("section_title"), F.col("t")).alias("prompt"), "record_id", "node_id", T.compact(F.col("question")).alias("question"), F.trim("section_title").alias("section_title"))
    out = preference.tasks(rows)
    return out.select(F.md5("prompt").alias("prompt_md5"), "id", F.array_join("scoring_questions", "|").alias("questions"), "prompt_group_size")


def _rewards(spark, d):
    """Summaries of a paper's nodes as candidates; the scores of its records' questions."""
    s = table(spark, d, "node_summaries").where("node_sum_raw_output IS NOT NULL").select(F.col("paper_id").alias("id"), F.col("node_id").alias("cand"), F.col("node_sum_raw_output").alias("output"))
    q = table(spark, d, "node_scores").where("score IS NOT NULL AND NOT isnan(score) AND paper_id = split_part(record_id, '::', 1)").select(F.col("paper_id").alias("id"), F.col("node_id").alias("cand"), F.round("score", 4).cast("decimal(12,4)").alias("score"))
    raw = table(spark, d, "evidence_tasks").groupBy(F.col("paper_id").alias("id")).agg((F.sum(F.coalesce("raw_query_score", F.lit(0.0)).cast("decimal(12,4)")) / F.count("*")).cast("double").alias("raw_score"))
    return preference.rewards(s, q.withColumn("score", F.col("score").cast("double")), raw)


def preference_rewards(spark, d):
    r = _rewards(spark, d)
    return r.select("id", "cand", F.round("relevance", 9).alias("relevance"), "leakage", "long_phrase", "long_output", F.round("reward", 9).alias("reward"))


def preference_pairs(spark, d):
    r = _rewards(spark, d)
    return preference.pairs(r.withColumn("reward", F.round("reward", 9)).withColumn("relevance", F.round("relevance", 9))).select("id", "chosen_index", "rejected_index", F.round("reward_margin", 9).alias("reward_margin"), "n")


def preference_gates(spark, d):
    r = _rewards(spark, d).withColumn("reward", F.round("reward", 9)).withColumn("relevance", F.round("relevance", 9))
    return preference.skip_counts(preference.gates(preference.pairs(r)))


def raw_gate(spark, d):
    return preference.skip_counts(preference.raw_gate(table(spark, d, "evidence_tasks").withColumn("raw_score", F.col("raw_query_score"))))


def resume(spark, d):
    t = table(spark, d, "evidence_tasks").select(F.concat_ws("::node", "record_id", F.col("node_id").cast("string")).alias("id"), "task_id")
    done = table(spark, d, "records").where("split = 'train'").join(table(spark, d, "evidence_tasks"), F.col("id") == F.col("record_id")).select(F.concat_ws("::node", "record_id", F.col("node_id").cast("string")).alias("id"))
    return preference.without_done(t, done)


def penalties(spark, d):
    s = table(spark, d, "node_summaries")
    o = F.col("node_sum_raw_output")
    return s.select("paper_id", "node_id", T.leakage_penalty(o).alias("leakage"), T.long_phrase_penalty(o).alias("long_phrase"), T.long_output_penalty(o, 3).alias("long_output"), F.round(T.redundancy_penalty(o), 9).alias("redundancy"))


def phrases_split(spark, d):
    s = table(spark, d, "node_summaries")
    return s.select("paper_id", "node_id", F.array_join(T.phrases(F.col("node_sum_raw_output"), 5), "|").alias("phrases"), F.array_join(T.summary_phrases(F.col("section_title"), F.col("node_sum_text")), "|").alias("memory"))


def memory_tokens(spark, d):
    s = table(spark, d, "node_summaries")
    made = T.memory_tokens(T.phrases(F.col("node_sum_raw_output"), 5))
    return s.select("paper_id", "node_id", F.array_join(made, " ").alias("tokens"), T.token_phrase(made).alias("text"))


def preference_losses(spark, d):
    t = table(spark, d, "evidence_tasks").where("raw_query_score IS NOT NULL AND NOT isnan(raw_query_score)")
    x = F.col("raw_query_score")
    return t.select("task_id", F.round(metrics.preference_loss(x * 10, x * -7, x, -x), 6).alias("loss"), metrics.policy_loss(x, x * 0.5, -x, x * 2).alias("policy"))


QUERIES = {f.__name__: f for f in (question_first, token_f1, set_f1, best_scores, eval_metrics, efficiency_avg, preference_tasks, preference_rewards, preference_pairs, preference_gates, raw_gate, resume, penalties, phrases_split, memory_tokens, preference_losses)}

_NORM = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\\s\\x0b]', ' ', 'g'), '\\b(?:a|an|the)\\b', ' ', 'g'), '{WS}+', ' ', 'g'))"
_FIRST = "r AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY paper_id, question_id ORDER BY record_seq) = 1)"
_PRED = f"""
WITH {_FIRST},
refs AS (SELECT paper_id, question_id, list(DISTINCT normalized_answer) AS answers, list(DISTINCT coalesce(evidence_node_ids, [])) AS sets FROM answer_refs WHERE normalized_answer IS NOT NULL GROUP BY ALL),
p AS (SELECT r.paper_id, r.question_id, regexp_replace(coalesce(target_answer.normalized_answer, ''), ' [^ ]+$', '') AS prediction, coalesce(gold_evidence_node_ids, []) AS evidence, answers, sets FROM r JOIN refs USING (paper_id, question_id)),
pa AS (SELECT paper_id, question_id, prediction, unnest(answers) AS answer FROM p),
t0 AS (SELECT *, list_filter(string_split({_NORM("prediction")}, ' '), lambda x: x <> '') AS a, list_filter(string_split({_NORM("answer")}, ' '), lambda x: x <> '') AS b FROM pa),
t1 AS (SELECT *, coalesce(list_sum(list_transform(list_intersect(list_distinct(a), list_distinct(b)), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS common FROM t0),
tf AS (SELECT paper_id, question_id, answer, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN common = 0 THEN 0.0 ELSE 2 * (common / len(a)) * (common / len(b)) / ((common / len(a)) + (common / len(b))) END AS f1,
  CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS em FROM t1)
"""


def _set_f1(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(list_distinct({a}), list_distinct({b}))) / (len(list_distinct({a})) + len(list_distinct({b}))) END"


_BEST = (
    _PRED
    + f""", ps AS (SELECT paper_id, question_id, evidence, unnest(sets) AS s FROM p),
es AS (SELECT paper_id, question_id, max({_set_f1("evidence", "s")}) AS evidence_f1, max(CASE WHEN list_sort(list_distinct(evidence)) = list_sort(list_distinct(s)) THEN 1.0 ELSE 0.0 END) AS evidence_em FROM ps GROUP BY ALL),
an AS (SELECT paper_id, question_id, max(f1) AS answer_f1, max(em) AS answer_em FROM tf GROUP BY ALL),
best AS (SELECT * FROM an JOIN es USING (paper_id, question_id))
"""
)
_PH = f"list_filter(list_transform(regexp_split_to_array(coalesce(node_sum_raw_output, ''), '\\n+'), lambda x: {compact('x')}), lambda x: x <> '')"
_LEAK = lambda x: " + ".join(f"{w} * len(regexp_extract_all(coalesce({x}, ''), '(?im){p}'))" for p, w in T.LEAKAGE)
_LONG = "coalesce(list_sum(list_transform(ph, lambda x: greatest(len(string_split(x, ' ')) - 5, 0))), 0)"
_REW = f"""
WITH s AS (SELECT paper_id AS id, node_id AS cand, node_sum_raw_output AS output, {_PH} AS ph FROM node_summaries WHERE node_sum_raw_output IS NOT NULL),
q AS (SELECT paper_id AS id, node_id AS cand, avg(CAST(CAST(round(score, 4) AS DECIMAL(12,4)) AS DOUBLE)) AS mean_score, min(CAST(CAST(round(score, 4) AS DECIMAL(12,4)) AS DOUBLE)) AS min_score FROM node_scores
  WHERE score IS NOT NULL AND NOT isnan(score) AND paper_id = split_part(record_id, '::', 1) GROUP BY ALL),
w AS (SELECT paper_id AS id, CAST(sum(CAST(coalesce(raw_query_score, 0) AS DECIMAL(12,4))) AS DOUBLE) / count(*) AS raw_score FROM evidence_tasks GROUP BY ALL),
a AS (SELECT id, cand, min_score, mean_score - raw_score AS relevance, CAST({_LEAK("output")} AS DOUBLE) AS leakage, CAST({_LONG} AS DOUBLE) AS long_phrase, CAST(greatest(len(ph) - 5, 0) AS DOUBLE) AS long_output FROM s JOIN q USING (id, cand) JOIN w USING (id)),
b AS (SELECT *, round(relevance - leakage - long_phrase - long_output, 9) AS reward, round(relevance, 9) AS rel FROM a),
pr AS (SELECT id, first(cand ORDER BY reward DESC, rel DESC, leakage, cand) AS chosen_index, last(cand ORDER BY reward DESC, rel DESC, leakage, cand) AS rejected_index, first(min_score ORDER BY reward DESC, rel DESC, leakage, cand) AS min_chosen,
  round(first(reward ORDER BY reward DESC, rel DESC, leakage, cand) - last(reward ORDER BY reward DESC, rel DESC, leakage, cand), 9) AS reward_margin, count(*) AS n FROM b GROUP BY ALL)
"""
SQL = {
    "question_first": f"WITH {_FIRST} SELECT paper_id, question_id, record_seq FROM r",
    "token_f1": _PRED + "SELECT paper_id, question_id, answer, round(f1, 9) AS f1, CAST(em AS DOUBLE) AS em FROM tf",
    "set_f1": f"""WITH j AS (SELECT record_seq, a.annotation_id, coalesce(gold_evidence_node_ids, []) AS x, coalesce(a.evidence_node_ids, []) AS y FROM records r JOIN answer_refs a USING (paper_id, question_id))
SELECT record_seq, annotation_id, round({_set_f1("x", "y")}, 9) AS f1 FROM j""",
    "best_scores": _BEST + "SELECT paper_id, question_id, round(answer_f1, 9) AS answer_f1, CAST(answer_em AS DOUBLE) AS answer_em, round(evidence_f1, 9) AS evidence_f1, CAST(evidence_em AS DOUBLE) AS evidence_em FROM best",
    "eval_metrics": _BEST + "SELECT round(avg(answer_f1), 6) AS answer_f1, round(avg(answer_em), 6) AS answer_em, round(avg(evidence_f1), 6) AS evidence_f1, round(avg(evidence_em), 6) AS evidence_em, CAST(count(*) AS DOUBLE) AS count FROM best",
    "efficiency_avg": """SELECT 'eff_seeds_avg' AS metric, round(sum(len("query".seed_candidates)) / count(*), 6) AS value FROM records
UNION ALL SELECT 'eff_gold_avg', round(sum(coalesce(len(gold_evidence_node_ids), 0)) / count(*), 6) FROM records""",
    "preference_tasks": f"""WITH t AS (SELECT task_id, record_id, e.node_id, {compact("question")} AS question, trim(e.section_title) AS section_title,
  array_to_string([{", ".join("'" + x + "'" for x in T.NODE_PROMPT)}, '', 'Section title:', coalesce(nullif({compact("e.section_title")}, ''), 'Unknown'), '', 'Paragraph node:', {compact("text")}], chr(10)) AS prompt
  FROM evidence_tasks e JOIN nodes n USING (paper_id, node_id) WHERE trim(text) <> ''),
c AS (SELECT prompt, question, section_title, min(task_id) AS seq FROM t GROUP BY ALL)
SELECT md5(prompt) AS prompt_md5, (SELECT record_id || '::node' || node_id FROM t WHERE t.prompt = c.prompt ORDER BY task_id LIMIT 1) AS id, string_agg(question, '|' ORDER BY seq, question, section_title) AS questions, CAST(count(*) AS INTEGER) AS prompt_group_size FROM c GROUP BY prompt""",
    "preference_rewards": _REW + "SELECT id, cand, rel AS relevance, leakage, long_phrase, long_output, reward FROM b",
    "preference_pairs": _REW + "SELECT id, chosen_index, rejected_index, reward_margin, n FROM pr",
    "preference_gates": _REW + "SELECT CASE WHEN chosen_index = rejected_index THEN 'tie' WHEN min_chosen < 0.2 THEN 'chosen_similarity' WHEN reward_margin < 0.1 THEN 'margin' ELSE 'written' END AS outcome, count(*) AS n FROM pr GROUP BY 1",
    "raw_gate": "SELECT CASE WHEN raw_query_score < 0.3 THEN 'raw_query_similarity' ELSE 'written' END AS outcome, count(*) AS n FROM evidence_tasks GROUP BY 1",
    "resume": "SELECT record_id || '::node' || node_id AS id, task_id FROM evidence_tasks WHERE record_id || '::node' || node_id NOT IN (SELECT record_id || '::node' || node_id FROM evidence_tasks JOIN records ON id = record_id WHERE split = 'train')",
    "penalties": f"""WITH s AS (SELECT paper_id, node_id, node_sum_raw_output AS o, {_PH} AS ph FROM node_summaries),
r AS (SELECT *, list_filter(list_transform(ph, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS pl FROM s)
SELECT paper_id, node_id, CAST({_LEAK("o")} AS DOUBLE) AS leakage, CAST({_LONG} AS DOUBLE) AS long_phrase, CAST(greatest(len(ph) - 3, 0) AS DOUBLE) AS long_output,
  CASE WHEN len(pl) < 2 THEN 0.0 ELSE round((len(pl) - len(list_distinct(pl))) / len(pl), 9) END AS redundancy FROM r""",
    "phrases_split": f"""SELECT paper_id, node_id, array_to_string({_PH}[1:5], '|') AS phrases,
  array_to_string(list_concat(list_filter([{compact("section_title")}], lambda x: x <> ''), list_filter(list_transform(regexp_split_to_array(coalesce(node_sum_text, ''), '[;\\n]'), lambda x: {compact("x")}), lambda x: x <> '')), '|') AS memory FROM node_summaries""",
    "memory_tokens": f"""WITH m AS (SELECT paper_id, node_id, list_transform({_PH}[1:5], lambda x: coalesce(nullif(trim(regexp_replace(upper(x), '[^A-Z0-9_]+', '_', 'g'), '_'), ''), 'EMPTY')) AS t FROM node_summaries),
k AS (SELECT paper_id, node_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM m),
f AS (SELECT paper_id, node_id, CASE WHEN starts_with(x, 'MEM_') THEN x ELSE 'MEM_' || x END AS x, min(i) AS i FROM k GROUP BY ALL),
g AS (SELECT paper_id, node_id, string_agg(x, ' ' ORDER BY i) AS tokens, string_agg(replace(regexp_replace(x, '^MEM_', ''), '_', ' '), ' ; ' ORDER BY i) AS text FROM f GROUP BY ALL)
SELECT m.paper_id, m.node_id, coalesce(tokens, 'MEM_EMPTY') AS tokens, coalesce(text, 'EMPTY') AS text FROM m LEFT JOIN g USING (paper_id, node_id)""",
    "summary_bundles": f"""WITH m AS (SELECT paper_id, node_id, {_PH}[1:5] AS ph FROM node_summaries WHERE {compact("node_sum_raw_output")} <> ''),
k AS (SELECT paper_id, node_id, unnest(ph) AS x, generate_subscripts(ph, 1) AS i FROM m),
f AS (SELECT paper_id, node_id, 'MEM_' || coalesce(nullif(trim(regexp_replace(upper(x), '[^A-Z0-9_]+', '_', 'g'), '_'), ''), 'EMPTY') AS x, min(i) AS i FROM k GROUP BY ALL),
g AS (SELECT paper_id, node_id, string_agg(x, ' ' ORDER BY i) AS t FROM f GROUP BY ALL)
SELECT m.paper_id, m.node_id, array_to_string(ph, '; ') AS node_sum_text, coalesce(t, 'MEM_EMPTY') AS node_sum_tokens_text FROM m LEFT JOIN g USING (paper_id, node_id)""",
    "preference_losses": """WITH t AS (SELECT task_id, raw_query_score AS x FROM evidence_tasks WHERE raw_query_score IS NOT NULL AND NOT isnan(raw_query_score))
SELECT task_id, round(ln(1 + exp(-0.1 * ((x * 10 - x * -7) - (x + x)))), 6) AS loss, (x - x * 0.5) * -x - 0.01::DOUBLE * (x * 2) AS policy FROM t""",
}
