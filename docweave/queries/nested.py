"""Queries of problem 5 (nested records to flat tables) and their SQL."""

from __future__ import annotations

from docweave.operators.flatten import PAPER_TABLES, flatten, positions
from docweave.session import table


def p5_found(spark, d):
    return positions(table(spark, d, "papers"), "paper_seq", PAPER_TABLES)


def p5_sections(spark, d):
    return flatten(table(spark, d, "papers"), "paper_seq", PAPER_TABLES["section"])


def p5_spans(spark, d):
    return flatten(table(spark, d, "papers"), "paper_seq", PAPER_TABLES["span"])


def p5_paragraphs(spark, d):
    return flatten(table(spark, d, "papers"), "paper_seq", PAPER_TABLES["paragraph"])


def p5_questions(spark, d):
    return flatten(table(spark, d, "papers"), "paper_seq", PAPER_TABLES["question"])


def p5_answers(spark, d):
    return flatten(table(spark, d, "papers"), "paper_seq", PAPER_TABLES["answer"])


def p5_evidence(spark, d):
    return flatten(table(spark, d, "papers"), "paper_seq", PAPER_TABLES["evidence"])


QUERIES = {f.__name__: f for f in (p5_found, p5_sections, p5_spans, p5_paragraphs, p5_questions, p5_answers, p5_evidence)}

_BASE = """
WITH sec AS (
  SELECT paper_seq, x - 1 AS a, full_text[x].section_name AS section_name, full_text[x].paragraphs AS paragraphs
  FROM (SELECT *, unnest(range(1, len(full_text) + 1)) AS x FROM papers) WHERE full_text[x] IS NOT NULL
  UNION ALL
  SELECT paper_seq, x - 1, full_text_cols.section_name[x], full_text_cols.paragraphs[x]
  FROM (SELECT *, unnest(range(1, greatest(coalesce(len(full_text_cols.section_name), 0), coalesce(len(full_text_cols.paragraphs), 0)) + 1)) AS x FROM papers)),
par AS (
  SELECT paper_seq, a, y - 1 AS b, paragraphs[y] AS text
  FROM (SELECT *, unnest(range(1, len(paragraphs) + 1)) AS y FROM sec) WHERE paragraphs[y] IS NOT NULL),
que AS (
  SELECT paper_seq, x - 1 AS a, qas[x].question AS question_text, qas[x].question_id AS question_id,
    qas[x].answers AS answers, NULL AS cols
  FROM (SELECT *, unnest(range(1, len(qas) + 1)) AS x FROM papers) WHERE qas[x] IS NOT NULL
  UNION ALL
  SELECT paper_seq, x - 1, qas_cols.question[x], qas_cols.question_id[x], NULL, qas_cols.answers[x]
  FROM (SELECT *, unnest(range(1, len(qas_cols.question) + 1)) AS x FROM papers)),
ans AS (
  SELECT paper_seq, a, y - 1 AS b, answers[y].annotation_id AS annotation_id, answers[y].worker_id AS worker_id, answers[y].answer AS answer
  FROM (SELECT *, unnest(range(1, len(answers) + 1)) AS y FROM que) WHERE answers[y] IS NOT NULL
  UNION ALL
  SELECT paper_seq, a, y - 1, cols.annotation_id[y], cols.worker_id[y], cols.answer[y]
  FROM (SELECT *, unnest(range(1, len(cols.answer) + 1)) AS y FROM que)),
spa AS (
  SELECT paper_seq, a, b, z - 1 AS c, answer.extractive_spans[z] AS text
  FROM (SELECT *, unnest(range(1, len(answer.extractive_spans) + 1)) AS z FROM ans) WHERE answer.extractive_spans[z] IS NOT NULL),
evi AS (
  SELECT paper_seq, a, b, z - 1 AS c, answer.evidence[z] AS text
  FROM (SELECT *, unnest(range(1, len(answer.evidence) + 1)) AS z FROM ans) WHERE answer.evidence[z] IS NOT NULL)
"""

SQL = {
    "p5_found": _BASE
    + """
SELECT paper_seq, 'section' AS piece, CAST(a AS INTEGER) AS pos_a, -1 AS pos_b, -1 AS pos_c FROM sec
UNION ALL SELECT paper_seq, 'paragraph', CAST(a AS INTEGER), CAST(b AS INTEGER), -1 FROM par
UNION ALL SELECT paper_seq, 'question', CAST(a AS INTEGER), -1, -1 FROM que
UNION ALL SELECT paper_seq, 'answer', CAST(a AS INTEGER), CAST(b AS INTEGER), -1 FROM ans
UNION ALL SELECT paper_seq, 'span', CAST(a AS INTEGER), CAST(b AS INTEGER), CAST(c AS INTEGER) FROM spa
UNION ALL SELECT paper_seq, 'evidence', CAST(a AS INTEGER), CAST(b AS INTEGER), CAST(c AS INTEGER) FROM evi""",
    "p5_sections": _BASE + "SELECT paper_seq, CAST(a AS INTEGER) AS section, section_name FROM sec",
    "p5_spans": _BASE + "SELECT paper_seq, CAST(a AS INTEGER) AS question, CAST(b AS INTEGER) AS answer, CAST(c AS INTEGER) AS element, text FROM spa",
    "p5_paragraphs": _BASE + "SELECT paper_seq, CAST(a AS INTEGER) AS section, CAST(b AS INTEGER) AS paragraph, text FROM par",
    "p5_questions": _BASE + "SELECT paper_seq, CAST(a AS INTEGER) AS question, question_text, question_id FROM que",
    "p5_answers": _BASE
    + """SELECT paper_seq, CAST(a AS INTEGER) AS question, CAST(b AS INTEGER) AS answer, annotation_id, worker_id,
  answer.unanswerable AS unanswerable, answer.free_form_answer AS free_form_answer, answer.yes_no AS yes_no FROM ans""",
    "p5_evidence": _BASE + "SELECT paper_seq, CAST(a AS INTEGER) AS question, CAST(b AS INTEGER) AS answer, CAST(c AS INTEGER) AS element, text FROM evi",
}
