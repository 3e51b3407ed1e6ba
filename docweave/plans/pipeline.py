"""The stages from papers to routed predictions, as one lazy plan per stage.

prepare: papers to nodes, edges and records. link: pointers and their labels. retrieve:
embeddings and seeds. route: selected nodes. evaluate: metrics. What later stages read several times is written to the shared folder
once (``session.cut``), in place of files between processes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import metrics
from docweave.functions import text as T
from docweave.models.plugins import TextEmbedder, TextGenerator, embed_texts, label_with_retries
from docweave.operators import checks, documents, graph, match, retrieval, routing
from docweave.session import cut


@dataclass
class Prepared:
    nodes: DataFrame
    edges: DataFrame
    records: DataFrame


def prepare(papers: DataFrame, limit: int = 0, keep_unanswerable: bool = True, max_section_chars: int = 0) -> Prepared:
    """Nodes, chain edges and question records; ``limit`` counts papers, also those without nodes."""
    checks.no_truncation(max_section_chars)
    papers = documents.prefix(papers, limit, "paper_seq")
    nodes = cut(documents.nodes(papers))
    matched = match.evidence_nodes(documents.answers(papers), nodes)
    records = documents.question_records(papers, matched, keep_unanswerable)
    records = records.join(nodes.select("paper_seq").distinct(), "paper_seq", "left_semi")
    return Prepared(nodes, graph.chain(nodes), cut(records))


def link(prepared: Prepared, generator: TextGenerator, k: int = 4) -> DataFrame:
    """Pointer links with labels, phrases and tokens; one generation per distinct prompt."""
    cands = graph.pointer_candidates(graph.normalized_pointers(prepared.edges), k)
    links = graph.with_endpoints(graph.pointer_links(cands, k), prepared.nodes)
    links = links.withColumn("prompt", T.link_prompt(F.col("src_title"), F.col("src_text"), F.col("dst_title"), F.col("dst_text")))
    retry = lambda prompt, bad: "\n".join([T.RETRY_PROMPT[0], "Previous output:", " ".join((bad or "").split()) or "<empty>", "", T.RETRY_PROMPT[1], "", prompt])
    made = label_with_retries(links.select("prompt"), generator, retry)
    out = links.join(made.withColumnRenamed("output", "raw_output"), "prompt").drop("prompt")
    return out.withColumn("link_phrase", T.link_phrase(F.col("edge_type"), F.col("link_label"), F.col("raw_output"))).withColumn("link_tokens", T.memory_tokens(F.array("link_phrase")))


def _asked(prepared: Prepared) -> DataFrame:
    """(id, record_id): each record with the first one of its question and paper, which stands for all."""
    key = ["paper_seq", "text"]
    rows = prepared.records.select("id", "paper_seq", F.col("query.question").alias("text"))
    first = rows.groupBy(*key).agg(F.min("id").alias("record_id"))
    return rows.join(first, key).select("id", "record_id", *key)


def retrieve(prepared: Prepared, embedder: TextEmbedder, k: int = 12) -> tuple[DataFrame, DataFrame]:
    """(scores of all nodes with ranks, the top k) of each question of a paper; each distinct text is embedded once.

    ``record_id`` is the smallest record of the question: annotations don't change scores.
    """
    asked = prepared.records.groupBy("paper_seq", F.col("query.question").alias("text")).agg(F.min("id").alias("record_id"))
    passages = prepared.nodes.select("paper_seq", "node_id", F.concat_ws(" ", "section_title", "text").alias("text"))
    vectors = cut(embed_texts(retrieval.text_dictionary(asked.select("text"), passages.select("text")), embedder))
    q = asked.join(vectors, "text").select("record_id", "paper_seq", F.col("vector").alias("q"))
    n = passages.join(vectors, "text").select("paper_seq", "node_id", F.col("vector").alias("v"))
    scores = q.join(n, "paper_seq").select("record_id", "paper_seq", "node_id", retrieval.dot(F.col("q"), F.col("v")).alias("score"))
    ranked = cut(retrieval.ranked(scores))
    return ranked, ranked.where(F.col("rank") <= k)


def route(prepared: Prepared, scores: DataFrame, fixed: int = 5, picks: int = 3, most: int = 8, top_k: int = 16, seeds: int = 16, hops: int = 2) -> DataFrame:
    """(record_id, node_id, read_order) of the nodes a reader gets, with the scores as logits.

    Questions are routed once; all records
    of a question get its nodes.
    """
    checks.budgets(fixed, picks, most, top_k, seeds, hops)
    order = documents.document_order(prepared.nodes).select("paper_seq", "node_id", F.col("node_idx").cast("int").alias("idx"))
    nodes = retrieval.min_max(scores).join(order, ["paper_seq", "node_id"]).withColumn("start_logit", F.col("score")).withColumn("norm", F.col("norm_score"))
    at = lambda p: order.select("paper_seq", F.col("node_id").alias(p), F.col("idx").alias(f"{p}_idx"))
    e = prepared.edges.join(at("src"), ["paper_seq", "src"]).join(at("dst"), ["paper_seq", "dst"])
    e = e.select("paper_seq", (F.col("src_idx") * 2 + (F.col("edge_type") == "paragraph_prev").cast("int")).cast("int").alias("edge_idx"), "src_idx", "dst_idx", F.col("score").alias("logit"))
    nodes = cut(nodes)
    edges = nodes.select("record_id", "paper_seq").distinct().join(e, "paper_seq").drop("paper_seq")
    start = nodes.select("record_id", "idx", "rank") if not seeds else nodes.where(F.col("rank") <= seeds).select("record_id", "idx", "rank")
    routed = routing.route(start, edges, nodes, fixed, picks, top_k, hops)
    read = routing.reading_order(routed, most).join(nodes.select("record_id", "idx", "node_id"), ["record_id", "idx"])
    return read.join(_asked(prepared).select("id", "record_id"), "record_id").select(F.col("id").alias("record_id"), "idx", "read_order", "node_id")


def evaluate(prepared: Prepared, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, means) of predictions (id, prediction, node_ids), one record per question."""
    refs = F.transform("answer_refs", lambda x: x["normalized_answer"])
    rows = metrics.first_per_question(prepared.records, "id").join(predictions, "id")
    f1, em = metrics.best_answer(F.col("prediction"), refs)
    e1, ee = metrics.best_evidence(F.col("node_ids"), F.col("gold_evidence_sets"))
    scored = rows.select("id", "paper_id", "question_id", "prediction", F.col("node_ids").alias("predicted_evidence_node_ids"), f1.alias("answer_f1"), em.alias("answer_em"), e1.alias("evidence_f1"), ee.alias("evidence_em"))
    return scored, metrics.prediction_metrics(scored)
