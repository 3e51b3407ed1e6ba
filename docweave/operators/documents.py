"""Papers to sections, paragraphs, nodes, questions, answers and rendered documents.

Both encodings of the nested fields are read natively: row lists, or a struct of parallel
lists padded to the longer one. The key of a paper row is ``paper_seq``: a paper loaded
twice stays two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docweave.functions.text import WS, blank_to_null, compact, evidence_texts, is_routable, normalized_answer, section_title, words

SCHEMA_VERSION = 3
#: Spellings of split names and the split they mean.
SPLITS = {"train": "train", "validation": "validation", "dev": "validation", "eval": "validation", "test": "test"}


def split_name(c: Column) -> Column:
    """The split a spelling means; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv]), F.lower(F.trim(c)))


def paper_id_of(df: DataFrame) -> Column:
    """id, else paper_id, else ''."""
    return F.coalesce(blank_to_null(F.col("id")), blank_to_null(F.col("paper_id")), F.lit(""))


def raw_sections(papers: DataFrame) -> DataFrame:
    """(paper_seq, section_index, section_name, paragraphs) with names as they are."""
    a = papers.select("paper_seq", F.posexplode("full_text").alias("section_index", "s")).where("s IS NOT NULL").select("paper_seq", "section_index", "s.section_name", "s.paragraphs")
    none = F.array().cast("array<string>")
    zipped = F.arrays_zip(F.coalesce("full_text_cols.section_name", none).alias("section_name"), F.coalesce("full_text_cols.paragraphs", F.array().cast("array<array<string>>")).alias("paragraphs"))
    b = papers.where("full_text_cols IS NOT NULL").select("paper_seq", F.posexplode(zipped).alias("section_index", "s"))
    b = b.select("paper_seq", "section_index", F.col("s").getField("section_name").alias("section_name"), F.col("s").getField("paragraphs").alias("paragraphs"))
    return a.unionByName(b)


def sections(papers: DataFrame) -> DataFrame:
    """raw_sections with 'Section N' for blank names."""
    return raw_sections(papers).withColumn("section_title", section_title(F.col("section_name"), F.col("section_index"))).drop("section_name")


def nodes(papers: DataFrame) -> DataFrame:
    """Routable paragraphs with dense ids from 1, relative position and word count.

    One shuffle, by paper; null paragraphs count as blank ones.
    """
    paragraphs = sections(papers).select("paper_seq", "section_index", "section_title", F.posexplode("paragraphs").alias("paragraph_index", "raw"))
    kept = paragraphs.withColumn("text", compact(F.col("raw"))).where(is_routable(F.col("text"), F.col("section_title"))).drop("raw")
    order = W.partitionBy("paper_seq").orderBy("section_index", "paragraph_index")
    n = F.count("*").over(W.partitionBy("paper_seq"))
    rank = F.row_number().over(order)
    return kept.select(
        "paper_seq",
        rank.alias("node_id"),
        F.lit("paragraph").alias("node_type"),
        "section_index",
        "paragraph_index",
        "section_title",
        "text",
        F.when(n > 1, (rank - 1) / F.greatest(n - 1, F.lit(1))).otherwise(0.0).alias("paragraph_frac"),
        F.greatest(F.size(words(F.col("text"))), F.lit(1)).alias("token_hint"),
    )


def questions(papers: DataFrame) -> DataFrame:
    """(paper_seq, question_index, question, question_id, answers or answer columns)."""
    a = papers.select("paper_seq", F.posexplode("qas").alias("question_index", "q")).where("q IS NOT NULL")
    a = a.select("paper_seq", "question_index", compact(F.col("q.question")).alias("question"), F.col("q.question_id").alias("question_id"), F.col("q.answers").alias("rows"), F.lit(None).cast(papers.schema["qas_cols"].dataType["answers"].dataType.elementType).alias("cols"))
    b = papers.select("paper_seq", "qas_cols", F.posexplode("qas_cols.question").alias("question_index", "q"))
    rows_type = papers.schema["qas"].dataType.elementType["answers"].dataType
    b = b.select("paper_seq", "question_index", compact(F.col("q")).alias("question"), F.get("qas_cols.question_id", F.col("question_index")).alias("question_id"), F.lit(None).cast(rows_type).alias("rows"), F.get("qas_cols.answers", F.col("question_index")).alias("cols"))
    fallback = F.concat(F.lit("q"), F.col("question_index").cast("string"))
    return a.unionByName(b).withColumn("question_id", F.coalesce(blank_to_null(F.col("question_id")), fallback))


def answers(papers: DataFrame) -> DataFrame:
    """One row per annotation: ids, normalized answer and its kind, evidence texts.

    Row lists replace a missing or empty annotation id, parallel lists one out of range only.
    """
    q = questions(papers)
    made = lambda i: F.concat("question_id", F.lit("_a"), i.cast("string"))
    keys = ["paper_seq", "question_index", "question_id", "question"]
    a = q.select(*keys, F.posexplode("rows").alias("answer_index", "x")).where("x IS NOT NULL")
    a = a.select(*keys, "answer_index", F.coalesce(blank_to_null(F.col("x.annotation_id")), made(F.col("answer_index"))).alias("annotation_id"), F.coalesce("x.worker_id", F.lit("")).alias("worker_id"), F.col("x.answer").alias("answer"))
    b = q.select(*keys, "cols", F.posexplode("cols.answer").alias("answer_index", "answer"))
    in_range = F.col("answer_index") < F.size(F.coalesce("cols.annotation_id", F.array().cast("array<string>")))
    own = F.coalesce(F.get("cols.annotation_id", F.col("answer_index")), F.lit(""))
    b = b.select(*keys, "answer_index", F.when(in_range, own).otherwise(made(F.col("answer_index"))).alias("annotation_id"), F.coalesce(F.get("cols.worker_id", F.col("answer_index")), F.lit("")).alias("worker_id"), "answer")
    both = a.unionByName(b)
    text, kind = normalized_answer(F.col("answer"))
    return both.select(*keys, "answer_index", "annotation_id", "worker_id", text.alias("normalized_answer"), kind.alias("answer_type"), evidence_texts(F.col("answer.evidence")).alias("evidence"))


def question_records(papers: DataFrame, matched: DataFrame, keep_unanswerable: bool = True) -> DataFrame:
    """One record per annotation with all references of its question attached.

    ``matched`` holds (paper_seq, question_index, answer_index, node_ids). Unanswerable
    annotations are dropped only after the references are gathered.
    """
    key = ["paper_seq", "question_index"]
    refs = answers(papers).drop("evidence").join(matched, [*key, "answer_index"], "left")
    ids = F.coalesce("node_ids", F.array().cast("array<int>"))
    refs = refs.withColumn("evidence_node_ids", ids).withColumn("has_text_evidence", F.size(ids) > 0).drop("node_ids")
    one = F.struct("answer_index", "annotation_id", "worker_id", "answer_type", "normalized_answer", "evidence_node_ids", "has_text_evidence")
    every = refs.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("answer_refs"))
    meta = papers.select("paper_seq", paper_id_of(papers).alias("paper_id"), compact(F.col("title")).alias("title"), compact(F.col("abstract")).alias("abstract"))
    out = refs.join(every, key).join(meta, "paper_seq")
    if not keep_unanswerable:
        out = out.where("answer_type <> 'unanswerable'")
    return out.select(
        F.concat_ws("::", "paper_id", "question_id", "annotation_id").alias("id"),
        "paper_seq",
        "paper_id",
        "question_id",
        "annotation_id",
        F.struct("paper_id", "title", "abstract").alias("doc_meta"),
        F.struct("question", "question_index").alias("query"),
        F.struct("answer_type", "normalized_answer").alias("target_answer"),
        F.transform("answer_refs", lambda x: x.dropFields("answer_index")).alias("answer_refs"),
        F.col("evidence_node_ids").alias("gold_evidence_node_ids"),
        F.transform(F.filter("answer_refs", lambda x: x["has_text_evidence"]), lambda x: x["evidence_node_ids"]).alias("gold_evidence_sets"),
    )


def record_meta(records: DataFrame, node_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Counters of each record: nodes, sections, paragraphs, links, gold evidence."""
    n = node_rows.groupBy("paper_seq").agg(F.count("*").alias("num_nodes"), F.countDistinct("section_index").alias("num_sections"), F.count_if(F.col("node_type") == "paragraph").alias("num_paragraphs"))
    e = edges.groupBy("paper_seq").agg(F.count("*").alias("num_routing_links"))
    out = records.join(n, "paper_seq").join(e, "paper_seq", "left").na.fill(0, ["num_routing_links"])
    gold = F.size("gold_evidence_node_ids")
    return out.select("id", "paper_seq", F.lit(SCHEMA_VERSION).alias("graph_schema_version"), "num_nodes", "num_sections", "num_paragraphs", "num_routing_links", gold.alias("num_gold_evidence"), (gold > 0).alias("has_text_evidence"), (F.size("gold_evidence_sets") > 0).alias("has_text_evidence_refs"))


def raw_documents(papers: DataFrame) -> DataFrame:
    """Titles where present and paragraphs, joined by blank lines, as in the source."""
    parts = F.concat(F.filter(F.array(F.coalesce("section_name", F.lit(""))), lambda x: x != ""), F.transform(F.coalesce("paragraphs", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit(""))))
    rows = raw_sections(papers).select("paper_seq", "section_index", parts.alias("parts"))
    ordered = F.array_sort(F.collect_list(F.struct("section_index", "parts")))
    return rows.groupBy("paper_seq").agg(ordered.alias("s")).select("paper_seq", F.array_join(F.flatten(F.transform("s", lambda x: x["parts"])), "\n\n").alias("raw_document_text"))


def segments(node_rows: DataFrame) -> DataFrame:
    """Headers wherever the section changes from the node before, and paragraphs, in order."""
    order = W.partitionBy("paper_seq").orderBy("section_index", "paragraph_index", "node_id")
    changed = node_rows.withColumn("changed", F.coalesce(F.lag("section_index").over(order) != F.col("section_index"), F.lit(True)))
    title = F.trim("section_title")
    head = F.struct(F.lit(0).alias("part"), F.lit("section_header").alias("segment_type"), F.when(title != "", F.concat(F.lit("Section: "), title)).otherwise(F.concat(F.lit("Section "), (F.col("section_index") + 1).cast("string"))).alias("text"))
    body = F.struct(F.lit(1).alias("part"), F.lit("paragraph").alias("segment_type"), F.col("text"))
    return changed.select("paper_seq", "node_id", F.explode(F.when(F.col("changed"), F.array(head, body)).otherwise(F.array(body))).alias("x")).select("paper_seq", "node_id", "x.part", "x.segment_type", "x.text")


def linearized_documents(papers: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Title, abstract, then each section's title and paragraphs, blank ones dropped."""
    rows = node_rows.groupBy("paper_seq", "section_index").agg(F.first("section_title").alias("t"), F.array_sort(F.collect_list(F.struct("paragraph_index", "node_id", "text"))).alias("p"))
    part = F.concat(F.array(F.when(compact(F.col("t")) != "", F.concat(F.lit("Section: "), compact(F.col("t")))).otherwise(F.concat(F.lit("Section "), (F.col("section_index") + 1).cast("string")))), F.filter(F.transform("p", lambda x: compact(x["text"])), lambda x: x != ""))
    body = rows.select("paper_seq", "section_index", part.alias("parts")).groupBy("paper_seq").agg(F.array_sort(F.collect_list(F.struct("section_index", "parts"))).alias("s"))
    head = papers.select("paper_seq", compact(F.col("title")).alias("title"), compact(F.col("abstract")).alias("abstract"))
    joined = head.join(body, "paper_seq")
    first = F.filter(F.array(F.when(F.col("title") != "", F.concat(F.lit("Title: "), "title")), F.when(F.col("abstract") != "", F.concat(F.lit("Abstract: "), "abstract"))), lambda x: x.isNotNull())
    return joined.select("paper_seq", F.array_join(F.concat(first, F.flatten(F.transform("s", lambda x: x["parts"]))), "\n\n").alias("linearized_context"))


def document_order(node_rows: DataFrame, key: str = "paper_seq") -> DataFrame:
    """node_idx: position of a node in document order, from 0."""
    order = W.partitionBy(key).orderBy("section_index", "paragraph_index", "node_id")
    return node_rows.withColumn("node_idx", F.row_number().over(order) - 1)


def prefix(df: DataFrame, limit: int, order: str) -> DataFrame:
    """The first rows by a sequence column; 0 for all. Never a bare limit, whose rows are arbitrary."""
    return df.where(F.col(order) <= limit) if limit else df


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")
