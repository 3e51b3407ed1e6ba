"""Text functions as Column expressions; all run inside code generation, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"

# Patterns and words of the routable paragraph rule.
PLACEHOLDER_TITLE = r"^(?:(?:(?:::+)(?:\s*:::+)*)|Section \d+)$"
NUMBERING_ONLY = r"^\d+(?:\.\d+)+(?:[A-Za-z]+)?$"
EMAIL = r"(?U)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
AFFILIATION = "department of|university|institute|faculty of|school of"
FLOAT_PREFIX = "FLOAT SELECTED"

#: Instructions that leak into outputs, with their weights.
LEAKAGE = [
    (r"^\s*Section title\s*:", 0.5),
    (r"^\s*Paragraph node\s*:", 1.0),
    (r"^\s*Evidence\s*:", 1.0),
    (r"^\s*Summary\s*:", 1.0),
    (r"^\s*Phrase\s*:", 1.0),
    (r"^\s*Summary\s+\d+\s*:", 1.0),
    (r"^\s*Rules\s*:", 1.0),
    (r"\bWrite up to five concise retrieval phrases for one paragraph node\b", 2.0),
    (r"\bWrite 1 to 5 concise retrieval phrases for the paragraph node\b", 2.0),
    (r"\bEach phrase must use at most 5 words\b", 2.0),
    (r"\bWrite one phrase per line\b", 2.0),
    (r"\bOutput one phrase per line\b", 2.0),
    (r"\bPrefer exact key terms from the paragraph\b", 2.0),
    (r"\bKeep important names, datasets, methods, results, numbers, and comparisons\b", 2.0),
    (r"\bIf the paragraph is about an action or relation\b", 2.0),
    (r"\bKeep the subject and relation words together\b", 2.0),
    (r"\bDo not replace specific words with generic words\b", 2.0),
    (r"\bDo not write explanations, labels, bullets, or citations\b", 2.0),
    (r"\bDo not use bullets, numbering, or separators\b", 2.0),
    (r"^\s*(?:system|user|assistant)\s*:", 2.0),
    (r"\bYou are Qwen\b", 3.0),
    (r"\blabels or explanations\b", 0.5),
    (r"\bphrase per line\b", 0.5),
]
MAX_PHRASE_WORDS = 5
MAX_PHRASES = 5

#: Link labels and their phrases.
LINK_PHRASES = {
    "DATASET_INFO": "gives dataset information",
    "BASELINE_COMPARISON": "names baselines or comparisons",
    "EVALUATION": "gives evaluation setup or metrics",
    "ANNOTATION_SCHEMA": "gives labels or annotation scheme",
    "METHOD_DETAILS": "explains method or features",
    "RESULTS": "reports results or findings",
    "EXAMPLE_CASE": "gives example or case",
    "OTHER": "continues related content",
}
LEADING_MARKUP = r"^\s*(?:[-*]|[0-9]+[.)])\s*"

#: The generation prompts, line by line.
NODE_PROMPT = [
    "Write 1 to 5 concise retrieval phrases for the paragraph node.",
    "Each phrase must use at most 5 words.",
    "Write one phrase per line.",
    "Prefer exact key terms from the paragraph.",
    "When a phrase captures a relation or comparison, keep the related entities and relation/comparison words together.",
    "Do not replace specific words with generic words.",
    "Do not write explanations, labels, bullets, or citations.",
    "Do not use bullets, numbering, or separators.",
]
LINK_PROMPT = "Choose the best label for the destination paragraph."
RETRY_PROMPT = ("The previous output was invalid because it was not exactly one allowed label.", "Try again. Output exactly one label from the list and no other words.")


def compact(c: Column) -> Column:
    """White space runs to one blank, ends trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS + "+", " "))


def words(c: Column) -> Column:
    """Words of a compacted text."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def section_title(title: Column, index: Column) -> Column:
    """The compacted title, 'Section i+1' for a blank one."""
    return F.coalesce(blank_to_null(compact(title)), F.concat(F.lit("Section "), (index + 1).cast("string")))


def is_routable(text: Column, title: Column) -> Column:
    """Whether a paragraph is content: no numbering, address, affiliation or list stub."""
    t, head = compact(text), compact(title)
    n = F.size(words(t))
    placeholder = head.rlike(PLACEHOLDER_TITLE)
    unpunctuated = ~t.rlike("[.!?;:]")
    commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    stub = (t.startswith("— ") | t.startswith("- ")) & (n <= 8)
    mark = F.contains(t, F.lit("$^{")) & (n <= 40)
    affiliation = (n <= 24) & F.lower(t).rlike(AFFILIATION) & unpunctuated
    names = (n <= 16) & (commas >= 4) & unpunctuated
    return (t != "") & ~t.rlike(NUMBERING_ONLY) & ~t.rlike(EMAIL) & ~stub & ~(placeholder & (mark | affiliation | names))


def distinct_ignoring_case(a: Column) -> Column:
    """The first of equal strings, compared in lower case, in order."""
    low = F.transform(a, F.lower)
    return F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def normalized_answer(a: Column) -> tuple[Column, Column]:
    """(answer, kind) of an answer struct by precedence: unanswerable, spans, free form, yes/no."""
    spans = distinct_ignoring_case(F.filter(F.transform(F.coalesce(a["extractive_spans"], F.array().cast("array<string>")), compact), lambda x: x != ""))
    free = compact(a["free_form_answer"])
    none = F.coalesce(a["unanswerable"], F.lit(False))
    has_spans = F.size(spans) > 0
    text = F.when(none, "unanswerable").when(has_spans, F.array_join(spans, " ; ")).when(free != "", free).when(a["yes_no"], "yes").when(~a["yes_no"], "no").otherwise("unanswerable")
    kind = F.when(none, "unanswerable").when(has_spans, "extractive").when(free != "", "free_form").when(a["yes_no"].isNotNull(), "yes_no").otherwise("unanswerable")
    return text, kind


def evidence_texts(evidence: Column) -> Column:
    """Compacted distinct evidence without pointers to floats."""
    parts = F.transform(F.coalesce(evidence, F.array().cast("array<string>")), compact)
    return distinct_ignoring_case(F.filter(parts, lambda x: (x != "") & ~x.startswith(FLOAT_PREFIX)))


def score_text(c: Column) -> Column:
    """Lower case, other than a-z and 0-9 to blanks, articles dropped, compacted."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\b(?:a|an|the)\b", " "), WS + "+", " "))


def memory_token(c: Column, prefix: str = "MEM_") -> Column:
    """Upper case with underscores, prefixed unless MEM_ or REL_ is there; empty to <prefix>EMPTY."""
    t = F.btrim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9_]+", "_"), F.lit("_"))
    return F.when(t == "", prefix + "EMPTY").when(t.startswith("MEM_") | t.startswith("REL_"), t).otherwise(F.concat(F.lit(prefix), t))


def expand_memory(c: Column) -> Column:
    """A run of several MEM_ tokens to its pieces; what stands before the first is dropped."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), f"^{WS}+|{WS}+$", "")
    pieces = F.filter(F.transform(F.split(t, "(?i)(?=MEM_)"), lambda x: F.btrim(x, F.lit(" \t\r\n,;|/"))), lambda x: (x != "") & F.upper(x).startswith("MEM_"))
    many = F.size(F.split(F.upper(t), "MEM_")) > 2
    return F.when(t == "", F.array().cast("array<string>")).when(many & (F.size(pieces) > 0), pieces).otherwise(F.array(t))


def memory_tokens(tokens: Column, fallback: Column | None = None, most: int = 12) -> Column:
    """Distinct memory tokens in order, at most ``most`` (0: all), MEM_EMPTY for none."""
    empty = F.array().cast("array<string>")
    raw = F.coalesce(tokens, empty) if fallback is None else F.concat(F.coalesce(tokens, empty), F.coalesce(fallback, empty))
    flat = F.transform(F.flatten(F.transform(raw, expand_memory)), lambda x: memory_token(x))
    out = F.array_distinct(F.transform(flat, lambda x: F.when(x.startswith("MEM_"), x).otherwise(F.concat(F.lit("MEM_"), x))))
    out = F.slice(out, 1, most) if most else out
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("MEM_EMPTY")))


def token_phrase(tokens: Column) -> Column:
    """Tokens back to readable phrases, joined with ' ; '."""
    plain = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda x: compact(F.replace(F.regexp_replace(x, "^(?:MEM_|REL_)", ""), F.lit("_"), F.lit(" "))))
    return F.array_join(F.filter(plain, lambda x: x != ""), " ; ")


def phrases(output: Column, most: int = 0) -> Column:
    """Lines of an output, compacted, blank ones dropped; the first ``most`` if given."""
    out = F.filter(F.transform(F.split(F.coalesce(output, F.lit("")), "\n+"), compact), lambda x: x != "")
    return F.slice(out, 1, most) if most else out


def summary_phrases(title: Column, summary: Column) -> Column:
    """Section title and the phrases of a summary between semicolons or line breaks."""
    parts = F.filter(F.transform(F.split(F.coalesce(summary, F.lit("")), "[;\n]"), compact), lambda x: x != "")
    return F.concat(F.filter(F.array(compact(title)), lambda x: x != ""), parts)


def long_phrase_penalty(output: Column) -> Column:
    """Words beyond five, summed over phrases."""
    over = F.transform(phrases(output), lambda x: F.greatest(F.size(words(x)) - MAX_PHRASE_WORDS, F.lit(0)))
    return F.aggregate(over, F.lit(0), lambda a, x: a + x).cast("double")


def long_output_penalty(output: Column, most: int = MAX_PHRASES) -> Column:
    return F.greatest(F.size(phrases(output)) - most, F.lit(0)).cast("double")


def leakage_penalty(output: Column) -> Column:
    """Weights of leaked instructions times their occurrences."""
    text = F.coalesce(output, F.lit(""))
    return sum((F.regexp_count(text, F.lit("(?imd)" + p)) * F.lit(w) for p, w in LEAKAGE), F.lit(0.0))


def redundancy_penalty(output: Column) -> Column:
    """Share of repeated phrases, compared by letters and digits."""
    plain = F.filter(F.transform(phrases(output), lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))), lambda x: x != "")
    n = F.size(plain)
    return F.when(n < 2, 0.0).otherwise((n - F.size(F.array_distinct(plain))) / n)


def link_label(output: Column) -> Column:
    """The link label an output names, null if it names none."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(output, F.lit("")), f"^{WS}+|{WS}+$", ""), LEADING_MARKUP, "")
    t = F.btrim(F.replace(F.upper(compact(t)), F.lit("-"), F.lit("_")), F.lit(".,:;`'\"[](){}"))
    return F.when(t.isin(*LINK_PHRASES), t)


def clean_link_output(output: Column) -> Column:
    return compact(F.regexp_replace(F.regexp_replace(F.coalesce(output, F.lit("")), f"^{WS}+|{WS}+$", ""), LEADING_MARKUP, ""))


def link_phrase(edge_type: Column, label: Column, output: Column) -> Column:
    """Direction and the label's phrase, or the cleaned output without a label."""
    way = F.when(F.coalesce(edge_type, F.lit("")) == "paragraph_next", "next paragraph").otherwise("previous paragraph")
    by_label = F.element_at(F.create_map(*[F.lit(x) for kv in LINK_PHRASES.items() for x in kv]), label)
    phrase = F.coalesce(by_label, clean_link_output(output))
    return F.when(phrase == "", way).otherwise(compact(F.concat_ws(" ", way, phrase)))


def node_prompt(title: Column, text: Column) -> Column:
    """The generation prompt of a paragraph; an empty paragraph is an error."""
    t = compact(text)
    head = F.coalesce(blank_to_null(compact(title)), F.lit("Unknown"))
    made = F.concat_ws("\n", *[F.lit(x) for x in [*NODE_PROMPT, "", "Section title:"]], head, F.lit(""), F.lit("Paragraph node:"), t)
    return F.when(t == "", F.raise_error(F.lit("empty paragraph"))).otherwise(made)


def link_prompt(src_title: Column, src: Column, dst_title: Column, dst: Column) -> Column:
    a, b = compact(src), compact(dst)
    name = lambda c: F.coalesce(blank_to_null(compact(c)), F.lit("Unknown"))
    made = F.concat_ws("\n", F.lit(LINK_PROMPT), F.lit("Labels: " + ", ".join(LINK_PHRASES)), F.lit(""), F.lit("Source paragraph:"), name(src_title), a, F.lit(""), F.lit("Destination paragraph:"), name(dst_title), b)
    return F.when((a == "") | (b == ""), F.raise_error(F.lit("empty paragraph"))).otherwise(made)


def retry_prompt(prompt: Column, invalid: Column) -> Column:
    return F.concat_ws("\n", F.lit(RETRY_PROMPT[0]), F.lit("Previous output:"), F.coalesce(blank_to_null(compact(invalid)), F.lit("<empty>")), F.lit(""), F.lit(RETRY_PROMPT[1]), F.lit(""), prompt)


def chat_prompt(system: str, user: Column) -> Column:
    """The plain form for tokenizers without a chat template."""
    return F.concat(F.lit(system + "\n\n"), user)


def safe_name(c: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", "_"), F.lit("_")))


def paper_key(paper_id: Column, meta_paper_id: Column, record_id: Column, whole: Column) -> Column:
    """paper_id, else that of the metadata, else the record id's part before '::', else a hash."""
    prefix = F.when(F.contains(record_id, F.lit("::")), F.split_part(record_id, F.lit("::"), F.lit(1)))
    return F.coalesce(blank_to_null(paper_id), blank_to_null(meta_paper_id), blank_to_null(prefix), F.sha2(F.to_json(whole), 256))


def prefix_segment(title: Column, abstract: Column) -> Column:
    t, a = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(abstract, F.lit("")))
    return F.concat(F.lit("<prefix>"), F.concat_ws("\n\n", F.when(t != "", F.concat(F.lit("Title: "), t)), F.when(a != "", F.concat(F.lit("Abstract: "), a))), F.lit("</prefix>"))


def query_segment(question: Column) -> Column:
    return F.concat(F.lit("<query>"), F.coalesce(question, F.lit("")), F.lit("</query>"))


def target_segment(answer: Column) -> Column:
    return F.concat(F.lit("<target>"), F.coalesce(answer, F.lit("")), F.lit("</target>"))


def evidence_segment(title: Column, node_id: Column, text: Column) -> Column:
    return F.concat(F.lit("<evidence>Section: "), F.trim(F.coalesce(title, F.lit(""))), F.lit("\nParagraph "), node_id.cast("string"), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("</evidence>"))


def with_end_token(ids: Column, end: int) -> Column:
    """The end token appended where it is missing."""
    return F.when((F.size(ids) > 0) & (F.element_at(ids, -1) == end), ids).otherwise(F.concat(ids, F.array(F.lit(end))))
