"""Problem 6: splitting oversized items at natural boundaries, by structure-tree packing.

A text is parsed into a tree: sections under headings of each depth, markup blocks, blocks
between blank lines, list entries by indentation, lines, sentences. Only nodes over the size
are descended into. Going up again, neighbours are merged while they fit, the rest of a
descended node with its siblings too. The size leaves room for the overlap; a sentence that
fits the limit stays whole even so and takes from the overlap; one over the limit is cut at
white space or, without any, at the size. The size is then lowered as long as the number of
pieces stays the same, so that no short rest is left.

Consecutive pieces overlap by ``overlap`` characters: from the first natural end in that
stretch if it leaves half of it, else from the first white space, else from the character.
It is less only where a single sentence leaves no room or the piece before is shorter; the
overlap of each piece is stated in its row.

Texts within the limit are filtered out on the JVM side and never reach Python.

Defined results: null texts and texts within the limit give no rows; blank stretches belong
to the piece before; concatenating ``text[start + overlap_chars:end]`` of the pieces in
order gives the text back, character by character; lengths are code points; repeated rows
are split once each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Natural ends: line breaks; . ! ? before white space; the CJK full stops.
LINE = r"\r\n|[\n\r\v\f\x1c-\x1e\x85  ]"
_END = re.compile(rf"(?:{LINE})\s*|[.!?](?=\s)\s*|[。！？]\s*")
_BREAK = re.compile(rf"{LINE}|[.!?](?=\s)|[。！？]")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_LINES = re.compile(rf"(?:{LINE})\s*")
_HEAD = re.compile(r"(?:(#{1,6})\s|(\d+(?:\.\d+)*)\.?\s+\S|[A-Z][^\n.!?]{0,78}$)")
_TAG = re.compile(r"(?<=\n)(?=[ \t]*<(?:h[1-6]|p|div|section|article|ul|ol|li|table|tr|blockquote|pre)\b)", re.I)
_ENTRY = re.compile(r"^([ \t]*)(?:[-*+•]|\d+[.)]|[a-z][.)])[ \t]", re.M)
_SPACE = re.compile(r"\s+")

PIECES = "tbl string, paper_id string, node_id int, piece int, start int, end int, overlap_chars int, forced_cut boolean, cut_class string, text string"


def _cuts(text: str, a: int, b: int, pattern: re.Pattern) -> list[tuple[int, int]]:
    """The spans that the pattern's matches end, white space kept with the span before."""
    out, at = [], a
    for m in pattern.finditer(text, a, b):
        if a < m.end() < b:
            out.append((at, m.end()))
            at = m.end()
    out.append((at, b))
    return out


def _depth(block: str) -> int:
    """Depth of the heading that a block is, 0 if it is none."""
    one = block.strip()
    m = _HEAD.match(one) if len(one) <= 80 and "\n" not in one else None
    return 0 if m is None else len(m[1]) if m[1] else m[2].count(".") + 1 if m[2] else 1


def _sections(depth: int):
    """Blocks between blank lines, gathered under the headings down to a depth."""

    def parts(text: str, a: int, b: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for x, y in _cuts(text, a, b, _BLANK):
            if not out or 0 < _depth(text[x:y]) <= depth:
                out.append((x, y))
            else:
                out[-1] = (out[-1][0], y)
        return out

    return parts


def _entries(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The outermost list entries, with what is nested in them; other lines stay together."""
    found = [(m.start(), len(m[1].expandtabs())) for m in _ENTRY.finditer(text, a, b) if m.start() == a or text[m.start() - 1] == "\n"]
    least = min((d for _, d in found), default=0)
    at = [a, *(x for x, d in found if d == least and x > a), b]
    return list(zip(at, at[1:]))


_LEVELS = (
    *(_sections(d) for d in (1, 2, 3, 6)),
    lambda t, a, b: _cuts(t, a, b, _TAG),
    lambda t, a, b: _cuts(t, a, b, _BLANK),
    _entries,
    lambda t, a, b: _cuts(t, a, b, _LINES),
    lambda t, a, b: _cuts(t, a, b, _END),
)


def cut_class(text: str, limit: int) -> str:
    """``forced`` if some stretch without natural end is longer than the limit."""
    at = 0
    for m in _BREAK.finditer(text):
        end = m.end() if text[m.start()] in ".!?。！？" else m.start()
        if end - at > limit:
            if len(text[at:end].strip()) > limit:
                return "forced"
        at = m.end()
    return "forced" if len(text[at:].strip()) > limit else "natural"


#: (start, end, ended by force, children)
Node = tuple[int, int, bool, list]


def _tree(text: str, a: int, b: int, size: int, limit: int, level: int = 0) -> Node:
    """The tree down to nodes of at most ``size``, or single sentences of at most ``limit``."""
    while b - a > size and level < len(_LEVELS):
        parts = _LEVELS[level](text, a, b)
        level += 1
        if len(parts) > 1:
            return a, b, False, [_tree(text, x, y, size, limit, level) for x, y in parts]
    if b - a <= limit:
        return a, b, False, []
    whole, out = (a, b), []
    while b - a > size:
        at = -1
        for m in _SPACE.finditer(text, a + size // 2, a + size):
            at = m.end()
        at = at if a < at <= a + size else a + size
        out.append((a, at, True, []))
        a = at
    return *whole, False, [*out, (a, b, False, [])]


def _pack(node: Node, size: int) -> list[tuple[int, int, bool]]:
    """Bottom-up: neighbouring parts are merged while they fit, across the ends of nodes too."""
    a, b, forced, children = node
    if b - a <= size or not children:
        return [(a, b, forced)]
    out: list[tuple[int, int, bool]] = []
    for child in children:
        for x, y, f in _pack(child, size):
            if out and y - out[-1][0] <= size:
                out[-1] = (out[-1][0], y, f)
            else:
                out.append((x, y, f))
    return out


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """Pieces (start, end, overlap with the piece before, cut by force) within the limit."""
    size = max(1, limit - overlap)
    tree = _tree(text, 0, len(text), size, limit)
    packed = _pack(tree, size)
    low, high = len(text) // len(packed), size  # the least size with as many pieces
    while high - low > max(1, size // 64):
        middle = (low + high) // 2
        made = _pack(tree, middle)
        if len(made) <= len(packed):
            packed, high = made, middle
        else:
            low = middle
    out: list[tuple[int, int, int, bool]] = []
    for a, b, forced in packed:
        if out and not text[a:b].strip() and b - out[-1][0] <= limit:
            out[-1] = (out[-1][0], b, *out[-1][2:])
            continue
        back = 0
        if out and overlap:
            low = max(out[-1][0] + 1, a - min(overlap, limit - (b - a)))
            if low < a:
                natural = next((m.end() for m in _END.finditer(text, max(0, low - 1), a) if low <= m.end() <= (low + a) // 2), None)
                if natural is None:
                    natural = next((m.end() for m in _SPACE.finditer(text, low, a) if m.end() <= (low + a) // 2), low)
                back = a - natural
        out.append((a - back, b, back, forced))
    return out


def _run(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for tbl, paper, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                kind = cut_class(text, limit)
                for k, (a, b, back, forced) in enumerate(split_text(text, limit, overlap)):
                    rows.append((tbl, paper, node, k, a, b, back, forced, kind, text[a:b] if with_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def split_items(df: DataFrame, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """Pieces of the rows (tbl, paper_id, node_id, text) whose text is over the limit."""
    if limit < 2 or not 0 <= overlap < limit:
        raise ValueError("limit must be at least 2, overlap from 0 to under the limit")
    big = df.select("tbl", "paper_id", F.col("node_id").cast("int"), "text").where(F.char_length("text") > limit)
    return big.mapInArrow(_run(limit, overlap, with_text), PIECES)


def reassembled(pieces: DataFrame) -> DataFrame:
    """Per item the pieces, and length and digest of the text they give without the overlaps."""
    own = F.expr("substring(text, overlap_chars + 1)")
    each = pieces.groupBy("tbl", "paper_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("piece", own.alias("own")))).alias("p"), F.max(F.char_length("text")).alias("longest"))
    text = F.array_join(F.transform("p", lambda x: x["own"]), "")
    return each.select("tbl", "paper_id", "node_id", F.char_length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"), F.col("longest").cast("bigint").alias("longest"))


def node_items(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.lit("nodes").alias("tbl"), "paper_id", "node_id", "text")


def document_items(raw: DataFrame) -> DataFrame:
    return raw.select(F.lit("raw_records").alias("tbl"), "paper_id", F.lit(0).alias("node_id"), F.col("raw_document_text").alias("text"))
