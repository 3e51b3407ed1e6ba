"""Problem 5: deeply nested records to related flat tables.

Each record is stream-parsed, a batch at a time, into triples of path, ordinals and value:
``qas[].answers[].answer.evidence[]`` with ordinals (question, answer, element). The
triples are grouped by their repeated ancestor and each group is pivoted into one table,
whose rows carry the record's key and the ordinals of all ancestors, so that a row's
parent is the row with one ordinal less. A table may gather several encodings of the
same content. Parsing works on Arrow offsets and needs no shuffle: a record's triples
never leave the task that read it.

Defined results: ordinals are positions in the source arrays, null elements counted; null
arrays and null records give no rows; null elements give none unless the table says so;
blank strings do; records with the same key are flattened each; columns not named in
the tables are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Triples = tuple[np.ndarray, list[np.ndarray], pa.Array]


@dataclass(frozen=True)
class Encoding:
    """Where one encoding keeps a table's rows and columns.

    rows: ancestor paths, each with whether its null elements give rows as well;
    within: a path of the leading ordinals that must exist, if any;
    columns: column name to leaf path.
    """

    rows: tuple[tuple[str, bool], ...]
    columns: dict[str, str] = field(default_factory=dict)
    within: str | None = None


@dataclass(frozen=True)
class Flat:
    """A flat table: the names of its ordinals, the types of its columns, its encodings."""

    ordinals: tuple[str, ...]
    columns: dict[str, str]
    encodings: tuple[Encoding, ...]


def parse_triples(array: pa.Array, path: str, rows: np.ndarray, ordinals: list[np.ndarray], out: dict[str, Triples]) -> None:
    """Adds the triples of an array and all below it to ``out``, by path."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    out[path] = (rows, ordinals, array)
    kind = array.type
    if pa.types.is_struct(kind):
        for name, child in zip([f.name for f in kind], array.flatten()):
            parse_triples(child, f"{path}.{name}", rows, ordinals, out)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        lengths = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum(), dtype=np.int64) - np.repeat(begin, lengths)
        parse_triples(array.flatten(), f"{path}[]", np.repeat(rows, lengths), [*(np.repeat(o, lengths) for o in ordinals), at], out)


def _codes(rows: np.ndarray, ordinals: list[np.ndarray], radix: int) -> np.ndarray:
    code = rows.astype(np.int64)
    for o in ordinals:
        code = code * radix + o
    return code


def _radix(found: dict[str, Triples]) -> int:
    return 1 + max((int(o.max()) for _, ords, _ in found.values() for o in ords if len(o)), default=0)


def _row_codes(enc: Encoding, found: dict[str, Triples], radix: int) -> np.ndarray:
    parts = []
    for path, nulls in enc.rows:
        if path in found:
            rows, ords, values = found[path]
            code = _codes(rows, ords, radix)
            parts.append(code if nulls else code[values.is_valid().to_numpy(zero_copy_only=False)])
    codes = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    if enc.within and len(codes):
        rows, ords, _ = found[enc.within]
        depth = len(found[enc.rows[0][0]][1]) - len(ords)
        codes = codes[np.isin(codes // radix**depth, _codes(rows, ords, radix))]
    return codes


def pivot(spec: Flat, found: dict[str, Triples], keys: pa.Array, n_rows: int) -> list[pa.Array] | None:
    """Key, ordinals and columns of one table; None if the ordinals' product is too large."""
    radix, depth = _radix(found), len(spec.ordinals)
    if n_rows * radix**depth >= 2**62:
        return None
    per: list[list[pa.Array]] = []
    for enc in spec.encodings:
        codes = _row_codes(enc, found, radix)
        ords = [codes // radix ** (depth - 1 - k) % radix for k in range(depth)]
        cols = [keys.take(pa.array(codes // radix**depth)), *(pa.array(o.astype(np.int32)) for o in ords)]
        for name, kind in spec.columns.items():
            arrow = {"string": pa.string(), "boolean": pa.bool_()}[kind]
            path = enc.columns.get(name)
            if path not in found:
                cols.append(pa.nulls(len(codes), arrow))
                continue
            rows, o, values = found[path]
            theirs = _codes(rows, o, radix)
            source = np.full(len(codes), -1, np.int64)
            if len(codes) and len(theirs):
                to = np.minimum(np.searchsorted(codes, theirs), len(codes) - 1)
                hit = codes[to] == theirs
                source[to[hit]] = np.flatnonzero(hit)
            cols.append(values.take(pa.array(source, mask=source < 0)).cast(arrow))
        per.append(cols)
    return [pa.concat_arrays(list(c)) for c in zip(*per)]


def _parsed(batch: pa.RecordBatch) -> dict[str, Triples]:
    found: dict[str, Triples] = {}
    rows = np.arange(batch.num_rows, dtype=np.int64)
    for name, column in zip(batch.schema.names[1:], batch.columns[1:]):
        parse_triples(column, name, rows, [], found)
    return found


def _slices(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _halves(batch: pa.RecordBatch, spec: Flat) -> Iterator[list[pa.Array]]:
    made = pivot(spec, _parsed(batch), batch.column(0), batch.num_rows)
    if made is not None:
        yield made
    elif batch.num_rows > 1:
        half = batch.num_rows // 2
        yield from _halves(batch.slice(0, half), spec)
        yield from _halves(batch.slice(half), spec)
    else:
        raise ValueError("a record's arrays are too long to number")


def _sources(specs: list[Flat]) -> list[str]:
    paths = [p for s in specs for e in s.encodings for p in (*(r for r, _ in e.rows), *e.columns.values(), *([e.within] if e.within else []))]
    return list(dict.fromkeys(p.split(".")[0].split("[")[0] for p in paths))


def flatten(df: DataFrame, key: str, spec: Flat) -> DataFrame:
    """The flat table of a specification: key, ordinals, columns."""
    rows = df.select(key, *_sources([spec]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for cols in _halves(batch, spec):
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays(cols, [key, *spec.ordinals, *spec.columns])

    kinds = [f"{key} {rows.schema[key].dataType.simpleString()}", *(f"{o} int" for o in spec.ordinals), *(f"{c} {k}" for c, k in spec.columns.items())]
    return rows.mapInArrow(run, ", ".join(kinds))


def positions(df: DataFrame, key: str, specs: dict[str, Flat], names: tuple[str, ...] = ("pos_a", "pos_b", "pos_c")) -> DataFrame:
    """The rows of all tables in one pass: key, piece and ordinals, -1 where there is none."""
    rows = df.select(key, *_sources(list(specs.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for piece, spec in specs.items():
                bare = Flat(spec.ordinals, {}, spec.encodings)
                for cols in _halves(batch, bare):
                    n = len(cols[0])
                    rest = [pa.array(np.full(n, -1, np.int32))] * (len(names) - len(spec.ordinals))
                    if n:
                        yield pa.RecordBatch.from_arrays([cols[0], pa.array([piece] * n), *cols[1:], *rest], [key, "piece", *names])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, piece string, " + ", ".join(f"{n} int" for n in names))


_A, _B = "qas[].answers[]", "qas_cols.answers[].answer[]"
_Q = "qas_cols.question[]"

#: The tables of papers, for both of their encodings.
PAPER_TABLES = {
    "section": Flat(
        ("section",),
        {"section_name": "string"},
        (
            Encoding((("full_text[]", False),), {"section_name": "full_text[].section_name"}),
            Encoding((("full_text_cols.section_name[]", True), ("full_text_cols.paragraphs[]", True)), {"section_name": "full_text_cols.section_name[]"}),
        ),
    ),
    "paragraph": Flat(
        ("section", "paragraph"),
        {"text": "string"},
        (
            Encoding((("full_text[].paragraphs[]", False),), {"text": "full_text[].paragraphs[]"}),
            Encoding((("full_text_cols.paragraphs[][]", False),), {"text": "full_text_cols.paragraphs[][]"}),
        ),
    ),
    "question": Flat(
        ("question",),
        {"question_text": "string", "question_id": "string"},
        (
            Encoding((("qas[]", False),), {"question_text": "qas[].question", "question_id": "qas[].question_id"}),
            Encoding(((_Q, True),), {"question_text": _Q, "question_id": "qas_cols.question_id[]"}),
        ),
    ),
    "answer": Flat(
        ("question", "answer"),
        {"annotation_id": "string", "worker_id": "string", "unanswerable": "boolean", "free_form_answer": "string", "yes_no": "boolean"},
        (
            Encoding(((_A, False),), {"annotation_id": f"{_A}.annotation_id", "worker_id": f"{_A}.worker_id", **{c: f"{_A}.answer.{c}" for c in ("unanswerable", "free_form_answer", "yes_no")}}),
            Encoding(((_B, True),), {"annotation_id": "qas_cols.answers[].annotation_id[]", "worker_id": "qas_cols.answers[].worker_id[]", **{c: f"{_B}.{c}" for c in ("unanswerable", "free_form_answer", "yes_no")}}, _Q),
        ),
    ),
    "span": Flat(
        ("question", "answer", "element"),
        {"text": "string"},
        (
            Encoding(((f"{_A}.answer.extractive_spans[]", False),), {"text": f"{_A}.answer.extractive_spans[]"}),
            Encoding(((f"{_B}.extractive_spans[]", False),), {"text": f"{_B}.extractive_spans[]"}, _Q),
        ),
    ),
    "evidence": Flat(
        ("question", "answer", "element"),
        {"text": "string"},
        (
            Encoding(((f"{_A}.answer.evidence[]", False),), {"text": f"{_A}.answer.evidence[]"}),
            Encoding(((f"{_B}.evidence[]", False),), {"text": f"{_B}.evidence[]"}, _Q),
        ),
    ),
}
