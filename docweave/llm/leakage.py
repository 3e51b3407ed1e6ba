"""Problem 8: evaluation texts leaking into training text, by latent semantic retrieval.

Passages are TF-IDF vectors over the words and word pairs of the evaluation items, with
document frequencies counted over the whole corpus. Terms that stand mostly in copies of an
item (``COPIED`` pairs nearly in its order) count only outside of these: however many copies
an item has, they don't make its own terms common. A randomised SVD of the items' matrix
(products with its distributed rows on the executors; factors of bounded size are
orthogonalised on the driver) gives a latent space of at most ``RANK`` dimensions; every
corpus window is projected into it and compared with all items by cosine, the norm of the
window being that of the whole vector, so that windows of other matter fall behind.
Candidates are checked by a longest common subsequence of the item and the candidate's
stretch of the document, whose dense part must cover a connected half of the item, and by
the item's rare words and numbers (its answers), which must be there too.

The corpus is read and divided into words once, for all items: documents become numbers of
the items' words, written as binary chunks that both the count of frequencies and the search
read. Items are a stated query set. Groups of at most ``GROUP_ITEMS`` items and
``GROUP_TOKENS`` words share a pass; in it blocks of at most ``BLOCK_ITEMS`` items have a
latent space each. So all that is broadcast is bounded.

Defined results: null, empty and wordless texts and items and documents without id give no
rows; equal items are each found; repeated documents are searched row by row and reported
once per doc_id and item; other columns are ignored; an empty table on either side gives no
rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import cut

GROUP_ITEMS, GROUP_TOKENS, BLOCK_ITEMS = 4096, 1_000_000, 256
RANK = 128
WINDOW, STRIDE = 48, 24
#: Pairs of one item in nearly its order that make a copy (a third of its words in items under 48), and the shift that counts as order.
COPIED, SHIFT = 16, 8
#: Documents without any term that every corpus counts as having besides, so that frequencies mean something in small ones too.
PRIOR_DOCUMENTS = 1000
#: Words of a chunk of documents.
CHUNK = 400_000
_HAN = re.compile("([㐀-鿿぀-ヿ])")
_WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id bigint, item_id bigint, cosine double, coverage double"


def _normal(text: str) -> str:
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _FORMAT.sub("", text)
        text = _HAN.sub(r" \1 ", text)
    return text.lower()


def words(text: str) -> list[str]:
    """Lower case words without format characters and inner hyphens; Han and Kana signs are words each."""
    return _WORD.findall(_HYPHEN.sub("", _normal(text)))


def divided(text: str) -> dict[str, list[str]]:
    """Words that a copy may write in parts: hyphenated ones, and letters with digits."""
    out = {}
    for m in _COMPOUND.finditer(_normal(text)):
        parts = _PART.findall(m.group())
        if len(parts) > 1:
            out["".join(parts)] = parts
    return out


_FORMAT = re.compile("[­؜᠎​-‏‪-‮⁠-⁯﻿]")
_COMPOUND = re.compile(r"[^\W_]+(?:[-‐‑–][^\W_]+)*")
_PART = re.compile(r"[^\W\d_]+|\d+")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑–](?:\n(?=[a-zà-ÿ])|(?=\w))")


class Items:
    """The items of a group: vocabulary and terms, later weights and the latent spaces of its blocks."""

    def __init__(self, items: list[tuple[int, list[str]]], compounds: dict[str, list[str]] | None = None):
        """``compounds``: words of the items to the parts they may be written in."""
        self.ids = [i for i, _ in items]
        self.word_id: dict[str, int] = {}
        self.tokens = [np.array([self.word_id.setdefault(w, len(self.word_id)) for w in t], np.int64) for _, t in items]
        self.own = len(self.word_id)  # the numbers after it are parts of words and neighbours written as one
        number = lambda w: self.word_id.setdefault(w, len(self.word_id))
        self.parts = {self.word_id[w]: np.array([number(x) for x in p], np.int64) for w, p in (compounds or {}).items() if w in self.word_id}
        self.joined: dict[int, list[int]] = {}
        for _, t in items:
            for x, y in zip(t, t[1:]):
                made = number(x + y)
                for w in (x, y):
                    if made not in (held := self.joined.setdefault(self.word_id[w], [])):
                        held.append(made)
        self.v = len(self.word_id)
        runs = [self.run_codes(t) for t in self.tokens]
        # each pair with its first place, so that items that share pairs share its count of copies
        self.runs, first = np.unique(np.concatenate([*runs, np.zeros(0, np.int64)]), return_index=True)
        self.run_item = np.repeat(np.arange(len(runs)), [len(r) for r in runs])[first]
        self.run_at = np.concatenate([*(np.arange(len(r)) for r in runs), np.zeros(0, np.int64)])[first]
        self.copied_runs = np.array([min(COPIED, max(2, len(t) // 3)) for t in self.tokens], np.int64)
        self.n_terms = self.v + len(self.runs)
        self.weight = np.ones(self.n_terms)
        self.rare = np.zeros(self.v, bool)
        self.blocks: list[Block] = []
        self.bits: dict[int, dict[int, int]] = {}  # filled by the tasks as they go

    def run_codes(self, t: np.ndarray) -> np.ndarray:
        """Codes of the word pairs; -1 where a word is unknown."""
        if len(t) < 2:
            return np.zeros(0, np.int64)
        a, b = t[:-1], t[1:]
        code = a * self.v + b
        code[(a < 0) | (b < 0)] = -1
        return code

    def terms(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, terms) of a sequence of word numbers, words and pairs, by position."""
        at = np.flatnonzero(t >= 0)
        code = self.run_codes(t)
        known = np.flatnonzero(code >= 0)
        if len(self.runs) and len(known):
            k = np.minimum(np.searchsorted(self.runs, code[known]), len(self.runs) - 1)
            own = self.runs[k] == code[known]
            run_at, run_terms = known[own], self.v + k[own]
        else:
            run_at = run_terms = np.zeros(0, np.int64)
        pos = np.concatenate((at, run_at))
        term = np.concatenate((t[at], run_terms))
        order = np.argsort(pos, kind="stable")
        return pos[order], term[order]

    def holds(self, text: np.ndarray, word: int) -> bool:
        """Whether a text has a word, its parts side by side, or the word joined to a neighbour of it."""
        if (text == word).any():
            return True
        if (p := self.parts.get(word)) is not None and len(text) >= len(p):
            if (np.lib.stride_tricks.sliding_window_view(text, len(p)) == p).all(1).any():
                return True
        return bool(np.isin(text, self.joined.get(word, [])).any())

    def outside_copies(self, offsets: np.ndarray, pos: np.ndarray, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Which terms of texts stand in no cell where the text follows an item."""
        is_run = np.flatnonzero(term >= self.v)
        d, item, at = doc[is_run], self.run_item[term[is_run] - self.v], self.run_at[term[is_run] - self.v]
        size = np.bincount(d * len(self.ids) + item, minlength=1)
        enough = np.flatnonzero(size[d * len(self.ids) + item] >= self.copied_runs[item])
        if not len(enough):
            return np.ones(len(pos), bool)
        d, item, at, p = d[enough], item[enough], at[enough], pos[is_run[enough]]
        band = (p - offsets[d] - at) // SHIFT
        low, width = int(band.min()), int(band.max() - band.min()) + 2
        key = (item * len(offsets) + d) * width + band - low
        bands, size = _pairs(key)
        bands = bands[size >= self.copied_runs[bands // (len(offsets) * width)]]
        member = np.isin(key, np.concatenate((bands, bands + 1)))
        p, d = p[member], d[member]
        cells = int((np.diff(offsets)).max()) // STRIDE + 2
        copied = np.unique(np.concatenate([d * cells + (p + k - offsets[d]) // STRIDE for k in (0, 2)]))
        return ~np.isin(doc * cells + (pos - offsets[doc]) // STRIDE, copied)


class Block:
    """Some items of a group with their latent space."""

    def __init__(self, items: range, terms: np.ndarray):
        self.items = items
        self.terms = terms
        self.latent = np.zeros((len(terms), 0), np.float32)
        self.item_latent = np.zeros((len(items), 0), np.float32)


def _pairs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and how often each and its follower come."""
    at, size = np.unique(key, return_counts=True)
    both = size.copy()
    both[:-1] += np.where(at[1:] == at[:-1] + 1, size[1:], 0)
    return at, both


NUMBERED = "ids binary, offsets binary, tokens binary"


def numbered(documents: DataFrame, word_id: dict[str, int]) -> DataFrame:
    """Documents as numbers of the items' words, in chunks: ids, where each begins, numbers.

    Words of no item are -1, and two of them follow each document.
    """
    held = documents.sparkSession.sparkContext.broadcast(word_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        ids: list[int] = []
        flat: list[int] = []
        offsets = [0]

        def chunk() -> pa.RecordBatch:
            parts = (np.array(ids, np.int64), np.array(offsets, np.int64), np.array(flat, np.int32))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["ids", "offsets", "tokens"])

        for batch in batches:
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i)
                flat.extend([get(w, -1) for w in words(text)])
                flat.extend((-1, -1))
                offsets.append(len(flat))
                if len(flat) > CHUNK:
                    yield chunk()
                    ids.clear()
                    flat.clear()
                    offsets[:] = [0]
        if ids:
            yield chunk()

    return documents.mapInArrow(run, NUMBERED)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i, o, t in zip(*(c.to_pylist() for c in batch.columns)):
            yield np.frombuffer(i, np.int64), np.frombuffer(o, np.int64), np.frombuffer(t, np.int32).astype(np.int64)


def document_frequencies(numbers: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Documents that hold each term, over the whole corpus, and the number of documents.

    Of terms that most of their documents hold in copies only, the documents that hold them elsewhere.
    """
    held = numbers.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        df, copies, n = np.zeros(b.n_terms + 1, np.int64), np.zeros(b.n_terms + 1, np.int64), 0
        for ids, offsets, t in _chunks(batches):
            pos, term = b.terms(t)
            doc = np.searchsorted(offsets, pos, side="right") - 1
            key = doc * b.n_terms + term
            df[:-1] += np.bincount(np.unique(key) % b.n_terms, minlength=b.n_terms)
            outside = b.outside_copies(offsets, pos, doc, term)
            some = np.zeros(len(offsets), bool)
            some[doc[~outside]] = True
            only = np.setdiff1d(key[~outside], key[outside & some[doc]])
            copies[:-1] += np.bincount(only % b.n_terms, minlength=b.n_terms)
            n += len(ids)
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at]), pa.array(copies[at])], ["term", "df", "copies"])

    counts = numbers.mapInArrow(run, "term bigint, df bigint, copies bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("copies").alias("copies")).collect()
    out = np.zeros(items.n_terms + 1, np.int64)
    for term, df, copies in counts:
        out[term] = df - copies if 2 * copies > df else df
    held.unpersist()
    return out[:-1], int(out[-1])


def weigh(items: Items, df: np.ndarray, n: int, common: float = 0.03, rare: float = 0.003) -> None:
    """IDF weights, none for terms in more than ``common`` of the documents; rare words."""
    share = (df + 1) / (n + PRIOR_DOCUMENTS)
    items.weight = np.maximum(0.0, np.log(common / share))
    items.weight[items.own : items.v] = 0.0
    items.rare = share[: items.v] <= rare


def _rows(items: Items, part: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit TF-IDF vectors of some items: terms of weight and values."""
    out = []
    for i in part:
        term, tf = np.unique(items.terms(items.tokens[i])[1], return_counts=True)
        w = np.sqrt(tf) * items.weight[term]
        out.append((term[w > 0], w[w > 0] / max(float(np.sqrt((w**2).sum())), 1e-12)))
    return out


def randomised_svd(spark, items: Items, rank: int = RANK, seed: int = 5, power: int = 2) -> None:
    """The latent spaces of a group's blocks by random projection and power iteration.

    The rows of all blocks are one table, spread over tasks; A times a matrix and its
    transpose times a matrix are computed there. The driver orthogonalises factors of (items
    x rank) and (rank x rank) entries; latent vectors have (terms x rank), bounded by a block.
    """
    rng, table = np.random.default_rng(seed), []
    items.blocks = []
    for k, start in enumerate(range(0, len(items.tokens), BLOCK_ITEMS)):
        part = range(start, min(start + BLOCK_ITEMS, len(items.tokens)))
        rows = _rows(items, part)
        terms = np.unique(np.concatenate([t for t, _ in rows]))
        items.blocks.append(Block(part, terms))
        table += [(k, i, np.searchsorted(terms, t).tolist(), w.tolist()) for i, (t, w) in enumerate(rows)]
    rows = cut(spark.createDataFrame(table, "block int, item int, terms array<int>, weights array<double>").repartition(4, "item"))
    sizes = [(len(b.items), len(b.terms)) for b in items.blocks]
    width = [min(n, rank) for n, _ in sizes]

    def times(factors: list[np.ndarray], transposed: bool) -> list[np.ndarray]:
        held = spark.sparkContext.broadcast([x.astype(np.float32) for x in factors])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, i, t, w in zip(*(c.to_pylist() for c in batch.columns)):
                    own = made.setdefault(k, np.zeros((sizes[k][1 if transposed else 0], width[k])))
                    if transposed:
                        own[t] += np.array(w)[:, None] * held.value[k][i]
                    else:
                        own[i] += np.array(w) @ held.value[k][t]
            for k, x in made.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["block", "part"])

        out = [np.zeros((n[1 if transposed else 0], w)) for n, w in zip(sizes, width)]
        for k, part in rows.mapInArrow(run, "block int, part binary").toLocalIterator():
            out[k] += np.frombuffer(part, np.float32).reshape(out[k].shape)
        held.unpersist()
        return out

    q = [np.linalg.qr(y)[0] for y in times([rng.standard_normal((d, w)) for (_, d), w in zip(sizes, width)], False)]
    for _ in range(power):
        q = [np.linalg.qr(y)[0] for y in times(times(q, True), False)]
    for block, b in zip(items.blocks, times(q, True)):  # b: terms x rank
        values, u = np.linalg.eigh(b.T @ b)
        keep = values > 1e-9 * max(values.max(initial=0.0), 1e-12)
        block.latent = ((b @ u[:, keep]) / np.sqrt(values[keep])).astype(np.float32)
    for block, x in zip(items.blocks, _projected(items)):
        block.item_latent = x


def _projected(items: Items) -> Iterator[np.ndarray]:
    """Latent vectors of the items, of length one."""
    for block in items.blocks:
        made = np.zeros((len(block.items), block.latent.shape[1]), np.float32)
        for i, (t, w) in enumerate(_rows(items, block.items)):
            made[i] = w @ block.latent[np.searchsorted(block.terms, t)]
        yield made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)


def word_bits(item: np.ndarray) -> dict[int, int]:
    """Places of each word of an item as the bits of a number."""
    out: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs_positions(item: np.ndarray, part: np.ndarray, bits: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """One longest common subsequence as pairs of positions.

    A row of the table is one number, whose zero bits are the places of the item where the
    length grows; a word of the part is a few operations on it.
    """
    m = len(item)
    bits = word_bits(item) if bits is None else bits
    full = row = (1 << m) - 1
    rows = [row]
    for w in part.tolist():
        if own := bits.get(w):
            both = row & own
            row = (row + both | row - both) & full
        rows.append(row)
    out, i, j = [], m, len(part)
    while i and j:
        at = 1 << (i - 1)
        if rows[j] & at:
            i -= 1
        elif rows[j - 1] & at:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            j -= 1
    return out[::-1]


def dense_spans(pairs: list[tuple[int, int]], gap: int = 4, least: int = 8, density: float = 0.6) -> list[tuple[int, int, int]]:
    """Stretches of the item (start, end, matched) that the common subsequence covers densely.

    A stretch ends where more than ``gap`` words of either side lie between two matches;
    more than one match without any neighbour is no stretch.
    """
    out = []
    start = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k][0] - pairs[k - 1][0] > gap or pairs[k][1] - pairs[k - 1][1] > gap:
            a, b = pairs[start], pairs[k - 1]
            length = max(b[0] - a[0], b[1] - a[1]) + 1
            if k - start >= least and k - start >= density * length:
                out.append((a[0], b[0] + 1, k - start))
            start = k
    return out


def coverage(covered: np.ndarray, gap: int = 12) -> float:
    """Share of the item in its longest connected covered part."""
    n = len(covered)
    at = np.flatnonzero(covered)
    if not len(at):
        return 0.0
    best, start = 0, 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] - at[k - 1] > gap:
            best = max(best, int(at[k - 1] - at[start]) + 1)
            start = k
    return best / n


def _candidates(b: Items, offsets: np.ndarray, t: np.ndarray, least_cosine: float) -> dict[tuple[int, int], list]:
    """(document, item) to the best cosine and the windows, over all windows of a chunk."""
    pos, term = b.terms(t)
    live = b.weight[term] > 0
    pos, term = pos[live], term[live]
    found: dict[tuple[int, int], list] = {}
    if not len(pos):
        return found
    doc = np.searchsorted(offsets, pos, side="right") - 1
    width = int(np.diff(offsets).max()) // STRIDE + 2
    key = doc * width + (pos - offsets[doc]) // STRIDE
    weight = b.weight[term]
    for block in b.blocks:
        k = np.minimum(np.searchsorted(block.terms, term), len(block.terms) - 1) if len(block.terms) else np.zeros(0, np.int64)
        own = np.flatnonzero(block.terms[k] == term) if len(k) else k
        if not len(own):
            continue
        cells, first = np.unique(key[own], return_index=True)
        first = np.append(first, len(own))
        # the norm has all terms of the group, so it is counted over the same cells
        at = np.searchsorted(cells, key)
        at[at == len(cells)] = 0
        inside = cells[at] == key
        energy = np.bincount(at[inside], weight[inside] ** 2, len(cells))
        latent = np.empty((len(cells), block.latent.shape[1]), np.float32)
        scaled = block.latent
        step = 4096
        for c in range(0, len(cells), step):
            e = min(c + step, len(cells))
            part = own[first[c] : first[e]]
            latent[c:e] = np.add.reduceat(scaled[k[part]] * weight[part, None].astype(np.float32), first[c:e] - first[c], axis=0)
        # a window is a cell and its follower
        follows = np.flatnonzero(cells[1:] == cells[:-1] + 1)
        both, norm = latent, energy
        if len(follows):
            both, norm = latent.copy(), energy.copy()
            both[follows] += latent[follows + 1]
            norm[follows] += energy[follows + 1]
        norm = np.sqrt(norm)
        # no cosine is larger than the window's share in the space
        near = np.flatnonzero(np.linalg.norm(both, axis=1) >= least_cosine * norm)
        for s in range(0, len(near), 8192):
            part = near[s : s + 8192]
            cosine = both[part] @ block.item_latent.T / norm[part, None]
            for r, i in zip(*np.nonzero(cosine >= least_cosine)):
                cell = int(cells[part[r]])
                x = found.setdefault((cell // width, block.items[i]), [0.0, []])
                x[0] = max(x[0], float(cosine[r, i]))
                x[1].append(cell % width)
    return found


def _search(ids: np.ndarray, offsets: np.ndarray, t: np.ndarray, b: Items, least_cosine: float, least_cover: float) -> list[tuple[int, int, float, float]]:
    """(document, item, cosine, coverage) of the documents that hold items."""
    out = []
    for (row, item), (cos, cells) in _candidates(b, offsets, t, least_cosine).items():
        own = b.tokens[item]
        text = t[offsets[row] : offsets[row + 1] - 2]
        covered = np.zeros(len(own), bool)
        spans: list[list[int]] = []
        for c in sorted(set(cells)):
            lo, hi = max(0, c * STRIDE - len(own) // 2), min(len(text), c * STRIDE + WINDOW + len(own) // 2)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        pairs = np.unique(b.run_codes(own))
        for lo, hi in spans:
            for at in range(lo, hi, 1500):
                piece = text[at : min(hi, at + 2000)]
                if np.isin(b.run_codes(piece), pairs).sum() < 0.08 * len(own):
                    continue  # a covered half with every third word altered has a sixth
                if item not in b.bits:
                    b.bits[item] = word_bits(own)
                rest, bits = own, b.bits[item]
                while found_spans := dense_spans(lcs_positions(rest, piece, bits), least=max(2, min(8, len(own) // 3))):
                    for a, e, _ in found_spans:  # parts in another order are found by what is left
                        covered[a:e] = True
                    rest, bits = np.where(covered, -2, own), None
        cover = coverage(covered)
        if cover < least_cover:
            continue
        answers = np.unique(own[covered & b.rare[own]])
        if len(answers) and sum(b.holds(text, w) for w in answers.tolist()) < 0.4 * len(answers):
            continue
        out.append((int(ids[row]), b.ids[item], cos, cover))
    return out


def item_groups(items: DataFrame) -> Iterator[Items]:
    """Groups of the items, in order of their ids."""
    open_: list[tuple[int, list[str]]] = []
    compounds: dict[str, list[str]] = {}
    size = 0
    for row in items.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        w = words(row["text"])
        if not w:
            continue
        if open_ and (len(open_) >= GROUP_ITEMS or size + len(w) > GROUP_TOKENS):
            yield Items(open_, compounds)
            open_, compounds, size = [], {}, 0
        compounds |= divided(row["text"])
        open_.append((row["item_id"], w))
        size += len(w)
    if open_:
        yield Items(open_, compounds)


def leaks(documents: DataFrame, items: DataFrame, least_cosine: float = 0.15, least_cover: float = 0.45, rank: int = RANK) -> DataFrame:
    """Documents and the items they hold, with the best cosine and the covered share."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    made = None
    for group in item_groups(items):
        numbers = cut(numbered(texts, group.word_id))
        weigh(group, *document_frequencies(numbers, group))
        randomised_svd(spark, group, rank)
        held = spark.sparkContext.broadcast(group)  # bounded by GROUP_ITEMS and GROUP_TOKENS

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for ids, offsets, t in _chunks(batches):
                if rows := _search(ids, offsets, t, held.value, least_cosine, least_cover):
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "cosine", "coverage"])

        part = numbers.mapInArrow(run, FOUND)
        made = part if made is None else made.unionByName(part)
    if made is None:
        return spark.createDataFrame([], FOUND)
    return made.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("coverage").alias("coverage"))
