"""Models behind plug-ins: embedders, generators, tokenizers, and their operators.

A plug-in is any picklable object with the method named in its protocol; it is built once
per Python worker. The built-in ones need no weights: a hashing embedder and an extractive
generator, both deterministic.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import LINK_PHRASES


class TextEmbedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class TextGenerator(Protocol):
    def generate(self, prompts: list[str], seed: int | None = None) -> list[str]: ...


class HashingEmbedder:
    """Mean of signed word hashes of the whole text, unit length; with ``most``, of so many first words."""

    def __init__(self, dim: int = 64, most: int | None = None):
        self.dim, self.most = dim, most

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split()[: self.most]:
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1.0 if h >> 16 & 1 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class ExtractiveGenerator:
    """Phrases of the prompt's last paragraph; another seed picks others."""

    def __init__(self, phrases: int = 3, words: int = 4):
        self.phrases, self.words = phrases, words

    def generate(self, prompts: list[str], seed: int | None = None) -> list[str]:
        out = []
        for p in prompts:
            ws = re.findall(r"[^\W_]{3,}", (p or "").rstrip().split("\n")[-1]) or ["empty"]
            at = (seed or 0) * self.words
            out.append("\n".join(" ".join(ws[(at + k * self.words) % len(ws) :][: self.words]) for k in range(self.phrases)))
        return out


def masked_mean(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of states over unmasked places, unit length."""
    m = mask[..., None].astype(states.dtype)
    mean = (states * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def embed_texts(texts: DataFrame, embedder: TextEmbedder, column: str = "text") -> DataFrame:
    """Distinct texts with their vectors: each text is embedded once."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embedder.embed(batch.fillna("").tolist())), index=batch.index)

    return texts.select(column).where(F.col(column).isNotNull()).distinct().withColumn("vector", run(F.col(column)))


def generate(prompts: DataFrame, generator: TextGenerator, rounds: int = 1, per_round: int = 1, column: str = "prompt") -> DataFrame:
    """(prompt, cand, output) for distinct prompts: rounds times per_round candidates each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for k in range(rounds * per_round):
                made = generator.generate(texts, None if rounds * per_round == 1 else k)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k] * len(texts), pa.int32()), pa.array(made, pa.string())], [column, "cand", "output"])

    return prompts.select(column).distinct().mapInArrow(run, f"{column} string, cand int, output string")


_MARKUP = re.compile(r"^\s*(?:[-*]|[0-9]+[.)])\s*")


def parse_label(output: str) -> str | None:
    """The link label an output names, as the Column expression of the same name does."""
    t = " ".join(_MARKUP.sub("", (output or "").strip()).split()).upper().replace("-", "_").strip(".,:;`'\"[](){}")
    return t if t in LINK_PHRASES else None


def label_with_retries(prompts: DataFrame, generator: TextGenerator, retry, attempts: int = 3, column: str = "prompt") -> DataFrame:
    """(prompt, label, output, outputs, attempts): invalid outputs are asked again.

    ``retry(prompt, invalid)`` makes the next prompt. The loop runs inside the batch, on
    distinct prompts and for the still invalid ones only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = batch.column(0).to_pylist()
            outputs: list[list[str]] = [[] for _ in base]
            labels: list[str | None] = [None] * len(base)
            asked = list(base)
            for _ in range(attempts):
                todo = [i for i, x in enumerate(labels) if x is None]
                if not todo:
                    break
                for i, out in zip(todo, generator.generate([asked[i] for i in todo])):
                    outputs[i].append(out)
                    labels[i] = parse_label(out)
                    asked[i] = retry(base[i], out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(labels, pa.string()), pa.array([o[-1] for o in outputs], pa.string()), pa.array(outputs, pa.list_(pa.string())), pa.array([len(o) for o in outputs], pa.int32())],
                [column, "link_label", "output", "outputs", "attempts"],
            )

    return prompts.select(column).distinct().mapInArrow(run, f"{column} string, link_label string, output string, outputs array<string>, attempts int")


class TokenizerFile:
    """A public tokenizer file by path: .tiktoken, .json or .model; loaded once per worker."""

    def __init__(self, path: str, pattern: str | None = None):
        self.path, self.pattern, self._own = path, pattern, None

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "_own": None}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._own is None:
            kind = os.path.splitext(self.path)[1]
            if kind == ".json":
                from tokenizers import Tokenizer

                own = Tokenizer.from_file(self.path)
                own.encode_special_tokens = True
                self._own = lambda ts: [e.ids for e in own.encode_batch(ts, add_special_tokens=False)]
            elif kind == ".model":
                import sentencepiece

                own = sentencepiece.SentencePieceProcessor(model_file=self.path)
                self._own = lambda ts: own.encode(ts, num_threads=1)
            else:
                import tiktoken

                if not self.pattern:
                    raise ValueError("a rank file needs its pattern")
                with open(self.path, "rb") as f:
                    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                own = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
                self._own = lambda ts: [own.encode_ordinary(t) for t in ts]
        return self._own(texts)


def token_lengths(df: DataFrame, tokenizer: TokenizerFile, column: str = "text", name: str = "n_tokens") -> DataFrame:
    """Token counts; null for null texts."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            counts = [len(t) for t in tokenizer.encode(batch.fillna("").tolist())]
            yield pd.Series(counts, index=batch.index).where(batch.notna()).astype("Int32")

    return df.withColumn(name, run(F.col(column)))


def max_length(tokenizer_limit: int | None, config_limit: int | None, sentinel: int = 1_000_000) -> int:
    """The smaller of the limits that are set and real, 0 if none is."""
    real = [x for x in (tokenizer_limit, config_limit) if x and 0 < x < sentinel]
    return min(real, default=0)


def require_within(rows: DataFrame, length: str, reserved: int, most: int) -> DataFrame:
    """Rows whose tokens and reserved ones fit; any other is an error, never cut."""
    over = F.col(length) + reserved > most
    return rows.withColumn(length, F.when(over, F.raise_error(F.lit("text is over the context limit")).cast("int")).otherwise(F.col(length)))


def sequence_log_probs(logits: np.ndarray, labels: np.ndarray, ignore: int = -100) -> np.ndarray:
    """Sum of the log probabilities of the labels, each predicted at the place before."""
    x = logits[:, :-1].astype(np.float64)
    x = x - x.max(-1, keepdims=True)
    logp = x - np.log(np.exp(x).sum(-1, keepdims=True))
    y = labels[:, 1:]
    keep = y != ignore
    picked = np.take_along_axis(logp, np.where(keep, y, 0)[..., None], -1)[..., 0]
    return (picked * keep).sum(-1)


def pad_pairs(prompts: list[list[int]], answers: list[list[int]], pad: int, end: int, ignore: int = -100) -> dict[str, np.ndarray]:
    """Right-padded prompt and answer tokens; labels only for the answer, with its end token."""
    rows = [(p, a if a and a[-1] == end else [*a, end]) for p, a in zip(prompts, answers)]
    most = max((len(p) + len(a) for p, a in rows), default=0)
    ids, labels, mask = np.full((len(rows), most), pad), np.full((len(rows), most), ignore), np.zeros((len(rows), most), np.int64)
    for i, (p, a) in enumerate(rows):
        n = len(p) + len(a)
        ids[i, :n], labels[i, len(p) : n], mask[i, :n] = [*p, *a], a, 1
    return {"input_ids": ids, "labels": labels, "attention_mask": mask}


def resolve_model(name: str, roots: list[str]) -> str:
    """A model's folder: the path itself, else a registry entry's main snapshot or last one, else the name."""
    if os.path.isdir(name):
        return name
    for root in roots:
        base = os.path.join(root, "models--" + name.replace("/", "--"))
        for ref in ("main", "master"):
            path = os.path.join(base, "refs", ref)
            if os.path.exists(path):
                with open(path) as f:
                    snapshot = os.path.join(base, "snapshots", f.read().strip())
                if os.path.isdir(snapshot):
                    return snapshot
        every = os.path.join(base, "snapshots")
        if os.path.isdir(every) and (found := sorted(os.listdir(every))):
            return os.path.join(every, found[-1])
    return name
