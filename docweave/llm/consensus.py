"""Problem 2: consensus from several annotators' labels, by a mean-field variational model.

Each annotator has a confusion row per kind of the true answer, with Dirichlet priors:
the mass of giving the true answer, and of giving a wrong one of each kind (a wrong one is
spread over the other answers of the question). Classes have a Dirichlet prior per kind.
The updates alternate between the posterior of each question's answers and the expected
counts of the annotators; the expectations of log probabilities are digammas. Marked
evidence is the same model with two classes per node and two rows per annotator.

The likelihood of a class is the sum over all votes of the question as if wrong, plus a
correction from the votes for the class, so the work is linear in the votes and no pairs
within a question are formed. Votes are shuffled by question once and written as one row of
small numbers per question. An iteration is one pass over these rows: the posterior follows
from the annotators' parameters and only sums per annotator leave the tasks. It stops when
the expected counts move by less than ``tolerance`` of the votes. Where a question has more
than ``max_votes`` votes, or there are more than ``max_annotators`` annotators to hold at
once, the same updates run as group-bys over single votes with joins on sized or salted sides.

Defined results: votes without annotator (null or blank) or without answer do not count; of
several votes of one annotator on a question the latest counts, equal times going to the
larger (annotation_id, answer); a null time is the earliest; null evidence is none marked;
repeated node ids count once; null papers and questions are keys like others; other columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docweave.session import cut, sized_join

KINDS = ("yes_no", "unanswerable", "extractive", "free_form")
QUESTION = ["paper_id", "question_id"]
K = len(KINDS)
RIGHT, WRONG = 4.0, 0.5
HIT, MISS = 4.0, 1.0
#: Per annotator: votes, right by kind, wrong by given and true kind, and of evidence the expected true and other nodes, of all and of the marked ones.
SUMS = 1 + K + K * K + 4


def digamma(x: Column) -> Column:
    """Digamma for x > 0: six recurrence steps, then the asymptotic series."""
    y = x + 6.0
    inv = 1.0 / (y * y)
    series = F.log(y) - 0.5 / y - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))
    return series - (1 / x + 1 / (x + 1) + 1 / (x + 2) + 1 / (x + 3) + 1 / (x + 4) + 1 / (x + 5))


def clean_worker(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def compared_form(c: Column) -> Column:
    """The sorted set of the parts between semicolons, compared without case and signs."""
    parts = F.transform(F.split(c, ";"), lambda p: F.trim(F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}]+", " ")))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != ""))), " ; ")


def vote_rows(refs: DataFrame) -> DataFrame:
    """Every usable row: answer in compared form, kind, marked nodes, rank of the row."""
    return refs.select(
        *QUESTION,
        clean_worker(F.col("worker_id")).alias("worker"),
        compared_form(F.col("normalized_answer")).alias("answer"),
        F.coalesce(F.when(F.col("answer_type").isin(*KINDS), F.col("answer_type")), F.lit("free_form")).alias("kind"),
        F.array_distinct(F.coalesce("evidence_node_ids", F.array().cast("array<int>"))).alias("nodes"),
        F.struct(F.coalesce(F.unix_micros("submitted_at"), F.lit(-(2**62))).alias("at"), F.coalesce("annotation_id", F.lit("")).alias("id")).alias("rank"),
    ).where("worker IS NOT NULL AND worker <> '' AND answer IS NOT NULL")


def counted_votes(refs: DataFrame) -> DataFrame:
    """One row per question and annotator, the latest."""
    return _latest(vote_rows(refs))


def _latest(rows: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("answer", "kind", "nodes"), F.struct("rank", "answer"))
    return rows.groupBy(*QUESTION, "worker").agg(latest.alias("v")).select(*QUESTION, "worker", "v.*")


def _digamma(x: np.ndarray) -> np.ndarray:
    y = x + 6.0
    inv = 1.0 / (y * y)
    series = np.log(y) - 0.5 / y - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))
    return series - sum(1 / (x + i) for i in range(6))


class Parameters:
    """Expectations of the annotators' log probabilities, from their expected counts."""

    def __init__(self, sums: np.ndarray, of_kind: np.ndarray):
        n = len(sums)
        alpha = np.empty((n, K, K + 1))
        alpha[:, :, 0] = sums[:, 1 : 1 + K] + RIGHT
        alpha[:, :, 1:] = sums[:, 1 + K : 1 + K + K * K].reshape(n, K, K).transpose(0, 2, 1) + WRONG  # true kind, given kind
        self.answers = _digamma(alpha) - _digamma(alpha.sum(2, keepdims=True))
        self.prior = _digamma(of_kind + 1.0)
        t1, t0, m1, m0 = sums[:, -4:].T
        true = np.stack((m1 + HIT, np.maximum(t1 - m1, 0.0) + MISS))
        other = np.stack((np.maximum(t0 - m0, 0.0) + HIT, m0 + MISS))
        self.marked, self.unmarked = _digamma(true) - _digamma(true.sum(0))
        self.other_unmarked, self.other_marked = _digamma(other) - _digamma(other.sum(0))


class Votes:
    """The votes of a batch of questions as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        lists = lambda name: batch.column(name)
        flat = lambda name: np.asarray(lists(name).flatten(), np.int64)
        sizes = lambda name: np.asarray(lists(name).value_lengths(), np.int64)
        rows = np.arange(batch.num_rows)
        self.rows = len(rows)
        self.n, self.m, marks, nodes = sizes("w"), sizes("kinds"), sizes("mark_w"), sizes("nodes")
        self.worker, self.given = flat("w"), flat("k")
        self.row, self.class_row, self.node_row = np.repeat(rows, self.n), np.repeat(rows, self.m), np.repeat(rows, nodes)
        self.first = np.cumsum(self.m) - self.m
        self.cls, self.kind = flat("c") + self.first[self.row], flat("kinds")
        self.mark_worker = flat("mark_w")
        self.mark = flat("mark_node") + np.repeat(np.cumsum(nodes) - nodes, marks)
        self.votes = np.bincount(self.cls, minlength=len(self.kind))
        self.marks = np.bincount(self.mark, minlength=len(self.node_row))

    def answers(self, p: Parameters | None) -> np.ndarray:
        """Posterior of the classes; without parameters the shares of the votes."""
        if p is None:
            return self.votes / self.n[self.class_row]
        own = self.kind[self.cls]
        wrong = p.answers[self.worker, :, self.given + 1] - np.log(np.maximum(self.m - 1, 1))[self.row][:, None]
        base = np.stack([np.bincount(self.row, wrong[:, k], self.rows) for k in range(K)], 1)
        up = p.answers[self.worker, own, 0] - wrong[np.arange(len(own)), own]
        s = np.bincount(self.cls, up, len(self.kind)) + base[self.class_row, self.kind] + p.prior[self.kind]
        e = np.exp(s - np.maximum.reduceat(s, self.first)[self.class_row])
        return e / np.bincount(self.class_row, e)[self.class_row]

    def evidence(self, p: Parameters | None) -> np.ndarray:
        """Posterior of the marked nodes."""
        if p is None:
            return self.marks / self.n[self.node_row]
        base = np.bincount(self.row, (p.unmarked - p.other_unmarked)[self.worker], self.rows)
        up = np.bincount(self.mark, (p.marked - p.unmarked - p.other_marked + p.other_unmarked)[self.mark_worker], len(self.node_row))
        return 1 / (1 + np.exp(-np.clip(up + base[self.node_row], -700, 700)))

    def sums(self, p: Parameters | None, annotators: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts per annotator and of the kinds of the true answers."""
        q, own = self.answers(p), self.kind[self.cls]
        of_kind = np.bincount(self.class_row * K + self.kind, q, self.rows * K).reshape(-1, K)
        out = np.zeros((annotators, SUMS))
        out[:, 0] = np.bincount(self.worker, minlength=annotators)
        out[:, 1 : 1 + K] = np.bincount(self.worker * K + own, q[self.cls], annotators * K).reshape(-1, K)
        missed = of_kind[self.row]
        missed[np.arange(len(own)), own] -= q[self.cls]
        for k in range(K):
            out[:, 1 + K + k : 1 + K + K * K : K] = np.bincount(self.worker * K + self.given, np.maximum(missed[:, k], 0.0), annotators * K).reshape(-1, K)
        e = self.evidence(p)
        out[:, -4] = np.bincount(self.worker, np.bincount(self.node_row, e, self.rows)[self.row], annotators)
        out[:, -3] = np.bincount(self.worker, np.bincount(self.node_row, 1 - e, self.rows)[self.row], annotators)
        out[:, -2] = np.bincount(self.mark_worker, e[self.mark], annotators)
        out[:, -1] = np.bincount(self.mark_worker, 1 - e[self.mark], annotators)
        return out, of_kind.sum(0)

    def judged(self, annotators: int, least: int) -> np.ndarray:
        """Per annotator: questions where more than half of the others agree, and those answered alike."""
        order = np.lexsort((-self.votes, self.class_row))
        best = order[self.first]  # each question has a class
        top = self.votes[best]
        rest = self.votes.copy()
        rest[best] = 0
        second = np.maximum.reduceat(rest, self.first) if self.rows else rest
        n, mine = self.n[self.row], self.cls == best[self.row]
        same = mine & (2 * (top[self.row] - 1) > n - 1)
        counts = (same | mine & (2 * second[self.row] > n - 1) | ~mine & (2 * top[self.row] > n - 1)) & (n >= least)
        return np.stack((np.bincount(self.worker, counts, annotators), np.bincount(self.worker, same & counts, annotators)), 1)


_LIST = "array<int>"
PACKED = f"paper_id string, question_id string, answers array<string>, kinds {_LIST}, w {_LIST}, c {_LIST}, k {_LIST}, nodes {_LIST}, mark_w {_LIST}, mark_node {_LIST}"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of small numbers per question."""
    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 7]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for paper, question, votes in zip(*(c.to_pylist() for c in batch.columns)):
            votes.sort(key=lambda v: v["w"])
            answers = sorted({v["answer"] for v in votes})
            at = {a: i for i, a in enumerate(answers)}
            kind = [K] * len(answers)
            for v in votes:
                kind[at[v["answer"]]] = min(kind[at[v["answer"]]], v["kind"])
            nodes = sorted({x for v in votes for x in v["nodes"] if x is not None})
            place = {x: i for i, x in enumerate(nodes)}
            marks = [(v["w"], place[x]) for v in votes for x in v["nodes"] if x is not None]
            row = (paper, question, answers, kind, [v["w"] for v in votes], [at[v["answer"]] for v in votes], [v["kind"] for v in votes], nodes, [w for w, _ in marks], [x for _, x in marks])
            for column, value in zip(out, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def _kind_number() -> Column:
    return (F.array_position(F.lit(list(KINDS)), F.col("kind")) - 1).cast("int")


class Consensus:
    """The fitted model over packed questions; every table is one pass over them."""

    def __init__(self, packed: DataFrame, workers: list[str], max_iterations: int, tolerance: float):
        self.packed, self.workers, self.iterations = packed, workers, 0
        n, p, before, total = len(workers), None, None, None
        while True:
            total, of_kind = self._pass(p)
            self.sums = total
            moved = np.abs(total - before).sum() if before is not None else np.inf
            if self.iterations == max_iterations or moved <= tolerance * max(1.0, total[:, 0].sum()):
                break
            p, before = Parameters(total, of_kind), total
            self.iterations += 1
        self.parameters = p if n else None

    def _pass(self, p: Parameters | None) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.workers)
        held = self.packed.sparkSession.sparkContext.broadcast(p)  # at most max_annotators rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, of_kind = np.zeros((n, SUMS)), np.zeros(K)
            for batch in batches:
                if batch.num_rows:
                    own, kinds = Votes(batch).sums(held.value, n)
                    made += own
                    of_kind += kinds
            at = np.flatnonzero(made[:, 0])
            rows = np.vstack((made[at], np.pad(of_kind, (0, SUMS - K))[None]))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), *(pa.array(rows[:, i]) for i in range(SUMS))], ["worker", *(f"s{i}" for i in range(SUMS))])

        sums = self.packed.drop("paper_id", "question_id", "answers").mapInArrow(run, "worker int, " + ", ".join(f"s{i} double" for i in range(SUMS)))
        total, of_kind = np.zeros((n, SUMS)), np.zeros(K)
        for r in sums.groupBy("worker").agg(*[F.sum(f"s{i}") for i in range(SUMS)]).collect():  # one row per annotator
            if r[0] < 0:
                of_kind = np.array(r[1 : 1 + K])
            else:
                total[r[0]] = r[1:]
        held.unpersist()
        return total, of_kind

    def _table(self, schema: str, rows_of) -> DataFrame:
        held = self.packed.sparkSession.sparkContext.broadcast(self.parameters)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield rows_of(batch, Votes(batch), held.value)

        return self.packed.mapInArrow(run, schema)

    def answers(self) -> DataFrame:
        """Posterior, votes and pairwise agreement of each question's answers."""

        def rows_of(batch, v, p):
            n = v.n[v.class_row]
            same = np.bincount(v.class_row, v.votes * (v.votes - 1.0), v.rows) / np.where(v.n > 1, v.n * (v.n - 1.0), np.nan)
            ids = [batch.column(c).take(pa.array(v.class_row)) for c in QUESTION]
            return pa.RecordBatch.from_arrays([*ids, batch.column("answers").flatten(), pa.array(v.votes), pa.array(n), pa.array(v.answers(p)), pa.array(same[v.class_row], mask=n < 2)], [*QUESTION, "answer", "votes", "n", "q", "agreement"])

        return self._table("paper_id string, question_id string, answer string, votes bigint, n bigint, q double, agreement double", rows_of)

    def evidence(self) -> DataFrame:
        """Marks, annotators of the question and posterior of being evidence of each marked node."""

        def rows_of(batch, v, p):
            ids = [batch.column(c).take(pa.array(v.node_row)) for c in QUESTION]
            return pa.RecordBatch.from_arrays([*ids, batch.column("nodes").flatten(), pa.array(v.marks), pa.array(v.n[v.node_row]), pa.array(v.evidence(p))], [*QUESTION, "node", "marks", "n", "q"])

        return self._table("paper_id string, question_id string, node int, marks bigint, n bigint, q double", rows_of)

    def annotators(self) -> DataFrame:
        spark, k = self.packed.sparkSession, 1 + K
        rows = [(w, int(s[0]), float(s[1:k].sum()), float(s[k : k + K * K].sum())) for w, s in zip(self.workers, self.sums)]
        return spark.createDataFrame(rows, "worker string, answered bigint, right double, wrong double")

    def judged(self, least: int) -> DataFrame:
        """Per annotator the questions where more than half of the others agree, and those answered alike."""
        n, workers = len(self.workers), self.packed.sparkSession.sparkContext.broadcast(self.workers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = np.zeros((n, 2))
            for batch in batches:
                if batch.num_rows:
                    made += Votes(batch).judged(n, least)
            at = np.flatnonzero(made[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array([workers.value[i] for i in at], pa.string()), pa.array(made[at, 0].astype(np.int64)), pa.array(made[at, 1].astype(np.int64))], ["worker", "n", "same"])

        each = self.packed.drop("paper_id", "question_id", "answers").mapInArrow(run, "worker string, n bigint, same bigint")
        return each.groupBy("worker").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))


class WideConsensus:
    """The same updates as group-bys over single votes, for any number of annotators and votes a question."""

    def __init__(self, votes: DataFrame, max_iterations: int, tolerance: float):
        votes = votes.withColumn("paper_id", F.coalesce("paper_id", F.lit("\0"))).withColumn("question_id", F.coalesce("question_id", F.lit("\0")))
        self.votes = cut(votes.select(*QUESTION, "worker", "answer", _kind_number().alias("kind"), "nodes"))
        size = self._per_question(self.votes, F.count("*").alias("n"))
        classes = self.votes.groupBy(*QUESTION, "answer").agg(F.count("*").alias("votes"), F.min("kind").alias("class_kind"))
        many = self._per_question(classes, F.count("*").alias("m"), F.sum(F.col("votes") * (F.col("votes") - 1)).alias("same"))
        self.classes = cut(sized_join(sized_join(classes, size, QUESTION), many, QUESTION))
        self.joined = cut(sized_join(self.votes.drop("nodes"), self.classes.select(*QUESTION, "answer", "class_kind", "m"), [*QUESTION, "answer"]))
        self.marks = cut(self.votes.select(*QUESTION, "worker", F.explode("nodes").alias("node")).where("node IS NOT NULL"))
        self.items = cut(sized_join(self.marks.groupBy(*QUESTION, "node").agg(F.count("*").alias("marks")), size, QUESTION))
        total = self.votes.count()
        q = self.classes.withColumn("q", F.col("votes") / F.col("n"))
        e = self.items.withColumn("q", F.col("marks") / F.col("n"))
        before, self.iterations = None, 0
        while True:
            counts = self._counts(q, e)
            if before is not None:
                names = [c for c in counts.columns if c != "worker"]
                both = counts.join(before.toDF("worker", *[f"b_{c}" for c in names]), "worker")
                moved = both.agg(F.sum(sum((F.abs(F.col(c) - F.col(f"b_{c}")) for c in names), F.lit(0.0)))).first()[0] or 0.0
            if self.iterations == max_iterations or before is not None and moved <= tolerance * max(1, total):
                break
            q, e, before = self._answers(q, counts), self._evidence(counts), counts
            self.iterations += 1
        self.q, self.e, self.counts = q, e, counts

    @staticmethod
    def _per_question(df: DataFrame, *sums: Column) -> DataFrame:
        return cut(df.groupBy(*QUESTION).agg(*sums))

    def _counts(self, q: DataFrame, e: DataFrame) -> DataFrame:
        of_kind = lambda k: F.when(F.col("class_kind") == k, F.col("q")).otherwise(0.0)
        sums = self._per_question(q, *[F.sum(of_kind(k)).alias(f"q{k}") for k in range(K)])
        seen = sized_join(sized_join(self.joined, q.select(*QUESTION, "answer", "q"), [*QUESTION, "answer"]), sums, QUESTION)
        missed = lambda s, k: F.when(F.col("kind") == s, F.greatest(F.col(f"q{k}") - of_kind(k), F.lit(0.0))).otherwise(0.0)
        answers = seen.groupBy("worker").agg(F.count("*").alias("answered"), *[F.sum(of_kind(k)).alias(f"r{k}") for k in range(K)], *[F.sum(missed(s, k)).alias(f"w{s}{k}") for s in range(K) for k in range(K)])
        totals = self._per_question(e, F.sum("q").alias("t1"), F.sum(1 - F.col("q")).alias("t0"))
        every = sized_join(self.votes.select(*QUESTION, "worker"), totals, QUESTION).groupBy("worker").agg(F.sum("t1").alias("t1"), F.sum("t0").alias("t0"))
        marked = sized_join(self.marks, e.select(*QUESTION, "node", "q"), [*QUESTION, "node"]).groupBy("worker").agg(F.sum("q").alias("m1"), F.sum(1 - F.col("q")).alias("m0"))
        return cut(answers.join(every, "worker", "left").join(marked, "worker", "left").na.fill(0.0))

    def _answers(self, q: DataFrame, counts: DataFrame) -> DataFrame:
        alpha = lambda k: [F.col(f"r{k}") + RIGHT, *[F.col(f"w{s}{k}") + WRONG for s in range(K)]]
        rows = [F.array(*[digamma(x) - digamma(sum(alpha(k)[1:], alpha(k)[0])) for x in alpha(k)]) for k in range(K)]
        held = sized_join(self.joined, cut(counts.select("worker", F.array(*rows).alias("l"))), ["worker"])
        spread = F.log(F.greatest(F.col("m") - 1, F.lit(1)))
        wrong = lambda k: F.get(F.get("l", k), F.col("kind") + 1) - spread
        up = F.get(F.get("l", F.col("class_kind")), F.lit(0)) - wrong(F.col("class_kind"))
        scored = cut(held.groupBy(*QUESTION, "answer").agg(F.sum(up).alias("up"), *[F.sum(wrong(F.lit(k))).alias(f"b{k}") for k in range(K)]))
        base = self._per_question(scored, *[F.sum(f"b{k}").alias(f"c{k}") for k in range(K)])
        of_kind = lambda k: F.when(F.col("class_kind") == k, F.col("q")).otherwise(0.0)
        prior = q.agg(*[digamma(F.coalesce(F.sum(of_kind(k)), F.lit(0.0)) + 1.0) for k in range(K)]).first()
        s = F.col("up") + F.get(F.array(*[F.col(f"c{k}") + float(prior[k]) for k in range(K)]), F.col("class_kind"))
        s = cut(sized_join(sized_join(self.classes, scored.select(*QUESTION, "answer", "up"), [*QUESTION, "answer"]), base, QUESTION).withColumn("s", s).select(*self.classes.columns, "s"))
        s = cut(sized_join(s, self._per_question(s, F.max("s").alias("top")), QUESTION).withColumn("e", F.exp(F.col("s") - F.col("top"))))
        return cut(sized_join(s, self._per_question(s, F.sum("e").alias("z")), QUESTION).select(*self.classes.columns, (F.col("e") / F.col("z")).alias("q")))

    def _evidence(self, counts: DataFrame) -> DataFrame:
        a, b = F.col("m1") + HIT, F.greatest(F.col("t1") - F.col("m1"), F.lit(0.0)) + MISS
        x, y = F.greatest(F.col("t0") - F.col("m0"), F.lit(0.0)) + HIT, F.col("m0") + MISS
        ab, xy = digamma(a + b), digamma(x + y)
        params = cut(counts.select("worker", (digamma(b) - ab - digamma(x) + xy).alias("unmarked"), (digamma(a) - ab - digamma(y) + xy).alias("marked")))
        base = self._per_question(sized_join(self.votes.select(*QUESTION, "worker"), params, ["worker"]), F.sum("unmarked").alias("base"))
        up = cut(sized_join(self.marks, params, ["worker"]).groupBy(*QUESTION, "node").agg(F.sum(F.col("marked") - F.col("unmarked")).alias("up")))
        made = sized_join(sized_join(self.items, up, [*QUESTION, "node"]), base, QUESTION)
        return cut(made.select(*self.items.columns, (1 / (1 + F.exp(-(F.col("up") + F.col("base"))))).alias("q")))

    @staticmethod
    def _named(df: DataFrame) -> DataFrame:
        for c in QUESTION:
            df = df.withColumn(c, F.nullif(c, F.lit("\0")))
        return df

    def answers(self) -> DataFrame:
        same = F.col("same") / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1))
        return self._named(self.q).select(*QUESTION, "answer", "votes", "n", "q", same.alias("agreement"))

    def evidence(self) -> DataFrame:
        return self._named(self.e).select(*QUESTION, "node", "marks", "n", "q")

    def annotators(self) -> DataFrame:
        plus = lambda names: sum((F.col(c) for c in names), F.lit(0.0))
        return self.counts.select("worker", "answered", plus([f"r{k}" for k in range(K)]).alias("right"), plus([f"w{s}{k}" for s in range(K) for k in range(K)]).alias("wrong"))

    def judged(self, least: int) -> DataFrame:
        two = F.max_by(F.struct("answer", "votes"), F.struct("votes", "answer"))
        best = self._per_question(self.classes.where(F.col("n") >= least), two.alias("t"), F.first("n").alias("n"))
        rest = sized_join(self.classes, best.select(*QUESTION, "t"), QUESTION).where("answer <> t.answer")
        second = self._per_question(rest, F.max("votes").alias("second"))
        seen = sized_join(self.votes.select(*QUESTION, "worker", "answer"), cut(best.join(second, QUESTION, "left")), QUESTION)
        mine = F.col("answer") == F.col("t.answer")
        same = mine & (2 * (F.col("t.votes") - 1) > F.col("n") - 1)
        counts = same | (mine & (2 * F.coalesce("second", F.lit(0)) > F.col("n") - 1)) | (~mine & (2 * F.col("t.votes") > F.col("n") - 1))
        return seen.where(counts).groupBy("worker").agg(F.count("*").alias("n"), F.count_if(same).alias("same"))


def fit(refs: DataFrame, max_votes: int = 5_000, max_annotators: int = 50_000, max_iterations: int = 50, tolerance: float = 1e-3) -> Consensus | WideConsensus:
    """The fitted model."""
    rows = vote_rows(refs)
    workers = rows.select("worker").distinct().limit(max_annotators + 1).collect()
    if len(workers) > max_annotators or not rows.groupBy(*QUESTION).count().where(F.col("count") > max_votes).isEmpty():
        return WideConsensus(_latest(rows), max_iterations, tolerance)
    names = sorted(r[0] for r in workers)
    numbers = refs.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "worker string, w int")
    # one shuffle by question serves the latest votes and the packing
    votes = _latest(rows.repartition(*QUESTION)).join(F.broadcast(numbers), "worker")
    grouped = votes.groupBy(*QUESTION).agg(F.collect_list(F.struct("w", "answer", _kind_number().alias("kind"), "nodes")).alias("votes"))
    return Consensus(cut(grouped.mapInArrow(_packed, PACKED)), names, max_iterations, tolerance)


def reliability(counts: DataFrame) -> DataFrame:
    """Per annotator the posterior mean of giving the true answer and its 95 % interval."""
    a, b = F.col("right") + RIGHT, F.col("wrong") + K * WRONG
    mean = a / (a + b)
    half = 1.96 * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return counts.select("worker", "answered", mean.alias("reliability"), F.greatest(mean - half, F.lit(0.0)).alias("low"), F.least(mean + half, F.lit(1.0)).alias("high"))


def agreement(votes: DataFrame) -> DataFrame:
    """Krippendorff's alpha for nominal answers over the questions with two votes or more."""
    per = votes.groupBy(*QUESTION, "answer").agg(F.count("*").alias("k")).withColumn("n", F.sum("k").over(W.partitionBy(*QUESTION))).where("n >= 2")
    observed = per.agg(F.sum(F.col("k") * (F.col("n") - F.col("k")) / (F.col("n") - 1)).alias("o"), F.sum("k").alias("total"))
    squares = per.groupBy("answer").agg(F.sum("k").cast("double").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("sq"))
    expected = (F.col("total") * F.col("total") - F.col("sq")) / (F.col("total") - 1)
    both = observed.crossJoin(squares)  # one row each
    return both.select(F.col("total").alias("votes"), (1 - F.col("o") / F.when(expected > 0, expected)).alias("alpha"))


def consensus(refs: DataFrame, least: int = 3, **limits) -> dict[str, DataFrame]:
    """answers (posterior, votes, agreement), evidence, annotators, and votes against the others'."""
    model = fit(refs, **limits)
    return {"answers": model.answers(), "evidence": model.evidence(), "annotators": reliability(model.annotators()), "judged": model.judged(least)}


def findings(made: dict[str, DataFrame], least: int = 3, answered: int = 10, negligible: float = 1e-9) -> DataFrame:
    """The model's candidates that hold by the rule of majorities.

    Candidates are answers and nodes with a posterior that is not ``negligible``, and
    annotators whose interval of reliability reaches below one half. What the posterior sees
    otherwise than the majority is in ``disputed``.
    """
    subject = F.concat_ws("::", *QUESTION).alias("subject")
    held = (F.col("n") >= least) & (F.col("q") >= negligible)
    a = made["answers"].where(held & F.expr("2 * votes > n")).select(F.lit("answer").alias("finding"), subject, F.col("answer").alias("found_value"))
    b = made["evidence"].where(held & F.expr("2 * marks > n")).select(F.lit("evidence").alias("finding"), subject, F.col("node").cast("string").alias("found_value"))
    often = made["judged"].where(f"n >= {answered} AND 2 * same < n")
    c = often.join(made["annotators"].where("low < 0.5").select("worker"), "worker").select(F.lit("annotator").alias("finding"), F.col("worker").alias("subject"), F.lit("").alias("found_value"))
    return a.unionByName(b).unionByName(c)


def disputed(made: dict[str, DataFrame], least: int = 3) -> DataFrame:
    """Answers and nodes on which the posterior and the plain majority differ."""
    subject = F.concat_ws("::", *QUESTION).alias("subject")
    rows = made["answers"].select(F.lit("answer").alias("finding"), subject, F.col("answer").alias("found_value"), F.col("votes"), "n", "q")
    rows = rows.unionByName(made["evidence"].select(F.lit("evidence").alias("finding"), subject, F.col("node").cast("string").alias("found_value"), F.col("marks").alias("votes"), "n", "q"))
    return rows.where((F.col("n") >= least) & (F.expr("2 * votes > n") != (F.col("q") > 0.5)))
