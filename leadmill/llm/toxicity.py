"""Toxicity scores from the nearest labelled examples.

Texts and labelled examples are TF-IDF vectors over word stems, the first four
letters of each word, and numbers.  The nearest examples of a text are found by exact cosine in
an inverted index with block maxima.  The few lists that hold many of the examples
are kept dense and summed for several texts at once; the sums so far bound the
nearest examples' cosines from below, the block maxima of the other lists bound
what a block can still add, and only blocks that can hold a nearer example are
summed in full.  The examples vote with weights that fall with their distance;
votes are calibrated by isotonic regression on the examples themselves, each left
out of its own vote.  The nearest examples are the evidence.

The model is fitted on at most *sample_rows* labelled rows (those with the smallest
hash) with texts of at most *sample_chars* characters, which bounds the
vocabulary, the index and what is broadcast.  Scoring, of the examples too, is one
narrow pass over the texts.  A score depends on the text alone.

Defined results: a null or empty text, like any without a known term, gets the
smoothed share of toxic examples among those without a known term; without any
labelled row the score is 0; repeated rows get the same score; a null
``doc_id`` is carried along and is not held out; labelled rows without a
document or without a label are left out; of repeated labels the largest counts,
of several labelled texts with one ``doc_id`` the smallest; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill import storage
from leadmill.llm.bpe import slices

SAMPLE_ROWS = 8_192
SAMPLE_CHARS = 200_000
NEIGHBOURS = 31
EVIDENCE = 3
BLOCK = 64
STEM = 4
#: Power of the inverse document frequency: below 1, as rare stems are mostly chance.
RARITY = 0.75
FOLDS = 5
#: A list that holds more than one in so many examples is kept dense.
DENSE_ONE_IN = 16
#: Texts whose dense lists are summed at once.
BATCH = 32

# Letters without those after the first few, and numbers.
_STEMS = re.compile(rf"([^\W\d_]{{1,{STEM}}}|\d+)[^\W\d_]*")


def stems(text: str | None) -> Counter[str]:
    return Counter(_STEMS.findall((text or "").lower()))


def is_held_out(doc_id):
    """Condition on a column: rows never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


class Vectors:
    """Turns texts into unit TF-IDF vectors over a vocabulary."""

    def __init__(self, idf: dict[str, float]):
        self.number = {term: i for i, term in enumerate(idf)}
        self._idf = np.array(list(idf.values()))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        number = self.number
        known = sorted((number[t], n) for t, n in stems(text).items() if t in number)
        if not known:
            return np.zeros(0, np.int64), np.zeros(0)
        terms, counts = np.array(known).T
        weight = (1 + np.log(counts)) * self._idf[terms]
        return terms, weight / np.sqrt((weight**2).sum())


class BlockMaxIndex:
    """Inverted index over unit vectors with the largest weight of each term in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(vectors)
        lengths = [len(t) for t, _ in vectors]
        terms = np.concatenate([t for t, _ in vectors]) if self.n else np.zeros(0, np.int64)
        weights = np.concatenate([w for _, w in vectors]) if self.n else np.zeros(0)
        order = np.argsort(terms, kind="stable")
        self._docs = np.repeat(np.arange(self.n, dtype=np.int32), lengths)[order]
        self._weights = weights[order]
        self._term_start = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self._open()

    def _open(self) -> None:
        """The dense lists, and of the others the entries of each term in each block with their largest weight."""
        size = np.diff(self._term_start)
        self.n_blocks = -(-self.n // BLOCK)
        dense = np.flatnonzero(size * DENSE_ONE_IN > self.n)
        self._dense_at = np.full(len(size), -1)
        self._dense_at[dense] = np.arange(len(dense))
        self._dense = np.zeros((len(dense), self.n_blocks * BLOCK))
        for at, term in enumerate(dense.tolist()):
            own = slice(self._term_start[term], self._term_start[term + 1])
            self._dense[at, self._docs[own]] = self._weights[own]
        terms = np.repeat(np.arange(len(size)), size)
        blocks = self._docs // BLOCK
        starts = np.flatnonzero((np.diff(terms, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0))
        self._run_block = blocks[starts]
        self._run_max = np.maximum.reduceat(self._weights, starts) if len(starts) else np.zeros(0)
        self._run_start = np.append(starts, len(terms))
        self._term_run = np.searchsorted(starts, self._term_start)

    def __getstate__(self) -> dict:
        """Only what the lists are made from travels, document numbers in as few bytes as will do."""
        return {
            "n": self.n, "_term_start": self._term_start, "_weights": self._weights,
            "_docs": self._docs.astype(np.min_scalar_type(max(0, self.n - 1))),
        }

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"_docs": state["_docs"].astype(np.int32)}
        self._open()

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The *k* examples with the largest cosine above zero, nearest first; ties to the smaller number."""
        return self.nearest_of_all([(terms, weights)], k, [skip])[0]

    def nearest_of_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int,
                       skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for each vector; *skip* has an example to leave out for each."""
        found = []
        for start in range(0, len(vectors), BATCH):
            some = vectors[start : start + BATCH]
            asked = np.zeros((len(some), len(self._dense)))
            for row, (terms, weights) in zip(asked, some):
                at = self._dense_at[terms]
                row[at[at >= 0]] = weights[at >= 0]
            for i, (sums, (terms, weights)) in enumerate(zip(asked @ self._dense, some)):
                rare = self._dense_at[terms] < 0
                found.append(self._finish(sums, terms[rare], weights[rare], k, skip[start + i] if skip else -1))
        return found

    def _finish(self, sums: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip: int):
        if skip >= 0:
            sums[skip] = -np.inf
        least = np.partition(sums, len(sums) - k)[len(sums) - k] if self.n > k else 0.0
        # What the other lists add to a block at most.
        runs, share = _spread(self._term_run[terms], self._term_run[terms + 1], weights)
        blocks = self._run_block[runs]
        more = np.bincount(blocks, share * self._run_max[runs], minlength=self.n_blocks)
        bound = (sums.reshape(-1, BLOCK).max(axis=1) + more) * (1 + 1e-12) + 1e-12
        held = (bound >= least)[blocks]
        entries, share = _spread(self._run_start[runs[held]], self._run_start[runs[held] + 1], share[held])
        sums = sums + np.bincount(self._docs[entries], share * self._weights[entries], minlength=len(sums))
        scores = np.round(sums[: self.n], 12)
        if self.n > k:
            least = np.partition(scores, self.n - k)[self.n - k]
        near = np.flatnonzero((scores >= least) & (scores > 0)) if self.n > k else np.flatnonzero(scores > 0)
        near = near[np.lexsort((near, -scores[near]))[:k]]
        return near, scores[near]


def _spread(starts: np.ndarray, stops: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each start to its stop, and for each the share of its stretch."""
    sizes = stops - starts
    places = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    return places, np.repeat(share, sizes)


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone smoothed share of label 1 by vote: (votes, shares) to interpolate."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # label sum, rows, vote sum
    for vote, label in zip(votes[order].tolist(), labels[order].tolist()):
        pools.append([label, 1, vote])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return (
        np.array([v / n for _, n, v in pools]), np.array([(s + 0.5) / (n + 1) for s, n, _ in pools])
    )


@dataclass
class Model:
    """What scoring needs; its size is bounded by the sample."""

    idf: dict[str, float] = field(default_factory=dict)
    index: BlockMaxIndex | None = None
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: list = field(default_factory=list)
    prior: float = 0.0
    unknown: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def open(self) -> None:
        if not hasattr(self, "vectors"):
            self.vectors = Vectors(self.idf)

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "vectors"}

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Distance-weighted share of label 1 among neighbours, drawn towards the prior."""
        weight = 1 / (0.1 + 1 - np.minimum(cosine, 1.0))
        return float(((weight * self.labels[near]).sum() + self.prior) / (weight.sum() + 1))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple]]]:
        """Score and evidence of each text."""
        self.open()
        if self.index is None:
            return [(self.unknown, [])] * len(texts)
        out = []
        for near, cosine in self.index.nearest_of_all([self.vectors(t) for t in texts], NEIGHBOURS):
            if not len(near):
                out.append((self.unknown, []))
                continue
            vote = self.vote(near, cosine)
            # A little of the vote keeps the order within a step of the curve.
            share = 0.98 * float(np.interp(vote, *self.curve)) + 0.02 * vote
            out.append((share, [
                (self.ids[n], float(c), int(self.labels[n]))
                for n, c in zip(near[:EVIDENCE].tolist(), cosine[:EVIDENCE].tolist())
            ]))
        return out


def _count_terms(sample: DataFrame) -> DataFrame:
    """``term, seen``: labelled rows that hold each term."""

    def run(batches):
        for batch in slices(batches):
            seen = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(set(stems(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "seen"]
            )

    return sample.select("text").mapInArrow(run, "term string, seen long").groupBy("term").agg(F.sum("seen").alias("seen"))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from labelled rows outside the held-out fold."""
    chosen = (
        labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("toxic"))
        .filter(F.col("l_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("l_id")))
        .groupBy("l_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("l_id"), "l_id").limit(sample_rows)
    )
    # The chosen ids are bounded by sample_rows, so only their texts move.
    sample = storage.materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .filter(F.coalesce(F.char_length("text"), F.lit(0)) <= sample_chars)
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")),
        "examples",
    )
    rows = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = rows.get(1, 0), rows.get(0, 0)
    n = n1 + n0
    if not n1 or not n0:
        rate = float(n1 > 0)
        return Model(prior=rate, unknown=rate)
    counted = _count_terms(sample).orderBy("term").toArrow()
    idf = dict(zip(
        counted.column("term").to_pylist(), ((np.log((1 + n) / (1 + counted.column("seen").to_numpy())) + 1) ** RARITY).tolist()
    ))
    del counted

    def run(batches):
        vectors = Vectors(idf)
        for batch in slices(batches):
            found = [vectors(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([t for t, _ in found], pa.list_(pa.int32())),
                 pa.array([w for _, w in found], pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "terms", "weights"],
            )

    id_type = sample.schema["doc_id"].dataType.simpleString()
    made = sample.mapInArrow(
        run, f"doc_id {id_type}, toxic int, terms array<int>, weights array<double>"
    ).toArrow()
    ids, labels = made.column("doc_id").to_pylist(), made.column("toxic").to_numpy()
    vectors = []
    for batch in made.select(["terms", "weights"]).to_batches():
        terms, weights = (c.flatten().to_numpy() for c in batch.columns)
        ends = np.cumsum(batch.column(0).value_lengths().to_numpy())[:-1]
        vectors += zip(np.split(terms, ends), np.split(weights, ends))
    blank = [int(y) for (t, _), y in zip(vectors, labels.tolist()) if not len(t)]
    # Examples with the same heaviest term share blocks, which keeps bounds tight.
    known = sorted(
        (i for i, (t, _) in enumerate(vectors) if len(t)),
        key=lambda i: (int(vectors[i][0][int(np.argmax(vectors[i][1]))]), int(labels[i]), str(ids[i])),
    )
    examples = [vectors[i] for i in known]
    model = Model(
        idf=idf, index=BlockMaxIndex(examples, len(idf)) if examples else None,
        labels=labels[known].astype(float), ids=[ids[i] for i in known],
        prior=n1 / n, unknown=(sum(blank) + 0.5) / (len(blank) + 1) if blank else n1 / n,
    )
    if examples:
        model.curve = isotonic(_own_votes(sample, model), model.labels)
    return model


def _own_votes(sample: DataFrame, model: Model) -> np.ndarray:
    """The vote on each example, left out itself."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        own.open()
        number = {doc_id: i for i, doc_id in enumerate(own.ids)}
        for batch in slices(batches):
            asked = [(number[i], t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if i in number]
            near = own.index.nearest_of_all([own.vectors(t) for _, t in asked], NEIGHBOURS, [i for i, _ in asked])
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in asked], pa.int64()), pa.array([own.vote(*n) for n in near], pa.float64())],
                names=["at", "vote"],
            )

    got = sample.select("doc_id", "text").mapInArrow(run, "at long, vote double").toArrow()
    votes = np.zeros(len(model.ids))
    votes[got.column("at").to_numpy()] = got.column("vote").to_numpy()
    return votes


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` and ``evidence`` (doc_id, cosine, label of the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = shared.value
        for batch in slices(batches):
            found = own.score(batch.column(1).to_pylist())
            told = [[{"doc_id": i, "cosine": c, "toxic": y} for i, c, y in e] for _, e in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in found], pa.float64()),
                 pa.array(told, pa.list_(pa.struct([
                     ("doc_id", batch.schema.field(0).type), ("cosine", pa.float64()), ("toxic", pa.int32())
                 ])))],
                names=["doc_id", "score", "evidence"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, score double, evidence array<struct<doc_id: {id_type}, cosine: double, toxic: int>>"
    )
