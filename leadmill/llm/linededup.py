"""Line dedup by a deletion-neighbourhood join.

Two lines are near when one word edit (change, insertion or removal) turns one
into the other and the longer has *near_words* words or more: short lines would
match by chance.  Lines of every length are compared for equality.  A line goes when an earlier line, in the order of ``doc_id`` and
line number, is equal or near; the earliest stays.

Equal lines are aggregated first.  For the distinct lines every variant with one
word deleted is a hashed key.  A key also says what it stands for: a variant at
its place (lines that share it differ in that word) or a shorter line.  All lines
that share a key of the first kind are near to its earliest one.  Under a key of
the second kind only the line that is the shorter one is near to the others,
which may be two edits apart; so the earliest row of either part is kept, and
each part is matched with the other.  An aggregate finds these rows; no pairs are
made, however many lines share a key.  The found partner is verified on the words.

Lines without any possible partner are left out before variants are made: one
edit leaves the first or the last words of both lines equal, so the hashes of
those two ends are counted first.

Lines of fewer than *min_words* words, by default only those of none, are left alone.

Defined results: a null or empty text has no lines to compare; rows with a null
``doc_id`` are neither compared nor changed; rows that share a ``doc_id`` share
their line numbers, and only a smaller (``doc_id``, line) counts as earlier, so
repeated rows do not remove each other's lines; other columns are kept; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill import storage
from leadmill.llm.bpe import map_texts, slices
from leadmill.llm.hashing import BASE, U64, mixed, powers, word_hashes

MIN_WORDS = 1
#: The longer of two near lines has so many words at least.
NEAR_WORDS = 10
#: Characters of texts that are hashed as one buffer.
ROW_CHARS = 1 << 18
#: Variants handed back to Spark at a time, but for those of a longer line.
BATCH_KEYS = 1 << 16
_TAG = U64(0xD6E8FEB86659FD93)
#: What a line is to a key: one of several that differ at a place, the shorter line, one with a word more.
_CHANGED, _OWN, _REMOVED = range(3)


def _sequence_key(sums: np.ndarray, length) -> np.ndarray:
    return mixed(sums + np.asarray(length).astype(U64) * U64(BASE))


class Lines:
    """Hashes of the lines of one text, or of several in a row, that have enough words.

    Texts in a row are one buffer, as a text's end ends a line: a document costs
    no more than its characters.  ``of`` is the place of each line's text.
    """

    def __init__(self, texts: list[str | None] | str | None, min_words: int):
        texts = texts if isinstance(texts, list) else [texts]
        raw = "\n".join(t or "" for t in texts).lower().encode()
        self._words, places = word_hashes(raw)
        breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        of_line = np.searchsorted(breaks, places)
        number, first, count = np.unique(of_line, return_index=True, return_counts=True)
        long = count >= min_words
        number, self._first, self.count = number[long], first[long], count[long]
        starts = np.cumsum([0, *((t or "").count("\n") + 1 for t in texts)])[:-1]
        self.of = np.searchsorted(starts, number, side="right") - 1
        self.number = number - starts[self.of]
        up, self._down = powers.upto(len(self._words) + 1)
        self._sums = np.concatenate([[U64(0)], np.cumsum(self._words * up[:-1])])

    def _stretch(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _sequence_key((self._sums[start + n] - self._sums[start]) * self._down[start], n)

    def keys(self) -> np.ndarray:
        return self._stretch(self._first, self.count)

    def ends(self, shorter: bool) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the first and the last words of each line.

        Lines from 2^c words to below 2^(c+1) take 2^(c-1) words; *shorter* gives
        those that lines with one word fewer take.
        """
        size = np.left_shift(1, np.log2(np.maximum(self.count - shorter, 1)).astype(np.int64)) // 2
        front = self._stretch(self._first, size)
        back = self._stretch(self._first + self.count - size, size)
        return mixed(front ^ _TAG), mixed(back ^ (_TAG << U64(1)))


def deletion_keys(line: str, with_removals: bool, near_words: int = NEAR_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a line's variants with one word deleted, and with *with_removals* its own; and their parts.

    A line of fewer than *near_words* words can only be the shorter of two.
    """
    words, _ = word_hashes(line.encode())
    n = len(words)
    up, down = powers.upto(n + 1)
    sums = np.concatenate([[U64(0)], np.cumsum(words * up[:n])])
    without = sums[:-1] + (sums[-1] - sums[1:]) * down[1]
    removed = _sequence_key(without, n - 1)
    changed = mixed(removed ^ mixed(np.arange(1, n + 1, dtype=U64) * _TAG))
    own = _sequence_key(sums[-1:], n)
    if n < near_words:
        changed, removed = changed[:0], removed[:0]
    kinds = [changed, own, np.unique(removed)] if with_removals else [changed]
    return np.concatenate(kinds), np.repeat(np.arange(len(kinds), dtype=np.int8), [len(k) for k in kinds])


def near(one: list[str], two: list[str]) -> bool:
    """Whether at most one word edit turns *one* into *two*."""
    if len(one) > len(two):
        one, two = two, one
    if len(two) - len(one) > 1:
        return False
    same = next((i for i, (a, b) in enumerate(zip(one, two)) if a != b), len(one))
    return one[same + (len(one) == len(two)) :] == two[same + 1 :]


def _line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int, near_words: int) -> DataFrame:
    """``doc_id, line_no, n_words, line, e0..e3``: the key of each line and of its ends if it may have near ones."""

    def run(batches):
        for batch in slices(batches):
            batch = batch.filter(batch.column(0).is_valid())
            for doc, found in _in_rows(batch.column(0).to_numpy(), batch.column(1).to_pylist(), min_words):
                once = (found.count & (found.count - 1)) != 0  # the same ends either way
                few = found.count < near_words - 1
                arrays = [pa.array(c) for c in (doc[found.of], found.number, found.count, found.keys().view(np.int64))]
                arrays += [pa.array(e.view(np.int64), mask=few) for e in found.ends(False)]
                arrays += [pa.array(e.view(np.int64), mask=few | once) for e in found.ends(True)]
                arrays[1:3] = [a.cast(pa.int32()) for a in arrays[1:3]]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "line_no", "n_words", "line", "e0", "e1", "e2", "e3"]
    return map_texts(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        run,
        "doc_id long, line_no int, n_words int, line long, e0 long, e1 long, e2 long, e3 long",
    )


def _in_rows(docs: np.ndarray, texts: list[str | None], min_words: int):
    """Documents and the lines of their texts, about *ROW_CHARS* characters at once."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= ROW_CHARS or at == len(texts) - 1:
            found = Lines(texts[start : at + 1], min_words)
            if len(found.number):
                yield docs[start : at + 1], found
            start, size = at + 1, 0


def _line_texts(with_lines: DataFrame) -> DataFrame:
    """``line, words``: normalised text of the asked line numbers of each document."""

    def run(batches):
        for batch in slices(batches):
            keys, texts = [], []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = (text or "").lower().split("\n")
                for want in asked:
                    if want["line_no"] < len(lines):
                        keys.append(want["line"])
                        texts.append(b" ".join(lines[want["line_no"]].encode().split()).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(texts, pa.string())], names=["line", "words"]
            )

    return map_texts(with_lines.select("text", "asked"), run, "line long, words string")


def _variants(lines: DataFrame, near_words: int) -> DataFrame:
    """``variant, part, doc_id, line_no, line``: the deletion neighbourhood of each line."""

    def made(parts):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c)) for c in zip(*parts)],
            names=["variant", "part", "doc_id", "line_no", "line"],
        )

    def run(batches):
        for batch in slices(batches):
            parts, size = [], 0
            columns = (batch.column(i).to_pylist() for i in range(5))
            for words, removals, doc, number, line in zip(*columns):
                keys, kinds = deletion_keys(words, removals, near_words)
                parts.append((keys.view(np.int64), kinds, np.full(len(keys), doc),
                              np.full(len(keys), number, np.int32), np.full(len(keys), line)))
                size += len(keys)
                if size >= BATCH_KEYS:
                    yield made(parts)
                    parts, size = [], 0
            if parts:
                yield made(parts)

    return map_texts(
        lines.select("words", "removals", "doc_id", "line_no", "line"), run,
        "variant long, part byte, doc_id long, line_no int, line long",
    )


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs of lines (``words``, ``kept_words``) that are near indeed."""

    def run(batches):
        for batch in slices(batches):
            both = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            mask = pa.array([near(a.split(" "), b.split(" ")) for a, b in both], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [c.filter(mask) for c in batch.columns[2:]], names=["line", "kept_doc_id", "kept_line_no"]
            )

    return map_texts(
        pairs.select("words", "kept_words", "line", "kept_doc_id", "kept_line_no"), run,
        "line long, kept_doc_id long, kept_line_no int",
    )


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """Lines that go: ``doc_id, line_no, line`` (hash), ``kept_doc_id, kept_line_no, distance``."""
    lines = storage.materialize(_line_table(docs, id_col, text_col, min_words, near_words), "lines")
    place = F.struct("doc_id", "line_no")
    distinct = storage.materialize(
        lines.groupBy("line").agg(
            F.min(place).alias("first"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"),
            *(F.max(f"e{i}").alias(f"e{i}") for i in range(4)),
        ),
        "distinct",
    )

    # Lines that share an end with another line.
    ends = distinct.select(
        "line", "n_words", F.explode(F.array(*(f"e{i}" for i in range(4)))).alias("end")
    ).filter("end IS NOT NULL")
    shared = ends.groupBy("end").agg(
        F.min("line").alias("least"), F.max("line").alias("most"),
        F.min("n_words").alias("shortest"), F.max("n_words").alias("longest"),
    ).filter("least < most").select("end", (F.col("longest") > F.col("shortest")).alias("uneven"))
    open_lines = ends.join(shared, "end").groupBy("line").agg(F.max("uneven").alias("removals"))
    asked = storage.materialize(
        distinct.select("line", "first").join(open_lines, "line").select("first.*", "line", "removals"), "asked"
    )
    wanted = asked.groupBy(F.col("doc_id").alias("w_id")).agg(
        F.collect_list(F.struct("line_no", "line")).alias("asked")
    )
    own = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).alias("text"))
    texts = storage.materialize(
        _line_texts(own.join(wanted, F.col("d_id") == F.col("w_id"))).dropDuplicates(["line"]), "line-texts"
    )

    # The earliest lines of each key, then the earliest partner of each line.
    variants = storage.materialize(_variants(asked.join(texts, "line"), near_words), "variants")
    row, is_own = F.struct("doc_id", "line_no", "line"), F.col("part") == _OWN
    earliest = variants.groupBy("variant").agg(
        F.min(F.when(is_own, row)).alias("shorter"), F.min(F.when(~is_own, row)).alias("others"),
        F.max("line").alias("most"), F.min("line").alias("least"), F.min("part").alias("has"),
    ).filter((F.col("least") < F.col("most")) & (F.col("has") < _REMOVED)).select("variant", "shorter", "others")
    early = F.when(F.col("part") == _REMOVED, F.col("shorter")).otherwise(F.col("others"))
    partners = (
        variants.join(earliest, "variant").withColumn("early", early)
        .filter(F.struct(F.col("early.doc_id"), F.col("early.line_no")) < F.struct("doc_id", "line_no"))
        .groupBy("line").agg(F.min("early").alias("kept"))
        .select("line", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"),
                F.col("kept.line").alias("kept"))
    )
    near_lines = _verified(
        partners.join(texts, "line").join(
            texts.select(F.col("line").alias("kept"), F.col("words").alias("kept_words")), "kept"
        )
    )

    acts = distinct.join(near_lines, "line", "left").filter("copies > 1 OR kept_doc_id IS NOT NULL").select(
        F.col("line").alias("a_line"), "first", "kept_doc_id", "kept_line_no"
    )
    is_near = F.col("kept_doc_id").isNotNull()
    return (
        lines.select("doc_id", "line_no", "line").join(acts, F.col("line") == F.col("a_line"))
        .filter(is_near | (place != F.col("first")))
        .select(
            "doc_id", "line_no", "line",
            F.coalesce("kept_doc_id", "first.doc_id").alias("kept_doc_id"),
            F.coalesce("kept_line_no", "first.line_no").alias("kept_line_no"),
            is_near.cast("int").alias("distance"),
        )
        # Repeated rows meet by document: a hot line's rows stay split among the tasks of the join.
        .repartition("doc_id").distinct()
    )


def remove_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, least_left_percent: int = 0) -> DataFrame:
    """*docs* without the lines that go; same columns.

    A document that loses lines and is left with less than *least_left_percent*
    of its words, or with none, goes as a whole if the percentage is above 0; at
    0 every row stays, if with an empty text.
    """
    gone = removals(
        docs, id_col=id_col, text_col=text_col, min_words=min_words, near_words=near_words
    ).groupBy(
        F.col("doc_id").alias("_gone_id")
    ).agg(F.collect_list(F.struct("line_no", "line")).alias("_gone_lines"))
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            stays = [True] * len(texts)
            for i, gone_lines in enumerate(batch.column(len(schema)).to_pylist()):
                if gone_lines and texts[i] is not None:
                    old, texts[i] = texts[i], _without(texts[i], gone_lines, min_words)
                    if least_left_percent and texts[i] != old:
                        left = len(texts[i].encode().split())
                        stays[i] = left > 0 and left * 100 >= len(old.encode().split()) * least_left_percent
            columns = list(batch.columns[: len(schema)])
            columns[at] = pa.array(texts, pa.string())
            made = pa.RecordBatch.from_arrays(columns, names=schema.names)
            yield made.filter(pa.array(stays, pa.bool_()))

    joined = docs.join(gone, F.col(id_col).cast("long") == F.col("_gone_id"), "left")
    return map_texts(joined.select(*(docs[c] for c in docs.columns), "_gone_lines"), run, schema)


def _without(text: str, gone_lines: list[dict], min_words: int) -> str:
    """*text* without the lines that have both the number and the hash of a gone one."""
    found = Lines(text, min_words)
    own = dict(zip(found.number.tolist(), found.keys().view(np.int64).tolist()))
    gone = {g["line_no"] for g in gone_lines if own.get(g["line_no"]) == g["line"]}
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
