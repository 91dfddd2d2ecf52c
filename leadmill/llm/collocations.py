"""Phrases whose words occur together more often than apart.

Windows of words are counted in a HAT trie: a shallow trie over word ids whose
leaves are hash containers of suffixes; a container that grows too large bursts
into a trie node with a container for each next word.  A task's trie holds a
bounded number of entries; beyond that its largest subtrees leave as sorted runs.
Runs of all tasks are merged by sums.  The rows of a run are dealt out by the
whole window, not by its prefix alone, so no prefix gathers in one task.

A word id is a 64-bit hash of language and word.  Every id that reaches the least
count is checked to stand for one word; if one does not, all is counted again with
another seed, so results are exact.

Counting goes by length: words, pairs, then windows of up to four.  A longer
phrase reaches the least count only if its parts do, so words and pairs below it
cut the windows of the next pass.  Tasks know them by bitmaps of a fixed size; a
false hit there counts a window in vain and loses none.

Defined results: a null text is empty and a null language is ``und``; rows count
as often as they stand, repeated ones too; ids and other columns are not read; ties of
score and count are ranked by the phrase in UTF-8 byte order; an empty table gives
no phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadmill import storage
from leadmill.llm.hashing import BASE, U64, mixed

LEAST_COUNT = 30
#: A candidate goes when a longer one that holds it has this part of its count, in percent.
ABSORBED_PERCENT = 80
TOP = 2000
LONGEST = 4
#: Entries of a container before it bursts, and of a task's trie before it spills.
BURST = 4_096
MOST_ENTRIES = 300_000
MOST_WORDS = 200_000
#: Bits of a bitmap, as a power of two.
LOG_BITS = 26
CHUNK_CHARS = 2 << 20
_HASHED_BYTES = 64
_SEEDS = 4

# Bytes of a text: part of a word, between words, between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

WORD_COLUMNS = [f"w{i}" for i in range(1, LONGEST + 1)]


def _digest(raw: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


class Words:
    """The words of some texts in a row: ids, bytes and whether each follows the one before it in a piece."""

    def __init__(self, langs: list[str | None], texts: list[str | None], seed: int):
        raws = [(t or "").encode() for t in texts]
        self.langs = ["und" if lang is None else lang for lang in langs]
        data = _LOWER[np.frombuffer(b"\n".join(raws), np.uint8)]
        kind = _KIND[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], kind != 0, [True]])))
        starts, stops = edge[0::2], edge[1::2]
        self._data, self._starts, self._stops = data, starts, stops
        breaks = np.flatnonzero(kind == 2)
        piece = np.searchsorted(breaks, starts)
        self.follows = np.diff(piece, prepend=-1) == 0
        ends = np.cumsum([len(r) + 1 for r in raws])
        self.text_of = np.searchsorted(ends, starts, side="right")
        known = {lang: _digest(lang.encode(), seed) for lang in set(self.langs)}
        by_text = np.array([known[lang] for lang in self.langs], U64)
        self.ids = self._hashes(seed) ^ by_text[self.text_of]
        self.ids = mixed(self.ids)
        self.ids[self.ids == 0] = 1

    def _hashes(self, seed: int) -> np.ndarray:
        length = self._stops - self._starts
        order = np.argsort(-length, kind="stable")
        starts, descending = self._starts[order], -length[order]
        sums = np.full(len(order), _digest(b"", seed), U64)
        for at in range(min(_HASHED_BYTES, -int(descending[0]) if len(order) else 0)):
            n = np.searchsorted(descending, -at)
            sums[:n] = sums[:n] * U64(BASE | 1) + self._data[starts[:n] + at] + U64(1)
        for i in range(np.searchsorted(descending, -_HASHED_BYTES)):
            sums[i] = U64(_digest(self.word(order[i]), seed))
        out = np.empty_like(sums)
        out[order] = mixed(sums)
        return out

    def word(self, at: int) -> bytes:
        return self._data[self._starts[at] : self._stops[at]].tobytes()


def _chunks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Words]:
    """Words of the rows (lang, text), a bounded number of characters at once or one text."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            langs.append(lang.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "") + 1
            if size >= CHUNK_CHARS:
                yield Words(langs, texts, seed)
                langs, texts, size = [], [], 0
    if texts:
        yield Words(langs, texts, seed)


class Inner(dict):
    """A trie node: next word id to a further node or a container."""


class HatTrie:
    """Counts of windows of word ids, all of one length.

    A container maps the rest of a window, an id or a tuple of ids, to its count.
    """

    def __init__(self, burst: int = BURST, most: int = MOST_ENTRIES):
        self._root, self._burst, self._most, self._size = Inner(), burst, most, 0

    def add(self, windows: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct windows, one row each, that are sorted."""
        if not len(windows):
            return
        starts = np.flatnonzero(np.diff(windows[:, 0], prepend=~windows[0, 0]))
        if windows.shape[1] == 2:
            rests = windows[:, 1].tolist()
        else:
            rests = list(map(tuple, windows[:, 1:].tolist()))
        counts, ends = counts.tolist(), [*starts[1:].tolist(), len(windows)]
        for first, start, end in zip(windows[starts, 0].tolist(), starts.tolist(), ends):
            self._add(self._root, first, rests[start:end], counts[start:end])

    def _add(self, parent: Inner, first: int, rests: list, counts: list[int]) -> None:
        node = parent.get(first)
        if type(node) is Inner:
            for rest, n in zip(rests, counts):
                self._add(node, rest[0], [rest[1] if len(rest) == 2 else rest[1:]], [n])
            return
        if node is None:
            node = parent[first] = dict(zip(rests, counts))
            self._size += len(node)
        else:
            self._size -= len(node)
            get = node.get
            for rest, n in zip(rests, counts):
                node[rest] = get(rest, 0) + n
            self._size += len(node)
        if len(node) > self._burst and type(rests[0]) is tuple:
            parent[first] = apart = Inner()
            for rest, n in node.items():
                apart.setdefault(rest[0], {})[rest[1] if len(rest) == 2 else rest[1:]] = n

    def full(self) -> bool:
        return self._size > self._most

    def spill(self, down_to: int) -> tuple[np.ndarray, np.ndarray] | None:
        """A sorted run (windows, one row each, and their counts) of the largest subtrees, until *down_to* entries are left."""
        if self._size <= down_to:
            return None
        sizes = {first: _entries(node) for first, node in self._root.items()}
        firsts, lengths, rests, counts = [], [], [], []
        for first in sorted(sizes, key=sizes.get, reverse=True):
            if self._size <= down_to:
                break
            self._size -= sizes[first]
            firsts.append(first)
            lengths.append(sizes[first])
            _gather(self._root.pop(first), (), rests, counts)
        run = np.column_stack([np.repeat(np.array(firsts, U64), lengths), np.array(rests, U64)])
        order = np.lexsort(run.T[::-1])
        return run[order], np.array(counts, np.int64)[order]


def _entries(node: dict) -> int:
    return sum(map(_entries, node.values())) if type(node) is Inner else len(node)


def _gather(node: dict, prefix: tuple[int, ...], rests: list, counts: list[int]) -> None:
    """Append the rests of all windows below *node* and their counts."""
    if type(node) is Inner:
        for key, below in node.items():
            _gather(below, (*prefix, key), rests, counts)
        return
    if prefix:
        rests += [(*prefix, *rest) if type(rest) is tuple else (*prefix, rest) for rest in node]
    else:
        rests += node
    counts += node.values()


class Bitmap:
    """Membership of hashes in a set, with false hits but no false misses; its size is fixed."""

    def __init__(self, members: DataFrame, key: Column, log_bits: int = LOG_BITS):
        self._shift = U64(64 - log_bits)
        made = members.select(F.shiftrightunsigned(key, 64 - log_bits).alias("bit")).groupBy(
            F.shiftright("bit", 6).alias("at")
        ).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63L AS int)))").alias("bits")).toArrow()
        self._bits = np.zeros(1 << max(0, log_bits - 6), U64)
        self._bits[made.column("at").to_numpy()] = made.column("bits").to_numpy().view(U64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        bit = keys >> self._shift
        return (self._bits[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1) != 0


# One key of two neighbouring ids, alike on columns and on arrays: ids are well mixed, so a rotation will do.


def _pair_column(first: str, second: str) -> Column:
    turned = F.shiftleft(second, 23).bitwiseOR(F.shiftrightunsigned(second, 41))
    return F.col(first).bitwiseXOR(turned)


def _pair_keys(ids: np.ndarray) -> np.ndarray:
    after = ids[1:]
    return ids[:-1] ^ (after << U64(23) | after >> U64(41))


def _vocabulary(rows: DataFrame, seed: int) -> DataFrame:
    """``w, lang, word, n``: words of each task, with their counts."""
    names = ["w", "lang", "word", "n"]

    def table(seen: dict) -> pa.RecordBatch:
        columns = list(zip(*((w, lang, word, n) for w, (n, lang, word) in seen.items())))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(columns[0], U64).view(np.int64)), pa.array(columns[1], pa.string()),
             pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], pa.int64())], names=names
        )

    def run(batches):
        seen: dict[int, list] = {}
        for words in _chunks(batches, seed):
            ids, first, counts = np.unique(words.ids, return_index=True, return_counts=True)
            langs = words.text_of[first].tolist()
            for w, at, of, n in zip(ids.tolist(), first.tolist(), langs, counts.tolist()):
                if w in seen:
                    seen[w][0] += n
                else:
                    seen[w] = [n, words.langs[of], words.word(at)]
            if len(seen) > MOST_WORDS:
                yield table(seen)
                seen = {}
        if seen:
            yield table(seen)

    return rows.mapInArrow(run, "w long, lang string, word string, n long")


def _windows(words: Words, known: Bitmap, pairs: Bitmap | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows, one row each, and their counts; sorted.

    Pairs of known words, or with *pairs* windows of three or four words whose
    pairs are known; the fourth is 0 where the third ends a window.
    """
    ids = words.ids
    if len(ids) < 2:
        return np.zeros((0, 2), U64), np.zeros(0, np.int64)
    common = known.has(ids)
    linked = common[:-1] & common[1:] & words.follows[1:]
    if pairs is None:
        columns = [ids[:-1][linked], ids[1:][linked]]
    else:
        linked &= pairs.has(_pair_keys(ids))
        at = np.flatnonzero(linked[:-1] & linked[1:])
        fourth = np.append(ids, U64(0))[at + 3]
        fourth[~np.append(linked, False)[at + 2]] = 0
        columns = [ids[at], ids[at + 1], ids[at + 2], fourth]
    order = np.lexsort(columns[::-1])
    rows = np.stack([c[order] for c in columns], axis=1)
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[starts], np.diff(np.append(starts, len(rows)))


def _counted(rows: DataFrame, seed: int, known, pairs=None) -> DataFrame:
    """``w1.., n``: the windows of all texts, each task's runs merged."""
    width = 2 if pairs is None else LONGEST
    names = [*WORD_COLUMNS[:width], "n"]

    def table(windows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [np.ascontiguousarray(windows[:, i]).view(np.int64) for i in range(width)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, counts)], names=names)

    def run(batches):
        trie = HatTrie()
        for words in _chunks(batches, seed):
            trie.add(*_windows(words, known.value, pairs and pairs.value))
            if trie.full():
                yield table(*trie.spill(MOST_ENTRIES // 4))
        if rest := trie.spill(0):
            yield table(*rest)

    counted = rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return counted.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def _padded(counted: DataFrame, width: int, least: int) -> DataFrame:
    """Phrases of *width* words with their counts, further words 0."""
    return counted.filter(F.col("f") >= least).select(
        *WORD_COLUMNS[:width], *(F.lit(0).cast("long").alias(c) for c in WORD_COLUMNS[width:]),
        F.lit(width).alias("width"), "f",
    )


def _part(start: int, width: int) -> Column:
    """Words *start* to *start* + *width* of a phrase, padded."""
    inside = [F.col(WORD_COLUMNS[i]) for i in range(start, start + width)]
    outside = [F.lit(0).cast("long")] * (LONGEST - width)
    return F.struct(*(c.alias(name) for c, name in zip(inside + outside, WORD_COLUMNS)))


def _parts(phrases: DataFrame, wanted: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """One row for each (width, k, side, start, length) in *wanted* and phrase of that width: ``k, side, part``."""
    by_width = [
        F.when(F.col("width") == width, F.array(*(
            F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), _part(start, length).alias("part"))
            for w, k, side, start, length in wanted if w == width
        ))) for width in sorted({x[0] for x in wanted})
    ]
    return phrases.select(*WORD_COLUMNS, "width", "f", F.explode(F.coalesce(*by_width)).alias("cut")).select(
        *WORD_COLUMNS, "width", "f", "cut.k", "cut.side", "cut.part"
    )


def phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least_count: int = LEAST_COUNT,
            absorbed_percent: int = ABSORBED_PERCENT, top: int = TOP) -> DataFrame:
    """The best phrases of two to four words of each language.

    ``lang, rank, phrase, a, l, r, n, score``: the phrase stands *a* times; at its
    lowest-scoring cut its parts stand *l* and *r* times; the language has *n*
    words; the score is 2,000,000 a / (l + r), rounded down.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    for seed in range(_SEEDS):
        vocabulary = storage.materialize(_vocabulary(rows, seed), "words")
        check = F.xxhash64("lang", "word")
        known = storage.materialize(
            vocabulary.groupBy("w").agg(
                F.sum("n").alias("f"), F.min(check).alias("c1"), F.max(check).alias("c2")
            ).filter(F.col("f") >= least_count), "known-words",
        )
        if known.filter("c1 <> c2").isEmpty():
            break
    else:
        raise RuntimeError("word ids are not unique with any seed")

    share = spark.sparkContext.broadcast
    words = share(Bitmap(known, F.col("w")))
    pairs = storage.materialize(
        _counted(rows, seed, words).withColumnRenamed("n", "f").filter(F.col("f") >= least_count), "pairs"
    )
    windows = storage.materialize(
        _counted(rows, seed, words, share(Bitmap(pairs, _pair_column("w1", "w2")))), "windows"
    )
    triples = windows.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("f"))
    fours = windows.filter("w4 <> 0").withColumnRenamed("n", "f")
    singles = _padded(known.select(F.col("w").alias("w1"), "f"), 1, least_count)
    candidates = storage.materialize(
        _padded(pairs, 2, least_count).union(_padded(triples, 3, least_count)).union(_padded(fours, 4, least_count)),
        "candidates",
    )

    # The lowest-scoring cut of each candidate.
    widths = range(2, LONGEST + 1)
    cuts = [(w, k, side, start, length) for w in widths for k in range(1, w)
            for side, start, length in ((0, 0, k), (1, k, w - k))]
    counts = singles.union(candidates).select(
        F.struct(*WORD_COLUMNS).alias("counted"), F.col("f").alias("part_f")
    )
    cut = (
        _parts(candidates, cuts).join(counts, F.col("part") == F.col("counted"))
        .groupBy(*WORD_COLUMNS, "width", "f", "k").agg(
            F.sum(F.when(F.col("side") == 0, F.col("part_f"))).alias("l"),
            F.sum(F.when(F.col("side") == 1, F.col("part_f"))).alias("r"),
        )
        .withColumn("score", F.expr("cast(2000000 * cast(f AS decimal(20,0)) div (cast(l AS decimal(20,0)) + r) AS long)"))
        .groupBy(*WORD_COLUMNS, "width", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    )

    # Candidates inside a longer one of nearly their count go.
    inner = [(w, 0, 0, start, length) for w in widths for length in range(2, w) for start in range(w - length + 1)]
    holders = _parts(candidates.filter("width > 2"), inner).groupBy("part").agg(F.max("f").alias("held"))
    absorbed = holders.filter(
        F.col("held") >= least_count
    ).select(F.col("part").alias("inside"), "held")
    left = cut.join(absorbed, F.struct(*WORD_COLUMNS) == F.col("inside"), "left").filter(
        F.col("held").isNull()
        | (F.lit(100).cast("decimal(4,0)") * F.col("held") < F.lit(absorbed_percent).cast("decimal(4,0)") * F.col("f"))
    )

    # The first of each language; ties of score and count stay until the phrases are known.
    of_word = storage.materialize(
        vocabulary.join(known.select(F.col("w").alias("k")), F.col("w") == F.col("k"), "left_semi")
        .select("w", "lang", "word").distinct(), "texts",
    )
    scored = left.join(of_word.select("w", "lang"), F.col("w1") == F.col("w")).select(
        "lang", *WORD_COLUMNS, "f", "low.score", "low.l", "low.r"
    )
    best = F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("f")))
    first = scored.withColumn("place", best).filter(F.col("place") <= top)
    spoken = (
        first.select("*", F.posexplode(F.array(*WORD_COLUMNS)).alias("pos", "at")).filter("at <> 0")
        .join(of_word.select("w", "word"), F.col("at") == F.col("w"))
        .groupBy("lang", *WORD_COLUMNS, "f", "score", "l", "r")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("said"))
        .withColumn("phrase", F.array_join("said.word", " "))
    )
    totals = vocabulary.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    return (
        spoken.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
        .join(totals, F.col("lang") == F.col("of_lang"))
        .select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
    )
