"""Spelling variants by an index of variable-length grams.

Grams are taken from the two ends of a word.  The gram dictionary holds the grams
that more than *list_most* words share; frequencies fall with length, so a word's
shortest gram outside the dictionary has a short inverted list.  One edit leaves
all of a word intact before and after its place, so it cannot affect a gram that
lies on one side of it.  For every place this bound says which grams survive:

* the rare gram at the front, if the place lies behind it;
* the rare gram at the back, if the place lies before it;
* otherwise only dictionary grams, the whole stretches on either side; their long
  lists are merged by one key of both, under which only few words can meet.

Two words one edit apart therefore share a key of the place of the edit.  Each
list is bounded by *list_most* or by the letters one place can take, so the join
makes a number of candidates that grows with the vocabulary only.  Candidates are
verified by their edit distance inside the join.

A word's form is its most frequent near word, if frequent enough; roots follow
forms by doubling joins, and since a form is at least so many times as frequent,
there are few rounds.

Defined results: a null or empty text has no words; a null ``doc_id`` counts as an
empty one in the hash; rows count as often as they stand, repeated ones too;
a word of any length is compared as a whole; other columns are not read; ties of frequency go to the smaller word in code-point
order; an empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill import storage
from leadmill.llm.bpe import slices

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is at least so many times as frequent as its word.
FORM_FACTOR = 10
#: One in so many words of a document loses a letter.
DROP_ONE_IN = 31
#: Words that may share a gram outside the dictionary.
LIST_MOST = 16
#: Lengths of grams: every one from the shortest on, and above 32 in steps of a half, so that the grams of a
#: very long word take work in proportion to its length.
SHORTEST_GRAM = 3
GRAM_SIZES = [*range(SHORTEST_GRAM, 33), *(int(32 * 1.5**i) for i in range(1, 44))]
MOST_WORDS = 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def document_words(doc_id: int | None, text: str | None, least_length: int = LEAST_LENGTH) -> Counter[str]:
    """Words of a text with their counts, after some have lost a letter."""
    runs = Counter(_RUN.findall((text or "").encode().translate(_LOWER).decode()))
    mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    words: Counter[str] = Counter()
    for run, n in runs.items():
        if len(run) < least_length:
            continue
        drop = zlib.crc32(run.encode(), mark)
        if drop % DROP_ONE_IN == 0:
            at = drop % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least_length:
                continue
        words[run] += n
    return words


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that stand often enough."""

    def table(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update(document_words(doc, text, least_length))
                if len(seen) > MOST_WORDS:
                    yield table(seen)
                    seen = Counter()
        if seen:
            yield table(seen)

    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .mapInArrow(run, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    )


def _front(length: Column) -> Column:
    return F.substring("word", F.lit(1), length)


def _back(length: Column) -> Column:
    return F.substring("word", F.char_length("word") - length + 1, length)


def _with_bounds(words: DataFrame, list_most: int) -> DataFrame:
    """Words with ``front`` and ``back``: how many of their letters at either end hold no gram outside the dictionary."""
    length, sizes = F.char_length("word"), F.array(*map(F.lit, GRAM_SIZES))
    grams = words.select(
        "word", F.explode(F.filter(sizes, lambda size: size <= length)).alias("size")
    ).select("word", "size", F.explode(F.array(F.lit(0), F.lit(1))).alias("end")).select(
        "word", "size", "end",
        F.xxhash64("end", F.when(F.col("end") == 0, _front(F.col("size"))).otherwise(_back(F.col("size")))).alias("gram"),
    )
    dictionary = grams.groupBy("gram").count().filter(F.col("count") > list_most).select(F.col("gram").alias("frequent"))
    longest = grams.join(dictionary, F.col("gram") == F.col("frequent")).groupBy(F.col("word").alias("of")).agg(
        *(F.max(F.when(F.col("end") == e, F.col("size"))).alias(name) for e, name in ((0, "front"), (1, "back")))
    )

    def reach(end: str) -> Column:
        further = F.filter(sizes, lambda size: size > F.coalesce(end, F.lit(0)))
        return F.least(F.get(further, F.lit(0)) - 1, length)

    return words.join(longest, F.col("word") == F.col("of"), "left").select(
        "word", "n", length.alias("length"), *(reach(c).alias(c) for c in ("front", "back"))
    )


def near_pairs(words: DataFrame, *, list_most: int = LIST_MOST) -> DataFrame:
    """``a, b, a_n, b_n``: words of *words* (``word, n``, distinct) that one edit of a code point turns into each other, a < b."""
    bounded = storage.materialize(_with_bounds(words, list_most), "bounds")
    front, back, length = F.col("front"), F.col("back"), F.col("length")

    # Places whose surviving grams all are in the dictionary.
    low, high = F.greatest(F.lit(0), length - 1 - back), F.least(front, length - 1)
    places = F.when(low <= high, F.sequence(low, high))

    def without(at: Column) -> tuple[Column, Column]:
        return F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.col("length"))

    def one(kind: str, *parts: Column) -> Column:
        return F.xxhash64(F.lit(kind), *parts)

    shared = F.concat(
        F.array(
            F.when(front < length, one("front", _front(front + 1))),
            F.when(back < length, one("back", _back(back + 1))),
        ),
        F.coalesce(F.transform(places, lambda at: one("place", at, *without(at))), F.array().cast("array<bigint>")),
    )
    removed = F.transform(places, lambda at: one("whole", F.concat(*without(at))))
    keyed = bounded.select("word", "n", F.explode(F.array_distinct(F.array_compact(shared))).alias("key"))
    longer = bounded.select("word", "n", F.explode(F.array_distinct(removed)).alias("key"))
    whole = bounded.filter(length <= front + back).select("word", "n", one("whole", F.col("word")).alias("key"))

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), F.col("key").alias(f"{name}_key"))

    one_edit = F.levenshtein("a", "b", 1) == 1
    alike = side(keyed, "a").join(
        side(keyed, "b"), (F.col("a_key") == F.col("b_key")) & (F.col("a") < F.col("b")) & one_edit
    )
    shorter = side(longer, "a").join(side(whole, "b"), (F.col("a_key") == F.col("b_key")) & one_edit)
    turned = [F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x)
              for x, y in (("a", "b"), ("b", "a"), ("a_n", "b_n"), ("b_n", "a_n"))]
    columns = ["a", "b", "a_n", "b_n"]
    return alike.select(*columns).union(shorter.select(*turned)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form, by following forms twice as far each round."""
    state = storage.materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("over"), F.col("root").alias("next"))
        joined = storage.materialize(
            state.join(further, F.col("root") == F.col("over"), "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ), "roots",
        )
        state = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return state


def variants(words: DataFrame, *, form_factor: int = FORM_FACTOR, list_most: int = LIST_MOST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each of *words* (``word, n``, distinct)."""
    words = storage.materialize(words, "vocabulary")
    pairs = storage.materialize(near_pairs(words, list_most=list_most), "near-words")
    both = pairs.union(pairs.select("b", "a", "b_n", "a_n"))
    best = both.groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"),
        F.first("a_n").alias("a_n"),
    )
    found = storage.materialize(
        best.select(
            "a", "n_near", (F.col("best.less") <= -form_factor * F.col("a_n")).alias("has"),
            F.col("best.b").alias("b"), (-F.col("best.less")).alias("b_n"),
        ).select("a", "n_near", *(F.when(F.col("has"), F.col(c)).alias(name) for c, name in (("b", "form"), ("b_n", "form_n")))),
        "forms",
    )
    roots = _roots(found.filter("form IS NOT NULL").select(F.col("a").alias("word"), "form"))
    return (
        words.join(found, F.col("word") == F.col("a"), "left")
        .join(roots.select(F.col("word").alias("rooted"), "root"), F.col("word") == F.col("rooted"), "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
        )
    )
