"""MinHash near-duplicates with odd sketches.

A document's set holds its distinct shingles of five words.  Documents with
equal sets form a class; the classes are linked when their Jaccard similarity is
large enough.  MinHash bands give candidates; an odd sketch of each class, a
parity bitmap of its MinHash samples, gives the similarity of a candidate pair
from the population count of an XOR; pairs that may be similar enough are
confirmed on the full sets.

Each bucket of a band first proposes only its smallest class to its members, and
a member confirms only the best proposal.  Where a bucket then still holds
several components, the members outside its main component are compared with
those of other components by their sketches, inside the join condition, so only
pairs that may link become rows, each in the first band that it shares.  Pairs
that are already connected need no link.  The samples of a sketch are the
smallest hashes of a set, all of them in a short text, so the bound is tight.
Bands and sketches leave a link of similarity 0.75 out with a chance of about
3e-7.

Exact copies are aggregated before the exchange; band buckets are counted before
they are joined; nothing is collected but counts and check sums.

Defined results: a null or empty text has an empty set and is linked with
nothing; rows with a null ``doc_id`` get a null component and are kept; each of
several rows with one ``doc_id`` follows its own text, and repeated rows share
their verdict; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill import storage
from leadmill.llm.bpe import slices
from leadmill.llm.graph import components
from leadmill.llm.hashing import BASE, U64, mixed, word_hashes

WORDS = 5
MIN_PERCENT = 75
BANDS, BAND_ROWS = 40, 4
#: MinHash samples in an odd sketch, and the sketch's 64-bit words.
SAMPLES, SKETCH_WORDS = 512, 16
#: Standard deviations that a sketch may be off before a link is missed.
MARGIN = 6.0
_SHINGLE_FACTORS = mixed(np.arange(1, 64, dtype=U64) * U64(BASE)) | U64(1)
_PERMUTE = (mixed(np.arange(1000, 1000 + BANDS * BAND_ROWS, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (mixed(np.arange(5000, 5000 + BANDS * BAND_ROWS, dtype=U64)) >> U64(32)).astype(np.uint32)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    each, _ = word_hashes((text or "").encode().lower())
    if not len(each):
        return each
    n = min(words, len(each))
    joined = np.zeros(len(each) - n + 1, U64)
    for i in range(n):
        joined += each[i : len(each) - n + 1 + i] * _SHINGLE_FACTORS[i]
    return np.unique(mixed(joined + U64(n)))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest permuted value of a set under each permutation."""
    short = (hashes ^ (hashes >> U64(32))).astype(np.uint32)
    least = np.full(len(_PERMUTE), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        permuted = short[None, at : at + 1024] * _PERMUTE[:, None] + _SHIFT[:, None]
        np.minimum(least, permuted.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.astype(U64).reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=U64)
    for i in range(BAND_ROWS):
        key = mixed(key * U64(BASE) + rows[:, i])
    return key.view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap of the MinHash samples of a set: its *SAMPLES* smallest hashes."""
    bits = mixed(hashes[:SAMPLES] + U64(BASE)) % U64(64 * SKETCH_WORDS)
    parity = np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def most_differing_bits(n1: Column, n2: Column) -> Column:
    """Bits in which two odd sketches may differ if their sets are similar enough.

    The expected difference of the samples at the threshold, then that of the
    bits, each with *MARGIN* standard deviations.
    """
    larger, smaller = F.greatest(n1, n2), F.least(n1, n2)
    part_larger = F.least(F.lit(1.0), SAMPLES / larger)
    part_smaller = F.least(F.lit(1.0), SAMPLES / smaller)
    apart = (n1 + n2) * ((100 - MIN_PERCENT) / (100 + MIN_PERCENT))
    samples = part_larger * apart + smaller * (part_smaller - part_larger)
    samples = samples + MARGIN * F.sqrt(1.5 * samples * (1 - part_larger))
    size = 64.0 * SKETCH_WORDS
    fade = F.exp(-4 * samples / size)
    spread = F.greatest(F.lit(0.0), size / 4 * (1 - fade) - samples * fade)
    return size / 2 * (1 - F.sqrt(fade)) + MARGIN * F.sqrt(spread) + 1


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b`` (hashes of the set), ``bands, sketch``."""

    def run(batches):
        for batch in slices(batches):
            sizes, first, second, bands, sketches = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_set(text)
                sizes.append(len(hashes))
                first.append(int(mixed(hashes).sum(dtype=U64).view(np.int64)))
                second.append(int(mixed(hashes ^ U64(BASE)).sum(dtype=U64).view(np.int64)))
                least = min_hashes(hashes)
                bands.append(band_keys(least) if len(hashes) else [])
                sketches.append(odd_sketch(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(second, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<bigint>, sketch array<bigint>"
    )


def _confirmed(pairs: DataFrame, texts: DataFrame, *carried: str) -> DataFrame:
    """Pairs (``a, b`` and the *carried* numbers) whose full sets are similar enough."""
    names = ["a", "b", *carried]

    def run(batches):
        for batch in slices(batches):
            kept = []
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = shingle_set(one), shingle_set(two)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both > 0 and 100 * both >= MIN_PERCENT * (len(x) + len(y) - both))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[2:]], names=names)

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    with_texts = pairs.join(left, "a").join(right, "b").select("text_a", "text_b", *names)
    return with_texts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _differing(one: str, two: str) -> Column:
    bits = (F.bit_count(F.col(f"{one}.k{i}").bitwiseXOR(F.col(f"{two}.k{i}"))) for i in range(SKETCH_WORDS))
    return reduce(Column.__add__, bits)


def _may_link(one: str, two: str) -> Column:
    """Size bound and sketch bound of a pair of classes, as one condition."""
    n1, n2 = F.col(f"{one}.n_shingles"), F.col(f"{two}.n_shingles")
    sizes = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * MIN_PERCENT
    return sizes & (_differing(one, two) <= most_differing_bits(n1, n2))


def duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of *docs*."""
    signed = storage.materialize(_signatures(docs, id_col, text_col), "signatures")
    classes = storage.materialize(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("first_id")),
        "classes",
    )
    of_class = (
        (signed["doc_id"] == classes["first_id"]) & (signed["set_a"] == classes["set_a"])
        & (signed["set_b"] == classes["set_b"]) & (signed["n_shingles"] == classes["n_shingles"])
    )
    firsts = storage.materialize(
        signed.join(classes, of_class, "left_semi").select(
            F.col("doc_id").alias("member"), "n_shingles", "bands",
            *(F.get("sketch", F.lit(i)).alias(f"k{i}") for i in range(SKETCH_WORDS)),
        ),
        "firsts",
    )
    sketches = firsts.drop("bands")

    # Buckets of a band with more than one class, and their smallest class.
    in_band = firsts.select("member", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.min("member").alias("head"), F.max("member").alias("tail")).filter(
        "head < tail"
    ).select("band", "head")
    members = storage.materialize(in_band.join(shared, "band"), "buckets")

    # The best proposal of each member.
    proposed = members.filter("member > head").select("head", "member").distinct()
    rated = (
        proposed.join(sketches.alias("x"), F.col("head") == F.col("x.member"))
        .join(sketches.alias("y"), proposed["member"] == F.col("y.member"))
        .filter(_may_link("x", "y"))
        .select("head", proposed["member"].alias("member"), _differing("x", "y").alias("bits"))
    )
    best = rated.groupBy("member").agg(F.min(F.struct("bits", "head")).alias("best"))
    pairs = best.select(F.col("best.head").alias("a"), F.col("member").alias("b"))
    candidates = members.select(F.col("member").alias("doc_id")).distinct()
    texts = storage.materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(
            candidates, "doc_id", "left_semi"
        ),
        "texts",
    )
    links = storage.materialize(_confirmed(pairs, texts), "confirmed")
    joined = storage.materialize(components(links), "joined")

    # Buckets that still hold several components: members outside the main one
    # against those of other components.
    named = members.join(joined, F.col("member") == F.col("node"), "left").select(
        "band", "member", F.coalesce("component", "member").alias("component")
    )
    per_part = named.groupBy("band", "component").agg(F.count("*").alias("size"))
    mixed = per_part.groupBy("band").agg(
        F.max(F.struct("size", "component"))["component"].alias("main"), F.count("*").alias("parts")
    ).filter("parts > 1").select("band", "main")
    rows = storage.materialize(named.join(mixed, "band").join(firsts, "member"), "open")
    first_shared = F.get("x.bands", F.array_position(
        F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True
    ).cast("int") - 1)
    apart = (
        (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.component") == F.col("y.main")) | (F.col("x.member") < F.col("y.member")))
    )
    more = (
        rows.filter("component != main").alias("x")
        .join(rows.alias("y"), apart & _may_link("x", "y") & (first_shared == F.col("x.band")))
        .select(F.col("x.member").alias("a"), F.col("y.member").alias("b"),
                F.col("x.component").alias("part_a"), F.col("y.component").alias("part_b"))
    )
    added = storage.materialize(_confirmed(more, texts, "part_a", "part_b"), "confirmed")
    parts = components(added.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
    found = joined.select("node", F.col("component").alias("part")).join(
        parts.select(F.col("node").alias("part"), F.col("component").alias("whole")), "part", "full"
    ).select(F.coalesce("node", "part").alias("node"), F.coalesce("whole", "part").alias("component"))

    reached = classes.join(found, F.col("first_id") == F.col("node"), "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "first_id").alias("component")
    )
    return (
        signed.select("doc_id", "n_shingles", "set_a", "set_b")
        .join(reached, ["set_a", "set_b", "n_shingles"], "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """*docs* with one document of each group: the smallest ``doc_id``; same columns."""
    dropped = duplicates(docs, id_col=id_col, text_col=text_col).filter("NOT kept").select(
        F.col("doc_id").alias("_dropped_id")
    ).distinct()
    return docs.join(dropped, F.col(id_col) == F.col("_dropped_id"), "left_anti")
