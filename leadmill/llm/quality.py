"""Quality rules with cross-document line frequency, in DataFrame functions only.

The lines of a text are normalised (lower case, single spaces) and hashed.  For
every host the distinct documents that hold a line are counted; a line above the
limit is boilerplate of that host and is removed; a document that loses too much
of its words is rejected, as are documents that fail the base rules.

Copies with the same text count as one document, so a document is not
boilerplate of its own copies.  What is shuffled is one narrow row per line
(hashes and a word count), first spread by document and line, then summed before
the exchange by line; texts stay where they are.  Verdicts are found per text
and joined back on its hash; a text with very many copies is an ordinary skewed
join key, which adaptive execution splits.

Defined results: a null text has no words and fails the base rules; a null host
counts as the empty host; repeated rows get the same verdict each; a null
``doc_id`` is carried along; other columns are not read, and ``clean`` keeps them as
they are; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import bind

SPACE = "[ \\t-\\r]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"

#: Base rules: fewest words, and the most words in percent that repeated windows may cover.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is above the limit in more than so many documents of a host, however large it is ...
MAX_LINE_DOCS = 20
#: ... or in more than this percentage of them, for small hosts, and at least in so many.
MAX_LINE_PERCENT = 5
MIN_LINE_DOCS = 3
#: A document is depleted when more than this percentage of its words is removed.
MAX_REMOVED_PERCENT = 50


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return bind(
        trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))
    )


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more in the text."""

    def windows(w):
        return F.when(
            F.size(w) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    def starts(ordered):
        """Places of repeated windows; equal windows are neighbours in *ordered*."""

        def twin(k, other):
            return F.coalesce(F.get(ordered, k)["h"] == F.get(ordered, other)["h"], F.lit(False))

        kept = F.filter(
            F.transform(
                F.sequence(F.lit(0), F.size(ordered) - 1),
                lambda k: F.when(
                    twin(k, k + 1) | ((k > 0) & twin(k, F.greatest(k - 1, F.lit(0)))), F.get(ordered, k)["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.sort_array(kept)

    def covered(places):
        steps = F.transform(
            places,
            lambda p, k: F.when(k == 0, 3).otherwise(
                F.least(F.lit(3), p - F.get(places, F.greatest(k - 1, F.lit(0))))
            ),
        )
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    def count(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            bind(bind(ordered, starts), covered)
        )

    return bind(bind(words, windows), count)


def base_features(docs: DataFrame, *, text_col: str = "text") -> list[Column]:
    """Columns of the base rules: counts over a whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = words_of(F.col(text_col))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    counted = bind(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    return [
        counted.alias("_counted"),
        (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
        bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    ]


def _host(source_col: str) -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit(""))


def _content(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def line_key(words: Column) -> Column:
    """Hash of a normalised line."""
    return F.xxhash64(F.array_join(words, " "))


def line_removals(docs: DataFrame, *, text_col: str = "text", source_col: str = "source",
                  max_line_docs: int = MAX_LINE_DOCS, max_line_percent: int = MAX_LINE_PERCENT,
                  min_line_docs: int = MIN_LINE_DOCS) -> DataFrame:
    """``host, content, removed_words, removed_lines`` of every text that loses a line.

    *content* is the hash of the text and *removed_lines* holds line hashes.
    """
    lines = F.transform(
        F.split(F.lower(F.col(text_col)), "\n", -1),
        lambda line: bind(
            words_of(line), lambda w: F.struct(line_key(w).alias("line"), F.size(w).alias("words"))
        ),
    )
    rows = docs.select(
        _host(source_col).alias("host"), _content(text_col).alias("content"),
        F.posexplode(F.filter(lines, lambda s: s["words"] > 0)).alias("place", "at"),
    )
    # Copies of a text say the same; after this a text has each of its lines once.
    once = rows.groupBy("host", "content", "place").agg(
        F.first("at.line").alias("line"), F.first("at.words").alias("words")
    )
    held = once.groupBy("host", "line").agg(F.count_distinct("content").alias("line_docs"))
    hosts = docs.select(_host(source_col).alias("host"), _content(text_col).alias("content")).groupBy(
        "host"
    ).agg(F.count_distinct("content").alias("host_docs"))
    share = F.col("line_docs") * 100 > F.col("host_docs") * max_line_percent
    above = (
        held.filter(F.col("line_docs") >= min(min_line_docs, max_line_docs + 1))
        .join(hosts, "host")
        .filter((F.col("line_docs") > max_line_docs) | (share & (F.col("line_docs") >= min_line_docs)))
        .select("host", "line")
    )
    return (
        once.join(above, ["host", "line"])
        .groupBy("host", "content")
        .agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    )


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          max_line_docs: int = MAX_LINE_DOCS, max_line_percent: int = MAX_LINE_PERCENT,
          min_line_docs: int = MIN_LINE_DOCS,
          max_removed_percent: int = MAX_REMOVED_PERCENT) -> DataFrame:
    """Counts and verdict of every document, one row per row of *docs*.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    removed_words, base_failed, kept``.
    """
    features = docs.select(
        F.col(id_col).alias("doc_id"), _host(source_col).alias("host"), _content(text_col).alias("content"),
        *base_features(docs, text_col=text_col),
    )
    lost = line_removals(
        docs, text_col=text_col, source_col=source_col,
        max_line_docs=max_line_docs, max_line_percent=max_line_percent, min_line_docs=min_line_docs,
    ).select("host", "content", "removed_words")
    return (
        features.join(lost, ["host", "content"], "left")
        .select("doc_id", "_counted.*", "n_symbols", "n_dup_lines",
                F.coalesce("removed_words", F.lit(0).cast("long")).alias("removed_words"))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "removed_words", base_failed().alias("base_failed"),
        )
        .withColumn("kept", ~F.col("base_failed") & ~depleted(max_removed_percent))
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )


def depleted(max_removed_percent: int) -> Column:
    return F.col("removed_words") * 100 > F.col("n_words") * max_removed_percent


def clean(docs: DataFrame, *, text_col: str = "text", source_col: str = "source",
          max_line_docs: int = MAX_LINE_DOCS, max_line_percent: int = MAX_LINE_PERCENT,
          min_line_docs: int = MIN_LINE_DOCS,
          max_removed_percent: int = MAX_REMOVED_PERCENT) -> DataFrame:
    """The documents that pass, without the lines above the limit; same columns."""
    lost = line_removals(
        docs, text_col=text_col, source_col=source_col,
        max_line_docs=max_line_docs, max_line_percent=max_line_percent, min_line_docs=min_line_docs,
    ).select(
        F.col("host").alias("_q_host"), F.col("content").alias("_q_content"),
        F.col("removed_words").alias("_q_removed"), F.col("removed_lines").alias("_q_lines"),
    )
    counted = base_features(docs, text_col=text_col)[0].alias("_q_counted")
    failed = (F.col("_q_counted.n_words") < MIN_WORDS) | (
        F.col("_q_counted.n_repeat_words") * 100 > F.col("_q_counted.n_words") * MAX_REPEAT_PERCENT
    )
    passed = docs.select("*", counted, _host(source_col).alias("_q_host"), _content(text_col).alias("_q_content"))
    passed = passed.filter(~failed)
    joined = passed.join(lost, ["_q_host", "_q_content"], "left").filter(
        F.coalesce(F.col("_q_removed") * 100 <= F.col("_q_counted.n_words") * max_removed_percent, F.lit(True))
    )
    kept_lines = F.array_join(
        F.filter(
            F.split(F.col(text_col), "\n", -1),
            lambda x: ~F.array_contains("_q_lines", line_key(words_of(F.lower(x)))),
        ),
        "\n",
    )
    text = F.when(F.col("_q_lines").isNull(), F.col(text_col)).otherwise(kept_lines)
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))
