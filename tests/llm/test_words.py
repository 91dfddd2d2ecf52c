"""Spelling variants, phrases and exact search against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures
from leadmill.llm import collocations, spelling, topk

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# -- spelling variants ---------------------------------------------------------


def words_of(doc_id, text):
    found = collections.Counter()
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = run.translate(LOWER)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        if h % 31 == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(words):
    rows = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        form = min(near, key=lambda x: (-words[x], x), default=None)
        if form is not None and words[form] < 10 * n:
            form = None
        rows[w] = [form, w, n, len(near), words[form] if form else None]
    for w, row in rows.items():
        while rows[row[1]][0]:
            row[1] = rows[row[1]][0]
    return {w: tuple(r) for w, r in rows.items()}


def got_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def vocabulary_rows():
    """Dense words over few letters, many with common beginnings and ends, and chains of forms."""
    rng, words = random.Random(5), {}
    for _ in range(260):
        words["".join(rng.choice("abé") for _ in range(rng.randint(7, 9)))] = rng.choice((2, 3, 30, 400))
    for tail in range(60):
        words["common" + "".join(rng.choice("xyzuvw") for _ in range(rng.randint(1, 5)))] = rng.choice((2, 25, 300))
        words["".join(rng.choice("xyzuvw") for _ in range(rng.randint(1, 5))) + "ending"] = 2 + tail
    words |= {"chained": 2, "chainee": 20, "chaiiee": 200, "chaiiff": 5, "aaaaaaa": 9, "aaaaaaaa": 90}
    return words


@pytest.mark.parametrize("list_most", [1, 4, 16])
def test_spelling_variants(spark, list_most):
    words = vocabulary_rows()
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got_variants(spelling.variants(df, list_most=list_most)) == variants_of(words)


def test_spelling_vocabulary(spark):
    rows = fixtures.corpus(40) + [
        (900, "Straßenbahn ÉTUDIANTE ×÷multiply " * 3, "x", "s", 0), (901, "a" * 300_000, "x", "s", 0),
        (901, "a" * 300_000, "x", "s", 0), (None, "withoutid withoutid", "x", "s", 0),
    ]
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        want.update(words_of(doc_id, text))
    df = fixtures.clashing(fixtures.frame(spark, rows)).withColumn("word", F.lit(1)).withColumn("n", F.lit(1))
    got = {r.word: r.n for r in spelling.vocabulary(df).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}
    assert got_variants(spelling.variants(spelling.vocabulary(df))) == variants_of(got)


def test_spelling_of_nothing(spark):
    assert spelling.variants(spelling.vocabulary(fixtures.frame(spark, []))).collect() == []
    assert spelling.variants(spelling.vocabulary(fixtures.frame(spark, [(1, None, "x", "s", 0), (2, "", "x", "s", 0)]))).collect() == []


# -- phrases -------------------------------------------------------------------


def phrases_of(rows, least, percent, top):
    f, totals = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    long = {key: n for key, n in f.items() if len(key[1]) > 1 and n >= least}
    out = collections.defaultdict(list)
    for (lang, words), a in long.items():
        holders = (n for (other, more), n in long.items() if other == lang and len(more) > len(words)
                   and any(more[i : i + len(words)] == words for i in range(len(more) - len(words) + 1)))
        if any(100 * n >= percent * a for n in holders):
            continue
        cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, found in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    }


def phrase_rows():
    rng, rows = random.Random(11), []
    words = ["the", "of", "Ünder", "new", "york", "times", "x" * 70, "y" * 70, "a-b", "in"]
    for i in range(120):
        text = " ".join(rng.choice(words[: 3 + i % 8]) + rng.choice(("", "", "", ".", ",", "\n", "\t")) for _ in range(60))
        rows.append((i, text, rng.choice(("en", "de", None)), "s", 0))
    rows += [(500, "new york times reads well\x0b" * 50, "en", "s", 0)] * 2
    return rows + [(501, None, "en", "s", 0), (502, "", None, "s", 0), (503, "...", "fr", "s", 0)]


@pytest.mark.parametrize("most, chunk", [(300_000, 1 << 20), (50, 400)])
def test_phrases(spark, monkeypatch, most, chunk):
    rows = phrase_rows()
    monkeypatch.setattr(collocations, "MOST_ENTRIES", most)
    df = fixtures.clashing(fixtures.frame(spark, rows)).withColumn("w", F.lit(1)).withColumn("n", F.lit(1))
    got = collocations.phrases(df, least_count=12, absorbed_percent=80, top=25)
    want = phrases_of(rows, 12, 80, 25)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == want
    assert {r[0] for r in want} == {"en", "de", "und"}


def test_phrases_of_nothing(spark):
    assert collocations.phrases(fixtures.frame(spark, [])).collect() == []
    assert collocations.phrases(fixtures.frame(spark, [(1, None, None, "s", 0), (2, "one two", "en", "s", 0)])).collect() == []


def test_trie_bursts_and_spills():
    rng = np.random.default_rng(1)
    windows = rng.integers(1, 6, (4000, 4)).astype(np.uint64)
    trie, runs = collocations.HatTrie(burst=8, most=100), []
    for part in np.array_split(windows, 40):
        part = np.unique(part, axis=0, return_counts=True)
        trie.add(*part)
        if trie.full():
            runs.append(trie.spill(50))
    runs.append(trie.spill(0))
    total = collections.Counter()
    for rows, counts in (r for r in runs if r):
        assert rows.tolist() == sorted(rows.tolist())
        for row, n in zip(rows.tolist(), counts.tolist()):
            total[tuple(row)] += n
    parts = [np.unique(p, axis=0, return_counts=True) for p in np.array_split(windows, 40)]
    want = collections.Counter()
    for rows, counts in parts:
        want.update(dict(zip(map(tuple, rows.tolist()), counts.tolist())))
    assert total == want and trie.spill(0) is None


def test_word_ids_of_a_seed_differ():
    ids = [collocations.Words(["en"], ["one two " + "z" * 90], seed).ids.tolist() for seed in (0, 1)]
    assert not set(ids[0]) & set(ids[1]) and len(set(ids[0])) == 3
    assert collocations.Words(["de"], ["one"], 0).ids[0] != ids[0][0]


# -- exact search --------------------------------------------------------------


def usable(rows):
    kept = {}
    for vec_id, v in rows:
        if vec_id is None or not v or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        v = tuple(math.floor(256 * x) for x in v)
        kept[vec_id] = min(kept.get(vec_id, v), v)
    sizes = collections.Counter(map(len, kept.values()))
    width = max(sizes, key=lambda n: (sizes[n], n), default=0)
    return {i: v for i, v in kept.items() if len(v) == width}


def nearest(rows, every, k):
    kept, out = usable(rows), set()
    for q in (i for i in kept if i % every == 0):
        scores = [(-min(max(sum(a * b for a, b in zip(kept[q], v)), -(2**63)), 2**63 - 1), i) for i, v in kept.items() if i != q]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def vector_rows(n=400, dim=6, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, list(rows[7][1])) for i in range(60)]  # a hot vector
    rows += [(600 + i, [0.0] * dim) for i in range(12)]
    rows += [(700, None), (701, [1.0] * (dim + 1)), (702, [None] * dim), (703, [math.nan] * dim),
             (704, [math.inf] * dim), (None, [1.0] * dim), (705, [1e307] * dim), (3, [2.0] * dim), (3, [-2.0] * dim)]
    return rows


def found(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.select("*", *(F.lit(1).alias(c) for c in ("q", "v", "norm", "strip", "ids", "score", "rank")))
    got = topk.search(df, F.col("vec_id") % 10 == 0, **kwargs).select("query_id", "rank", "vec_id", "score").collect()
    return {tuple(r) for r in got}


@pytest.mark.parametrize("sizes", [{}, {"head_rows": 3, "strip_rows": 40, "group_rows": 7}])
def test_exact_search(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rows = vector_rows()
    assert found(spark, rows, k=5, **sizes) == nearest(rows, 10, 5)


def test_exact_search_beyond_doubles(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice((1e9, -1e9, 3e8, 1.0)) + rng.random() for _ in range(4)]) for i in range(60)]
    assert found(spark, rows, k=4, strip_rows=20) == nearest(rows, 10, 4)
    rows = [(i, [rng.choice((1e200, -1e200, 1e-9)) for _ in range(4)]) for i in range(40)]
    assert found(spark, rows, k=4) == nearest(rows, 10, 4)


def test_exact_search_of_few(spark):
    assert found(spark, [], k=5) == set()
    assert found(spark, [(0, [1.0, 2.0])], k=5) == set()
    assert found(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.0])], k=5) == {(0, 1, 1, 256 * 128)}
    assert found(spark, [(0, []), (10, []), (2, [])], k=1) == set()


def test_bounds_leave_entries_unscored(spark, monkeypatch):
    rng = np.random.default_rng(4)
    entries = np.floor(rng.normal(size=(4000, 16)) * np.geomspace(4, 0.05, 16) * 256)
    scored = []
    whole = topk.products
    monkeypatch.setattr(topk, "products", lambda q, e, at, of: scored.append(len(at)) or whole(q, e, at, of))
    rotation = np.linalg.svd(entries.T @ entries)[0]
    queries, ids = entries[:20], np.arange(20)
    rows = topk.scan(queries, np.full(20, -np.inf), ids, entries, [np.array([i]) for i in range(4000)], rotation, 5)
    assert sum(scored) < 0.5 * 20 * 4000
    exact = (queries @ entries.T).astype(np.int64)
    for q in range(20):
        want = sorted((-exact[q, i], i) for i in range(4000) if i != q)[:5]
        assert sorted((-s, i) for at, s, i in rows.tolist() if at == q)[:5] == want
