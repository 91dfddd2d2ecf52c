"""Operators that look at one text at a time."""

import hashlib
import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import fixtures
from leadmill.llm import bpe, packing, pii, queries, secrets

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.ForcedBoundaryBPE(bpe.read_spec(PATH))


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "É", "ß", "İ", "Σ", "中", "<|endoftext|>", " ", "\n", "\xa0", "\x85", "'s", "12", "½",
                                  "qx", "zx", "!?", "ŉ", "é", "‍", "😀"]) | st.characters(exclude_categories=("Cs",)), max_size=20))
def test_bpe_is_the_library(parts):
    text = "".join(parts)
    ids = library_ids(text)
    assert CODEC.encode(text) == packed(ids)
    assert CODEC.decode(packed(ids)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_forced_boundaries_cut_where_no_token_joins():
    pieces, final, first = CODEC.fragments(["anqxzthe", "a"])
    assert pieces == ["anq", "x", "zthe", "a"] and final.tolist() == [False, False, True, True]
    assert first.tolist() == [0, 3]


def test_bpe_long_word_and_memo_restart(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    text = "ab" * 5000 + " " + "x" * 3000
    for t in (text, "one two three four five", text):
        assert CODEC.encode(t) == packed(library_ids(t))


_LATIN_PARTS = ["'", "s", "t", "re", "ve", "m", "ll", "d", "'Re", "word", "É", "ß", "ŉ", "½", "7", "2024", " ", "\n", "\t", "!?", "…", "“x”", "–"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_LATIN_PARTS), max_size=12), max_size=5))
def test_bpe_latin_words_are_those_of_the_pattern(parts):
    texts = ["".join(p) for p in parts]
    data, offsets, bounds = bpe.latin_words(texts)
    words = [data[a:b].decode() for a, b in zip(offsets, offsets[1:])]
    assert [words[a:b] for a, b in zip(bounds, bounds[1:])] == [bpe._WORD.findall(t.lower()) for t in texts]


@pytest.mark.parametrize("group_chars, learn_words", [(1, 1), (200, 3), (1 << 20, 1 << 14)])
def test_bpe_many_texts_at_once_keep_their_order(monkeypatch, group_chars, learn_words):
    monkeypatch.setattr(bpe, "GROUP_CHARS", group_chars)
    monkeypatch.setattr(bpe, "LEARN_WORDS", learn_words)
    texts = ["plain words, they're 12", None, "中文 words", "a<|endoftext|>b<|x|>", "", "Élan ŉ…", "z" * 64 + " " + "z" * 65 + " Łódź",
             "<|startoftext|>", "\x0b\x1cctl", "anqxzthe qx zx", "'s''s 'sam I'LL've", "ab" * 500, "endoftext <|endoftext"] * 2
    codec = bpe.ForcedBoundaryBPE(bpe.read_spec(PATH))
    assert codec.encode_all(texts) == [packed(library_ids(t)) for t in texts]
    assert codec.encode_all(texts[::-1]) == [packed(library_ids(t)) for t in texts[::-1]]
    assert codec.encode_all([]) == [] and codec.encode_all([None]) == [b""]


def test_bpe_new_words_are_merged_together_without_the_library():
    """A library call, with its offsets and strings, took most of the time of a new word."""
    codec = bpe.ForcedBoundaryBPE(bpe.read_spec(PATH))
    texts = [" ".join(f"{a}{b}{c}ou{a}n" for b in "bdfgklmnprst" for c in ("an", "ith", "é", "qx")) for a in ("st", "w", "tr", "ba")]
    want = [packed(library_ids(t)) for t in texts]
    codec._inner_model = codec._end_model = codec._library = None
    assert codec.encode_all(texts) == want
    # Two look-ups a round for each class of lengths, however many words there are.
    codec._ids.clear()
    rounds, rank = [], codec._rank
    codec._rank = lambda left, right: rounds.append(len(left)) or rank(left, right)
    assert codec.encode_all(texts) == want and 0 < len(rounds) <= 4 * 16
    rounds.clear()
    assert codec.encode_all(texts) == want and not rounds


def test_bpe_table(spark):
    rows = fixtures.corpus() + [(3, "again", "en", "s", 5), (None, "no id", None, None, None)]
    df = bpe.encode(fixtures.clashing(fixtures.frame(spark, rows)), PATH, decoded=True)
    got = sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in df.collect())
    want = [(str(i), packed(library_ids(t)), LIBRARY.decode(library_ids(t), skip_special_tokens=False)) for i, t, *_ in rows]
    assert got == sorted(want)
    back = {r.doc_id: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert all(back[r.doc_id] == r.decoded for r in df.collect() if r.doc_id not in (3, None))
    assert bpe.encode(fixtures.frame(spark, []), PATH).count() == 0


def test_bpe_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op1_bpe_round_trip"](spark, sf_dir).collect():
        ids = library_ids(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_pieces(pieces, texts, capacity):
    """Every id in exactly one piece; sequences gapless and within the capacity."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = library_ids(texts[doc]) + [2]
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        for p in own:
            assert p.ids_crc32 == zlib.crc32(packed(ids[p.start : p.start + p.length]))
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert sum(p.length for p in own) <= capacity
    return by_sequence


def test_packing_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = queries.QUERIES["op10_packing"](spark, sf_dir).collect()
    windows = check_pieces(pieces, docs, 4096)
    # At most one padded window a task.
    tasks = {s >> 33 for s in windows}
    padded = [s for s, own in windows.items() if sum(p.length for p in own) < 4096]
    assert len(padded) <= len(tasks)


@pytest.mark.parametrize("max_open", [2, 1000])
def test_packing_small_windows(spark, max_open):
    rows = fixtures.corpus()
    df = packing.pack(fixtures.clashing(fixtures.frame(spark, rows)).coalesce(1), PATH, capacity=64, max_open=max_open)
    pieces = df.withColumn("ids_crc32", F.crc32("ids")).collect()
    windows = check_pieces(pieces, {i: t for i, t, *_ in rows}, 64)
    assert sum(sum(p.length for p in w) < 64 for w in windows.values()) <= 1
    assert packing.pack(fixtures.frame(spark, []), PATH).count() == 0


def test_packing_levels_minimise_squares():
    levels = packing.LevelArray(10)
    counts = [0] * 11
    for size in (3, 3, 4, 7, 2, 6, 5, 5, 1, 9):
        def squares(level):
            after = list(counts)
            if level:
                after[level] -= 1
            after[level + size] += 1
            return sum(n * n for n in after[1:10])

        choices = [h for h in range(0, 11 - size) if not h or counts[h]]
        chosen = levels.best(size)
        assert chosen in choices and squares(chosen) == min(map(squares, choices))
        for level, change in ((chosen, -1), (chosen + size, 1)):
            levels.add(level, change)
            if level:
                counts[level] += change


SECRETS = [
    ('KEY = "abc123XYZ9"\npassword = KEY', "abc123XYZ9"),
    ('{"db_password": "hunter2hunter2!"}', "hunter2hunter2!"),
    ('set_password("S3cr3t!!x1")', "S3cr3t!!x1"),
    ("--token  abc123def4", "abc123def4"),
    ("<secret>zz91aa88</secret>", "zz91aa88"),
    ('a = "q1w2e3r4"\nb = a + "t5y6u7i8"\nclient_secret := b', "q1w2e3r4"),
    ("x.auth_token = self.K\nself.K = 'f00ba4ba5'", "f00ba4ba5"),
]


@pytest.mark.parametrize("text,literal", SECRETS)
def test_secrets_follow_names(text, literal):
    named = [text[s.start : s.end] for s in secrets.find_spans(text) if s.kind == "named"]
    assert literal in named


@pytest.mark.parametrize("text", [None, "", "token: the", "the secret of a key is out", 'password = "${DB}"', 'colour = "abc123XYZ9"'])
def test_secrets_leave_clean_texts(text):
    assert not [s for s in secrets.find_spans(text) if s.kind == "named"]


def test_secrets_base_spans():
    text = "API_KEY: abcdefgh AKIA" + "A" * 12 + " passwd=short " + "0f" * 16 + " " + "a" * 31
    got = [(s.kind, text[s.start : s.end]) for s in secrets.find_spans(text) if s.kind != "named"]
    assert got == [("assign", "API_KEY: abcdefgh"), ("access", "AKIA" + "A" * 12), ("hex", "0f" * 16)]
    assert not secrets.base_spans("paſsword=abcdefghij")  # letters of the pattern in ASCII only


def test_secrets_long_texts_take_linear_time():
    for text in ("passworda" * 50_000, 'token = "' * 20_000, "key " * 50_000, "a=b;" * 50_000 + "token=a"):
        secrets.find_spans(text)


def test_secrets_tables(spark):
    rows = fixtures.corpus() + [(3, "token=abcdefghi1 x", "en", None, 0)] * 2
    df = fixtures.clashing(fixtures.frame(spark, rows))
    assert secrets.scan(df).count() == len(rows)
    masked = secrets.redact(df)
    assert masked.columns == df.columns
    assert [r.text for r in masked.filter("doc_id = 3 and text like '%x'").collect()] == ["[secret] x"] * 2
    assert masked.filter("text is null").count() == 1
    assert secrets.scan(fixtures.frame(spark, [])).count() == 0


def test_pii(spark):
    texts = ["mail bosbt.42@mail8.example.com now", "call +1 (988) 555-2485.", "(212) 555-0199 x", "4111 1111 1111 1111, 4111111111111111; 4111111111111112",
             "2021-02-28 and 28.02.2021 and 02/28/2021, bad 2021-02-30", "ip 42.144.35.254. v1.2.3.4.5", "123-45-6789 and 666-12-1234",
             "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", None, "", "plain", "12" * 5000, "a" * 5000 + "@"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(0, texts[0], None, None, None)]
    made = pii.pseudonymise(fixtures.clashing(fixtures.frame(spark, rows)), "k").collect()
    assert len(made) == len(rows)
    new = {r.doc_id: r.text for r in made}
    counts = {r.doc_id: {k: v for k, v in r.counts.asDict().items() if v} for r in made}
    assert [counts[i] for i in range(13)] == [{"email": 1}, {"phone": 1}, {"phone": 1}, {"card": 2}, {"date": 3}, {"ip": 1}, {"ssn": 1}, {"iban": 2}, {}, {}, {}, {}, {}]
    assert [new[i] for i in (8, 9, 10, 11, 12)] == [texts[i] for i in (8, 9, 10, 11, 12)]
    spaced, plain, bad = new[3].replace(";", ",").split(", ")
    assert spaced.replace(" ", "") == plain != "4111111111111111" and bad == "4111111111111112"
    for i in (0, 1, 2, 3, 5, 6, 7):
        assert new[i] != texts[i] and len(new[i]) == (len(texts[i]) if i != 5 else len(new[i]))
    # What validated still does, so a second pass replaces as much.
    again = pii.pseudonymise(spark.createDataFrame([(i, new[i]) for i in range(8)], "doc_id long, text string"), "k").collect()
    assert all({k: v for k, v in r.counts.asDict().items() if v} == counts[r.doc_id] for r in again)
    assert pii.pseudonymise(fixtures.frame(spark, []), "k").count() == 0


def test_pii_is_a_permutation(spark):
    names = pii.Pseudonyms("k")
    ssn = spark.range(3000).select(names.number("t", F.lpad(F.col("id").cast("string"), 5, "0")).alias("n"))
    assert ssn.distinct().count() == 3000
    days = spark.range(5000).select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    moved = days.select(names.date(F.col("d")).alias("n"))
    assert moved.filter("n is null").count() == 0 and moved.distinct().count() == 5000
