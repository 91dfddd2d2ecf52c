"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across:
the place between the two bytes is a certain cut.  A word is cut at all such
places, each fragment is encoded on its own, and the ids are concatenated; the
result is the encoding of the whole word.

Texts are taken many at a time: their words are found by character classes over
the joined texts, Arrow numbers the distinct ones, and the new ones among these are
merged together, one merge of every fragment a round.

Rows are independent, so the operator is one narrow pass over the texts: no
shuffle, and a lost executor only repeats its own partitions.  The vocabulary is
read once on the driver and broadcast; its size is that of the vocabulary file.

Defined results: a null text counts as empty and gives no ids and an empty
decoding; repeated rows give a row each; a null ``doc_id`` is carried along;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Rows handed back to Spark at a time; bounds the memory of a task.
SLICE_ROWS = 256
#: Bytes of an Arrow batch on its way to Python, but for a longer single row; bounds what a task has outside the heap.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Characters encoded at a time, but for a longer single text.
GROUP_CHARS = 1 << 20
#: New words merged together; bounds the table of their pairs.
LEARN_WORDS = 1 << 14
#: Words remembered by a task before its memory starts anew.
MEMO_WORDS = 400_000
#: Longest word, in bytes, that is remembered and merged together with others.
MEMO_BYTES = 64

#: Latin letters, digits, punctuation and plain spaces: here the word rule below
#: and lower-casing are the same in Python as in the tokenizers library.
_LATIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ſ–—‘-”…]")
_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+"
)
#: Class of each of these characters: white space, letter, digit, other.
_SPACE, _ONE_DIGIT, _OTHER = 0, 2, 3
_CLASS = np.array([
    _SPACE if c.isspace() else 1 if re.match(f"[{_LETTER}]", c) else _ONE_DIGIT if re.match(f"[{_DIGIT}]", c) else _OTHER
    for c in map(chr, range(ord("…") + 1))
], np.uint8)
#: Marks a special token among the words; no text in UTF-8 has this byte.
_MARK = b"\xff"
#: Rank of a pair that is never merged.
_NEVER = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder for a byte-level BPE with word ends (``word_bpe_49k.json``)."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        self._suffix = conf["model"]["end_of_word_suffix"]
        vocab = conf["model"]["vocab"]
        alphabet = byte_alphabet()
        self._byte_of = {c: b for b, c in enumerate(alphabet)}
        self._alphabet = str.maketrans({chr(b): c for b, c in enumerate(alphabet)})
        self._inner_pairs, self._end_pairs = self._pairs_inside(vocab)
        self._first_ids = np.array([[vocab.get(c + end, -1) for c in alphabet] for end in ("", self._suffix)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in conf["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self._ranks = np.argsort(keys, kind="stable").astype(np.int32)
        self._pairs = keys[self._ranks]
        self._merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        inner, end = self._first_ids
        self._byte_ranks = np.stack([self._rank(np.repeat(inner, 256), np.tile(right, 256)) for right in (inner, end)])
        self._library = Tokenizer.from_str(spec)
        bare = conf | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None}
        self._end_model = Tokenizer.from_str(json.dumps(bare))
        bare["model"] = conf["model"] | {"end_of_word_suffix": None}
        self._inner_model = Tokenizer.from_str(json.dumps(bare))
        self._special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self._special_split = re.compile("(" + "|".join(map(re.escape, self._special)) + ")")
        strings = {i: t for t, i in (vocab | self._special).items()}
        self._strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self._ids: dict[bytes, bytes] = {}

    # -- forced boundaries --------------------------------------------------

    def _pairs_inside(self, vocab) -> tuple[np.ndarray, np.ndarray]:
        """Tables of 256 x 256: byte pairs inside a token, and those that end a word."""
        inner, end = np.zeros(65536, bool), np.zeros(65536, bool)
        for token in vocab:
            ends = token.endswith(self._suffix) and len(token) > len(self._suffix)
            raw = [self._byte_of[c] for c in (token[: -len(self._suffix)] if ends else token)]
            pairs = [a * 256 + b for a, b in zip(raw, raw[1:])]
            if ends and pairs:
                end[pairs.pop()] = True
            inner[pairs] = True
        return inner, end

    def _stops(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ends of all fragments of the words from *starts* to *ends*, which lie side by side.

        With them all byte pairs, and the numbers of those that end a word.
        """
        pairs = data[:-1].astype(np.int32) * 256 + data[1:]
        cut = ~self._inner_pairs[pairs]
        last = ends[ends - starts > 1] - 2
        cut[last] = ~self._end_pairs[pairs[last]]
        cut[ends[:-1] - 1] = True
        return np.append(np.flatnonzero(cut) + 1, len(data)), pairs, last

    def fragments(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All words cut at every forced boundary.

        Gives the fragments in the byte alphabet, whether each ends its word, and
        the number of the first fragment of each word.
        """
        joined, starts, ends = _side_by_side([w.encode() for w in words])
        stops, _, _ = self._stops(np.frombuffer(joined, np.uint8), starts, ends)
        begins = np.concatenate([[0], stops[:-1]])
        shown = joined.decode("latin-1").translate(self._alphabet)
        pieces = [shown[a:b] for a, b in zip(begins.tolist(), stops.tolist())]
        ends_word = np.zeros(len(joined) + 1, bool)
        ends_word[ends] = True
        return pieces, ends_word[stops], np.searchsorted(begins, starts)

    # -- encoding -------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
        return np.where(self._pairs[at] == keys, self._ranks[at], _NEVER)

    def _learn_short(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Encode words together: a round makes the first merge of lowest rank in every fragment."""
        joined, starts, ends = _side_by_side(words)
        data = np.frombuffer(joined, np.uint8)
        stops, pairs, last = self._stops(data, starts, ends)
        begins = np.concatenate([[0], stops[:-1]])
        tokens = self._first_ids[0][data]
        tokens[ends - 1] = self._first_ids[1][data[ends - 1]]
        ranks = np.append(self._byte_ranks[0][pairs], _NEVER)
        ranks[last] = self._byte_ranks[1][pairs[last]]
        ranks[stops - 1] = _NEVER
        # Neighbours inside a fragment, -1 where there is none.
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[stops - 1] = before[begins] = -1
        sizes = stops - begins
        for low, high in ((1, 8), (8, MEMO_BYTES)):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            self._merge(tokens, ranks, after, before, begins[chosen], sizes[chosen])
        kept = tokens >= 0
        ids = tokens[kept].astype("<u4").tobytes()
        bounds = (np.concatenate([[0], np.cumsum(kept)[ends - 1]]) * 4).tolist()
        return {word: ids[a:b] for word, a, b in zip(words, bounds, bounds[1:])}

    def _merge(self, tokens, ranks, after, before, begins, sizes) -> None:
        """Merge the fragments from *begins* on; tokens that are merged into the one before become -1."""
        if not len(begins):
            return
        step = np.arange(int(sizes.max()))
        table = ranks[np.minimum(begins[:, None] + step, len(ranks) - 1)]
        table[step >= sizes[:, None]] = _NEVER
        rows = np.arange(len(begins))
        while True:
            places = table[rows].argmin(axis=1)
            best = table[rows, places]
            going = best != _NEVER
            if not going.all():
                rows, places, best = rows[going], places[going], best[going]
            if not len(rows):
                return
            at = begins[rows] + places
            gone = after[at]
            tokens[at], tokens[gone] = self._merged[best], -1
            table[rows, gone - begins[rows]] = _NEVER
            right = after[gone]
            after[at] = right
            more = right >= 0
            before[right[more]] = at[more]
            table[rows, places] = np.where(more, self._rank(tokens[at], tokens[right]), _NEVER)
            left = before[at]
            more = left >= 0
            row, at, left = rows[more], at[more], left[more]
            table[row, left - begins[row]] = self._rank(tokens[left], tokens[at])

    def _learn_long(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Encode words by the library: each distinct fragment on its own, then concatenate."""
        pieces, final, first = self.fragments([w.decode() for w in words])
        encoded = {}
        for ends, model in ((False, self._inner_model), (True, self._end_model)):
            distinct = list({p for p, f in zip(pieces, final.tolist()) if f is ends})
            if distinct:
                made = model.encode(distinct, is_pretokenized=True, add_special_tokens=False)
                ids = np.array(made.ids, "<u4").tobytes()
                stops = np.cumsum(np.bincount(made.word_ids, minlength=len(distinct))) * 4
                at = 0
                for piece, stop in zip(distinct, stops.tolist()):
                    encoded[piece, ends] = ids[at:stop]
                    at = stop
        parts = [encoded[key] for key in zip(pieces, final.tolist())]
        bounds = [*first.tolist(), len(parts)]
        return {word: b"".join(parts[a:b]) for word, a, b in zip(words, bounds, bounds[1:])}

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words; those that are not too long are remembered."""
        learned = {w: self._special[w[1:].decode()].to_bytes(4, "little") for w in words if w[0] == _MARK[0]}
        short = [w for w in words if len(w) <= MEMO_BYTES and w not in learned]
        long = [w for w in words if len(w) > MEMO_BYTES and w not in learned]
        for at in range(0, len(short), LEARN_WORDS):
            learned |= self._learn_short(short[at : at + LEARN_WORDS])
        self._ids |= learned
        return learned | self._learn_long(long) if long else learned

    def _split_words(self, text: str) -> list[str]:
        if not _LATIN.search(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            return _WORD.findall(text.lower())
        text = self._library.normalizer.normalize_str(text)
        byte_of = self._byte_of
        return [
            bytes(byte_of[c] for c in piece).decode()
            for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(text)
        ]

    def _listed_words(self, text: str) -> list[bytes]:
        """Words of any text; a special token is a word with `_MARK` in front."""
        words: list[bytes] = []
        for part in self._special_split.split(text) if "<|" in text else (text,):
            if part in self._special:
                words.append(_MARK + part.encode())
            else:
                words += (w.encode() for w in self._split_words(part))
        return words

    def _encode_words(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie side by side, and the number of ids before each word and of all."""
        array = pa.Array.from_buffers(
            pa.large_binary(), len(offsets) - 1,
            [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)],
        ).dictionary_encode()
        if len(self._ids) > MEMO_WORDS:
            self._ids.clear()
        words = array.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self._ids.get, words))
        new = [i for i, k in enumerate(known) if k is None]
        if new:
            learned = self._learn([words[i] for i in new])
            for i in new:
                known[i] = learned[words[i]]
        ids = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        codes = array.indices.to_numpy()
        ends = np.cumsum(sizes)
        counts = sizes[codes]
        before = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat((ends - sizes)[codes] - before[:-1], counts) + np.arange(before[-1])
        return ids[places], before

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        latin = [i for i, t in enumerate(texts) if "<|" not in t and not _LATIN.search(t)]
        data, offsets, bounds = latin_words([texts[i] for i in latin])
        rest = sorted(set(range(len(texts))).difference(latin))
        if rest:
            listed = [self._listed_words(texts[i]) for i in rest]
            words = [w for own in listed for w in own]
            offsets = np.append(offsets[:-1], offsets[-1] + np.cumsum([0, *map(len, words)]))
            bounds = np.append(bounds[:-1], bounds[-1] + np.cumsum([0, *map(len, listed)]))
            data += b"".join(words)
        ids, before = self._encode_words(data, offsets)
        places = before[bounds].tolist()
        out = [b""] * len(texts)
        for i, a, b in zip(latin + rest, places, places[1:]):
            out[i] = ids[a:b].tobytes()
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[str] = []
        chars = 0
        for text in texts:
            text = text or ""
            if group and chars + len(text) > GROUP_CHARS:
                out += self._encode_group(group)
                group, chars = [], 0
            group.append(text)
            chars += len(text)
        return out + self._encode_group(group) if group else out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    # -- decoding ----------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """Tokens of *ids* joined by spaces, as a vocabulary without decoder has it.

        Ids outside the vocabulary are left out.
        """
        strings = self._strings
        numbers = memoryview(ids).cast("I").tolist()
        try:
            return " ".join(map(strings.__getitem__, numbers))
        except IndexError:
            return " ".join(strings[i] for i in numbers if i < len(strings))


def _side_by_side(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words put one after the other, and where each starts and ends."""
    ends = np.cumsum([len(w) for w in words])
    return b"".join(words), np.concatenate([[0], ends[:-1]]), ends


def latin_words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words of texts without other characters than those of `_LATIN`, by the rule of `_WORD`.

    Gives the words side by side in UTF-8, where each starts, then their length,
    and the number of words before each text, then of all.
    """
    joined = "\n".join([*texts, ""])
    if joined.isascii():
        raw = joined.lower().encode()
        chars = np.frombuffer(raw, np.uint8)
        kind = np.frombuffer(raw.translate(_CLASS[:256].tobytes()), np.uint8)
    else:
        # These characters are the same in normal form C.
        chars = np.frombuffer(joined.lower().encode("utf-32-le"), "<u4")
        kind = _CLASS[chars]
    inside = kind != _SPACE
    first = inside.copy()
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _ONE_DIGIT)
    # An apostrophe that starts a word takes these letters with it; every text ends with a space.
    quotes = np.flatnonzero((chars == ord("'")) & first)
    one, two = chars[quotes + 1], chars[np.minimum(quotes + 2, len(chars) - 1)]
    for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
        taken = one == ord(ending[0])
        if len(ending) > 1:
            taken &= two == ord(ending[1])
        at = quotes[taken]
        first[at + 1] = False
        first[at + 1 + len(ending)] = inside[at + 1 + len(ending)]
    kept = chars[inside]
    starts = np.append(np.flatnonzero(first[inside]), len(kept))
    if kept.itemsize == 1:
        data = kept.tobytes()
    else:
        data = kept.tobytes().decode("utf-32-le").encode()
        widths = 1 + (kept >= 0x80) + (kept >= 0x800)
        starts = np.concatenate([[0], np.cumsum(widths)])[starts]
    lengths = np.array([0, *(len(t) + 1 for t in texts)])
    return data, starts, np.searchsorted(np.flatnonzero(first), np.cumsum(lengths))


@lru_cache(maxsize=2)
def _codec(spec: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(spec)


def read_spec(path: str) -> str:
    """Content of a vocabulary file; read on the driver, then broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def map_texts(rows: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over rows with whole texts, in batches of at most *BATCH_BYTES*.

    Spark's own bounds are 10,000 rows and 64 MB, and a batch is held several times
    outside the heap while it is filled, sent and read.  Spark takes the bound from
    the session when the result is computed, so it is left there; a smaller one stays.
    """
    spark = rows.sparkSession
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if as_bytes(spark.conf.get(_BATCH_CONF)) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, decoded: bool = False, *,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit) of every text.

    With *decoded* the ids are also decoded again, into column ``decoded``.
    *vocabulary* is the path of the vocabulary file.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(vocabulary))
    id_type = docs.schema[id_col].dataType

    def run(batches):
        codec = _codec(spec.value)
        for batch in slices(batches):
            ids = codec.encode_all(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            names = ["doc_id", "ids"]
            if decoded:
                columns.append(pa.array([codec.decode(i) for i in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {id_type.simpleString()}, ids binary" + ", decoded string" * decoded
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` and ``decoded`` from the output of `encode`; null ids decode to null."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    id_type = encoded.schema["doc_id"].dataType

    def run(batches):
        codec = _codec(spec.value)
        for batch in slices(batches):
            text = [None if i is None else codec.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text, pa.string())], names=["doc_id", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {id_type.simpleString()}, decoded string"
    )
