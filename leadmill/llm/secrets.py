"""Secret scans by assignment-aware lexing.

Texts are read as source and configuration: assignments, mappings, options and
elements become pairs of a name and a value; a value is a chain of literals and
names; names are followed to the literals that they were given (constant
propagation).  A literal is reported when the name it ends up under is sensitive
and the literal looks like key material.  Three fixed patterns are reported
besides: ``assign``, ``access`` and ``hex``; what the lexer adds is ``named``.

Rows are independent: one narrow pass, no shuffle.  All patterns start only at
the start of a name or run, so the time is linear in the text.

Defined results: a null text counts as empty and has no spans; repeated rows
give a row each; a null ``doc_id`` is carried along; other columns are not read
by `scan` and are kept by `redact`; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.bpe import slices

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "named")

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_CHARS)  # runs are maximal, so the same matches

#: Words of a target name and how sensitive they make it.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.7,
    "secret": 1.0, "token": 0.9, "apikey": 0.9, "credential": 0.8, "credentials": 0.8, "auth": 0.6,
}
#: Pairs of words that are sensitive together.
NAME_PAIRS = {("api", "key"): 0.9, ("access", "key"): 0.9, ("private", "key"): 0.9, ("signing", "key"): 0.9}
#: Values that stand for a secret that is kept elsewhere.
PLACEHOLDER = re.compile(
    r"(?i)^(?:change_?me|example|none|null|true|false|redacted|your[_-].*|x+|\*+|<.*>|\$\{.*\}|%.*%|\{\{.*\}\})$"
)
MIN_SCORE = 0.5
MIN_LITERAL = 6

# Without one of these no name can be sensitive, and the lexer has nothing to add.
_STEM = re.compile(r"pass|pwd|secret|token|key|credential|auth", re.IGNORECASE)
_TARGET = re.compile(
    r"""(?<![\w$.\-])(?P<quote>["']?)(?P<name>[A-Za-z_$][\w$.\-]{0,127})(?P=quote)[ \t]*"""
    r"""(?:(?::[ \t]*[A-Za-z_]\w{0,31}[ \t]*)?(?::=|=>|[:=](?![=:]))[ \t]*|\([ \t]*(?=["'`])|(?<=[\w"'])[ \t](?=["'`]))"""
)
_OPTION = re.compile(r"(?<!\S)--(?P<name>[A-Za-z][\w\-]{0,127})[ \t]+(?P<value>[^\s\"'\-][^\s\"']*)")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]{0,127})>(?P<value>[^<\n]+)</(?P=name)>")
_STRING = re.compile(r'''"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`''')
_REFERENCE = re.compile(r"[A-Za-z_$][\w$.]*(?![\w$.\-/+=@:])")
_BARE = re.compile(r"""[^\s,;"'`#<>()\[\]{}]+""")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.?)?[ \t]*(?=[\"'`A-Za-z_$])")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    name: str | None = None
    score: float | None = None


class _Literal(NamedTuple):
    start: int
    end: int
    quoted: bool


def base_spans(text: str) -> list[Span]:
    found = [
        Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS
    ]
    if "AKIA" in text:
        found += [
            Span("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS
        ]
    return found + [Span("hex", *m.span()) for m in _LONG_HEX.finditer(text)]


def name_score(name: str) -> float:
    """How sensitive a target name is, from its words."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    single = max((NAME_WEIGHTS.get(p, 0.0) for p in parts), default=0.0)
    return max([single, *(NAME_PAIRS.get(p, 0.0) for p in zip(parts, parts[1:]))])


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like key material: length, entropy, mixed characters."""
    n = len(value)
    if n < MIN_LITERAL or PLACEHOLDER.match(value) or " " in value:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    score = min(1.0, entropy / 3.0)
    return score if mixed else score * (0.7 if quoted else 0.3)


def _value(text: str, at: int) -> list[_Literal | str]:
    """Literals and referenced names of the value that starts at *at*."""
    chain: list[_Literal | str] = []
    while True:
        if m := _STRING.match(text, at):
            group = next(g for g in (1, 2, 3) if m.start(g) >= 0)
            chain.append(_Literal(*m.span(group), True))
        elif m := _REFERENCE.match(text, at):
            chain.append(m[0].rpartition(".")[2])
            if not chain[-1]:
                chain.pop()
            if len(chain) == 1:
                chain.append(_Literal(*m.span(), False))
        elif not chain and (m := _BARE.match(text, at)):
            return [_Literal(*m.span(), False)]
        else:
            return chain
        more = _JOIN.match(text, m.end())
        if not more or not any(c in "+." for c in more[0]):
            return chain
        at = more.end()


def pairs(text: str) -> list[tuple[str, list[_Literal | str]]]:
    """Names and values of all assignments, mappings, calls, options and elements."""
    found = []
    for m in _TARGET.finditer(text):
        found.append((m.start(), m["name"], _value(text, m.end())))
    for pattern in (_OPTION, _ELEMENT):
        for m in pattern.finditer(text):
            found.append((m.start(), m["name"], [_Literal(*m.span("value"), pattern is _ELEMENT)]))
    found.sort(key=lambda f: f[0])
    return [(name, value) for _, name, value in found]


def named_literals(text: str) -> list[Span]:
    """Literals that a sensitive name holds, directly or through other names."""
    if not _STEM.search(text):
        return []
    assigned = pairs(text)
    constants: dict[str, list] = {}
    for name, value in assigned:
        constants.setdefault(name.rpartition(".")[2], []).extend(value)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    reached: dict[str, list[_Literal]] = {}

    def literals(start: str) -> list[_Literal]:
        if start not in reached:
            todo, seen, out = [start], {start}, []
            while todo:
                for item in constants.get(todo.pop(), ()):
                    if isinstance(item, _Literal):
                        out.append(item)
                    elif item not in seen:
                        seen.add(item)
                        todo.append(item)
            reached[start] = out
        return reached[start]

    for name in dict.fromkeys(name for name, _ in assigned):
        if not (sensitive := name_score(name)):
            continue
        for lit in literals(name.rpartition(".")[2]):
            score = sensitive * literal_score(text[lit.start : lit.end], lit.quoted)
            key = (lit.start, lit.end)
            if score >= MIN_SCORE and score > best.get(key, (0.0, ""))[0]:
                best[key] = (score, name)
    return [Span("named", *key, name, round(score, 6)) for key, (score, name) in best.items()]


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind; the lexer's where no base span covers them."""
    if not text:
        return []
    found = base_spans(text)
    for span in named_literals(text):
        if not any(b.start <= span.start and span.end <= b.end for b in found if b.kind != "named"):
            found.append(span)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


_SPANS = pa.list_(
    pa.struct([
        ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
        ("name", pa.string()), ("score", pa.float64()),
    ])
)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points, name, score) of every text."""

    def run(batches):
        for batch in slices(batches):
            spans = [[s._asdict() for s in find_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"]
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run,
        f"doc_id {id_type}, "
        "spans array<struct<kind: string, start: int, end: int, name: string, score: double>>",
    )


def mask_spans(text: str, spans: list[Span], mask: str) -> str:
    out, at = [], 0
    for span in spans:
        if span.start >= at:
            out += [text[at : span.start], mask]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, mask: str = "[secret]", text_col: str = "text") -> DataFrame:
    """*docs* with every span, and those that overlap it, replaced by one *mask*.

    All columns stay; a null text stays null.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            texts = []
            for text in batch.column(at).to_pylist():
                spans = find_spans(text)
                texts.append(mask_spans(text, spans, mask) if spans else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
