"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated numbers, dates and addresses are replaced by others of the same format
with a keyed Feistel permutation: the value is cut in two parts, and in each
round one part is moved, within its range, by a keyed hash of the other.  Equal
values get equal pseudonyms in all documents, different values different ones,
and a pseudonym passes the validation that its original passed.

Kinds: ``email`` (the local part, letters stay letters and digits digits),
``iban`` (account digits and letters, new check digits), ``date`` (any day of
1900 to 2099), ``ip`` (IPv4), ``ssn``, ``phone`` (country code and the leading
digits of area and exchange stay) and ``card`` (first digit stays, new check
digit).  What does not validate is left alone.

Rows are independent: one narrow pass inside the JVM, no shuffle.  Texts without
a digit or an at sign are passed on as they are.  Patterns start only at the
start of a run and do not back up, so time is linear in the text.

Defined results: a null text stays null with counts of 0; repeated rows give a
row each; a null ``doc_id`` is carried along; other columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import bind

KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "card")
ROUNDS = 8

_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*\.[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./\-])(?:\d{4}([./\-])\d{2}\1\d{2}|\d{2}([./\-])\d{2}\2\d{4})(?![./\-]?\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]*\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}|\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "card": r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?!\w)",
}


def _numbered(pattern: str, first: int) -> str:
    """*pattern* with its two back references counted from *first*."""
    return pattern.replace(r"\1", f"\\{first}").replace(r"\2", f"\\{first + 1}")


#: All kinds as one pattern; only the date pattern has groups.
PATTERN = "|".join(f"(?:{_numbered(p, 1)})" for p in _PATTERNS.values())

_FIRST_DAY, _DAYS = "1900-01-01", 73_049
_DAY_PARTS = (17, 4_297)  # their product is _DAYS


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


class Pseudonyms:
    """Pseudonym columns under one key."""

    def __init__(self, key: str):
        self._key = key

    def _hash(self, kind: str, round_no: Column, other: Column) -> Column:
        """Keyed hash of the other part, as 64 hexadecimal digits."""
        return F.sha2(F.concat_ws("|", F.lit(self._key), F.lit(kind), round_no.cast("string"), other.cast("string")), 256)

    def pair(self, kind: str, left: Column, right: Column, n_left: Column, n_right: Column) -> Column:
        """Permuted (left, right) with left below *n_left* and right below *n_right*."""

        def moved(value, n, other, round_no):
            step = F.conv(F.substring(self._hash(kind, round_no, other), 1, 15), 16, 10).cast("bigint")
            return F.pmod(value + F.pmod(step, n), n)

        start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
        n_left, n_right = n_left.cast("bigint"), n_right.cast("bigint")
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), start,
            lambda s, i: F.when(
                i % 2 == 1, F.struct(moved(s["l"], n_left, s["r"], i).alias("l"), s["r"].alias("r"))
            ).otherwise(F.struct(s["l"].alias("l"), moved(s["r"], n_right, s["l"], i).alias("r"))),
        )

    def number(self, kind: str, digits: Column) -> Column:
        """Another number with as many digits (up to 18)."""
        n = F.length(digits)
        half = F.floor(n / 2).cast("int")

        def power(k):
            return F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("bigint")

        def part(s):
            return F.coalesce(F.nullif(s, F.lit("")).cast("bigint"), F.lit(0))

        mixed = self.pair(
            kind, part(F.substr(digits, F.lit(1), half)), part(F.substr(digits, half + 1, n - half)),
            power(half), power(n - half),
        )
        return bind(
            mixed,
            lambda m: F.concat(
                F.when(half > 0, F.lpad(m["l"].cast("string"), half, F.lit("0"))).otherwise(""),
                F.lpad(m["r"].cast("string"), n - half, F.lit("0")),
            ),
        )

    def characters(self, kind: str, s: Column) -> Column:
        """Another string in which letters stay letters, digits digits, and the rest as it is."""
        n = F.length(s)
        half = F.floor(n / 2).cast("int")

        def within(c, first, size, step):
            return F.chr(F.lit(ord(first)) + F.pmod(F.ascii(c) - ord(first) + step, F.lit(size)))

        def shifted(text, other, round_no):
            def char(h):
                def one(c, i):
                    step = F.conv(F.substr(h, F.pmod(i * 3, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int") + i
                    return (
                        F.when(c.between("0", "9"), within(c, "0", 10, step))
                        .when(c.between("a", "z"), within(c, "a", 26, step))
                        .when(c.between("A", "Z"), within(c, "A", 26, step)).otherwise(c)
                    )

                return F.array_join(F.transform(_chars(text), one), "")

            return bind(self._hash(kind, round_no, other), char)

        start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, n - half).alias("r"))
        mixed = F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), start,
            lambda a, i: F.when(
                i % 2 == 1, F.struct(shifted(a["l"], a["r"], i).alias("l"), a["r"].alias("r"))
            ).otherwise(F.struct(a["l"].alias("l"), shifted(a["r"], a["l"], i).alias("r"))),
        )
        return bind(mixed, lambda m: F.concat(m["l"], m["r"]))

    # -- kinds: null where a hit does not validate ---------------------------

    def email(self, hit: Column) -> Column:
        return F.concat(
            self.characters("email", F.substring_index(hit, "@", 1)), F.lit("@"), F.substring_index(hit, "@", -1)
        )

    def iban(self, hit: Column) -> Column:
        plain = F.replace(hit, F.lit(" "), F.lit(""))

        def fresh(p):
            account = self.characters("iban", F.substr(p, F.lit(5)))
            land = F.substr(p, F.lit(1), F.lit(2))
            whole = bind(
                account,
                lambda a: F.concat(land, F.lpad((98 - _mod97(F.concat(a, land, F.lit("00")))).cast("string"), 2, "0"), a),
            )
            return F.when(
                _mod97(F.concat(F.substr(p, F.lit(5)), F.substr(p, F.lit(1), F.lit(4)))) == 1,
                bind(whole, lambda w: _refill(hit, w, "[A-Z0-9]")),
            )

        return bind(plain, fresh)

    def date(self, hit: Column) -> Column:
        mark = F.substr(F.regexp_replace(hit, "[0-9]", ""), F.lit(1), F.lit(1))
        plain = F.translate(hit, "./", "--")
        forms = ("yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy")
        year_first = F.length(F.substring_index(plain, "-", 1)) == 4
        day_first = ~year_first & (mark != "/")

        def parsed(form):
            return F.try_to_timestamp(plain, F.lit(form)).cast("date")

        def fresh(form):
            def made(day):
                n = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
                mixed = self.pair("date", F.floor(n / _DAY_PARTS[1]), n % _DAY_PARTS[1], *map(F.lit, _DAY_PARTS))
                new = bind(mixed, lambda m: (m["l"] * _DAY_PARTS[1] + m["r"]).cast("int"))
                text = F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), new), form)
                return F.when((n >= 0) & (n < _DAYS), F.replace(text, F.lit("-"), mark))

            return bind(parsed(form), made)

        # With slashes the month comes first where that is a date.
        return (
            F.when(year_first, fresh(forms[0])).when(day_first, fresh(forms[1]))
            .otherwise(F.coalesce(fresh(forms[2]), fresh(forms[1])))
        )

    def ip(self, hit: Column) -> Column:
        def fresh(o):
            mixed = self.pair("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
            text = bind(
                mixed,
                lambda m: F.concat_ws(
                    ".", *(x.cast("string") for x in (F.shiftright(m["l"], 8), m["l"] % 256, F.shiftright(m["r"], 8), m["r"] % 256))
                ),
            )
            return F.when(F.forall(o, lambda x: x <= 255), text)

        return bind(F.split(hit, "\\.").cast("array<int>"), fresh)

    def ssn(self, hit: Column) -> Column:
        def fresh(p):
            area = p[0] - F.when(p[0] > 666, 2).otherwise(1)
            mixed = self.pair("ssn", area * 99 + p[1] - 1, p[2] - 1, F.lit(898 * 99), F.lit(9999))
            valid = (p[0] > 0) & (p[0] != 666) & (p[0] < 900) & (p[1] > 0) & (p[2] > 0)

            def text(m):
                place = F.floor(m["l"] / 99)
                return F.concat_ws(
                    "-", F.lpad((place + F.when(place >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
                    F.lpad((m["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((m["r"] + 1).cast("string"), 4, "0"),
                )

            return F.when(valid, bind(mixed, text))

        return bind(F.split(hit, "-").cast("array<int>"), fresh)

    def phone(self, hit: Column) -> Column:
        """North American numbers keep the first digits of area and exchange; others two more than the country code."""

        def fresh(d):
            n = F.length(d)
            north = ((n == 11) & d.startswith("1")) | ((n == 10) & ~hit.startswith("+"))
            lead = n - 10
            area, line = F.substr(d, lead + 1, F.lit(3)), F.substr(d, lead + 4, F.lit(7))
            moved = F.concat(F.substr(area, F.lit(2), F.lit(2)), F.substr(line, F.lit(2), F.lit(6)))
            american = bind(
                self.number("phone", moved),
                lambda m: F.concat(
                    F.substr(d, F.lit(1), lead + 1), F.substr(m, F.lit(1), F.lit(2)),
                    F.substr(line, F.lit(1), F.lit(1)), F.substr(m, F.lit(3)),
                ),
            )
            keep = F.greatest(F.lit(0), F.least(F.lit(4), n - 4))
            other = F.concat(F.substr(d, F.lit(1), keep), self.number("phone", F.substr(d, keep + 1, n - keep)))
            whole = F.when(north, american).otherwise(other)
            return F.when((n >= 8) & (n <= 15), bind(whole, lambda w: _refill(hit, w, "[0-9]")))

        return bind(_digits(hit), fresh)

    def card(self, hit: Column) -> Column:
        def fresh(d):
            n = F.length(d)
            body = F.concat(F.substr(d, F.lit(1), F.lit(1)), self.number("card", F.substr(d, F.lit(2), n - 2)))
            whole = bind(body, lambda b: F.concat(b, _luhn(b)))
            valid = (_luhn(F.substr(d, F.lit(1), n - 1)) == F.substr(d, n)) & (F.translate(d, "0", "") != "")
            return F.when(valid, bind(whole, lambda w: _refill(hit, w, "[0-9]")))

        return bind(_digits(hit), fresh)

    def replace(self, hit: Column) -> Column:
        """Kind and pseudonym of a hit; null pseudonym where it does not validate."""
        kind = F.lit(None).cast("string")
        for name in reversed(KINDS):
            kind = F.when(hit.rlike(f"^(?:{_numbered(_PATTERNS[name], 1)})$"), F.lit(name)).otherwise(kind)

        def made(k):
            value = F.lit(None).cast("string")
            for name in reversed(KINDS):
                value = F.when(k == name, getattr(self, name)(hit)).otherwise(value)
            return F.struct(k.alias("kind"), value.alias("value"))

        return bind(kind, made)


def _luhn(payload: Column) -> Column:
    """Check digit of a digit string."""

    def weighed(c, i):
        d = c.cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.transform(_chars(F.reverse(payload)), weighed), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _mod97(s: Column) -> Column:
    """Remainder of an account string by 97, letters counting from 10."""

    def step(a, c):
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(a * F.when(value > 9, 100).otherwise(10) + value, F.lit(97))

    return F.aggregate(_chars(s), F.lit(0), step)


def _refill(shape: Column, content: Column, kind: str) -> Column:
    """*shape* with its characters of *kind* replaced, in order, by those of *content*."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s, c):
        taken = c.rlike(kind)
        return F.struct(
            F.concat(s["out"], F.when(taken, F.substr(content, s["k"], F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + taken.cast("int")).alias("k"),
        )

    return F.aggregate(_chars(shape), start, step)["out"]


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with pseudonyms, and ``counts``: replaced values of each kind."""
    names = Pseudonyms(key)
    text = F.col("text")
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    changed = F.transform("hits", lambda h: F.struct(h.alias("hit"), names.replace(h).alias("new")))

    def whole(h):
        parts = F.zip_with(
            F.split(text, PATTERN, -1), h,
            lambda p, x: F.concat(p, F.coalesce(x["new"]["value"], x["hit"], F.lit(""))),
        )
        return F.array_join(parts, "")

    def count(kind):
        same = F.filter("changed", lambda x: (x["new"]["kind"] == kind) & x["new"]["value"].isNotNull())
        return F.coalesce(F.size(same), F.lit(0)).cast("long").alias(kind)

    return (
        docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
        .select("doc_id", "text", hits.alias("hits"))
        .select("doc_id", "text", F.when(F.size("hits") > 0, changed).alias("changed"))
        .select(
            "doc_id",
            F.when(F.col("changed").isNull(), text).otherwise(whole(F.col("changed"))).alias("text"),
            F.struct(*(F.when(F.col("changed").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(k) for k in KINDS)).alias("counts"),
        )
    )


def text_of(text_col: str) -> Column:
    return F.col(text_col).cast("string")
