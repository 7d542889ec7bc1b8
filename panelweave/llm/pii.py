r"""Personal data: regular expressions propose spans, checksums confirm them, context words move their score.

Everything is a Column expression. A text is cut at its matches with one
regexp_replace (a marker on both sides of each match) and one split, so the
odd pieces are matches, the even ones what stands between; running lengths of
the pieces give code-point offsets, the neighbouring pieces the context.

Kinds email, ip, card and phone are found in every text and always kept when
their check (parts at most 255, Luhn, digit count) passes. Kinds iban
(mod-97), ssn and key are added when their score reaches ``min_score``.

Null and empty texts have no spans (n_* are 0, spans is ''). Texts of any
length are searched whole, in time linear in text and matches: running sums are
taken in slices of ``SLICE``. Spans that tie in start and kind cannot occur;
equal starts are ordered by kind. Rows are independent, repeated rows give
repeated results. Extra columns go along whatever their names, only one named
like the result is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

MARK, INSTEAD = "\u0001", "\u0002"


@dataclass(frozen=True)
class Kind:
    name: str
    rank: int
    pattern: str
    score: float
    words: str
    base: bool = True
    needs: str | None = None  # a cheap test before the pattern runs


# Possessive loops cannot give back what they took, so long runs neither
# overflow the regex stack nor cost quadratic time. A run's first character, or
# the end of the last match (\G), is the only place where a match can begin.
# An iban's pattern matches its first four characters only, as what follows may
# run on into the next word or hold another one; iban_at() finds its end.
# A card's pattern asks for the 14 digits that it must have: a shorter run fails
# at each of its few digits, and is no proposal that its check would drop.
KINDS = (
    Kind("email", 0, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|write|reach", needs="@"),
    Kind("ip", 1, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, r"\bip\b|host|server|address|ping"),
    Kind("card", 2, r"[0-9](?:[\x20-]?[0-9]){13,}+", 0.8, r"card|visa|master|credit|debit|pay|amex"),
    Kind("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", 0.8, r"phone|tel|call|mobile|fax|cell", needs="+"),
    Kind("iban", 4, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", 0.8, r"iban|bank|account|konto|compte|cuenta", base=False),
    Kind("ssn", 5, r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.4, r"ssn|social|security|tax", base=False, needs="-"),
    Kind("key", 6, r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", 0.7, r"key|secret|token|access|aws", base=False, needs="AKIA"),
)
CONTEXT = 40
SLICE = 256  # elements of an array that are summed up together
IBAN_MOST = 34 + 33  # characters and the blanks between them
#: Length of an IBAN by country (ISO 13616 registry).
IBAN_LENGTHS = {c: int(n) for n, codes in (x.split(":") for x in (
    "15:NO|16:BE|18:DK FI FK FO GL NL SD|19:MK SI|20:AT BA EE KZ LT LU MN XK|21:CH CR HR LI LV|22:BG BH DE GB GE IE ME RS|23:AE GI IL IQ OM SO TL|"
    "24:AD CZ DZ ES MD PK RO SA SE SK TN VG YE|25:LY PT ST|26:IS TR|27:BI DJ FR GR IT MC MR SM|28:AL AZ BY CY DO GT HN HU LB NI PL SV|29:BR EG PS QA UA|30:JO KW MU|31:MT SC|32:LC|33:RU"
).split("|")) for c in codes.split()}
BONUS = 0.3


def running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of int what plus gives of all before it, from 0. Appending copies an array, so it is done in slices: inside each and over their totals."""
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("to"))

    def before(x: Column, at: Column) -> Column:
        step = lambda a, v: F.struct(plus(a["at"], v).alias("at"), F.array_append(a["to"], a["at"]).alias("to"))
        return F.aggregate(x, start(at), step)["to"]

    def within(slices: Column) -> Column:
        totals = F.transform(slices, lambda x: F.aggregate(x, F.lit(0), plus))
        return F.flatten(F.zip_with(slices, before(totals, F.lit(0)), before))

    count = (F.size(values) - 1 + SLICE).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.floor(count / SLICE).cast("int") - 1), lambda i: F.slice(values, i * SLICE + 1, SLICE))
    return F.when(F.size(values) > 0, let(cut, within)).otherwise(F.array().cast("array<int>"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn's sum over a string of digits is a multiple of ten."""
    places = F.split(F.reverse(digits), "")
    values = F.transform(
        F.filter(places, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97_ok(value: Column) -> Column:
    """The check of an IBAN: first four characters to the end, letters as 10 to 35, remainder 1 of 97."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    marks = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (acc * 100 + v - 55) % 97).otherwise((acc * 10 + v - 48) % 97)

    return F.aggregate(marks, F.lit(0), step) == 1


def ip_ok(value: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def iban_at(tail: Column) -> Column:
    """The IBAN that tail starts with, '' if none: of its country's length or, where that isn't known, the longest of 15 to 34 characters that passes; no letter or digit may follow it."""
    known = F.create_map(*[F.lit(x) for c in IBAN_LENGTHS.items() for x in c])
    length = F.try_element_at(known, F.substring(tail, 1, 2))
    sizes = F.when(length.isNotNull(), F.array(length)).otherwise(F.sequence(F.lit(34), F.lit(15), F.lit(-1)))

    def one(n: Column) -> Column:
        pattern = F.concat(F.lit(r"^[A-Z0-9](?:\x20?[A-Z0-9]){"), (n - 1).cast("string"), F.lit("}(?![A-Za-z0-9])"))
        return F.call_function("regexp_extract", tail, pattern, F.lit(0))

    fit = F.filter(F.transform(sizes, one), lambda v: (v != "") & mod97_ok(v))
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(""))


def confirmed(kind: Kind, value: Column) -> Column:
    if kind.name == "ip":
        return ip_ok(value)
    if kind.name == "card":
        return let(digits_of(value), lambda d: F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), luhn_ok(d)).otherwise(False))
    if kind.name == "phone":
        return F.length(digits_of(value)).between(10, 15)
    if kind.name == "iban":
        return value != ""
    return F.lit(True)


SPAN = "array<struct<s:int,rank:int,e:int,kind:string,score:double>>"


def tail_of(p: Column, i: Column) -> Column:
    """The text from piece i on, as far as an IBAN and its context reach. Two pieces have five characters at least, so few are joined."""
    most = IBAN_MOST + CONTEXT
    return F.substring(F.array_join(F.transform(F.slice(p, i + 1, 2 * most // 5 + 2), lambda x: F.substring(x, 1, most)), ""), 1, most)


def before(p: Column, i: Column) -> Column:
    """The context before piece i, over as many pieces as it takes."""
    few = 2 * CONTEXT // 5 + 2
    return F.substring(F.array_join(F.transform(F.slice(p, F.greatest(i - few, F.lit(0)) + 1, F.least(i, F.lit(few))), lambda x: F.substring(x, -CONTEXT, CONTEXT)), ""), -CONTEXT, CONTEXT)


def spans_of(text: Column, kind: Kind, min_score: float) -> Column:
    """Confirmed spans of one kind: array of (s, rank, e, kind, score)."""
    safe = F.replace(text, F.lit(MARK), F.lit(INSTEAD))
    pieces = F.split(F.regexp_replace(safe, f"({kind.pattern})", f"{MARK}$1{MARK}"), MARK, -1)

    def with_starts(p: Column) -> Column:
        sums = let(F.transform(p, lambda x: F.length(x)), lambda n: running(n, lambda a, b: a + b))

        def build(starts: Column) -> Column:
            def one(i: Column) -> Column:
                s = F.get(starts, i)
                if kind.name == "iban":
                    return let(tail_of(p, i), lambda tail: let(iban_at(tail), lambda value: span(s, value, before(p, i), F.substring(tail, F.length(value) + 1, CONTEXT))))
                return span(s, F.get(p, i), F.substring(F.get(p, i - 1), -CONTEXT, CONTEXT), F.substring(F.get(p, i + 1), 1, CONTEXT))

            def span(s: Column, value: Column, left: Column, right: Column) -> Column:
                near = F.lower(F.concat(left, F.lit(" "), right))
                score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(kind.words), BONUS).otherwise(0.0))
                return F.struct(
                    s.alias("s"), F.lit(kind.rank).alias("rank"), (s + F.length(value)).alias("e"), F.lit(kind.name).alias("kind"),
                    F.when(confirmed(kind, value), score).otherwise(-1.0).alias("score"),
                )

            found = F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), one)
            least = 0.0 if kind.base else min_score
            return F.filter(found, lambda x: x["score"] >= least)

        return F.when(F.size(p) > 1, let(sums, build)).otherwise(F.array().cast(SPAN))

    found = let(pieces, with_starts)
    test = F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike("[0-9]")
    return F.when(test, found).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans_by_kind(text: Column, min_score: float) -> Column:
    """All spans of a text, sorted by start, then kind."""
    return F.array_sort(F.concat(*[spans_of(text, k, min_score) for k in KINDS]))


def find(df: DataFrame, text: str = "text", out: str = "pii", min_score: float = 0.5) -> DataFrame:
    """Adds column ``out``: all spans of ``text`` as an array sorted by start, then kind."""
    return df.withColumn(out, spans_by_kind(F.coalesce(F.col(text), F.lit("")), min_score))


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; overlapping spans go together under the first one's kind.

    The text is cut into slices once, so that a place in it is found without
    walking there from the beginning.
    """
    size = 1024

    def cut(parts: Column, reach: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / size).cast("int")
            some = F.slice(parts, first + 1, F.floor(b / size).cast("int") - first + 1)
            return F.substring(F.array_join(some, ""), a - first * size + 1, b - a)

        def one(x: Column, i: Column) -> Column:
            at = F.get(reach, i)
            return F.when(x["s"] >= at, F.concat(between(at, x["s"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise("")

        end = F.greatest(F.element_at(reach, -1), F.element_at(spans, -1)["e"])
        return F.concat(F.array_join(F.transform(spans, one), ""), between(end, F.length(text)))

    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    reach = let(F.transform(spans, lambda x: x["e"]), lambda e: running(e, lambda a, b: F.greatest(a, b)))
    return let(parts, lambda p: let(reach, lambda r: cut(p, r)))


def redact(df: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """Replaces every span of ``text`` by its kind in angle brackets. A null text stays null, a text without spans stays as it is."""
    t = F.col(text)
    found = let(spans_by_kind(F.coalesce(t, F.lit("")), min_score), lambda x: F.when(F.size(x) > 0, masked(t, x)).otherwise(t))
    return df.withColumn(text, found)


def report(df: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The digest columns of the query: counts, hash of the base spans, all spans and their scores."""
    df = find(df.select("doc_id", "text"), "text", "pii", min_score)
    names = [k.name for k in KINDS if k.base]
    base = F.filter("pii", lambda x: x["kind"].isin(names))
    count = lambda n: F.size(F.filter("pii", lambda x: x["kind"] == n)).cast("long").alias(f"n_{n}")
    return df.select(
        "doc_id", *[count(k.name) for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: F.round(x["score"], 2).cast("string")), ",").alias("scores"),
    )
