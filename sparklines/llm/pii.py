"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust a score.

Column expressions only. All positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklines.functions.spans import running
from sparklines.model import let

#: The patterns of the base kinds. Runs are possessive, which changes no match here (what
#: follows a run never matches in the run) and keeps long runs linear; a match may only start where a run
#: starts or where the match before ended, which are the leftmost places anyway.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Countries by the length of their account numbers (ISO 13616).
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
#: Further kinds. An account number is as long as its country says, so that words after it are never taken in; neither kind stands inside a longer run of letters or digits.
IBAN = (
    r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:"
    + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items())
    + ")(?![A-Za-z0-9])"
)
SSN = r"(?<![A-Za-z0-9])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. base: score of a confirmed match; context: words that lift it by `lift`; against: words that lower it as much."""

    name: str
    pattern: str
    hint: str
    context: str
    base: float
    lift: float = 0.3
    against: str = ""


#: Words beside numbers that only look like personal ones.
OTHER_NUMBERS = "serial|parts?|sku|isbn|model|tracking|version|order|invoice|ticket"
KINDS = (
    Kind("email", EMAIL, "@", "e-?mails?|mails?|contact|write|reach", 0.9),
    Kind("ip", IP, ".", "ips?|hosts?|servers?|address|client", 0.6),
    Kind("card", CARD, "", "cards?|credit|visa|pay|paid|payment|number", 0.7),
    Kind("phone", PHONE, "+", "phone|telephone|tel|call|mobile|cell|fax", 0.6),
    Kind("iban", IBAN, "", "iban|bic|swift|bank|account|konto|compte|cuenta", 0.7, against=OTHER_NUMBERS),
    Kind("ssn", SSN, "-", "ssn|social|security|insurance", 0.3, against=OTHER_NUMBERS),
)
_SPANS = "array<struct<s:int,rank:int,e:int,k:string,score:double>>"
BASE = ("email", "ip", "card", "phone")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check: from the right, every second one doubled, the sum a multiple of ten."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: x.try_cast("int"))
    total = F.aggregate(
        F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, x * 2 - 9).otherwise(x * 2)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the account number's remainder is 1: first four characters moved last, letters as 10 to 35."""
    packed = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(packed, 5, 64), F.substring(packed, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(c.try_cast("int")))
    rest = F.aggregate(values, F.lit(0), lambda a, v: F.when(v.isNull(), a).otherwise((a * F.when(v > 9, 100).otherwise(10) + v) % 97))
    return rest == 1


def _confirmed(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.substring(bare(p), 1, 3).try_cast("int") <= 255))
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(m))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":  # areas, groups and numbers that are never given out
        return ~F.rlike(m, F.lit("^(?:000|666|9)")) & ~F.contains(m, F.lit("-00-")) & ~F.endswith(m, F.lit("-0000"))
    return F.lit(True)


#: Code points on either side of a match in which a context word counts.
NEAR = 40


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind as array<struct<s, rank, e, k, score>>.

    The matches and the pieces between them (split by the same pattern) alternate, so running sums of their lengths are the
    places, in time linear in the matches. A context word counts whole, in the NEAR code points before or after the match up to the next match of the kind.
    """
    rank, none = KINDS.index(kind), F.array().cast("array<string>")
    hits, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    if kind.hint:
        some = F.contains(text, F.lit(kind.hint))
        hits, gaps = F.when(some, hits).otherwise(none), F.when(some, gaps).otherwise(none)
    context, against = (F.lit(rf"(?i)\b(?:{w})\b") for w in (kind.context, kind.against))

    def spans(hits: Column, gaps: Column) -> Column:
        n = F.size(hits)
        steps = F.zip_with(F.slice(gaps, 1, n), hits, lambda g, m: F.char_length(g) + F.char_length(m))
        beside = F.zip_with(F.slice(gaps, 1, n), F.slice(gaps, 2, n), lambda a, b: F.struct(F.right(a, F.lit(NEAR)).alias("before"), F.left(b, F.lit(NEAR)).alias("after")))
        each = F.zip_with(F.zip_with(hits, running(steps), lambda m, e: F.struct(m.alias("m"), e.alias("e"))), beside, lambda x, y: F.struct(x["m"].alias("m"), x["e"].alias("e"), y["before"].alias("before"), y["after"].alias("after")))
        good = F.filter(each, lambda x: _confirmed(kind.name, x["m"]))
        beside_it = lambda x: F.concat_ws(" ", x["before"], x["after"])

        def score(x: Column) -> Column:
            lifted = F.lit(kind.base) + F.when(F.rlike(beside_it(x), context), F.lit(kind.lift)).otherwise(F.lit(0.0))
            if kind.against:
                lifted -= F.when(F.rlike(beside_it(x), against), F.lit(kind.lift)).otherwise(F.lit(0.0))
            return F.least(lifted, F.lit(1.0))

        return F.transform(
            good,
            lambda x: F.struct(
                (x["e"] - F.char_length(x["m"])).alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind.name).alias("k"),
                score(x).alias("score"),
            ),
        )

    return let(hits, lambda h: F.when(F.size(h) > 0, let(gaps, lambda g: spans(h, g))).otherwise(F.array().cast(_SPANS)))


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Personal data in every text of docs(doc_id, text): counts, digests, and pii, an array of (s, rank, e, k, score).

    Base kinds (email, ip, card, phone) stay whatever their score; an account number (iban) must be as long as its country's and pass mod 97,
    a social security number (ssn) have parts that are given out, and both need a score of at least threshold. A whole context word within 40 characters beside
    it lifts the score, a word for other numbers (serial, order, invoice ...) lowers it: an ssn needs the former without the latter, an iban the former where the latter stands. base_sha256 digests the base spans as
    kind:start:end in order of start, then kind, comma-joined; spans lists all spans that way.
    Null text counts as empty (no spans, digest of the empty string); null ids and repeated rows are rows like
    others. No shuffle: one pass over the texts.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select("doc_id", *[spans_of(text, k).alias(k.name) for k in KINDS])
    further = [F.filter(k.name, lambda x: x["score"] >= threshold) for k in KINDS if k.name not in BASE]
    rows = rows.withColumn("base", F.array_sort(F.concat(*[F.col(k) for k in BASE])))
    rows = rows.withColumn("pii", F.array_sort(F.concat("base", *further)))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("pii").alias("spans"), "pii",
    )
