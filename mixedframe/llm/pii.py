"""Personal data in whole texts, with DataFrame functions only.

Patterns propose spans, validators confirm them (range of address parts, Luhn, mod-97, digit
counts), and words nearby raise or lower the score. The base kinds are scored 0.6 or more
by their validators alone, so context never drops them. Account numbers (``iban``) have the
length that their country prescribes, need the mod-97 check and a score of 0.5; national phone numbers (``local_phone``) have a base score
of 0.3 and need a phone word nearby.

Defined cases: a null text is empty; an empty text has no spans; a text of any length is
searched whole, in time proportional to its length; repeated rows are reported each; an empty
table gives no rows; columns of the input pass through, a column named ``personal`` is
replaced, as is one named ``__text``, ``__base`` or ``__more``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import cut_out, free_of, let, listed, pieces_of, regex_spans

# Countries with account numbers of each length: the registry, and those that use them without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI BL CF CG CM DJ FR GA GF GP GQ GR IT KM MC MF MG MQ MR NC PF PM RE SM TD TF WF YT",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

# What counts as personal data, in the order in which kinds are listed. A run is
# entered at its first character (or where the last match ended) and matched possessively,
# which gives the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.7, "local_phone": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "local_phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax)\b",
}
NEAR = 40
BONUS = 0.25
ACCEPT = 0.5


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    single = F.transform(F.filter(F.split(F.reverse(digits(value)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(single, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 check (first four characters moved to the end, letters from 10)."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(compact, F.lit(5), F.char_length(compact)), F.substring(compact, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        number = F.when(F.rlike(c, F.lit("[0-9]")), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    count = F.char_length(digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return F.rlike(value, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return F.when((count >= 13) & (count <= 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return (count >= 9) & (count <= 15)
    if kind == "iban":
        return mod97(value)
    return (count >= 7) & (count <= 12)


def _possible(kind: str, text: Column) -> Column:
    if kind in ("email", "phone"):
        return F.contains(text, F.lit("@" if kind == "email" else "+"))
    return F.rlike(text, F.lit("[0-9]"))


def _scored(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind with their score."""

    def score(body: Column, s: Column) -> Column:
        around = F.concat_ws(" ", cut_out(body, F.greatest(s.start - NEAR, F.lit(0)), s.start), cut_out(body, s.end, s.end + NEAR))
        return F.lit(SCORES[kind]) + F.when(F.rlike(around, F.lit(CONTEXT[kind])), BONUS).otherwise(0.0)

    def mark(x: Column) -> Column:
        named = lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value"), F.least(score(x.pieces, s), F.lit(1.0)).alias("score"))
        return F.transform(F.filter(x.spans, lambda s: _valid(kind, s.value)), named)

    spans = regex_spans(text, PATTERNS[kind], _possible(kind, text))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")
    # the text is cut into pieces only where something was found
    inputs = lambda s: F.struct(pieces_of(text).alias("pieces"), s.alias("spans"))
    marked = let(spans, lambda s: F.when(F.size(s) > 0, let(inputs(s), mark)).otherwise(none))
    return F.filter(marked, lambda s: s.score >= ACCEPT)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with ``personal``: array of (kind, start, end, value, score), kind after kind, each by start.

    An added span that overlaps one of a base kind is left out.
    """
    rows = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    text = F.col("__text")
    rows = rows.withColumn("__base", F.concat(*[_scored(text, kind) for kind in BASE]))
    rows = rows.withColumn("__more", F.concat(*[_scored(text, kind) for kind in KINDS if kind not in BASE]))
    return rows.withColumn("personal", F.concat("__base", free_of(F.col("__more"), F.col("__base")))).drop("__text", "__base", "__more")


def personal_report(docs: DataFrame) -> DataFrame:
    """Counts and spans per document, the spans of the base kinds also as a digest."""
    found = find_personal_data(docs.select("doc_id", "text")).select("doc_id", "personal")
    base = F.filter("personal", lambda s: s.kind.isin(*BASE))
    count = lambda kind: F.size(F.filter("personal", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("personal")).alias("spans"),
        F.array_join(F.transform("personal", lambda s: F.format_number(s.score, 2)), ",").alias("scores"),
    )
