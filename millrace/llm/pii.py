"""Personal data by patterns, checksums and context (operator 7), as DataFrame expressions only.

Regular expressions propose spans; validators confirm them: the Luhn sum for payment cards, parts up to 255 for IP
addresses, numbers of digits for phones and cards, and mod-97 for IBANs, which the method adds to the base kinds, as it
does social security numbers. Each confirmed span has a score: its kind's own, raised where a word of its kind's context
stands within `spans.NEAR` characters before or after it, up to the kind's next match. Base spans stay whatever their score; an added span needs
`LEAST` or more: an IBAN has it by its check digits, a social security number only by its context.

The patterns equal the plain ones of the contract: a guard keeps a match from being tried inside a run that failed as
a whole, and possessive loops don't back up where nothing could follow, so a text takes time in proportion to its
length and no deep recursion.

One narrow pass: no shuffle, no Python. Defined results: a null text is empty; repeated rows give repeated rows; an
empty table gives no rows; columns besides those named are ignored.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import spans as S

BONUS, LEAST = 0.35, 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.ascii(F.substring(digits, -i, F.lit(1))) - 48
    total = F.aggregate(places, F.lit(0), lambda a, i: a + F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 modulo 97, its first four letters moved to the end."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    rest = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda a, i: F.when(code(i) < 58, (a * 10 + code(i) - 48) % 97).otherwise((a * 100 + code(i) - 55) % 97))
    return rest == 1


def _octet(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = S.Rule("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), lambda t: t.contains("@"))
IP = S.Rule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: F.forall(F.split(m, r"\."), _octet))
CARD = S.Rule("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: S.let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))))
PHONE = S.Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), lambda t: t.contains("+"))
#: Countries by the length of their IBANs, those outside the registry that use them included.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def _iban_pattern() -> str:
    """An IBAN ends where its country's length says, so it never runs into the words behind it."""
    by_length = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?:{by_length})(?![A-Za-z0-9])"


IBAN = S.Rule("iban", _iban_pattern(), lambda m: mod97(F.regexp_replace(m, " ", "")), lambda t: t.rlike("[A-Z][A-Z][0-9][0-9]"))
SSN = S.Rule("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(True))
SCORES = {"email": 0.6, "ip": 0.5, "card": 0.6, "phone": 0.4, "iban": 0.7, "ssn": 0.3}
CONTEXT = {
    "email": "e-?mail|contact|mailto|kontakt|correo|courriel",
    "ip": "\\bip\\b|address|server|host|adresse",
    "card": "card|visa|credit|debit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon|llam",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "ssn": "\\bssn\\b|social security|tax(payer)? id|sozialversicherung",
}
BASE, ADDED = ([replace(r, context=CONTEXT[r.kind]) for r in rules] for rules in ((EMAIL, IP, CARD, PHONE), (IBAN, SSN)))


def score(span: Column) -> Column:
    """The score of a span."""
    own = F.lit(0.0)
    for kind, value in SCORES.items():
        own = F.when(span["kind"] == kind, F.lit(value)).otherwise(own)
    return F.least(F.lit(1.0), own + F.when(span["near"], F.lit(BONUS)).otherwise(F.lit(0.0)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans) with spans (start, rank, end, kind, text, score) by start: base spans and confirmed added ones."""
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    rules = [*BASE, *ADDED]
    found = plain.select("id", "t", *[S.spans(F.col("t"), r, k).alias(f"s{k}") for k, r in enumerate(rules)])
    every = found.select("id", "t", S.ordered(*[F.col(f"s{k}") for k in range(len(rules))]).alias("s"))
    scored = F.transform("s", lambda s: s.withField("score", score(s)))
    kept = F.filter(scored, lambda s: (s["rank"] < len(BASE)) | (s["score"] >= LEAST))
    return every.select("id", "t", F.when(F.size("s") > 0, kept).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,text:string,near:boolean,score:double>>)")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with each span replaced by its kind in angle brackets; a span inside an earlier one is skipped."""
    found = find(docs, id_col, text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), more.alias("out")))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.length("t"))))
    return found.select(F.col("id").alias(id_col), F.when(F.size("spans") > 0, done).otherwise(F.col("t")).alias(text_col))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, top_score."""
    s = F.col("spans")
    counts = [S.number(s, r.kind).alias(f"n_{r.kind}") for r in BASE]
    base = F.sha2(S.joined(S.of_rank(s, len(BASE))), 256).alias("base_sha256")
    top = F.array_max(F.transform(s, lambda x: x["score"])).alias("top_score")
    return find(docs, id_col, text_col).select(F.col("id").alias(id_col), *counts, base, S.joined(s).alias("spans"), top)
