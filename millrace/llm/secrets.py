"""Secret scans over a trigram inverted index (operator 5), as DataFrame expressions only.

Each rule's regular expression is turned into a Boolean trigram query (`trigram_query`): the trigrams that every match
must hold, as alternatives of conjunctions. The index posts (trigram, document) for the trigrams that some rule asks
for. Postings of a conjunction are intersected by an aggregate over (document, conjunction), documents that have all
trigrams of one are candidates, and only candidates are verified with the expression. A rule without mandatory trigrams
(runs of hex digits) scans all texts.

Texts of candidates come from a join by document. Documents without the rarest trigram of any conjunction can't be
candidates; they are left out of the side that carries texts, so texts are shuffled for likely candidates only.

Defined results: a null text is empty; rows that repeat an id and a text get equal results, one row each; rows with one
id and different texts are told apart by the text's hash; null ids are an id; an empty table gives no rows; columns
besides those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import spans as S
from millrace.llm.common import materialise

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Strings that an alternation may expand to before its trigrams are given up.
ALTERNATIVES = 64


@dataclass(frozen=True)
class Scan:
    """A rule with the expression that its trigrams are derived from, in Python's syntax, letter case ignored."""

    rule: S.Rule
    source: str


BASE = (
    Scan(S.Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8), r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    Scan(S.Rule("access", "AKIA[A-Z0-9]++", lambda m: F.length(m) >= 16), "AKIA[A-Z0-9]+"),
    Scan(S.Rule("hex", "(?<![0-9a-f])[0-9a-f]{32,}+", lambda m: F.lit(True)), "[0-9a-f]{32,}"),
)
ADDED = (
    Scan(S.Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}+", lambda m: F.lit(True)), "gh[pousr]_[A-Za-z0-9]{36,}"),
    Scan(S.Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}+", lambda m: F.lit(True)), "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Scan(S.Rule("key", "-----BEGIN (?:[A-Z]{2,10} ){0,2}PRIVATE KEY-----", lambda m: F.lit(True)), "-----BEGIN (?:[A-Z]{2,10} ){0,2}PRIVATE KEY-----"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The trigrams that a match must hold, lower-cased: alternatives, each a set of which all are needed; None if any text may match."""
    from re import _parser  # the standard library's parser of expressions

    best: list[list[str]] = []

    def strings(items) -> list[str]:
        """Walks a sequence; returns the exact strings of its last stretch and notes finished stretches in best."""
        now = [""]

        def flush():
            nonlocal now
            if min(map(len, now)) >= 3:
                best.append(now)
            now = [""]

        for op, arg in items:
            found = exact(op, arg)
            if found is None or len(found) * len(now) > ALTERNATIVES:
                flush()
                if found is not None:
                    now = found
            else:
                now = [a + b for a in now for b in found]
        flush()
        return now

    def exact(op, arg) -> list[str] | None:
        name = str(op)
        if name == "LITERAL":
            return [chr(arg).lower()]
        if name == "IN":
            chars = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return sorted(chars) if len(chars) <= 8 else None
        if name == "SUBPATTERN":
            return sequence(arg[-1])
        if name == "BRANCH":
            parts = [sequence(x) for x in arg[1]]
            return None if any(p is None for p in parts) else sorted({s for p in parts for s in p})
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            one = sequence(inner)
            if one is None or high > 3:
                return None
            out, power = set(), [""]
            for n in range(int(high) + 1):
                if n >= low:
                    out |= set(power)
                power = [a + b for a in power for b in one]
                if len(power) > ALTERNATIVES * 8:
                    return None
            return sorted(out) if len(out) <= ALTERNATIVES else None
        return None

    def sequence(items) -> list[str] | None:
        now = [""]
        for op, arg in items:
            found = exact(op, arg)
            if found is None or len(found) * len(now) > ALTERNATIVES:
                return None
            now = [a + b for a in now for b in found]
        return now

    strings(_parser.parse(pattern))
    if not best:
        return None
    # The stretch with the longest shortest string, then the fewest alternatives.
    chosen = max(best, key=lambda s: (min(map(len, s)), -len(s)))
    grams = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in chosen}
    return sorted((g for g in grams if not any(h < g for h in grams)), key=sorted)


def queries(scans: tuple[Scan, ...]) -> dict[int, list[frozenset[str]]]:
    return {k: q for k, s in enumerate(scans) if (q := trigram_query(s.source)) is not None}


_KEY = ["id", "h"]


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, id, h) of documents (id, h, t), written to the shared folder."""
    low = docs.select(*_KEY, F.lower("t").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return materialise(low.select(F.explode(held).alias("gram"), *_KEY))


def candidates(index: DataFrame, asked: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(id, h, rules): the bits of the rules whose trigram query a document meets."""
    terms = [(rule, c, g, 1 << n, (1 << len(conj)) - 1) for rule, conjs in asked.items() for c, conj in enumerate(conjs) for n, g in enumerate(sorted(conj))]
    # As many rows as the rules have trigrams, whatever the data.
    table = F.broadcast(index.sparkSession.createDataFrame(terms, "rule int, conj int, gram string, bit long, whole long"))
    met = index.join(table, "gram").groupBy(*_KEY, "rule", "conj").agg(F.bit_or("bit").alias("bits"), F.first("whole").alias("whole")).filter("bits = whole")
    return met.groupBy(*_KEY).agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Scan, ...] = BASE, added: tuple[Scan, ...] = ADDED) -> DataFrame:
    """(id, spans) with spans (start, rank, end, kind, text) by start, then rule: one row per row of docs."""
    scans = (*base, *added)
    asked = queries(scans)
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))
    open_ = [S.spans(F.col("t"), s.rule, k) for k, s in enumerate(scans) if k not in asked]
    scanned = plain.select(*_KEY, (F.concat(*open_) if open_ else S.no_spans()).alias("s0"))
    if not asked:
        return scanned.select("id", S.ordered(F.col("s0")).alias("spans"))
    index = build_index(plain, sorted({g for conjs in asked.values() for conj in conjs for g in conj}))
    often = {r.gram: r.n for r in index.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    anchors = sorted({min(sorted(conj), key=lambda g: often.get(g, 0)) for conjs in asked.values() for conj in conjs})
    anchored = F.lit(False)
    for g in anchors:
        anchored = anchored | F.contains(F.lower("t"), F.lit(g))
    likely = plain.filter(anchored)
    there = lambda k: F.expr(f"(rules & {1 << k}L) <> 0")
    both = likely.alias("d").join(candidates(index, asked).alias("c"), _same("d", "c"))
    some = [F.when(there(k), S.spans(F.col("d.t"), scans[k].rule, k)).otherwise(S.no_spans()) for k in asked]
    verified = both.select("d.id", "d.h", F.concat(*some).alias("s1")).filter("size(s1) > 0").dropDuplicates(_KEY)
    out = scanned.alias("d").join(verified.alias("c"), _same("d", "c"), "left")
    return out.select(F.col("d.id").alias("id"), S.ordered(F.col("s0"), F.coalesce(F.col("s1"), S.no_spans())).alias("spans"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans."""
    s = F.col("spans")
    counts = [S.number(s, x.rule.kind).alias(f"n_{x.rule.kind}") for x in BASE]
    base = F.sha2(S.joined(S.of_rank(s, len(BASE))), 256).alias("base_sha256")
    return find(docs, id_col, text_col).select(F.col("id").alias(id_col), *counts, base, S.joined(s).alias("spans"))




_RE2 = {
    "assign": (ASSIGN, f"length(regexp_extract(@, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8"),
    "access": ("AKIA[A-Z0-9]+", "length(@) >= 16"),
    "hex": ("[0-9a-f]{32,}", "true"),
    "github": ("gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    "chat": ("xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    "key": ("-----BEGIN (?:[A-Z]{2,10} ){0,2}PRIVATE KEY-----", "true"),
}
_LISTS = ", ".join(S.spans_sql("t", k, n, p, v) + f" AS s{n}" for n, (k, (p, v)) in enumerate(_RE2.items()))
_JOIN = "array_to_string(list_transform({}, lambda s: s.kind || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.\"end\" AS BIGINT)), ',')"
SQL = f"""
WITH f AS (SELECT doc_id, {_LISTS} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
o AS (SELECT doc_id, s0, s1, s2, list_sort(s0 || s1 || s2) AS base, list_sort(s0 || s1 || s2 || s3 || s4 || s5) AS every FROM f)
SELECT doc_id, len(s0) AS n_assign, len(s1) AS n_access, len(s2) AS n_hex, sha256({_JOIN.format("base")}) AS base_sha256, {_JOIN.format("every")} AS spans FROM o
"""
