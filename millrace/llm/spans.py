"""Spans of regular expressions as DataFrame expressions, with starts and ends in code points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose places are summed one by one; longer lists are cut into blocks of so many.
_BLOCK = 64


@dataclass(frozen=True)
class Rule:
    """A kind of span: a Java pattern, what each match must fulfil, and a cheap necessary condition on the whole text.

    A dropped match still uses up its text, as the contracts of the operators ask for.
    """

    kind: str
    pattern: str
    valid: Callable[[Column], Column]
    needs: Callable[[Column], Column] | None = None
    #: A Java pattern of words that count when they stand within `NEAR` characters of a match, in lower case.
    context: str | None = None


#: Characters before and after a match, up to the kind's next matches, that are its context.
NEAR = 48
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,text:string,near:boolean>>"


def no_spans() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def running(lengths: Column) -> Column:
    """Prefix sums of an array of integers, in blocks, so that the work stays near the array's length."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))

    def inside(blocks: Column) -> Column:
        return let(
            F.transform(blocks, _total),
            lambda sums: F.flatten(F.transform(blocks, lambda block, k: let(_total(F.slice(sums, F.lit(1), k)), lambda base: F.transform(block, lambda _, i: base + _total(F.slice(block, F.lit(1), i + 1)))))),
        )

    return let(cut, inside)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Valid matches of a rule in a text: leftmost, not overlapping; (start, rank, end, kind, text, near).

    Matches and the stretches between them alternate, so a match ends where the lengths so far end. Texts without a
    match are told by one search.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    inside = lambda c: F.lower(c).rlike(rule.context)

    def located(matches: Column) -> Column:
        def told(m: Column, before: Column, after: Column) -> Column:
            """A match and whether a word of its context is near; null where the match isn't valid."""
            near = F.lit(False) if rule.context is None else inside(F.right(before, F.lit(NEAR))) | inside(F.left(after, F.lit(NEAR)))
            return F.struct(m.alias("m"), F.when(rule.valid(m), near).alias("n"), (F.length(before) + F.length(m)).alias("step"))

        def placed(gaps: Column) -> Column:
            around = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), F.slice(gaps, F.lit(2), F.size(matches)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            every = F.zip_with(matches, around, lambda m, x: told(m, x["a"], x["b"]))
            return let(every, lambda xs: F.zip_with(running(F.transform(xs, lambda x: x["step"])), xs, lambda end, x: F.struct((end - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), x["m"].alias("text"), x["n"].alias("near"))))

        return F.filter(let(F.split(text, rule.pattern, -1), placed), lambda s: s["near"].isNotNull())

    there = text.rlike(rule.pattern)
    if rule.needs is not None:
        there = rule.needs(text) & there
    return F.when(there, let(found, located)).otherwise(no_spans())


def ordered(*lists: Column) -> Column:
    """All spans by start, then rank."""
    return F.array_sort(F.concat(*lists))


def joined(spans_: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_rank(spans_: Column, below: int) -> Column:
    return F.filter(spans_, lambda s: s["rank"] < below)


def number(spans_: Column, kind: str) -> Column:
    return F.size(F.filter(spans_, lambda s: s["kind"] == kind)).cast("long")


def spans_sql(text: str, kind: str, rank: int, pattern: str, valid: str) -> str:
    """DuckDB SQL for the list of valid matches {start, rank, end, kind, text}; `valid` is a condition on m, `pattern` in RE2."""
    quoted = pattern.replace("'", "''")
    found, gaps = f"regexp_extract_all({text}, '{quoted}')", f"string_split_regex({text}, '{quoted}')"
    steps = f"list_transform({found}, lambda m, i: length({gaps}[i]) + length(m))"
    placed = f"list_transform({found}, lambda m, i: {{'start': list_sum({steps}[1:i]) - length(m), 'rank': {rank}, 'end': list_sum({steps}[1:i]), 'kind': '{kind}', 'text': m}})"
    return f"list_filter({placed}, lambda s: {valid.replace('@', 's.text')})"
