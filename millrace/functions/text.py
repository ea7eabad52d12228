"""Column expressions on texts with the semantics of Unicode-aware stripping, truthiness and JSON repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schema import truthy

#: What counts as white space at a text's ends; trim() only takes U+0020.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
STRIP = rf"\A{SPACE}+|{SPACE}+\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; an expression that a lambda refers to would be computed at each step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, STRIP, "")


def content(instruction="instruction", response="response", text="text", turns="turns") -> Column:
    """What filters look at: instruction, response and text where they aren't empty, then all turns, joined by blanks."""
    keep = lambda c: F.when(truthy(c), F.col(c))
    return F.concat_ws(" ", keep(instruction), keep(response), keep(text), F.array_join(F.transform(turns, lambda t: t["content"]), " "))


def prefix_key(c: Column, length: int = 50) -> Column:
    """The first `length` characters, stripped, in lower case."""
    return F.lower(strip(F.substring(c, 1, length)))


def shingles(c: Column) -> Column:
    """The set of a text's character trigrams (text stripped, lower case); a shorter text is its own only one."""

    def of(t: Column) -> Column:
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))
        return F.when(F.length(t) < 3, F.array(t)).otherwise(many)

    return let(strip(F.lower(c)), of)


def words(c: Column) -> Column:
    """Lower-case words: letters and digits, all else separates."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def word_ngrams(c: Column, n: int) -> Column:
    """The set of a text's word n-grams, joined by blanks; none if it has fewer words."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, F.array_distinct(many)).otherwise(F.expr("cast(array() as array<string>)"))

    return let(words(c), of)


def ngram_hashes(c: Column, n: int) -> Column:
    """Hashes of a text's word n-grams, repeats included: words are hashed once and neighbours' hashes combined."""

    def of(h: Column) -> Column:
        out = h
        for k in range(1, n):
            later = F.slice(h, k + 1, F.greatest(F.size(h) - k, F.lit(0)))
            out = F.zip_with(F.slice(out, F.lit(1), F.greatest(F.size(h) - k, F.lit(0))), later, lambda a, b: F.xxhash64(a, b))
        return out

    return let(F.transform(words(c), lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= n, of(h)).otherwise(F.expr("cast(array() as array<bigint>)")))


def unfenced(c: Column) -> Column:
    """Stripped; if it starts with a code fence, without the lines that are fences."""
    t = strip(c)
    lines = F.filter(F.split(t, "\n"), lambda line: ~F.startswith(strip(line), F.lit("```")))
    return F.when(F.startswith(t, F.lit("```")), F.array_join(lines, "\n")).otherwise(t)


#: A text that is one JSON value from end to end; the engine's parser passes over what follows a value.
WHOLE_JSON = r'(?s)\A(?:\{.*\}|\[.*\]|"(?:[^"\\]|\\.)*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)\z'


def json_value(c: Column) -> Column:
    """The JSON value of a text as a variant; null if it is none."""
    return F.when(c.rlike(WHOLE_JSON), F.try_parse_json(c))


def judge_score(c: Column) -> Column:
    """The score in [0, 1] of a judge's reply: `score` of a JSON object (0.5 if it has none), else by the first number.

    Numbers up to 1 count as they are, up to 5 by fifths, up to 10 by tenths; larger ones and replies without a number
    give 0.5. A reply that is a JSON value but no object has no score (null) and passes the threshold.
    """
    t = unfenced(c)
    v = json_value(t)
    kind = F.schema_of_variant(v)
    field = F.try_variant_get(v, "$.score", "string")
    missing = F.try_variant_get(v, "$.score", "variant").isNull()
    told = strip(field).try_cast("double")
    number = F.regexp_extract(t, r"(\d+\.?\d*)", 1).try_cast("double")
    loose = F.when(number.isNull(), 0.5).when(number <= 1, number).when(number <= 5, number / 5).when(number <= 10, number / 10).otherwise(0.5)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return (
        F.when(F.startswith(kind, F.lit("OBJECT")), F.when(missing, F.lit(0.5)).when(told.isNotNull(), clamp(told)).otherwise(clamp(loose)))
        .when(v.isNotNull(), F.lit(None).cast("double"))
        .otherwise(clamp(loose))
    )


def repaired_json(text: str):
    """The JSON value in a model's reply: whole, else its first object, else its first array, else a repaired cut-off one.

    For replies on the driver; the column form for scores is judge_score. Raises ValueError if nothing can be read.
    """
    import json

    t = text.strip()
    if t.startswith("```"):
        t = "\n".join(line for line in t.split("\n") if not line.strip().startswith("```")).strip()

    def attempt(s: str):
        try:
            return True, json.loads(s)
        except ValueError:
            return False, None

    for opening, closing in ((None, None), ("{", "}"), ("[", "]")):
        piece = t if opening is None else t[t.find(opening) : t.rfind(closing) + 1] if opening in t and closing in t else ""
        ok, value = attempt(piece)
        if ok:
            return value
    for cut in range(0, min(200, max(len(t), 1)), 10):
        piece = t[: len(t) - cut] if cut else t
        if cut and "," in piece:
            piece = piece[: piece.rfind(",")]
        # A quote left open hides the brackets after it; closing counts follow the plain brackets.
        closed = piece + "}" * max(0, piece.count("{") - piece.count("}")) + "]" * max(0, piece.count("[") - piece.count("]"))
        ok, value = attempt(closed)
        if ok:
            return value
    raise ValueError("no JSON value in the reply")


def repaired(c: Column) -> Column:
    """The JSON value in each reply by repaired_json, as JSON text; null where nothing can be read.

    Replies come from calls that take a thousand times as long, so the repair runs in Python, by batches.
    """
    import pandas as pd

    def run(replies):
        import json

        def one(t):
            try:
                return None if t is None else json.dumps(repaired_json(t), ensure_ascii=False)
            except ValueError:
                return None

        return replies.map(one)

    run.__annotations__ = {"replies": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(c)
