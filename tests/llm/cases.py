"""Awkward documents for every operator: nulls, empties, ties, repeated rows, long texts, extra and clashing columns."""

import random

LONG = " ".join(f"w{k % 997}x{k % 13}" for k in range(20_000))
WORDS = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    out = [
        (0, None, None, None), (1, "", "en", "a"), (2, " \t\n\x0b\x0c\r ", "en", "a"), (3, "One", "en", None), (4, "one", "de", "a"), (5, "two words", None, "b"),
        (6, LONG, "en", "a"), (7, LONG, "en", "a"), (7, LONG, "en", "a"), (None, "an id that is null", "en", "b"), (None, "an id that is null", "en", "b"), (None, None, None, None),
        (8, "ÀÉ ünïcode wörds 日本語 😀 end", "fr", "é"), (9, "12345 67890 --- !!!", "en", "a"), (10, "a\x00b \x1c \x85 c", "en", "z"), (11, "1" * 5000 + "." + "2" * 5000, "en", "z"),
    ]
    out += [(100 + k, prose(k % 30, 40 + k % 7), ("en", "fr", None)[k % 3], f"s{k % 4}") for k in range(80)]
    return out


SCHEMA = "doc_id bigint, text string, lang string, source string"


def documents(spark, clash: bool = True):
    """The rows, with columns named like what operators add."""
    df = spark.createDataFrame(rows(), SCHEMA)
    if clash:
        for c in ("n_words", "score", "fp", "h", "id", "t", "size", "c0", "k0", "spans", "key", "salt", "root", "kept"):
            df = df.selectExpr("*", f"'clash' AS `{c}`")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
