"""Filters: stages that add a nullable `reject_reason` and remove nothing, so that survivors and counts share one plan.

The first filter that rejects a row gives its reason. A stage is a function from DataFrame to DataFrame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import resources
from millrace.functions import text as X
from millrace.schema import truthy

REASON = "reject_reason"


def _with_reason(df: DataFrame, rejected: Column, reason: str | Column) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    new = F.when(rejected, reason)
    return df.withColumn(REASON, F.coalesce(F.col(REASON), new) if REASON in df.columns else new)


def survivors(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNull()).drop(REASON)


def holds_any(text: Column, phrases: list[str], word_boundary: bool = False) -> Column:
    """Whether a text holds one of the phrases, letter case ignored; as substrings unless word_boundary."""
    if not phrases:
        return F.lit(False)
    low = F.lower(text)
    if word_boundary:
        import re

        return low.rlike(r"(?<!\w)(?:" + "|".join(re.escape(p.lower()) for p in sorted(phrases)) + r")(?!\w)")
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p.lower())) for p in sorted(phrases)])


def safety(df: DataFrame, words: list[str] | None = None, preset: str | None = None, text: Column | None = None, word_boundary: bool = False, match_topics: bool = False) -> DataFrame:
    """Rejects samples that hold a universally blocked phrase or a blocked word; sets safety_passed.

    match_topics also rejects samples whose topic is one of the preset's blocked topics.
    """
    told = resources.preset(preset)
    text = X.content() if text is None else text
    bad = holds_any(text, list(resources.BLOCKED)) | holds_any(text, [*(words or []), *told["blocklist_words"]], word_boundary)
    if match_topics and told["blocklist_topics"]:
        bad = bad | F.coalesce(F.col("topic").isin(told["blocklist_topics"]), F.lit(False))
    bad = F.coalesce(bad, F.lit(False))
    out = _with_reason(df, bad, "safety_blocked")
    return out.withColumn("safety_passed", ~bad)


def empty_response(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Rejects samples with an instruction and no response."""
    return _with_reason(df, truthy("instruction") & ~truthy("response") if enabled else F.lit(False), "empty_response")


def quality_threshold(df: DataFrame, least: float = 0.7, score: str = "quality_score") -> DataFrame:
    """Rejects scored samples below the threshold; unscored ones pass."""
    return _with_reason(df, F.coalesce(F.col(score) < least, F.lit(False)), "low_quality")


def collapse(df: DataFrame, action: str = "report", length: int = 50, most: int = 3, text: Column | None = None, pos: str = "_pos") -> DataFrame:
    """Texts that begin alike. A prefix (first `length` characters, stripped, lower case) collapses if more than `most`
    samples share it. remove: all but the first `most` are rejected; flag: all get extra.template_collapse; any other
    action leaves the samples alone.

    The prefix is counted before rows are ranked and only collapsing prefixes are: the counts are aggregated map-side,
    and one hot prefix doesn't bring its rows into a task unless it is removed by rank.
    """
    if action not in ("remove", "flag"):
        return _with_reason(df, F.lit(False), "template_collapse")
    text = F.coalesce(F.when(truthy("response"), F.col("response")), F.when(truthy("text"), F.col("text")), F.lit("")) if text is None else text
    keyed = df.withColumn("__prefix", X.prefix_key(text, length))
    counts = keyed.groupBy("__prefix").agg(F.count("*").alias("__n")).filter((F.col("__n") > most) & (F.col("__prefix") != ""))
    if action == "flag":
        marked = keyed.join(counts, "__prefix", "left")
        extra = F.from_json("extra", "map<string,string>")
        flagged = F.to_json(F.map_concat(F.map_filter(extra, lambda k, _: k != "template_collapse"), F.create_map(F.lit("template_collapse"), F.lit("true"))))
        return _with_reason(marked.withColumn("extra", F.when(F.col("__n").isNotNull(), flagged).otherwise(F.col("extra"))), F.lit(False), "template_collapse").drop("__prefix", "__n")
    # The first `most` of each collapsing prefix: ranks within hashed parts first, then among what is left of them.
    hot = keyed.join(counts, "__prefix", "left_semi").select("__prefix", F.col(pos).alias("__pos"), F.pmod(F.xxhash64(pos), F.lit(64)).alias("__part"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("__pos"))
    few = hot.withColumn("__r", rank("__prefix", "__part")).filter(F.col("__r") <= most)
    edge = few.withColumn("__r", rank("__prefix")).filter(F.col("__r") == most).select("__prefix", F.col("__pos").alias("__last"))
    return _with_reason(keyed.join(edge, "__prefix", "left"), F.coalesce(F.col(pos) > F.col("__last"), F.lit(False)), "template_collapse").drop("__prefix", "__last")


def exact_duplicates(df: DataFrame, text: Column, pos: str = "_pos") -> DataFrame:
    """Rejects all but the first of equal texts. Texts are compared by their 256-bit digests, so none is shuffled for that."""
    keyed = df.withColumn("__digest", F.sha2(text, 256))
    first = keyed.groupBy("__digest").agg(F.min(pos).alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    out = keyed.join(first, "__digest", "left")
    return _with_reason(out, F.coalesce(F.col(pos) > F.col("__first"), F.lit(False)), "duplicate").drop("__digest", "__first")


#: Benchmark n-grams up to which all tasks get them.
FEW_GRAMS = 1 << 20


def contamination(df: DataFrame, benchmark: DataFrame, text: Column, benchmark_text: Column, n: int = 8, pos: str = "_pos") -> DataFrame:
    """Rejects samples that share a word n-gram with a benchmark item: a semi join on hashes of n-grams, then ids.

    The benchmark's n-grams are counted and broadcast up to FEW_GRAMS of them, so that those of samples don't move;
    more are joined by a shuffle.
    """
    from millrace.operators.dedup import settled

    grams = lambda t: F.explode(X.ngram_hashes(t, n)).alias("g")
    theirs = settled(benchmark.select(grams(benchmark_text)).distinct())
    theirs = F.broadcast(theirs) if theirs.count() <= FEW_GRAMS else theirs
    hit = df.select(F.col(pos).alias("__hit"), grams(text)).join(theirs, "g", "left_semi").select("__hit").distinct()
    out = df.join(hit, F.col(pos) == F.col("__hit"), "left")
    return _with_reason(out, F.col("__hit").isNotNull(), "contaminated").drop("__hit")


def structure(df: DataFrame) -> DataFrame:
    """Strict checks: turns alternate between user and assistant after an optional system turn, none is empty, and a
    response doesn't repeat its instruction."""
    turns = F.filter("turns", lambda t: t["role"] != "system")
    expected = F.transform(turns, lambda t, i: t["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    uneven = F.exists(expected, lambda ok: ~ok) | F.exists(F.slice("turns", 2, F.greatest(F.size("turns"), F.lit(1))), lambda t: t["role"] == "system")
    blank = F.exists("turns", lambda t: X.strip(t["content"]) == "")
    out = _with_reason(df, F.coalesce(blank, F.lit(False)), "empty_turn")
    out = _with_reason(out, F.coalesce(uneven, F.lit(False)), "roles_out_of_turn")
    return _with_reason(out, F.coalesce(X.strip(F.col("response")) == X.strip(F.col("instruction")), F.lit(False)), "response_is_instruction")
