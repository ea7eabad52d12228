"""Reports: population, distributions, order statistics, coverage, validation, rejections, cost."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.filters import REASON
from millrace.operators.mapping import failure
from millrace.schema import truthy

POPULATION = ("instruction", "response", "system_prompt", "turns", "text", "quality_score", "domain", "topic", "language", "difficulty")


def population(samples: DataFrame, fields: tuple[str, ...] = POPULATION) -> DataFrame:
    """(field, filled, total): one scan, one aggregate row, unpivoted."""
    row = samples.agg(F.count("*").alias("total"), *[F.count(f).alias(f) for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])
    return row.select("total", F.explode(pairs).alias("x")).select("x.field", "x.filled", "total")


def distributions(samples: DataFrame, fields: tuple[str, ...] = ("language", "task_type", "difficulty")) -> DataFrame:
    """(field, value, n) of non-null values: all histograms from one scan by grouping sets."""
    cast = samples.select(*[F.col(f).cast("string").alias(f) for f in fields])
    which = F.coalesce(*[F.when(F.grouping(f) == 0, F.lit(f)) for f in fields])
    value = F.coalesce(*[F.when(F.grouping(f) == 0, F.col(f)) for f in fields])
    counted = cast.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields]).agg(F.count("*").alias("n"), which.alias("field"), value.alias("value"))
    return counted.filter("value IS NOT NULL").select("field", "value", "n")


def top(df: DataFrame, field: str, k: int, pos: str = "_pos") -> DataFrame:
    """The k most frequent truthy values (value, n), those seen first before others of equal number."""
    return df.filter(truthy(field)).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"), F.min(pos).alias("__first")).orderBy(F.desc("n"), "__first").limit(k).select("value", "n")


def order_statistics(df: DataFrame, value: str, by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """(by..., n, mean, median, p10, p90) of non-null values, each an element of the sorted values: at n div 2 (the upper
    median), n div 10 - 1 (0 at least) and 9 n div 10.

    Distinct values are counted first and running counts pick the elements, so what is sorted is the number of
    distinct values, not of rows.
    """
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    along = Window.partitionBy(*by).orderBy("__v")
    placed = counts.withColumns({"__to": F.sum("__n").over(along), "__all": F.sum("__n").over(Window.partitionBy(*by))})
    at = lambda index: F.round(F.min(F.when(F.col("__to") > index, F.col("__v"))), digits)
    n = F.col("__all")
    return placed.groupBy(*by).agg(
        F.max("__all").alias("n"),
        F.round(F.sum(F.col("__v") * F.col("__n")) / F.sum("__n"), digits).alias("mean"),
        at(F.floor(n / 2)).alias("median"), at(F.greatest(F.floor(n / 10) - 1, F.lit(0))).alias("p10"), at(F.least(n - 1, F.floor(9 * n / 10))).alias("p90"),
    )


def inspect(samples: DataFrame) -> dict:
    """Counts, field population and distributions of a dataset, for programs."""
    fields = ("instruction", "response", "quality_score", "domain", "language")
    rows = population(samples, fields).collect()
    out: dict = {"samples": rows[0].total if rows else 0, "fields": {r.field: r.filled for r in rows}, "distributions": {}}
    for r in distributions(samples).collect():
        out["distributions"].setdefault(r.field, {})[r.value] = r.n
    return out


def preview(samples: DataFrame, k: int = 5) -> list[str]:
    rows = samples.orderBy("_pos").limit(k).select(F.coalesce(F.when(truthy("instruction"), F.col("instruction")), F.when(truthy("text"), F.col("text")), F.lit("(no text)")).alias("t")).collect()
    return [r.t[:80] + ("..." if len(r.t) > 80 else "") for r in rows]


def described(samples: DataFrame, k: int = 5, size: int | None = None, name: str = "dataset") -> str:
    """The inspection as text."""
    rows = population(samples).collect()
    total = rows[0].total if rows else 0
    out = [f"{name}: {total:,} samples" + (f", {size / 2**20:.1f} MB" if size is not None else ""), "", "filled"]
    out += [f"  {r.field:<15}{r.filled:>10,}  {100 * r.filled / total if total else 0:5.1f} %" for r in rows]
    out += ["", "most frequent"]
    for field in ("language", "task_type", "difficulty"):
        found = top(samples.withColumn(field, F.col(field).cast("string")), field, 5).collect()
        if found:
            out.append(f"  {field:<12}" + ", ".join(f"{r.value} {r.n}" for r in found))
    q = order_statistics(samples, "quality_score", digits=2).collect()
    if q:
        out += ["", f"quality: mean {q[0].mean:.2f}, median {q[0].median:.2f}, p10 {q[0].p10:.2f}, p90 {q[0].p90:.2f}"]
    return "\n".join([*out, "", *(f"  {i}. {t}" for i, t in enumerate(preview(samples, k), 1))])


# --- health


def coverage(samples: DataFrame) -> DataFrame:
    """(dimension, value, n) of topics, task types, languages and difficulties that samples have."""
    some = samples.select(F.when(truthy("topic"), F.col("topic")).alias("topic"), F.when(truthy("task_type"), F.col("task_type")).alias("task_type"), F.when(truthy("language"), F.col("language")).alias("language"), "difficulty")
    return distributions(some, ("topic", "task_type", "language", "difficulty")).withColumnRenamed("field", "dimension")


def skew(samples: DataFrame, most: float = 0.7) -> DataFrame:
    """One row (easy, total, share, skewed): the share of difficulties 1 and 2."""
    d = samples.filter(F.col("difficulty").isNotNull())
    row = d.agg(F.count_if(F.col("difficulty").isin(1, 2)).alias("easy"), F.count("*").alias("total"))
    share = F.when(F.col("total") > 0, F.col("easy") / F.col("total")).otherwise(F.lit(0.0))
    return row.select("easy", "total", F.round(share, 4).alias("share"), (share > most).alias("skewed"))


def missing_topics(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Target topics (column topic) that no sample has."""
    return targets.select("topic").distinct().join(samples.select("topic").distinct(), "topic", "left_anti")


def health(samples: DataFrame, target_topics: list[str] | None = None) -> dict:
    """Coverage, quality, safety, diversity and warnings of a dataset."""
    counts = samples.agg(
        F.count("*").alias("n"), F.count_if(~F.col("safety_passed")).alias("blocked"),
        F.count_if(F.coalesce(F.get_json_object("extra", "$.template_collapse"), F.lit("")).isin("true", "1")).alias("collapsed"),
    ).first()
    seen: dict[str, dict] = {}
    for r in coverage(samples).collect():
        seen.setdefault(r.dimension, {})[r.value] = r.n
    quality = order_statistics(samples, "quality_score").collect()
    easy = skew(samples).first()
    warnings = []
    if target_topics:
        absent = len(set(target_topics) - set(seen.get("topic", {})))
        if absent:
            warnings.append(f"{absent} target topics have zero coverage")
    if easy.skewed:
        warnings.append(f"difficulty is skewed: {100 * easy.easy / easy.total:.0f}% at levels 1 and 2")
    levels = seen.get("difficulty", {})
    return {
        "total_samples": counts.n,
        "coverage": {
            "topics": {"found": len(seen.get("topic", {})), "distribution": {r.value: r.n for r in top(samples, "topic", 10).collect()}},
            "task_types": seen.get("task_type", {}), "languages": seen.get("language", {}),
            "difficulty_distribution": {k: levels[k] for k in sorted(levels, key=int)},
        },
        "quality": {k: quality[0][k] for k in ("mean", "median", "p10", "p90")} if quality else {},
        "safety": {"blocked": counts.blocked}, "diversity": {"template_collapse_flagged": counts.collapsed}, "warnings": warnings,
    }


def save_health(report: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(report, indent=2), encoding="utf-8")


def scarce_topics(samples: DataFrame, share: float = 0.1) -> DataFrame:
    """Topics (topic, n) among the rarest `share` of topics."""
    n = samples.filter(truthy("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy("n", "topic"))
    total = F.count("*").over(Window.partitionBy())
    return n.withColumns({"__r": rank, "__t": total}).filter(F.col("__r") <= F.ceil(F.col("__t") * share)).select("topic", "n")


# --- validation


def validated(samples: DataFrame, layout: str) -> DataFrame:
    """samples with `why` they don't fit the layout, null if they do."""
    return samples.withColumn("why", failure(layout))


def validate(samples: DataFrame, layout: str, most: int = 20, strict: bool = False) -> dict:
    """Counts of fitting and failing samples and the first errors. strict also fails repeated samples and responses that
    repeat their instruction."""
    marked = validated(samples, layout)
    if strict:
        key = F.sha2(F.to_json(F.struct("instruction", "response", "turns", "text", "chosen", "rejected", "info")), 256)
        first = marked.groupBy(key.alias("__k")).agg(F.min("_pos").alias("__first"))
        marked = marked.withColumn("__k", key).join(first, "__k")
        same = F.coalesce(F.col("instruction") == F.col("response"), F.lit(False))
        marked = marked.withColumn("why", F.coalesce("why", F.when(same, "response equals instruction"), F.when(F.col("_pos") > F.col("__first"), "duplicate")))
    counts = marked.agg(F.count("*").alias("total"), F.count("why").alias("failed")).first()
    errors = marked.filter("why IS NOT NULL").orderBy("_pos").limit(most).select("_pos", "id", "why").collect()
    return {"total": counts.total, "passed": counts.total - counts.failed, "failed": counts.failed, "errors": [{"row": r["_pos"], "id": r.id, "reason": r.why} for r in errors]}


def rejections(df: DataFrame) -> DataFrame:
    """(reason, n, pct of all rows, 1 decimal), 'passed' for survivors."""
    n = df.groupBy(F.coalesce(F.col(REASON), F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


# --- cost


def price(model: str, prices: dict[str, tuple[float, float]], overrides: dict[str, tuple[float, float]] | None = None) -> tuple[float, float] | None:
    """Prices per token in and out: an override (given per million), the name, without its tag or provider, any provider's."""
    if overrides and model in overrides:
        return overrides[model][0] / 1e6, overrides[model][1] / 1e6
    short = model.rpartition("/")[2]
    for name in (model, model.partition(":")[0], short, short.partition(":")[0]):
        if name in prices:
            return prices[name]
    return next((p for k, p in prices.items() if k.endswith("/" + short)), None)


def cost(usage: DataFrame, price_in: Column | None, price_out: Column | None) -> DataFrame:
    """(stage, prompt_tokens, completion_tokens, cost, pct) by stage and for all ('total'), by ROLLUP.

    Stage costs are rounded to 4 digits, the total from unrounded ones; without prices costs are null.
    """
    none = F.lit(None).cast("double")
    money = none if price_in is None or price_out is None else F.col("prompt_tokens") * price_in + F.col("completion_tokens") * price_out
    rows = usage.withColumn("__money", money).rollup("stage").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("__money"), 4).alias("cost"), F.grouping("stage").alias("__all"))
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    whole = F.greatest(F.max(F.when(F.col("__all") == 1, tokens)).over(Window.partitionBy()), F.lit(1))
    return rows.select(F.when(F.col("__all") == 1, "total").otherwise(F.col("stage")).alias("stage"), "prompt_tokens", "completion_tokens", "cost", F.round(100.0 * tokens / whole, 1).alias("pct"))


def cost_lines(costs: DataFrame) -> list[str]:
    """The report of `cost` as text: a line for each stage with its tokens, their share and its cost, by tokens, and the total."""
    rows = sorted(costs.collect(), key=lambda r: (r.stage == "total", -(r.prompt_tokens + r.completion_tokens), r.stage or ""))
    money = lambda r: "cost unknown" if r.cost is None else f"${r.cost:.4f}"
    tokens = lambda r: f"{r.stage}: {r.prompt_tokens + r.completion_tokens} tokens"
    return [f"{tokens(r)}, {money(r)}" if r.stage == "total" else f"{tokens(r)} ({r.pct:.1f} %), {money(r)}" for r in rows]


def estimate(n: int, factor: float = 1.0, evolve: bool = False, responses: bool = True, quality: bool = False, per_call: int = 1000) -> dict:
    """Calls and tokens that a run would take."""
    samples = math.ceil(n * factor)
    stages = 1 + evolve + responses + quality
    return {"samples": samples, "calls": samples * stages, "tokens": samples * stages * per_call}


# --- comparison and gaps


def gaps(samples: DataFrame, a: str, b: str, least: int = 1) -> DataFrame:
    """(a, b, n) of combinations of values seen in either column that fewer than `least` samples have.

    The grid is of distinct values, whose numbers are those of the dimensions.
    """
    seen = samples.groupBy(a, b).agg(F.count("*").alias("n"))
    left, right = (seen.filter(F.col(c).isNotNull()).select(c).distinct() for c in (a, b))
    return left.crossJoin(right).join(seen, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0).cast("long")).alias("n")).filter(F.col("n") < least)


def language_gaps(samples: DataFrame, language: str, dimension: str) -> DataFrame:
    """(language, dimension, n, missing): what each language lacks of the language that has most, per dimension."""
    n = samples.groupBy(language, dimension).agg(F.count("*").alias("n"))
    return n.withColumn("missing", F.max("n").over(Window.partitionBy(dimension)) - F.col("n"))


def compare(a: DataFrame, b: DataFrame, dimension: str, quality: str | None = None) -> DataFrame:
    """(value, n_a, n_b, delta of mean quality): a full outer join of two datasets' histograms."""
    mean = lambda: F.avg(quality) if quality else F.lit(None).cast("double")
    left = a.groupBy(F.col(dimension).alias("value")).agg(F.count("*").alias("n_a"), mean().alias("qa"))
    right = b.groupBy(F.col(dimension).alias("value")).agg(F.count("*").alias("n_b"), mean().alias("qb"))
    zero = F.lit(0).cast("long")
    return left.join(right, left["value"].eqNullSafe(right["value"]), "full").select(F.coalesce(left["value"], right["value"]).alias("value"), F.coalesce("n_a", zero).alias("n_a"), F.coalesce("n_b", zero).alias("n_b"), F.round(F.col("qb") - F.col("qa"), 4).alias("delta"))
