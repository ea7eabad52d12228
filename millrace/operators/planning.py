"""Plans of generation: grids of tasks, round robins, subsets for prompts, trees. Draws are ranks of seeded hashes, so
they depend on keys and seeds alone, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: Column) -> Column:
    """A text that orders keys at random, the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))


def grid(df: DataFrame, **dimensions: list) -> DataFrame:
    """All combinations of the rows of df with the values of each dimension; narrow."""
    for name, values in dimensions.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def ranked(df: DataFrame, bucket: Column, order: list, name: str = "_k") -> DataFrame:
    """df with `name`, 0 onwards in the order of (bucket, order): rows are counted by bucket and ranked within buckets only."""
    marked = df.withColumn("__part", bucket)
    sizes = marked.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = marked.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return inside.join(before, "__part").withColumn(name, (F.col("__before") + F.col("__rank") - 1).cast("long")).drop("__part", "__rank", "__before")


def by_hash(df: DataFrame, key: Column, *ties: str) -> DataFrame:
    """df with `_k`, 0 onwards in the order of a hexadecimal hash, in 4096 buckets."""
    return ranked(df, F.substring(key, 1, 3), [key, *ties])


def shuffled(plan: DataFrame, seed: int) -> DataFrame:
    """plan with `_k`, 0 onwards, in a seeded random order over all its columns."""
    return by_hash(plan, draw(seed, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in plan.columns]), *plan.columns)


def round_robin(plan: DataFrame, n: int, seed: int) -> DataFrame:
    """n tasks: the shuffled plan, again and again; `task` counts from 0."""
    numbered = shuffled(plan, seed)
    size = plan.count()
    tasks = plan.sparkSession.range(n if size else 0).withColumnRenamed("id", "task")
    return tasks.withColumn("_k", F.col("task") % F.lit(max(size, 1))).join(numbered, "_k").drop("_k")


def paired(n: int, items: DataFrame, item_key: str, others: list[str]) -> DataFrame:
    """(pair, item, other): pair i has item i mod their number, in the order of their numeric key, and other i mod theirs."""
    indexed = ranked(items, F.coalesce(F.floor(F.col(item_key) / (1 << 16)), F.lit(-(1 << 62))), [item_key])
    size = items.count()
    pairs = items.sparkSession.range(n if size else 0).withColumnRenamed("id", "pair")
    joined = pairs.withColumn("_k", F.col("pair") % F.lit(max(size, 1))).join(indexed, "_k")
    return joined.withColumn("other", F.element_at(F.array(*[F.lit(o) for o in others]), (F.col("pair") % len(others) + 1).cast("int"))).drop("_k")


def subsets(calls: DataFrame, call: str, seeds: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """(call, key, nth): k seeds for each call, without replacement.

    Seeds are put in one seeded order and a call takes k neighbours from a place of its own in the circle, so no call is
    crossed with all seeds.
    """
    indexed = by_hash(seeds.select(key), draw(seed, F.col(key).cast("string")), key)
    size = seeds.count()
    start = F.conv(F.substring(draw(seed + 1, F.col(call).cast("string")), 1, 8), 16, 10).cast("long")
    wants = calls.select(call, F.explode(F.array(*[F.lit(j).cast("long") for j in range(min(k, size))]) if min(k, size) else F.expr("cast(array() as array<bigint>)")).alias("nth"), start.alias("_s"))
    return wants.withColumn("_k", (F.col("_s") + F.col("nth")) % F.lit(max(size, 1))).join(indexed, "_k").select(call, key, "nth")


def strategy(strategies: list[str], seed: int, key: Column, round_: int = 0) -> Column:
    """One of the strategies, drawn by key and round."""
    n = F.conv(F.substring(draw(seed, key, F.lit(str(round_))), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(s) for s in strategies]), (n % len(strategies) + 1).cast("int"))


def positions_in_turn(df: DataFrame, eligible: Column, pos: str = "_pos") -> DataFrame:
    """df with `_turn`: 0 onwards over the eligible rows in order, null for others.

    Counts by range of positions come first, so rows are ranked within ranges only.
    """
    span = 1 << 16
    marked = df.withColumns({"__ok": F.coalesce(eligible, F.lit(False)), "__part": F.floor(F.col(pos) / span)})
    sizes = marked.groupBy("__part").agg(F.count_if("__ok").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    ranked = marked.withColumn("__rank", F.sum(F.col("__ok").cast("long")).over(Window.partitionBy("__part").orderBy(pos)))
    return ranked.join(before, "__part").withColumn("_turn", F.when(F.col("__ok"), F.col("__before") + F.col("__rank") - 1)).drop("__ok", "__part", "__rank", "__before")


def in_turn(values: list[str], turn: Column) -> Column:
    """values by turn, again and again; null without a turn."""
    return F.when(turn.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in values]), (F.coalesce(turn, F.lit(0)) % len(values) + 1).cast("int")))


# --- trees


def tree_paths(levels: list[tuple[DataFrame, str, str | None, str]]) -> DataFrame:
    """(node_id, parent_id, depth, path) of a tree given level by level as (table, key, parent key, name).

    One equi-join per level carries the path down; node ids are `<depth>:<key>`.
    """
    out = here = None
    for depth, (t, key, parent, name) in enumerate(levels):
        own = F.concat(F.lit(f"{depth}:"), F.col(key).cast("string"))
        if parent is None:
            here = t.select(own.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(depth).alias("depth"), F.array(F.col(name)).alias("path"))
        else:
            rows = t.select(own.alias("node_id"), F.concat(F.lit(f"{depth - 1}:"), F.col(parent).cast("string")).alias("parent_id"), F.lit(depth).alias("depth"), F.col(name).alias("_name"))
            up = here.select(F.col("node_id").alias("parent_id"), F.col("path").alias("_path"))
            here = rows.join(up, "parent_id").select("node_id", "parent_id", "depth", F.concat("_path", F.array("_name")).alias("path"))
        out = here if out is None else out.unionByName(here)
    return out


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are no node's parent."""
    parents = nodes.select(F.col("parent_id").alias("node_id")).filter("node_id IS NOT NULL").distinct()
    return nodes.join(parents, "node_id", "left_anti")


def subspace(domain: str | Column, path: Column) -> Column:
    """`Domain 'd' where a=b, c=d` of an array of (dimension, attribute_value)."""
    domain = F.lit(domain) if isinstance(domain, str) else domain
    told = F.array_join(F.transform(path, lambda x: F.concat(x["dimension"], F.lit("="), x["attribute_value"])), ", ")
    return F.concat(F.lit("Domain '"), domain, F.lit("'"), F.when(F.size(path) > 0, F.concat(F.lit(" where "), told)).otherwise(F.lit("")))


def best_and_worst(df: DataFrame, group: str, score: str, value: str, key: str) -> DataFrame:
    """(group, chosen, rejected, scores): the best and worst scored of each group with two different scores, ties by key."""
    ordered = lambda sign: F.struct(F.col(score) * sign, -F.col(key))
    out = df.groupBy(group).agg(
        F.max_by(value, ordered(1)).alias("chosen"), F.max_by(value, ordered(-1)).alias("rejected"),
        F.max(score).cast("double").alias("chosen_score"), F.min(score).cast("double").alias("rejected_score"),
    )
    return out.filter("chosen_score > rejected_score")


def best_of(df: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """The k best scored rows of each group, ties by key. Ranks within hashed parts of a group come first."""
    order = [F.desc(score), F.col(key)]
    part = Window.partitionBy(group, F.pmod(F.xxhash64(key), F.lit(32))).orderBy(*order)
    few = df.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= k)
    return few.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= k).withColumnRenamed("__r", "rank")
