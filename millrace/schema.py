"""The unified sample schema: one row type for instruction, chat, preference, verifiable and plain-text data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
_TYPES: dict[str, T.DataType] = {
    **dict.fromkeys(["id", "instruction", "response", "system_prompt"], T.StringType()),
    "turns": TURNS,
    **dict.fromkeys(["text", "chosen", "rejected"], T.StringType()),
    **dict.fromkeys(["chosen_score", "rejected_score"], T.DoubleType()),
    **dict.fromkeys(["info", "domain", "topic", "persona", "task_type", "language", "variant", "formality"], T.StringType()),
    "difficulty": T.IntegerType(),
    "quality_score": T.DoubleType(),
    "quality_reason": T.StringType(),
    "safety_passed": T.BooleanType(),
    **dict.fromkeys(["generation_model", "source_id"], T.StringType()),
    "evolution_history": T.ArrayType(T.StringType()),
    "extra": T.StringType(),
}
SAMPLE = T.StructType([T.StructField(k, v, k not in ("id", "evolution_history", "extra")) for k, v in _TYPES.items()])
FIELDS = list(_TYPES)
ROLES = ("user", "assistant", "system")


def truthy(c: Column | str) -> Column:
    """Not null and not the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c != "", F.lit(False))


def has_content() -> Column:
    """A sample holds an instruction, turns or a text, be it empty."""
    return F.col("instruction").isNotNull() | F.col("turns").isNotNull() | F.col("text").isNotNull()


def as_samples(df: DataFrame, pos: Column | str | None = None) -> DataFrame:
    """Completes and casts df to the sample schema, other columns dropped; `_pos` is kept or taken from pos.

    Values that can't be cast become null. Missing ids are hashes of the content and the position, so that recomputing
    a lost partition gives the same ids.
    """
    have = set(df.columns)

    def field(name: str) -> Column:
        kind = _TYPES[name]
        if name not in have:
            return F.lit(None).cast(kind)
        if df.schema[name].dataType == kind:
            return F.col(name)
        if isinstance(kind, T.ArrayType):
            # A file in which a list is null throughout is read with a text there.
            return F.col(name).cast(kind) if isinstance(df.schema[name].dataType, T.ArrayType) else F.from_json(F.col(name).cast("string"), kind)
        return F.col(name).try_cast(kind)

    place = pos if isinstance(pos, Column) else F.col(pos or "_pos") if (pos or "_pos") in have else F.lit(None).cast("long")
    out = df.select(*[field(n).alias(n) for n in FIELDS], place.cast("long").alias("_pos"))
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in ("instruction", "response", "text", "chosen", "rejected")], F.coalesce(F.to_json("turns"), F.lit("")), F.col("_pos").cast("string"))
    return out.withColumns({
        "id": F.coalesce("id", F.md5(key)),
        "evolution_history": F.coalesce("evolution_history", F.array().cast("array<string>")),
        "extra": F.coalesce("extra", F.lit("{}")),
    })


def with_positions(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds `_pos`, 0 onwards, by the given order. Positions are assigned by range partition and prefix sum.

    The ordered rows are written to Spark's checkpoint first, since range bounds are drawn anew whenever the plan runs.
    """
    ordered = df.repartitionByRange(*[F.col(o) if isinstance(o, str) else o for o in order]).sortWithinPartitions(*order)
    numbered = ordered.withColumn("__n", F.monotonically_increasing_id()).checkpoint()
    numbered = numbered.withColumns({"__p": F.shiftright("__n", 33), "__i": F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = numbered.groupBy("__p").agg(F.count("*").alias("__c"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(before.select("__p", "__b"), "__p").withColumn("_pos", F.col("__b") + F.col("__i")).drop("__n", "__p", "__i", "__b")
