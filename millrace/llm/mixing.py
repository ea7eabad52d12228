"""Mixing sources to target weights by systematic sampling (operator 2).

Each document of a source expects target / source_size copies. Documents of a source are put into one order, expected
copies are summed along it from one random offset, and a document is emitted once for each integer boundary that its
stretch crosses: its copies are the rounding up or down of what it expects, two at most. The order goes by size, finest
where it matters: by size class (16 classes an octave), then by a hash of id and text, so that every stretch of similar
sizes gives its share and the words taken miss the target by about one document.

No source is put in order by one task. Documents are counted by (source, size class, hash bucket); the counts, whose
number depends on sources and classes and not on documents, are summed along the order, and documents are ranked within
their cell only, by a shuffle of ids and sizes without texts. A hot source or size spreads over CELLS cells, by id and
text, so that null ids or one repeated id spread as well.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in the
order of weights; a source without words has target 0; repeated rows are ranked one by one; documents with null ids are
ranked like others, by their texts; an empty table gives no rows; columns besides id, text and source are ignored by `mix` and kept by
`sampled`. All numbers depend on ids, sizes and sources alone, so reruns agree.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import arrow_columns, materialise, word_counts

WEIGHTS = (5, 2, 1)
#: Share of all words to take, and the limit on each source as a multiple of its size.
SHARE, LIMIT = 1.5, 2.0
#: Hash buckets by which a size class of a source is cut.
CELLS = 256
SEED = 20


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Weights repeat over the sources by code point, null last. Sharing again what exceeds the limits ends where each
    source has min(limit * size, level * weight); the level follows from the sources in order of the level at which
    they reach their limit. Windows over the table of sources, one row each.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    t = sizes.withColumn("w", w).withColumn("cap", F.lit(float(limit)) * F.col("source_size")).withColumn("full", F.col("cap") / F.col("w"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("free", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("capped")) / F.col("free"))
    # The first source in this order whose limit isn't reached fixes the level; if all are at their limit, none does.
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def size_class(size: Column) -> Column:
    """Sizes below 32 one by one, above in 16 classes an octave."""
    octave = (F.length(F.bin(size)) - 1).cast("long")
    step = F.expr("size * 16 DIV shiftleft(1L, length(bin(size)) - 1)")
    return F.when(size < 32, size).otherwise(octave * 16 + step).cast("long")


def source_key(source: Column) -> Column:
    """A non-null text that tells null from every source."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def offset(key: Column, seed: int = SEED) -> Column:
    """One number in [0, 1) for each source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, cells: int) -> DataFrame:
    """id, source, text hash and size of each row and its place in the order: src, class, place, cell. Written down; narrow."""
    text = F.col(f"`{text_col}`")
    work = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), _hash(text).alias("h"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"), text.alias("t"))
    factory = lambda: lambda batch: [pa.array(word_counts(batch.column(0)))]
    sized = arrow_columns(work, factory, T.StructType([T.StructField("size", T.LongType())]), ["id", "source", "h", "digest"], ["t"])
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("digest")))
    keyed = sized.withColumns({"src": source_key(F.col("source")), "class": size_class(F.col("size")), "place": place})
    return materialise(keyed.drop("digest").withColumn("cell", F.pmod(F.conv(F.substring("place", 1, 4), 16, 10).cast("long"), F.lit(cells))))


def _copies(keyed: DataFrame, counted: DataFrame, weights, share, limit, seed) -> DataFrame:
    sizes = counted.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = targets(sizes, weights, share, limit).withColumn("src", source_key(F.col("source"))).drop("source")
    along = Window.partitionBy("src").orderBy("class", "cell")
    starts = counted.select("src", "class", "cell", (F.sum("n").over(along) - F.col("n")).alias("before")).join(goals, "src")
    rank = F.row_number().over(Window.partitionBy("src", "class", "cell").orderBy("place"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at, u = F.col("before") + F.col("rank"), offset(F.col("src"), seed)
    copies = (F.floor(u + at * each) - F.floor(u + (at - 1) * each)).cast("long")
    return keyed.withColumn("rank", rank.cast("long")).join(starts, ["src", "class", "cell"]).withColumn("copies", copies)


def _counted(keyed: DataFrame) -> DataFrame:
    return materialise(keyed.groupBy("src", "source", "class", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words")))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, limit, seed, cells) -> DataFrame:
    keyed = _keys(docs, id_col, text_col, source_col, seed, cells)
    return _copies(keyed, _counted(keyed), weights, share, limit, seed)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken): one row per row of docs."""
    out = _mixed(docs, id_col, text_col, source_col, weights, share, limit, seed, cells)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs.

    Copies are joined to the rows by id, source and text hash, which shuffles texts once and doesn't pass them through
    Python. Rows that agree in all three share their copies evenly, in turn by a hash of their columns.
    """
    name = lambda i, s, h: F.concat_ws(":", i.cast("string"), F.coalesce(i.isNull(), F.lit(True)).cast("string"), h.cast("string"), source_key(s))
    out = _mixed(docs, id_col, text_col, source_col, weights, share, limit, seed, cells)
    taken = out.groupBy(name(F.col("id"), F.col("source"), F.col("h")).alias("key")).agg(F.sum("copies").alias("total"), F.count("*").alias("rows")).filter("total > 0")
    by_row = F.xxhash64(*[F.col(f"k{i}") for i, f in enumerate(docs.schema) if "map<" not in f.dataType.simpleString()])
    work = docs.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(docs.columns)], name(F.col(f"`{id_col}`"), F.col(f"`{source_col}`").cast("string"), _hash(F.col(f"`{text_col}`"))).alias("key"))
    joined = work.join(taken, "key").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(by_row)).cast("long"))
    copies = F.expr("nth * total DIV rows - (nth - 1) * total DIV rows").cast("int")
    emitted = joined.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return emitted.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(docs.columns)])


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
placed AS (
  SELECT *, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest) AS place, len(bin(size)) - 1 AS octave FROM sized),
celled AS (
  SELECT *, CASE WHEN size < 32 THEN size ELSE octave * 16 + size * 16 // (1::BIGINT << octave) END AS class,
    CAST('0x' || substr(place, 1, 4) AS BIGINT) % {CELLS} AS cell FROM placed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, cell, place) AS nth FROM celled),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sizes),
levels AS (
  SELECT *, cap / w AS "full", sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS free, coalesce(sum(cap) OVER b, 0) AS capped,
    1.5::DOUBLE * sum(source_size) OVER () AS wanted
  FROM weighed WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((wanted - capped) / free, "full") AS level FROM levels WHERE (wanted - capped) / free <= "full"),
goals AS (SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target FROM levels, level),
rated AS (
  SELECT doc_id, size, source_size, target, nth, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('{SEED}:' || CASE WHEN r.source IS NULL THEN 'n' ELSE 's' || r.source END), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST((floor(u + nth * rate) - floor(u + (nth - 1) * rate)) * size AS BIGINT) AS taken FROM rated
"""
