"""Shared plumbing of the training-data operators: shared storage, Arrow kernels, skew-safe lookups, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the word definition `[^\x20\x09-\x0D]+`; bytes.split() without arguments splits at exactly these.
SPACE = " \t\n\x0b\x0c\r"
#: Text bytes that a Python kernel turns into objects at a time; Arrow batches are sliced to this.
SLICE_BYTES = 16 << 20
#: Salts that spread the rows of one hot key over tasks.
SALTS = 64
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster names in spark.checkpoint.dir, which every executor sees.

    Only on a single machine, where that setting is absent, a local folder is made and set; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def materialise(df: DataFrame, where: str | None = None, hashes: tuple[str, ...] = ()) -> DataFrame:
    """Writes the rows below the shared folder and reads them back: lineage ends there and a lost executor costs nothing.

    The write's own shuffle files go once it is done; nothing reads them again. For columns of hashes no dictionaries are tried.
    """
    spark = df.sparkSession
    path = where or shared_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").options(**{f"parquet.enable.dictionary#{c}": "false" for c in hashes}).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """The pyarrow filesystem and path of a folder as Spark names it (file:, hdfs:, s3: or a bare path)."""
    import pyarrow.fs as pafs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def publish(fs, path: str, write: Callable[[object], object]) -> object:
    """Writes a file under an attempt's own name and renames it, so that a repeated task leaves one whole file."""
    fs.create_dir(os.path.dirname(path), recursive=True)
    mine = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(mine) as out:
        result = write(out)
    fs.move(mine, path)
    return result


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of roughly `limit` bytes, a row at least."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * limit / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def texts_of(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if pa.types.is_null(array.type):
        return [b""] * len(array)
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def utf8_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end and the n + 1 offsets of its rows; null counts as empty."""
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


_WORD = np.array([c not in SPACE.encode() for c in range(256)])


def word_counts(array: pa.Array) -> np.ndarray:
    """Number of `[^\\x20\\x09-\\x0D]+` in each text, counted on the column's bytes."""
    data, offsets = utf8_buffer(array)
    word = _WORD[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = word[inner]
    return np.diff(np.searchsorted(np.flatnonzero(begins), offsets)).astype(np.int64)


def arrow_columns(df: DataFrame, factory: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], outputs: T.StructType, keep: list[str], need: list[str]) -> DataFrame:
    """The columns `keep` of df and those that a kernel computes from `need`, batch by batch in mapInArrow.

    factory() runs once in a task and returns the kernel; a kernel gets a record batch with the columns c0, c1, ...
    for `need` and returns one Arrow array for each output field. An output replaces a kept column of the same name.
    """
    names = {f.name.lower() for f in outputs}
    keep = [k for k in keep if k.lower() not in names]
    schema = T.StructType([*(df.schema[k] for k in keep), *outputs])
    work = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)], *[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(need)])
    k, n = len(keep), [f.name for f in schema]

    def run(batches):
        kernel = factory()
        for whole in batches:
            for batch in slices(whole):
                made = kernel(pa.RecordBatch.from_arrays(batch.columns[k:], names=batch.schema.names[k:]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], names=n)

    return work.mapInArrow(run, schema)


def salt(*by: str | Column, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def gather_keys(df: DataFrame, keys: list[str], salted: str, *aggs: Column) -> DataFrame:
    """One row per key with `aggs` (over columns p_* of partial aggregates) and the list `salts` under which the key's rows are found.

    df holds partial aggregates by (keys, salted); at most SALTS of them belong to one key.
    """
    return df.groupBy(*keys).agg(*aggs, F.collect_set(salted).alias("salts"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges: (node, root), root the smallest node of the component.

    Alternating large-star and small-star steps; each round is written to the shared folder. Both steps only take
    minima by node and join them back, so no node's neighbours are collected. Isolated nodes aren't returned.
    """
    e = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("s")).select("s.*").filter("u <> v").distinct()
        e = materialise(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
