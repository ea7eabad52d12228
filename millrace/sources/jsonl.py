"""JSON Lines and text files, in and out, and the other formats that Spark reads itself."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import json_value, strip
from millrace.operators import dedup, planning
from millrace.schema import SAMPLE


class MalformedLine(ValueError):
    """A line that isn't a JSON object; the message ends in path:line."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _line): stripped lines that aren't blank, with their numbers from 1, blank lines counted, files by name.

    A big file is read in blocks by many tasks. Lines of a block follow each other in one task, so a line's number is its
    place in the block and the number of lines in the blocks before it.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    blocks = raw.groupBy("f", "b").agg(F.min("m").alias("lo"), F.count("*").alias("n"))
    base = blocks.select("f", "b", "lo", (F.sum("n").over(Window.orderBy("f", "b")) - F.col("n")).alias("base"))
    return raw.join(base, ["f", "b"]).select((F.col("base") + F.col("m") - F.col("lo") + 1).alias("_line"), strip(F.col("value")).alias("value")).filter("value <> ''")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(_line, value) of lines that can't be parsed."""
    return lines(spark, path).filter(json_value(F.col("value")).isNull())


def check(spark: SparkSession, path: str) -> None:
    bad = malformed(spark, path).orderBy("_line").limit(1).collect()
    if bad:
        raise MalformedLine(f"malformed JSON at {path}:{bad[0]['_line']}")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """The file's records with `_pos`, the number of their line. strict raises MalformedLine; else bad lines are left out.

    `read` is for data whose line numbers don't matter.
    """
    if strict:
        check(spark, path)
    rows = lines(spark, path).filter(json_value(F.col("value")).isNotNull())
    if schema is None:
        schema = spark.read.json(path).schema
    return rows.select(F.from_json("value", schema).alias("r"), F.col("_line").alias("_pos")).select("r.*", "_pos")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A native sample file: unknown keys are dropped, and a line that is no sample raises."""
    rows = read_jsonl(spark, path, SAMPLE)
    empty = rows.filter("instruction IS NULL AND turns IS NULL AND text IS NULL").orderBy("_pos").limit(1).collect()
    if empty:
        raise MalformedLine(f"no instruction, turns or text at {path}:{empty[0]['_pos']}")
    from millrace.schema import as_samples

    return as_samples(rows)


def write_jsonl(df: DataFrame, path: str, mode: str = "append", nulls: bool = True) -> int:
    """Writes df as a folder of JSON Lines and returns the number of rows, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", str(not nulls).lower()).json(path)
    return seen.get["n"]


class JsonlWriter:
    """Output in JSON Lines that a run appends to: a fresh one empties the folder, a resumed one counts the lines there."""

    def __init__(self, spark: SparkSession, path: str, resume: bool = False, nulls: bool = True):
        self.path, self.nulls, self.count = path, nulls, 0
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(there):
            if resume:
                self.count = spark.read.text(path).filter(strip(F.col("value")) != "").count()
            else:
                fs.delete(there, True)

    def append(self, df: DataFrame) -> int:
        """Adds the rows of df, one line each, and returns the number of lines that are there now."""
        self.count += write_jsonl(df, self.path, "append", self.nulls)
        return self.count


def write_file(df: DataFrame, path: str, order: str | None = "_pos", nulls: bool = True) -> int:
    """Writes df as one JSON Lines file in order. Tasks write its parts to a shared folder, and their bytes are put one after
    the other in the file, buffer by buffer: no rows come to the driver."""
    spark = df.sparkSession
    ordered = df.orderBy(order) if order and order in df.columns else df
    body = ordered.select(F.to_json(F.struct(*[c for c in df.columns if c != order]), {"ignoreNullFields": str(not nulls).lower()}).alias("j"))
    seen, parts = Observation(), dedup.shared_folder(spark, "parts")
    body.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "none").option("lineSep", "\n").text(parts)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(parts)
    fs = there.getFileSystem(conf)
    out = jvm.java.io.FileOutputStream(str(Path(path).absolute()))
    try:
        names = [x.getPath().getName() for x in fs.listStatus(there)]
        for name in sorted((x for x in names if x.startswith("part-")), key=lambda x: int(x.split("-")[1])):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(there, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()
    fs.delete(there, True)
    return seen.get["n"]


FORMATS = {"json": "json", "jsonl": "json", "parquet": "parquet", "csv": "csv", "tsv": "csv", "orc": "orc", "txt": "text"}


def read(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """A file or folder by its suffix or `kind`: JSON Lines, Parquet, CSV, TSV, ORC or text."""
    kind = kind or path.rstrip("/").rpartition(".")[2]
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    reader = spark.read.format(FORMATS[kind])
    if FORMATS[kind] == "csv":
        reader = reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("multiLine", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write(df: DataFrame, path: str, kind: str | None = None, mode: str = "overwrite") -> None:
    kind = kind or path.rstrip("/").rpartition(".")[2]
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    writer = df.write.mode(mode).format(FORMATS[kind])
    if FORMATS[kind] == "csv":
        writer = writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"')
    writer.save(path)


def corpus(spark: SparkSession, path: str, field: str = "text", most: int | None = None, seed: int = 0) -> DataFrame:
    """(_pos, text) of a .jsonl file's field or a .txt file's lines, stripped, blank ones left out; at most `most` of them,
    drawn by a seeded order of positions, exactly and the same in every run."""
    kind = path.rpartition(".")[2]
    if kind == "jsonl":
        rows = lines(spark, path).select(F.col("_line").alias("_pos"), strip(F.get_json_object("value", f"$.{field}")).alias("text"))
    elif kind == "txt":
        rows = lines(spark, path).select(F.col("_line").alias("_pos"), F.col("value").alias("text"))
    else:
        raise ValueError(f"a corpus is a .jsonl or .txt file, not {path}")
    rows = rows.filter("text <> ''")
    if most is not None:
        rows = rows.orderBy(planning.draw(seed, F.col("_pos").cast("string")), "_pos").limit(most)
    if not rows.take(1):
        raise ValueError(f"no documents in {path}")
    return rows
