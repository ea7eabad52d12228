"""SimHash near-duplicates: a byte-position inverted index with count filtering (operator 9).

A fingerprint has eight positional bytes. Two fingerprints with at most `RADIUS` = 2 differing bits differ in two bytes
at most, so they share `LEAST_SHARED` = 6 positional bytes or more. Posting lists of single bytes would hold 1/256 of
all fingerprints each and pairs of them all; the index therefore groups the eight positions into four neighbouring
couples and posts each fingerprint under every choice of two couples (six keys of four positional bytes each). Two
differing bytes spoil at most two couples, so each wanted pair meets under one key at least. Pairs that meet are
tallied over all eight positions, kept from six shared bytes on, and verified bit by bit. Keys with more members than
`COLD` don't emit pairs: each member is posted under itself and its 32 one-bit variants outside the key (two
fingerprints that share a key differ by two bits or fewer exactly if they share such a variant), and each variant's
members are linked to their smallest, which is linear in the members and loses no component.

Defined results: a null, empty or blank text has the fingerprint zero and is linked like any other; texts of one or two
words have one shingle, the whole; repeated rows and ids give repeated result rows; a null id never is a component's
smallest unless all are null; an empty table gives no rows; columns besides id and text are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import arrow_columns, components, materialise, salt, texts_of

SHINGLE, SEED, RADIUS, LEAST_SHARED = 3, 42, 2, 6
#: Members up to which a key of the index emits the pairs of its members.
COLD = 256
#: Hashes turned into bits at a time.
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, repeats included, as an unsigned integer."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.array(list(map(partial(xxhash.xxh64_intdigest, seed=seed), parts)), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) with fp as a signed 64-bit integer; narrow."""

    def factory():
        return lambda batch: [pa.array(np.array([fingerprint(t, shingle) for t in texts_of(batch.column(0))], dtype=np.uint64).view(np.int64), pa.int64())]

    return arrow_columns(docs, factory, T.StructType([T.StructField("fp", T.LongType())]), keep or [id_col], [text_col])


def shared_bytes(a: Column, b: Column) -> Column:
    """Positional bytes that two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum((F.when(F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def _postings(nodes: DataFrame) -> DataFrame:
    couple = lambda p: F.shiftrightunsigned("fp", 16 * p).bitwiseAND(F.lit(0xFFFF))
    choices = [(i, j) for i in range(4) for j in range(i)]
    keys = F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(couple(i), 16)).bitwiseOR(couple(j)) for k, (i, j) in enumerate(choices)])
    return nodes.select("fp", F.explode(keys).alias("key"))


def links(nodes: DataFrame, cold: int = COLD) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`: all pairs of cold keys, a spanning set of the others' pairs."""
    posts = _postings(nodes)
    counts = posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialise(posts.join(counts, "key"))
    low = met.filter(F.col("n") <= cold)
    pairs = low.select("key", F.col("fp").alias("a")).join(low.select("key", F.col("fp").alias("b")), "key").filter("a < b")
    tallied = pairs.withColumn("shared", shared_bytes(F.col("a"), F.col("b"))).filter(F.col("shared") >= LEAST_SHARED)
    verified = tallied.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    # Variants: flips of the 32 bits outside the key; which couples the key holds follows from its number.
    choices = [(i, j) for i in range(4) for j in range(i)]
    masks = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << bit)) for bit in range(64) if bit // 16 not in c]) for c in choices])
    flips = F.transform(F.element_at(masks, (F.shiftright("key", 32) + 1).cast("int")), lambda m: m.bitwiseXOR(F.col("fp")))
    hot = met.filter(F.col("n") > cold).select("fp", F.explode(flips).alias("variant")).distinct()
    centre = hot.groupBy("variant").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    starred = hot.join(centre, "variant").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return verified.unionByName(starred).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, cold: int) -> DataFrame:
    """(id, h, fp, root, component_id) for each row of docs; h is the text's hash, root the component's smallest fingerprint."""
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("h"), F.col(f"`{text_col}`").alias("t"))
    rows = materialise(fingerprints(plain, "id", "t", ["id", "h"], shingle))
    # By fingerprint and salt first: a fingerprint that a third of all rows share stays spread over SALTS rows.
    part = rows.groupBy("fp", salt("id", "h").alias("salt")).agg(F.min("id").alias("id"))
    nodes = materialise(part.groupBy("fp").agg(F.min("id").alias("id"), F.collect_set("salt").alias("salts")))
    rooted = components(links(nodes.select("fp"), cold)).select(F.col("node").alias("fp"), "root")
    known = nodes.join(rooted, "fp", "left").select("fp", "id", "salts", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("id").alias("component_id"))
    spread = known.join(least, "root").select("fp", "root", "component_id", F.explode("salts").alias("salt"))
    return rows.withColumn("salt", salt("id", "h")).join(spread, ["fp", "salt"], "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, cold: int = COLD) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id): one row per row of docs."""
    found = _components(docs, id_col, text_col, shingle, cold)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, cold: int = COLD) -> DataFrame:
    """One row of docs for each component, that with the smallest id (then text hash, then hash of all columns), with all columns of docs."""
    rank = F.struct(F.col("id").isNull().alias("unknown"), "id", "h")
    part = _components(docs, id_col, text_col, shingle, cold).groupBy("root", salt("id", "h").alias("salt")).agg(F.min(rank).alias("best"))
    name = lambda i, h: F.concat_ws(":", i.cast("string"), h.cast("string"))
    winners = materialise(part.groupBy("root").agg(F.min("best").alias("best")).select(name(F.col("best.id"), F.col("best.h")).alias("key")))
    work = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)], name(F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("key"))
    # Rows that repeat a winner are aggregated, within each task first.
    cols = [f"k{i}" for i in range(len(docs.columns))]
    by_row = F.xxhash64(*[f"k{i}" for i, f in enumerate(docs.schema) if "map<" not in f.dataType.simpleString()])
    kept = work.join(winners, "key", "left_semi").groupBy("key").agg(F.min_by(F.struct(*cols), by_row).alias("row"))
    return kept.select(*[F.col(f"row.k{i}").alias(c) for i, c in enumerate(docs.columns)])
