"""Near-duplicates: MinHash over character trigrams and cosine similarity, removed greedily in input order."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

HASHES = 128
#: Shingles whose hashes a task remembers, and those of a text that are looked up at a time.
KNOWN, LOOKED_UP = 50_000, 4096
#: Positions that a band's key covers at least if it stands for a group of bands with one mismatch.
WIDE = 6
#: Members of a key beyond which they meet in parts.
HOT = 2048
#: Vectors of which two blocks meet in one matrix product.
VECTORS = 1024
#: Groups of vectors that tasks of the cosine join hold two of, and bytes of numbers in a group beyond which there are more.
GROUPS, GROUP_BYTES = 16, 1 << 25


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one named in spark.checkpoint.dir, which all executors see.

    On a single machine without that setting a local one is made and set; a cluster must name its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written to the folder named in spark.checkpoint.dir and read back, so that its lineage ends."""
    spark = df.sparkSession
    path = shared_folder(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _trigrams(text: str) -> set[str]:
    t = text.lower().strip()
    return {t} if len(t) < 3 else {t[i : i + 3] for i in range(len(t) - 2)}


_SEEDS = [i.to_bytes(4, "big") for i in range(HASHES)]


def _hashes(shingle: str) -> np.ndarray:
    data = shingle.encode("utf-8", "surrogatepass")
    return np.frombuffer(b"".join(hashlib.sha256(s + data).digest()[:8] for s in _SEEDS), "<u8")


def signatures(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, sig): 128 minima as 64-bit patterns (equality is all that is asked of them). Null texts count as empty.

    A task hashes each distinct shingle once; the memory of them is bounded.
    """

    def run(batches):
        known: dict[str, int] = {}
        table = np.empty((1024, HASHES), np.uint64)
        for batch in batches:
            out = np.empty((batch.num_rows, HASHES), np.int64)
            for row, t in enumerate(batch.column(1).to_pylist()):
                least, shingles = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64), list(_trigrams(t or ""))
                for k in range(0, len(shingles), LOOKED_UP):
                    if len(known) > KNOWN:
                        known.clear()
                    places = []
                    for s in shingles[k : k + LOOKED_UP]:
                        place = known.get(s)
                        if place is None:
                            place = known[s] = len(known)
                            if place == len(table):
                                table = np.concatenate([table, np.empty_like(table)])
                            table[place] = _hashes(s)
                        places.append(place)
                    np.minimum(least, table[places].min(axis=0), out=least)
                out[row] = least.view(np.int64)
            flat = pa.array(out.reshape(-1))
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, HASHES, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), sig], names=["key", "sig"])

    work = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return work.mapInArrow(run, f"key {work.schema['key'].dataType.simpleString()}, sig array<bigint>")


def agreement(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of equal minima."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.lit(float(HASHES))


def minhash_classes(sigs: DataFrame) -> DataFrame:
    """(sig, rep, n): one row for each distinct signature, with its smallest key and the number of its keys."""
    return sigs.groupBy("sig").agg(F.min("key").alias("rep"), F.count("*").alias("n"))


def minhash_members(sigs: DataFrame) -> DataFrame:
    """(key, rep): the class that each key belongs to. Classes are met in parts, so that a hot one spreads."""
    part = F.pmod(F.xxhash64("key"), F.lit(64)).cast("int").alias("part")
    salted = sigs.withColumn("part", part)
    held = salted.groupBy("sig", "part").agg(F.min("key").alias("rep")).groupBy("sig").agg(F.min("rep").alias("rep"), F.collect_set("part").alias("parts"))
    return salted.join(held.select("sig", "rep", F.explode("parts").alias("part")), ["sig", "part"]).select("key", "rep")


def minhash_pairs(sigs: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b, sim), a < b, of classes of equal signatures, by their smallest keys, whose agreement is over the
    threshold; none is missed. `minhash_members` tells the keys of a class; equal signatures aren't paired with each other.

    """
    return _class_pairs(settled(minhash_classes(sigs)), threshold)


def _keys(m: int) -> list[list[tuple[int, int]]]:
    """Keys, each a list of spans of positions, of which signatures that differ in at most m positions share at least one.

    Of m + 1 bands one is equal. Half as many groups of positions have one with at most one mismatch, so of a group's three
    parts two are equal: where groups are large enough, keys of two parts cover more positions than a band.
    """
    spans = lambda lo, hi, n: [(lo + (hi - lo) * k // n, lo + (hi - lo) * (k + 1) // n) for k in range(n)]
    groups = m // 2 + 1
    if m < 1 or HASHES * 2 // 3 < WIDE * groups:
        return [[span] for span in spans(0, HASHES, m + 1)]
    return [[x for x in parts if x != left_out] for parts in (spans(*group, 3) for group in spans(0, HASHES, groups)) for left_out in parts]


def _class_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """minhash_pairs of classes (sig, rep) that are written down.

    Classes meet where they share a key. Two low bits of each minimum travel along, as four words of 64 bits; positions
    where they differ are different ones, so nearly all pairs that meet are refused in the join, before anything of them
    is written. The rest is compared on whole signatures. Keys with over HOT members meet in parts.
    """
    m = HASHES - int(HASHES * threshold + 1e-9) - 1
    if m < 0:
        return classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("sim")).limit(0)
    bits = lambda half, bit: F.aggregate(F.slice("sig", 64 * half + 1, 64), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.shiftright(x, bit).bitwiseAND(F.lit(1))))
    hashes = [F.xxhash64(F.lit(k), *[F.slice("sig", lo + 1, hi - lo) for lo, hi in spans]) for k, spans in enumerate(_keys(m))]
    keyed = classes.select("rep", *[bits(half, bit).alias(f"w{half}{bit}") for half in (0, 1) for bit in (0, 1)], F.array(*hashes).alias("hs"))
    banded = keyed.select("rep", "w00", "w01", "w10", "w11", F.explode("hs").alias("h"))
    hot = banded.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("h", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    # There is at most one hot key in HOT postings, so they are few.
    banded = banded.join(F.broadcast(settled(hot)), "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # By number, so that partitions, small but full of pairs, aren't merged.
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = banded.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts").repartition(n, "h", "part").alias("a")
    other = banded.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").repartition(n, "h", "part").alias("b")
    differ = [F.bit_count(F.col(f"a.w{half}0").bitwiseXOR(F.col(f"b.w{half}0")).bitwiseOR(F.col(f"a.w{half}1").bitwiseXOR(F.col(f"b.w{half}1")))) for half in (0, 1)]
    near = (F.col("a.h") == F.col("b.h")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.rep") < F.col("b.rep")) & (differ[0] + differ[1] <= m)
    met = one.join(other, near).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
    left, right = classes.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), classes.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    return met.join(left, "a").join(right, "b").withColumn("sim", agreement(F.col("sa"), F.col("sb"))).filter(F.col("sim") > threshold).select("a", "b", "sim")


def greedy_removed(pairs: DataFrame, rounds: int = 1000) -> DataFrame:
    """Keys (key) that a greedy pass in key order removes: an item goes if an earlier one that stays is similar.

    Rounds over the pairs (a before b): items without earlier neighbours stay, their later neighbours go, and pairs of
    either are done. What stays is the first maximal independent set in key order.
    """
    open_ = settled(pairs.select("a", "b").distinct())
    gone = None
    for _ in range(rounds):
        if not open_.take(1):
            break
        stay = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        out = settled(open_.join(stay, "a", "left_semi").select(F.col("b").alias("key")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        left = open_.join(out, open_["a"] == out["key"], "left_anti")
        open_ = settled(left.join(out, left["b"] == out["key"], "left_anti"))
    else:
        raise RuntimeError(f"the greedy pass didn't end in {rounds} rounds")
    return gone if gone is not None else pairs.select(F.col("a").alias("key")).limit(0)


def minhash_dedup(df: DataFrame, text: str, key: str, threshold: float = 0.8) -> DataFrame:
    """The rows of df that stay. Classes of equal signatures keep their first row and only representatives are paired."""
    classes = settled(minhash_classes(signatures(df, text, key)))
    reps = classes.select(F.col("rep").alias("key")).join(greedy_removed(_class_pairs(classes, threshold)), "key", "left_anti")
    return df.join(reps.withColumnRenamed("key", "__kept"), F.col(key) == F.col("__kept"), "left_semi")


def cosine_pairs(df: DataFrame, key: str, vector: str, threshold: float, block: int = VECTORS) -> DataFrame:
    """All pairs (a, b, sim), a < b, with a cosine over the threshold; zero vectors have cosine 0.

    A stated exact all-pairs job: groups of vectors meet group by group in tasks of their own, there block by block, one
    matrix product each; a block holds `block` vectors, whatever their number.
    """

    def meet(one, two, blocks):
        for rows, columns, sims in blocks:
            i, j = np.nonzero(sims > threshold)
            a, b, s = one[rows][i], two[columns][j], sims[i, j]
            if one is two:
                once = (i + rows.start < j + columns.start) & (a != b)
                a, b, s = a[once], b[once], s[once]
            yield {"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": s}

    kind = df.schema[key].dataType.simpleString()
    return _groupwise(df, key, vector, block, meet, f"a {kind}, b {kind}, sim double")


def _groupwise(df: DataFrame, key: str, vector: str, block: int, meet: Callable, schema: str) -> DataFrame:
    """meet(keys of one group, keys of another or the same, blocks) for every two groups; blocks are (rows, columns, cosines).

    Every vector is sent once to each group, as it is stored. There are GROUPS of them, fewer of half a block if that is all,
    so what is sent grows as the input until groups reach GROUP_BYTES. Beyond, more groups keep a task's memory bounded.
    """
    kind = df.schema[vector].dataType.elementType.simpleString()
    stored = "float" if kind == "float" else "double"
    n, dim = df.agg(F.count("*"), F.max(F.size(vector))).first()
    groups = max(1, min(GROUPS, 2 * n // block), -(-n * 8 * max(dim or 0, 1) // GROUP_BYTES))
    placed = df.select(F.col(key).alias("k"), F.col(vector).cast(f"array<{stored}>").alias("v"), F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("g"))
    others = F.sequence(F.lit(0), F.lit(groups - 1))
    sent = placed.select("k", "v", "g", F.explode(others).alias("o")).withColumns({"x": F.least("g", "o"), "y": F.greatest("g", "o")}).drop("o")
    out = T._parse_datatype_string(schema)

    def run(place: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = (p.as_py() for p in place)
        held: dict[int, list] = {x: [], y: []}
        for batch in batches:
            k, v, g = (batch.column(batch.schema.get_field_index(c)) for c in ("k", "v", "g"))
            numbers = v.flatten().to_numpy(zero_copy_only=False)
            if v.null_count or len(numbers) != len(v) * dim or v.flatten().null_count:
                raise ValueError(f"vectors of {dim} numbers are asked for")
            numbers, keys, g = numbers.reshape(len(v), dim), k.to_numpy(zero_copy_only=False), g.to_numpy()
            for one in held:
                held[one].append((keys[g == one], numbers[g == one]))
        sides = {}
        for one, parts in held.items():
            unit = np.concatenate([p[1] for p in parts]).astype(np.float64)
            norm = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            sides[one] = np.concatenate([p[0] for p in parts]), np.divide(unit, norm, out=unit, where=norm > 0)
        held.clear()
        (one, left), (two, right) = sides[x], sides[y]

        def blocks():
            for i in range(0, len(left), block):
                for j in range(i if x == y else 0, len(right), block):
                    yield slice(i, i + block), slice(j, j + block), left[i : i + block] @ right[j : j + block].T

        arrow = to_arrow_schema(out)
        for found in meet(one, two, blocks()):
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    # By number, so that partitions, small but full of pairs, aren't merged.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(max(parts, groups * (groups + 1) // 2), "x", "y").groupBy("x", "y").applyInArrow(run, schema)


def embedding_dedup(df: DataFrame, key: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """The rows of df that a greedy pass by cosine keeps."""
    gone = greedy_removed(settled(cosine_pairs(df, key, vector, threshold)))
    return df.join(gone.withColumnRenamed("key", "__gone"), F.col(key) == F.col("__gone"), "left_anti")


def deduplicate(df: DataFrame, text: str, key: str, threshold: float = 0.9, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """MinHash, then cosine over vectors that embed adds as `embedding` (skipped without it)."""
    kept = settled(minhash_dedup(df, text, key, threshold))
    if embed is None:
        return kept
    return embedding_dedup(embed(kept), key, "embedding", threshold).drop("embedding")


def nearest(df: DataFrame, key: str, vector: str, block: int = VECTORS) -> DataFrame:
    """(key, cosine to the nearest other vector): low values are holes in the data. Exact, by groups: of each two groups
    every vector brings its best, so as many rows for each vector as there are groups leave the tasks."""

    def meet(one, two, blocks):
        same = one is two
        best = [np.full(len(x), -np.inf) for x in ((one,) if same else (one, two))]
        for rows, columns, sims in blocks:
            if same and rows == columns:
                np.fill_diagonal(sims, -np.inf)
            if sims.size:
                best[0][rows] = np.maximum(best[0][rows], sims.max(axis=1))
                best[-1][columns] = np.maximum(best[-1][columns], sims.max(axis=0))
        for keys, sim in zip((one, two), best):
            yield {"key": keys[sim != -np.inf], "sim": sim[sim != -np.inf]}

    best = _groupwise(df, key, vector, block, meet, f"key {df.schema[key].dataType.simpleString()}, sim double")
    return best.groupBy("key").agg(F.max("sim").alias("nearest"))


def relevance_diversity(spark: SparkSession, df: DataFrame, key: str, vector: str, score: str, k: int, weight: float = 0.5) -> list:
    """Keys of k rows by maximal marginal relevance: each next one has the largest weight * score - (1 - weight) * cosine to
    the nearest chosen. k passes, each one aggregate; only the chosen vectors come to the driver."""
    unit = F.expr(f"transform(cast({vector} as array<double>), x -> x)")
    norm = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x))
    work = settled(df.select(F.col(key).alias("key"), F.col(score).cast("double").alias("score"), F.transform(unit, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))).alias("v"), F.lit(0.0).alias("close")))
    chosen: list = []
    for _ in range(k):
        gain = F.lit(weight) * F.col("score") - F.lit(1 - weight) * F.col("close")
        best = work.filter(~F.col("key").isin(chosen) if chosen else F.lit(True)).orderBy(gain.desc(), "key").limit(1).collect()
        if not best:
            break
        chosen.append(best[0].key)
        dot = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in best[0].v]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        work = settled(work.withColumn("close", F.greatest("close", dot)))
    return chosen
