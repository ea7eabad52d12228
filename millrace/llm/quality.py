"""Quality rules with n-gram perplexity (operator 10).

The language models are interpolated modified Kneser-Ney models of character n-grams, one per language. Characters fold
to 64 symbols (letters, blank, digit, three kinds of marks, 31 classes of other letters, and the text's start), so an
n-gram of up to `ORDER` = 5 symbols is a 30-bit number and a language has at most 64**5 n-grams whatever the corpus's
size. Spark counts the n-grams of all documents (each task counts its own, the shuffle adds them up), takes
continuation counts, discounts, probabilities and back-off weights as DataFrames, and writes each language and order as
a sorted array of n-gram numbers beside arrays of their values. Scoring tasks map those arrays to memory and look all
n-grams of a text up by binary search; n-grams that the model lacks back off to shorter ones.

Beside them stands a model of words and pairs of words (`millrace.llm.wordmodel`), which grows with the corpus and tells
what five characters can't: words in senseless order, and words that the rest of the corpus doesn't use.

A document's perplexity must lie in its language's band, which reaches `SPREAD` interquartile ranges of the logarithm
beyond the quartiles of all distinct texts of that language that pass the base rules; copies weigh as one text, and a
range counts as `FLOOR` at least. The character model counts copies each, so a text with very many copies can fall below
its band. By words only a high perplexity counts,
since words that other texts foretell well are those of near copies: `SPREAD` times twice the way from the median to the
upper quartile (`WORD_FLOOR` at least) above that. A text's mean scatters around its language's with a variance of one
part that all texts have and one that falls with its length, so the way is times sqrt(1 + `SCATTER` / words). Base rules (words
`[^\\x20\\x09-\\x0D]+`): 20 words at least, and at most 30 % of words in 8-word windows found twice or more.

Defined results: null texts have no words and fail; a null language is a language of its own; texts without symbols
have a null perplexity and languages without a band reject nothing; U+0000 counts as a text's start; repeated rows are
counted and reported each; an empty table gives no rows; columns besides those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import wordmodel
from millrace.llm.common import SPACE, arrow_columns, filesystem, materialise, publish, shared_dir, slices, texts_of

ORDER, SPREAD, SCATTER, LEAST_WORDS, REPEATED, REPEAT_WINDOW = 5, 2.5, 50, 20, 30, 8
#: Least spread of log perplexities that a band is made from, by symbols and by words.
FLOOR, WORD_FLOOR = 0.02, 0.1
#: Steps of a unit of log perplexity in which quantiles are taken.
STEPS = 4096
#: Symbols are 6-bit numbers; the leading bits of an n-gram tell its part of the arrays.
_PAD, _BITS, _PART_BITS = 63, 6, 4
#: Distinct n-grams that a counting task holds before it hands them on.
HELD = 1 << 21
#: Bytes of text that a task scores at a time, and n-grams that it looks up at a time: the arrays of both take many times their texts.
STEP, AT_ONCE = 2 << 20, 1 << 20
_SYMBOLS = b"#*$%&|<>"


def _symbol_table() -> np.ndarray:
    cp = np.arange(0x110000, dtype=np.uint64)
    t = (32 + (cp * np.uint64(2654435761) >> np.uint64(9)) % np.uint64(31)).astype(np.uint8)
    t[:128] = 31
    t[0] = _PAD
    for c in range(26):
        t[ord("a") + c] = t[ord("A") + c] = 1 + c
    for c in SPACE:
        t[ord(c)] = 27
    for c in "0123456789":
        t[ord(c)] = 28
    t[ord(".")], t[ord(",")] = 29, 30
    return t


def ngrams(texts: list[str], table: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams that end at each symbol of the texts, and how many each text has."""
    joined = "".join("\0" * (order - 1) + t for t in texts)
    s = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint32)
    if len(s) < order:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    codes = s[: len(s) - order + 1].copy()
    for n in range(1, order):
        codes <<= np.uint32(_BITS)
        codes |= s[n : len(s) - order + 1 + n]
    real = s[order - 1 :] != _PAD
    ends = np.cumsum([order - 1 + len(t) for t in texts])
    begins = np.concatenate([[0], ends[:-1]])
    total = np.concatenate([[0], np.cumsum(real)])
    last = np.minimum(np.maximum(ends - order + 1, 0), len(real))
    return codes[real], total[last] - total[np.minimum(begins, len(real))]


_COUNT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, code, n) over all n-grams of all documents; a null language is ''."""

    def run(batches):
        table = _symbol_table()
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def batch_of(lang):
            codes, n = held.pop(lang)
            for at in range(0, len(codes), 1 << 18):
                c = codes[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.astype(np.int64)), pa.array(n[at : at + (1 << 18)])], names=["lang", "code", "n"])

        for whole in batches:
            for batch in slices(whole):
                by = defaultdict(list)
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text:
                        by[lang or ""].append(text)
                for lang, texts in by.items():
                    codes, n = np.unique(ngrams(texts, table, order)[0], return_counts=True)
                    if lang in held:
                        old, m = held[lang]
                        both, where = np.unique(np.concatenate([old, codes]), return_inverse=True)
                        codes, n = both, np.bincount(where, np.concatenate([m, n])).astype(np.int64)
                    held[lang] = codes, n.astype(np.int64)
                while sum(len(c) for c, _ in held.values()) > HELD:
                    yield from batch_of(max(held, key=lambda x: len(held[x][0])))
        for lang in list(held):
            yield from batch_of(lang)

    work = docs.select(F.col(f"`{lang_col}`").cast("string").alias("l"), F.col(f"`{text_col}`").alias("t"))
    return work.mapInArrow(run, _COUNT).groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): the modified Kneser-Ney discounts of one order by its counts of counts."""
    n = lambda k: F.count_if(F.col("n") == k).cast("double")
    t = grams.groupBy("lang").agg(*[n(k).alias(f"n{k}") for k in range(1, 5)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    exact = [(F.lit(float(k)) - F.lit(float(k + 1)) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")) for k in (1, 2, 3)]
    plain = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    # Small or saturated orders have too few rare n-grams for the estimate.
    return t.select("lang", *[F.when(plain, F.least(F.greatest(e, F.lit(0.1)), F.lit(k - 0.1))).otherwise(F.lit(k * 0.5)).alias(f"d{k}") for k, e in zip((1, 2, 3), exact, strict=True)])


def estimate(grams: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """For each order from 1: (lang, code, logp, logb) with the interpolated log probability of the n-gram's last symbol
    and the log back-off weight of the n-gram as a context (null if it is none)."""
    tables = [grams]
    for k in range(order - 1, 0, -1):
        tables.insert(0, materialise(tables[0].groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << _BITS * k) - 1)).alias("code")).agg(F.count("*").alias("n"))))
    out: list[DataFrame] = []
    lower = None
    for k, t in enumerate(tables, 1):
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        by = Window.partitionBy("lang", "context")
        t = t.join(_discounts(t), "lang").withColumn("context", F.shiftright("code", _BITS)).withColumn("d", d)
        t = t.withColumn("all", F.sum("n").over(by)).withColumn("b", F.sum("d").over(by) / F.col("all")).withColumn("own", (F.col("n") - F.col("d")) / F.col("all"))
        t = t.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << _BITS * (k - 1)) - 1)))
        if lower is None:
            t = t.withColumn("below", F.lit(1.0 / 64))
        else:
            t = t.join(lower.select("lang", F.col("code").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        lower = materialise(t.select("lang", "code", (F.col("own") + F.col("b") * F.col("below")).alias("p"), "context", "b"))
        if out:
            weights = lower.groupBy("lang", F.col("context").alias("code")).agg(F.log(F.first("b")).alias("logb"))
            out[-1] = out[-1].join(weights, ["lang", "code"], "full")
        out.append(lower.select("lang", "code", F.log("p").alias("logp")))
    out[-1] = out[-1].withColumn("logb", F.lit(None).cast("double"))
    return out


def _folder(lang: str) -> str:
    return hashlib.sha1(lang.encode()).hexdigest()


def write_model(tables: list[DataFrame], path: str) -> None:
    """Sorted arrays by language, order and part: <language digest>/<order>.<part>.key (u32), .logp and .logb (f32).

    A part holds the n-grams of some first symbols, so that no task gets all of a language's.
    """

    def run(batches):
        from contextlib import ExitStack

        fs, root = filesystem(path)
        rows = 0
        current, files, stack, names = None, [], None, []

        def close():
            if stack is not None:
                stack.close()
                for mine, name in names:
                    fs.move(mine, name)

        for b in batches:
            runs = pc.run_end_encode(pc.binary_join_element_wise(b.column(0), pc.cast(b.column(1), pa.string()), pc.cast(b.column(2), pa.string()), "\t"))
            at = 0
            for end, what in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                if what != current:
                    close()
                    current = what
                    lang, order, of = what.rsplit("\t", 2)
                    fs.create_dir(f"{root}/{_folder(lang)}", recursive=True)
                    stack, names, files = ExitStack(), [], []
                    for kind in ("key", "logp", "logb"):
                        name = f"{root}/{_folder(lang)}/{order}.{of}.{kind}"
                        mine = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
                        files.append(stack.enter_context(fs.open_output_stream(mine)))
                        names.append((mine, name))
                part = b.slice(at, end - at)
                files[0].write(part.column(3).to_numpy(zero_copy_only=False).astype("<u4").tobytes())
                for f, c in zip(files[1:], (4, 5), strict=True):
                    f.write(part.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                rows += end - at
                at = end
        close()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    from pyspark import TaskContext

    whole = None
    for k, t in enumerate(tables, 1):
        t = t.select("lang", F.lit(k).alias("order"), F.shiftright("code", _BITS * k - _PART_BITS).cast("int").alias("part"), "code", "logp", "logb")
        whole = t if whole is None else whole.unionByName(t)
    materialise(whole.repartition("lang", "order", "part").sortWithinPartitions("lang", "order", "part", "code").mapInArrow(run, "rows long"))


class Model:
    """The arrays of one language, mapped to memory where the folder is a file system's, else read."""

    def __init__(self, path: str, lang: str, order: int = ORDER):
        fs, root = filesystem(path)
        self.levels = []
        for k in range(1, order + 1):
            name = f"{root}/{_folder(lang)}/{k}"
            kinds = (("key", "<u4"), ("logp", "<f4"), ("logb", "<f4"))
            self.levels.append([[self._open(fs, f"{name}.{part}.{kind}", t) for kind, t in kinds] for part in range(1 << _PART_BITS)])
        # Symbols that the language never shows share what its symbols leave.
        seen = np.concatenate([logp for _, logp, _ in self.levels[0]])
        self.empty = not len(seen)
        seen = seen[~np.isnan(seen)]
        rest = 1.0 - float(np.exp(seen.astype(np.float64)).sum())
        self.floor = float(np.log(rest / (64 - len(seen)))) if len(seen) < 64 and rest > 1e-9 else -float(np.log(64.0))

    @staticmethod
    def _open(fs, name: str, kind: str) -> np.ndarray:
        if fs.type_name == "local":
            import os

            if not os.path.exists(name) or not os.path.getsize(name):
                return np.zeros(0, kind)
            return np.memmap(name, kind, "r")
        from pyarrow.fs import FileType

        if fs.get_file_info(name).type != FileType.File:
            return np.zeros(0, kind)
        with fs.open_input_file(name) as f:
            return np.frombuffer(f.read(), kind)

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the last symbols; each distinct n-gram of AT_ONCE is looked up once, in order."""
        out = np.empty(len(codes), np.float32)
        for at in range(0, len(codes), AT_ONCE):
            some = codes[at : at + AT_ONCE]
            packed = (some.astype(np.uint64) << np.uint64(32)) | np.arange(len(some), dtype=np.uint64)
            packed.sort()
            ordered = (packed >> np.uint64(32)).astype(np.uint32)
            starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            out[at + (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)] = np.repeat(self._logp(ordered[starts], len(self.levels)), np.diff(np.append(starts, len(ordered))))
        return out

    def _logp(self, codes: np.ndarray, level: int) -> np.ndarray:
        if not level:
            return np.full(len(codes), self.floor, np.float32)
        out = self._values(level, 1, codes)
        # Contexts that are never scored themselves (a text's start) have a back-off weight but no probability.
        missing = np.isnan(out)
        if missing.any():
            rest = codes[missing]
            below = self._logp(rest & np.uint32((1 << _BITS * (level - 1)) - 1), level - 1)
            if level > 1:
                below = below + np.nan_to_num(self._values(level - 1, 2, rest >> np.uint32(_BITS)))
            out[missing] = below
        return out

    def _values(self, level: int, kind: int, codes: np.ndarray) -> np.ndarray:
        """The values of n-grams in any order, nan for those that the model lacks."""
        out = np.full(len(codes), np.nan, np.float32)
        first = codes >> np.uint32(_BITS * level - _PART_BITS)
        for part in np.unique(first).tolist():
            keys, values = self.levels[level - 1][part][0], self.levels[level - 1][part][kind]
            if len(keys):
                mine = np.flatnonzero(first == part)
                at = np.minimum(np.searchsorted(keys, codes[mine]), len(keys) - 1)
                found = keys[at] == codes[mine]
                out[mine[found]] = values[at[found]]
        return out


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in windows of so many words that the text holds twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    roll = np.zeros(n, np.uint64)
    for k in range(window):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.sort(roll)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    places = defaultdict(list)
    for at in np.flatnonzero(np.isin(roll, twice)).tolist():
        places[tuple(words[at : at + window])].append(at)
    hit = np.zeros(len(words) + 1, np.int64)
    for found in places.values():
        if len(found) > 1:
            np.add.at(hit, found, 1)
            np.add.at(hit, np.array(found) + window, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


_BASE = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField(c, T.DoubleType()) for c in ("logppl", "logword")])


def scorer(model: str, words: str, order: int = ORDER) -> Callable[[pa.RecordBatch], list[pa.Array]]:
    """A kernel that takes texts and their languages, in slices of STEP bytes of text, to the columns of _BASE."""
    table = _symbol_table()
    models: dict[str, Model] = {}
    coder, lexicons = wordmodel.Coder(), {}

    def word_loss(batch):
        out = np.full(batch.num_rows, np.nan)
        at = 0
        for part in slices(batch, wordmodel.STEP):
            for lang in pc.unique(part.column(1)).to_pylist():
                same = pc.equal(part.column(1), lang)
                x = coder(part.column(0).filter(same))
                m = lexicons.get(lang) or lexicons.setdefault(lang, wordmodel.Model(words, lang))
                if len(x.texts):
                    out[at + np.flatnonzero(same.to_numpy(zero_copy_only=False))[x.texts]] = m.loss(x)
            at += part.num_rows
        return out

    def score(batch):
        data = texts_of(batch.column(0))
        base = []
        for b in data:
            words = b.split()
            base.append((len(words), len(b) - len(b.translate(None, SPACE.encode())), len(b) - len(b.translate(None, _SYMBOLS)), repeated_lines(b), repeated_words(words)))
        cols = np.array(base, np.int64).reshape(-1, 5)
        cols[:, 1] = pc.utf8_length(batch.column(0).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64) - cols[:, 1]
        by = defaultdict(list)
        for k, lang in enumerate(batch.column(1).to_pylist()):
            by[lang].append(k)
        loss = np.full(len(data), np.nan)
        texts = batch.column(0).to_pylist()
        for lang, ks in by.items():
            m = models.get(lang) or models.setdefault(lang, Model(model, lang, order))
            codes, n = ngrams([texts[k] or "" for k in ks], table, order)
            if not len(codes) or m.empty:
                continue
            total = np.concatenate([[0.0], np.cumsum(m.logp(codes), dtype=np.float64)])
            ends = np.cumsum(n)
            with np.errstate(invalid="ignore", divide="ignore"):
                loss[ks] = -(total[ends] - total[ends - n]) / n
        by_word = word_loss(batch)
        return [*(pa.array(cols[:, k]) for k in range(5)), *(pa.array(x, mask=np.isnan(x)) for x in (loss, by_word))]

    return lambda batch: [pa.concat_arrays(made) for made in zip(*map(score, slices(batch, STEP) if batch.num_rows else [batch]), strict=True)]


def measured(docs: DataFrame, model: str, words: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """(id, lang, h1 and h2: hashes of the text, the base measures, logppl and logword: mean negative log probability of a symbol and of a word, null
    without symbols, words or model)."""
    work = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"), F.col(f"`{text_col}`").alias("t"))
    work = work.withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64("t", F.lit(1))})
    return arrow_columns(work, lambda: scorer(model, words, order), _BASE, ["id", "lang", "h1", "h2"], ["t", "lang"])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def _quantiles(rows: DataFrame, column: str) -> DataFrame:
    """(lang, <column>1, <column>2, <column>3): the quartiles by language, to 1/STEPS; the same however rows are spread."""
    by = Window.partitionBy("lang")
    binned = rows.filter(F.col(column).isNotNull()).groupBy("lang", F.floor(F.col(column) * STEPS).alias("bin")).agg(F.count("*").alias("n"))
    binned = binned.withColumn("below", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    return binned.groupBy("lang").agg(*[((F.min(F.when(4 * F.col("below") >= k * F.col("all"), F.col("bin"))) + 0.5) / STEPS).alias(f"{column}{k}") for k in (1, 2, 3)])


def bands(rows: DataFrame, spread: float = SPREAD) -> DataFrame:
    """(lang, q1, q3, reach) on logppl and (w_q3, w_reach) on logword, over distinct texts."""
    t = rows.filter(~base_failed()).select("lang", "h1", "h2", "logppl", "logword").dropDuplicates(["lang", "h1", "h2"])
    t = _quantiles(t, "logppl").join(_quantiles(t, "logword"), "lang", "full")
    c = F.col
    return t.select("lang", c("logppl1").alias("q1"), c("logppl3").alias("q3"), (F.greatest(c("logppl3") - c("logppl1"), F.lit(FLOOR)) * spread).alias("reach"), c("logword3").alias("w_q3"), (F.greatest((c("logword3") - c("logword2")) * 2, F.lit(WORD_FLOOR)) * spread).alias("w_reach"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> str:
    """Counts, estimates and writes the models of all languages; returns their folder."""
    path = shared_dir(docs.sparkSession)
    write_model(estimate(materialise(counts(docs, text_col, lang_col, order)), order), path)
    return path


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: str | None = None, spread: float = SPREAD, words: str | None = None) -> DataFrame:
    """One row per row of docs: id, the base measures, base_failed, kept, and both perplexities with their limits."""
    model = model or train(docs, text_col, lang_col)
    words = words or wordmodel.train(docs, text_col, lang_col)
    rows = materialise(measured(docs, model, words, id_col, text_col, lang_col))
    out = rows.join(bands(rows, spread), "lang", "left").withColumn("base_failed", base_failed())
    widen = F.sqrt(1 + F.lit(float(SCATTER)) / F.greatest("n_words", F.lit(1)))
    reach, by_word = F.col("reach") * widen, F.col("w_reach") * widen
    out = out.withColumn("low", F.col("q1") - reach).withColumn("high", F.col("q3") + reach).withColumn("w_high", F.col("w_q3") + by_word)
    inside = F.coalesce(F.col("logppl").between(F.col("low"), F.col("high")), F.lit(True)) & F.coalesce(F.col("logword") <= F.col("w_high"), F.lit(True))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = [F.exp(c).alias(name) for c, name in (("logppl", "perplexity"), ("low", "low"), ("high", "high"), ("logword", "word_perplexity"), ("w_high", "word_high"))]
    return out.select(F.col("id").alias(id_col), *measures, "base_failed", (~F.col("base_failed") & inside).alias("kept"), *found)
