"""Language identification with string kernels (operator 1).

A text is represented by the presence of its character n-grams of one to `ORDER` letters (the blended spectrum), and
two texts are compared by the number of n-grams that both have, over the geometric mean of their own numbers. Nystrom:
`LANDMARKS` labelled texts span the space, and one-versus-rest kernel ridge regression is fitted in it. Scoring is two
matrix products for a batch of texts: presence by landmarks gives kernel values, kernel values by weights give a score
per language.

The kernel counts n-grams that occur in landmarks: no other n-gram can add to a kernel value with a landmark, and texts
are normalised by those. Letters are folded to lower case; all else but letters counts as one blank. Every letter and
every n-gram of the landmarks counts.

The classifier is fitted on a bounded sample of labelled rows: `PER_CLASS` distinct texts of each language, smallest
hashes first, of at most `SAMPLE_CHARS` characters where a language has such; from these `LANDMARKS` (or `MARKS` a
language, if that is more) are taken in turn by language, texts of at most `LANDMARK_CHARS` characters first. Everything
else reads all data and whole texts.

Defined results: a text that is null or has no letter is `und` with score 0; without labelled rows every text is; texts
without a known n-gram get the language of least score distance, first by name; ties of scores go to the first language
by name; rows with null ids are training rows; repeated rows give repeated rows; columns besides those named are kept
out unless asked for.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import arrow_columns

ORDER, LANDMARKS, MARKS, LANDMARK_CHARS, PER_CLASS, SAMPLE_CHARS, RIDGE = 3, 128, 2, 6000, 300, 100_000, 1e-3
#: Texts in one matrix product, and characters taken at a time from a long text.
BATCH, STRIDE = 64, 1 << 20
#: Texts with so many letters or more tell how much is known of a learned language; at least FEW of them; the fence below their lower quartile.
STEADY, FEW, FENCE, LEAST_RANGE = 200, 20, 3.0, 0.02
#: Bits of a letter in the number of an n-gram.
_BITS = 21


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class Columns:
    """Places 1, 2, ... of a sorted list of numbers, 0 for all others: a hash table that is searched for many at a time."""

    def __init__(self, numbers: np.ndarray):
        bits = max(4, (4 * len(numbers)).bit_length())
        self.down = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64).view(np.uint64)
        self.places = np.zeros(1 << bits, np.int32)
        left, self.most = np.arange(len(numbers)), 0
        while len(left):
            at = self._slot(numbers[left], self.most)
            free = np.flatnonzero(self.places[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            done = free[one]
            self.keys[at[done]] = numbers[left[done]]
            self.places[at[done]] = left[done] + 1
            left = np.delete(left, done)
            self.most += 1

    def _slot(self, numbers: np.ndarray, k: int) -> np.ndarray:
        at = (numbers * np.uint64(0x9E3779B97F4A7C15) >> self.down).astype(np.int64)
        return at + k & len(self.keys) - 1 if k else at

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        at = self._slot(numbers, 0)
        found = self.keys[at]
        out = np.where(found == numbers, self.places[at], 0)
        left = np.flatnonzero((found != numbers) & (self.places[at] > 0))
        for k in range(1, self.most):
            if not len(left):
                break
            at = self._slot(numbers[left], k)
            hit = self.keys[at] == numbers[left]
            out[left[hit]] = self.places[at[hit]]
            left = left[~hit & (self.places[at] > 0)]
        return out


class Kernel:
    """Presence of the landmarks' n-grams in texts."""

    def __init__(self, landmarks: list[str], order: int = ORDER):
        self.order = order
        # 0: blank, 1: letters that no landmark has, then the letters of the landmarks.
        letters = sorted({ord(c) for t in landmarks for c in t.lower() if c.isalpha()})
        self.symbols = np.zeros(0x110000, np.int32)
        self.symbols[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
        self.symbols[letters] = np.arange(2, len(letters) + 2)
        grams: list[set[int]] = [set() for _ in range(order)]
        for t in landmarks:
            for held, keys in zip(grams, self.keys(t), strict=True):
                held.update(np.unique(keys).tolist())
        self.columns = [Columns(np.array(sorted(held), np.uint64)) for held in grams]
        self.before = np.concatenate([[0], np.cumsum([len(held) for held in grams])]).tolist()
        self.width = self.before[-1] + 1

    def keys(self, text: str) -> list[np.ndarray]:
        ids = self.symbols[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        out = [ids]
        for n in range(1, self.order):
            out.append((out[-1][:-1] << np.uint64(_BITS)) | ids[n:])
        return out

    def presence(self, texts: list[str]) -> np.ndarray:
        """A row per text, of unit length; column 0 stands for n-grams that no landmark has and stays 0."""
        p = np.zeros((len(texts), self.width), np.float32)
        for row, t in zip(p, texts, strict=True):
            for at in range(0, max(len(t), 1), STRIDE):
                for columns, before, keys in zip(self.columns, self.before, self.keys(t[at : at + STRIDE + self.order - 1]), strict=False):
                    place = columns(keys)
                    row[np.where(place > 0, place + before, 0)] = 1
        p[:, 0] = 0
        norm = np.sqrt(p.sum(axis=1, keepdims=True))
        np.divide(p, norm, out=p, where=norm > 0)
        return p

    def known(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many `ORDER`-grams around a letter each text has, and the share of them that landmarks have."""
        n, hit = np.zeros(len(texts)), np.zeros(len(texts))
        for k, t in enumerate(texts):
            for at in range(0, max(len(t), 1), STRIDE):
                keys = self.keys(" " * (at == 0) + t[max(at - 1, 0) : at + STRIDE + self.order - 2] + " " * (at + STRIDE >= len(t)))
                inner = keys[0][1 : len(keys[-1]) + 1] > 0
                n[k] += inner.sum()
                hit[k] += (self.columns[-1](keys[-1][inner]) > 0).sum()
        return n, hit / np.maximum(n, 1)


class Classifier:
    def __init__(self, rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """rows: (text, language), whose order decides which become landmarks."""
        rows = [(t, y) for t, y in rows if has_letter(t)]
        self.languages = sorted({y for _, y in rows})
        if not rows:
            return
        queues = {y: sorted((t for t, z in rows if z == y), key=lambda t: len(t) > LANDMARK_CHARS) for y in self.languages}
        chosen = [q[k] for k in range(max(map(len, queues.values()))) for q in queues.values() if k < len(q)][: max(landmarks, MARKS * len(queues))]
        self.kernel = Kernel(chosen)
        marks = self.kernel.presence(chosen)
        self.marks = np.ascontiguousarray(marks.T)
        among = (marks @ self.marks).astype(np.float64)
        values, vectors = np.linalg.eigh(among)
        good = values > 1e-6 * max(values[-1], 1e-12)
        nystrom = vectors[:, good] / np.sqrt(values[good])
        found = np.concatenate([self.kernel.presence([t for t, _ in rows[k : k + BATCH]]) @ self.marks for k in range(0, len(rows), BATCH)]).astype(np.float64) @ nystrom
        goal = np.array([[1.0 if y == z else -1.0 for z in self.languages] for _, y in rows])
        # Each language weighs the same, however many rows it has.
        n = Counter(y for _, y in rows)
        weight = np.array([1.0 / n[y] for _, y in rows])[:, None]
        beta = np.linalg.solve(found.T @ (found * weight) + ridge * np.eye(found.shape[1]), found.T @ (goal * weight))
        self.weights = (nystrom @ beta).astype(np.float32)
        # What texts of the learned languages share with the landmarks, by texts that aren't landmarks themselves.
        marked = set(chosen)
        others = [t for t, _ in rows if t not in marked]
        n, share = self.kernel.known(others)
        share = share[n >= STEADY]
        if len(share) < FEW:
            # Small samples: half of the texts against the others, which share less than with all.
            texts = list(dict.fromkeys(t for t, _ in rows))
            n, share = Kernel(texts[::2]).known(texts[1::2])
            share = share[n >= STEADY]
        q1, q3 = np.quantile(share, [0.25, 0.75]) if len(share) >= FEW else (1.0, 1.0)
        self.least_known = float(q1 - FENCE * max(q3 - q1, LEAST_RANGE)) if len(share) >= FEW else 0.0

    def foreign(self, texts: list[str | None]) -> list[bool]:
        """Whether a text shares less with the landmarks than texts of the learned languages do: an unknown language or script, or letters at random."""
        if not self.languages:
            return [False] * len(texts)
        n, share = self.kernel.known([t or "" for t in texts])
        # Short texts scatter.
        scatter = FENCE * np.sqrt(self.least_known * (1 - self.least_known) / np.maximum(n, 1))
        return ((n > 0) & (share < self.least_known - scatter)).tolist()

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score in [0, 1] of each text."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        known = [k for k, t in enumerate(texts) if self.languages and has_letter(t)]
        for at in range(0, len(known), BATCH):
            ks = known[at : at + BATCH]
            scores = (self.kernel.presence([texts[k] for k in ks]) @ self.marks) @ self.weights
            best = scores.argmax(axis=1)
            for k, b, s in zip(ks, best, scores[np.arange(len(ks)), best], strict=True):
                out[k] = (self.languages[b], float(min(max((1.0 + s) / 2.0, 0.0), 1.0)))
        return [x for x, _ in out], [s for _, s in out]


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """The bounded sample: at most per_class distinct texts of each language.

    Distinct texts are counted by language first; then one scan keeps about per_class + 6 sqrt(per_class) texts of a
    language by the threshold on the texts' hash that its count asks for, and the smallest hashes of them are used.
    Copies of a text count once. Of a language without texts of at most sample_chars characters MARKS longer ones are used.
    """
    t = F.col(f"`{text_col}`")
    free = docs.filter(~held_out(F.col(f"`{id_col}`")) & F.col(f"`{lang_col}`").isNotNull() & t.isNotNull()).select(
        F.col(f"`{lang_col}`").cast("string").alias("y"), t.alias("t"), F.xxhash64(t).alias("x"), (F.length(t) > sample_chars).alias("long")
    )
    n = {(r.y, r.long): r.n for r in free.groupBy("y", "long").agg(F.approx_count_distinct("x", 0.02).alias("n")).collect()}
    if not n:
        return []
    # A tenth more, as the counts are estimates.
    take = {k: 1.1 * (per_class + 6 * per_class**0.5) if not k[1] else MARKS + 6 * MARKS**0.5 for k in n if not k[1] or (k[0], False) not in n}
    shares = free.sparkSession.createDataFrame([(*k, min(1.0, m / n[k]) if n[k] > 2 * m else 1.0) for k, m in take.items()], "y string, long boolean, share double")
    place = F.col("x").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    kept = free.join(F.broadcast(shares), ["y", "long"]).filter(place < F.col("share")).groupBy("y", "x").agg(F.min("t").alias("t"))
    rows = kept.collect()
    rows.sort(key=lambda r: (r.y, r.x & ((1 << 52) - 1), r.x))
    seen: Counter = Counter()
    out = []
    for r in rows:
        seen[r.y] += 1
        if seen[r.y] <= (per_class if (r.y, False) in take else MARKS):
            out.append((r.t, r.y))
    return out


_OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_FOREIGN = T.StructField("foreign", T.BooleanType())


def identify(docs: DataFrame, model: Classifier, text_col: str = "text", keep: list[str] | None = None, foreign: bool = False) -> DataFrame:
    """The columns `keep` (all by default) of docs with lang_pred and score, and with `foreign` whether a text is unlike all
    learned languages; narrow."""

    def factory():
        def kernel(batch):
            texts = batch.column(0).to_pylist()
            found, scores = model.predict(texts)
            out = [pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            return [*out, pa.array(model.foreign(texts), pa.bool_())] if foreign else out

        return kernel

    return arrow_columns(docs, factory, T.StructType([*_OUT, _FOREIGN]) if foreign else _OUT, docs.columns if keep is None else keep, [text_col])
