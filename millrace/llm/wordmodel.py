"""Word bigram models of the languages, in hash-partitioned sorted arrays that grow with the corpus (for operator 10).

A word is a run of letters and digits in lower case (all but ASCII marks and blanks counts as letter); a character of
three bytes from U+3000 to U+9FFF is a word of its own. A mark stands before and after each text. Counting tasks turn
words, pairs and whole texts into 46-bit hashes and hand sorted blocks of them, cut by leading bits, to the shuffle; each
reduce task adds up the blocks of its parts and writes sorted arrays. All words and pairs of all documents are counted.

A text is scored by what all other texts say: its own counts, times the number of its copies, are taken from the
totals first. A hash counted once belongs to the text that holds it and has nothing left then, so the arrays lack those
without any effect on a score. The probability of a word after another is (n + MU p) / (c + MU), a Dirichlet prior
around the word's own probability p, which in turn is (c + S / V) / (C + S) with the S words counted once of V.

Scoring looks the sorted hashes of a slice of texts up, part by part; a part is mapped to memory, or read and let go.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import filesystem, materialise, shared_dir, slices, utf8_buffer

MU = 20.0
#: Bytes of text at a time, and hashes that a counting task holds before it hands them on.
STEP, HELD = 1 << 20, 1 << 22
_BITS = 46
_WORD, _PAIR, _TEXT = 0, 1, 2
_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 1 << 64)
_LETTERS = np.array([c > 127 or chr(c).isalnum() for c in range(256)])
_ALONE = np.array([0xE3 <= c <= 0xE9 for c in range(256)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
_MARK = _mix(np.array([7], np.uint64))


def _code(x: np.ndarray, kind: int) -> np.ndarray:
    return (_mix(x) >> np.uint64(64 - _BITS)) & np.uint64((1 << _BITS) - 4) | np.uint64(kind)


@dataclass
class Coded:
    """Hashes of texts with words: texts has their rows; of is the text (by place) of each word, word its hash and pair that with the word before."""

    texts: np.ndarray
    of: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    whole: np.ndarray


class Coder:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            for name, r in (("up", _R), ("down", _RI)):
                p = np.full(n + 1, r, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def __call__(self, texts: pa.Array) -> Coded:
        data, offsets = utf8_buffer(pc.utf8_lower(texts.cast(pa.large_string())))
        n = len(data)
        self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[:n], out=sums[1:])
        letter = _LETTERS[data]
        alone = _ALONE[data]
        cut = alone.copy()
        cut[3:] |= alone[:-3]
        inner = offsets[:-1][offsets[:-1] < n]
        cut[inner] = True
        begins = letter.copy()
        begins[1:] &= ~letter[:-1] | cut[1:]
        begin = np.flatnonzero(begins)
        ends = letter.copy()
        ends[:-1] &= ~letter[1:] | cut[1:]
        end = np.flatnonzero(ends) + 1
        ids = _mix((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))
        bounds = np.searchsorted(begin, offsets)
        each = np.diff(bounds)
        rows = np.flatnonzero(each)
        each = each[rows]
        # A mark before each text's words, and one behind them all.
        at = np.arange(len(ids)) + np.repeat(np.arange(1, len(rows) + 1), each)
        line = np.full(len(ids) + len(rows) + 1, _MARK[0], np.uint64)
        line[at] = ids
        of = np.repeat(np.arange(len(rows)), each + 1)
        a, b = line[:-1], line[1:]
        word = _code(line, _WORD)
        o = offsets
        whole = (sums[o[rows + 1]] - sums[o[rows]]) * self.down[o[rows]] + (o[rows + 1] - o[rows]).astype(np.uint64)
        return Coded(rows, of, word[1:], _code(a * np.uint64(0xD6E8FEB86659FD93) + b, _PAIR), _code(whole, _TEXT))


def _pack(codes: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Steps between sorted hashes and counts, by byte planes, which the shuffle's compression takes well."""
    steps = np.diff(codes, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T[: _BITS // 8 + 1].tobytes(), n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(codes: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer(n, np.uint8).reshape(4, -1).T
    k = np.zeros((len(c), 8), np.uint8)
    k[:, : _BITS // 8 + 1] = np.frombuffer(codes, np.uint8).reshape(_BITS // 8 + 1, -1).T
    return np.cumsum(k.view(np.uint64).ravel(), dtype=np.uint64), np.ascontiguousarray(c).view("<u4").ravel().astype(np.int64)


def _folder(lang: str) -> str:
    return hashlib.sha1(lang.encode()).hexdigest()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> str:
    """Counts the words and pairs of all documents; returns the folder of the arrays, which ends in the number of leading bits."""
    spark = docs.sparkSession
    bits = max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    path = f"{shared_dir(spark)}-words-{bits}"

    def count(batches):
        coder = Coder()
        held: dict[str, list[np.ndarray]] = defaultdict(list)

        def flush():
            for lang in list(held):
                codes, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
                cuts = np.searchsorted(codes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(_BITS - bits)).tolist() + [len(codes)]
                rows = [(p, *_pack(codes[a:b], n[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                if rows:
                    part, c, m = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(part, pa.int32()), pa.array(c, pa.binary()), pa.array(m, pa.binary())], names=["lang", "part", "codes", "n"])

        size = 0
        for whole in batches:
            for batch in slices(whole, STEP):
                langs = batch.column(0)
                for lang in pc.unique(langs).to_pylist():
                    x = coder(batch.column(1).filter(pc.equal(langs, lang)))
                    held[lang] += [x.word, x.pair, x.whole]
                    size += len(x.word) + len(x.pair) + len(x.whole)
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    def write(batches):
        from pyspark import TaskContext

        fs, root = filesystem(path)
        mine = TaskContext.get().taskAttemptId()
        blocks: list[tuple[np.ndarray, np.ndarray]] = []
        current, rows = None, 0

        def put():
            lang, part = current
            codes = np.concatenate([c for c, _ in blocks])
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], np.concatenate([m for _, m in blocks])[order]
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            codes, n = codes[starts], np.add.reduceat(n, starts)
            words = codes & np.uint64(3) == _WORD
            sums = np.array([n[words].sum(), words.sum(), (n[words] == 1).sum()], "<i8")
            again = n > 1
            fs.create_dir(f"{root}/{_folder(lang)}", recursive=True)
            for kind, a in (("key", codes[again].astype("<u8")), ("n", np.minimum(n[again], 0xFFFFFFFF).astype("<u4")), ("sum", sums)):
                name = f"{root}/{_folder(lang)}/{part}.{kind}"
                with fs.open_output_stream(f"{name}.{mine}.tmp") as f:
                    f.write(a.tobytes())
                fs.move(f"{name}.{mine}.tmp", name)
            blocks.clear()

        for batch in batches:
            for lang, part, codes, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, part) != current:
                    if blocks:
                        put()
                    current = lang, part
                blocks.append(_unpack(codes, n))
                rows += 1
        if blocks:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    work = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("l"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    blocks = work.mapInArrow(count, "lang string, part int, codes binary, n binary")
    materialise(blocks.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(write, "rows long"))
    return path


class Model:
    """The arrays of one language."""

    def __init__(self, path: str, lang: str):
        self.bits = int(path.rpartition("-")[2])
        self.fs, root = filesystem(path)
        self.root = f"{root}/{_folder(lang)}"
        sums = [self._array(f"{p}.sum", "<i8") for p in range(1 << self.bits)]
        self.tokens, self.types, self.once = (int(x) for x in sum((s for s in sums if len(s)), np.zeros(3, np.int64)))

    def _array(self, name: str, kind: str) -> np.ndarray:
        import os

        name = f"{self.root}/{name}"
        if self.fs.type_name == "local":
            return np.memmap(name, kind, "r") if os.path.exists(name) and os.path.getsize(name) else np.zeros(0, kind)
        from pyarrow.fs import FileType

        if self.fs.get_file_info(name).type != FileType.File:
            return np.zeros(0, kind)
        with self.fs.open_input_file(name) as f:
            return np.frombuffer(f.read(), kind)

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """How often sorted hashes were counted; those counted once or never have 1."""
        out = np.ones(len(codes), np.int64)
        cuts = np.searchsorted(codes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(_BITS - self.bits)).tolist() + [len(codes)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a and len(keys := self._array(f"{p}.key", "<u8")):
                at = np.minimum(np.searchsorted(keys, codes[a:b]), len(keys) - 1)
                found = np.flatnonzero(keys[at] == codes[a:b])
                out[a + found] = self._array(f"{p}.n", "<u4")[at[found]]
        return out

    def _left(self, codes: np.ndarray, of: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Counts of hashes without those of their own text and its copies."""
        distinct, which = np.unique(codes, return_inverse=True)
        n = self.counts(distinct)[which]
        out = np.zeros(len(codes), np.int64)
        more = np.flatnonzero(n > 1)
        _, same, own = np.unique(which[more] * np.int64(len(copies)) + of[more], return_inverse=True, return_counts=True)
        out[more] = np.maximum(n[more] - own[same] * copies[of[more]], 0)
        return out

    def loss(self, x: Coded) -> np.ndarray:
        """Mean negative log probability of a word, by text."""
        distinct, which = np.unique(x.whole, return_inverse=True)
        copies = self.counts(distinct)[which]
        c = self._left(x.word, x.of, copies)
        # The words of a text in front of others are those behind others, its mark included.
        before = np.empty_like(c)
        before[1:] = c[:-1]
        starts = np.flatnonzero(np.diff(x.of, prepend=-1))
        before[starts] = c[np.append(starts[1:], len(c)) - 1]
        own = np.bincount(x.of)
        total = np.maximum(self.tokens - own * copies, 0)[x.of]
        once = max(self.once, 1)
        p = (c + once / max(self.types, 1)) / (total + once)
        p = (self._left(x.pair, x.of, copies) + MU * p) / (before + MU)
        return np.bincount(x.of, -np.log(p)) / own
