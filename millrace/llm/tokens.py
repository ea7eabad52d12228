"""Token ids as flat binary files (operator 6).

A store is a folder of parts in ascending id order. Part p has `p.bin` (token ids, little-endian, 16 bits unsigned if
the vocabulary fits, else 32), `p.off` (one little-endian 64-bit offset per document plus an end, counted in ids from
the part's start) and `p.ids` (the documents' ids as signed 64-bit integers and a bitmap-free null mark, the smallest
integer). Where a part begins in the whole follows from a prefix sum over the parts' lengths. Readers map the files to
memory and touch only the pages they need.

Texts are range-partitioned by id first and encoded where they are written, so that texts move once and ids never.
Words (a blank and what follows up to the next one) are encoded once and remembered in the Python worker, whose later
tasks find them (`Encoder`); the tokenizer is a byte-level BPE that never joins text across such a place, and longer runs
of white space are cut only where that holds.

Defined results: null and empty texts hold the end id alone; null document ids come first; rows with equal ids stay
next to each other, ordered by a hash of the text; ids that are no 64-bit integers are refused; an empty table gives an
empty store; columns besides id and text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import filesystem, materialise, publish, shared_dir, slices, utf8_buffer

END_ID = 2
#: Bits of an encoder's memory of words, words that the model takes at once, bytes of text at a time, and bytes of words
#: that are remembered (a multiple of eight).
MEMORY_BITS, JOINED, STEP, LONGEST = 21, 128, 2 << 20, 24
#: Documents that are read back at a time.
READ = 1024
_NULL = -(1 << 63)
#: White space as the tokenizer's pattern takes it (Unicode White_Space): of one byte and of more.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_WIDE = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_LEADS = np.zeros(256, bool)
_LEADS[[w[0] for w in _WIDE]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Characters of words whose pieces follow from their classes: letters, digits, ASCII marks but the apostrophe, and line
#: ends that stand alone inside a word.
_SIMPLE = re.compile(r"(?:[A-Za-z0-9À-ÖØ-öø-ɏА-яё一-鿿!-&(-/:-@\[-`{-~]|(?<=[^\n])\n(?=[^\n]))+")


def _byte_letters() -> np.ndarray:
    """The code point by which a byte-level vocabulary writes each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, np.uint16)
    out[kept] = kept
    rest = [b for b in range(256) if b not in set(kept)]
    out[rest] = np.arange(256, 256 + len(rest))
    return out


_LETTERS = _byte_letters()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mapped(text: str) -> str:
    return _LETTERS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")


def _harmless(token: str, byte_of: dict[str, int]) -> bool:
    """Whether a token can't span two classes of characters of simple words: it is letters, digits, marks or white space
    only, after one blank at most, or holds a character that simple words don't."""
    data = bytes(byte_of.get(c, 0) for c in token)
    kinds = {"l" if b >= 128 or chr(b).isalpha() else "d" if 48 <= b < 58 else "s" if b <= 32 else "m" for b in data[data[0] == 32 :]}
    if len(kinds) <= 1 and not (data[0] == 32 and kinds == {"s"} and data.strip(b" ")):
        return True
    try:
        return any(not _SIMPLE.fullmatch(c) for c in data.decode().replace(" ", "").replace("\n", ""))
    except UnicodeDecodeError:
        return False


class Memory:
    """Token ids of words of at most LONGEST bytes: a hash table that is searched for many words at a time.

    A word is told by its bytes as three numbers and its length, which two 64-bit hashes mix: one finds the slot, the
    other confirms it. A full table is emptied.
    """

    def __init__(self, kind: np.dtype, bits: int):
        self.bits, self.most = bits, (1 << bits) * 3 // 5
        self.ids = np.zeros(1 << 16, kind)
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.key, self.check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.at, self.size = np.zeros(n, np.uint32), np.zeros(n, np.uint16)
        self.held = self.end = self.probes = 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 for words that aren't held."""
        down, last = np.uint64(64 - self.bits), np.int64(len(self.key) - 1)
        slot = (key >> down).astype(np.int64)
        there = self.key[slot]
        out = np.where((there == key) & (self.check[slot] == check), slot, -1)
        left = np.flatnonzero((out < 0) & (there != 0))
        for k in range(1, self.probes):
            if not len(left):
                break
            slot = ((key[left] >> down).astype(np.int64) + k) & last
            there = self.key[slot]
            hit = (there == key[left]) & (self.check[slot] == check[left])
            out[left[hit]] = slot[hit]
            left = left[~hit & (there != 0)]
        return out

    def add(self, key: np.ndarray, check: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        down, last = np.uint64(64 - self.bits), np.int64(len(self.key) - 1)
        self.held += len(key)
        left, k = np.arange(len(key)), 0
        while len(left):
            slot = ((key[left] >> down).astype(np.int64) + k) & last
            free = np.flatnonzero(self.key[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            done, to = left[free[one]], slot[free[one]]
            self.key[to], self.check[to], self.at[to], self.size[to] = key[done], check[done], at[done], size[done]
            left = np.delete(left, free[one])
            k += 1
        self.probes = max(self.probes, k + 1)

    def room(self, n: int) -> None:
        if self.end + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(n, len(self.ids) // 2), self.ids.dtype)])


class Encoder:
    """Encodes texts to ids, with a memory of words where the tokenizer is a plain byte-level BPE.

    Texts are cut before blanks, but for blanks with white space on either side, all over a batch's bytes at once, and
    words that the memory holds are put together from it. New words are encoded many at a time: as long as no token of
    the vocabulary spans two classes of characters (letters, digits, marks), merges never cross the places where the
    tokenizer would cut simple words, so the model takes them joined and unsplit, and tokens that begin with a blank tell
    where words begin. Other words go through the tokenizer's own cuts one by one, long ones each time; so do whole
    texts with white space of more than one byte.
    """

    def __init__(self, path: str, bits: int = MEMORY_BITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        before, model = told.get("pre_tokenizer") or {}, told["model"]
        self.by_word = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not told.get("normalizer") and model["type"] == "BPE"
        self.added = [x["content"] for x in told.get("added_tokens", [])]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.joined = False
        # An added token that holds white space could span words.
        self.by_word = bool(self.by_word and not any(c.isspace() for x in self.added for c in x))
        if self.by_word:
            self.memory = Memory(self.kind, bits)
            byte_of = {chr(c): b for b, c in enumerate(_LETTERS.tolist())}
            vocab = {k: v for k, v in model["vocab"].items() if k not in self.added}
            plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            self.joined = plain and all(_harmless(k, byte_of) for k in vocab) and all(chr(c) in vocab for c in _LETTERS.tolist())
            self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)
            self.begins[[v for k, v in vocab.items() if k[0] == chr(_LETTERS[32])]] = True

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _word(self, word: str) -> np.ndarray:
        if any(x in word for x in self.added):
            return self._whole(word)
        bpe = self.tokenizer.model.tokenize
        return np.array([t.id for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word) for t in bpe(piece)], self.kind)

    def _put(self, ids: np.ndarray) -> None:
        m = self.memory
        m.room(len(ids))
        m.ids[m.end : m.end + len(ids)] = ids
        m.end += len(ids)

    def _learned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of words behind those of the memory; their places and numbers."""
        at, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        simple = [k for k, w in enumerate(words) if w[0] == " " and _SIMPLE.fullmatch(w, 1)] if self.joined else []
        bpe, done = self.tokenizer.model.tokenize, np.zeros(len(words), bool)
        for a in range(0, len(simple), JOINED):
            some = simple[a : a + JOINED]
            text = "".join([words[k] for k in some])
            if any(x in text for x in self.added):
                continue
            ids = np.array([t.id for t in bpe(_mapped(text))], np.int64)
            cuts = np.append(np.flatnonzero(self.begins[ids]), len(ids))
            at[some], size[some], done[some] = self.memory.end + cuts[:-1], np.diff(cuts), True
            self._put(ids)
        for k in np.flatnonzero(~done).tolist():
            ids = self._word(words[k])
            at[k], size[k] = self.memory.end, len(ids)
            self._put(ids)
        return at, size

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the number of each one's; null counts as empty."""
        if not self.by_word:
            each = [self._whole(t or "") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, self.kind), *each]), np.array([len(x) for x in each], np.int64)
        data, offsets = utf8_buffer(texts)
        n = len(data)
        if not n:
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        padded = np.concatenate([data, np.zeros(LONGEST + 8, np.uint8)])
        first = offsets[:-1][np.diff(offsets) > 0]
        # Blanks begin words, unless white space or an end is on both sides.
        blank = np.flatnonzero(data == 32)
        white = _WHITE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        inside = (white[np.maximum(blank - 1, 0)] | edge[blank]) & (white[np.minimum(blank + 1, n - 1)] | edge[blank + 1])
        begins = np.zeros(n, bool)
        begins[blank[~inside]] = True
        # White space of several bytes: such texts are taken whole.
        odd = np.flatnonzero(_LEADS[data])
        odd = odd[[bytes(padded[k : k + 3]).startswith(_WIDE) for k in odd.tolist()]] if len(odd) else odd
        slow = np.unique(np.searchsorted(offsets, odd, side="right") - 1)
        for k in slow.tolist():
            begins[offsets[k] : offsets[k + 1]] = False
        begins[first] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)
        length = end - start
        loads = np.ndarray((n + LONGEST,), "<u8", padded, strides=(1,))
        some = [loads[start + 8 * j] & _MASKS[np.clip(length - 8 * j, 0, 8)] for j in range(LONGEST // 8)]
        key, check = (_mix(sum((x * np.uint64(c) for x, c in zip(some, odd_, strict=True)), length.astype(np.uint64) * np.uint64(odd_[0]))) for odd_ in (_ODD, _ODD[::-1]))
        key |= np.uint64(1)
        m = self.memory
        if m.held >= m.most:
            m.clear()
        short = length <= LONGEST
        short[np.searchsorted(start, offsets[slow])] = False
        slot = np.full(len(start), -1, np.int64)
        slot[short] = m.find(key[short], check[short])
        done = slot >= 0
        at, size = np.where(done, m.at[slot], 0).astype(np.int64), np.where(done, m.size[slot], 0).astype(np.int64)
        new = np.flatnonzero(short & ~done)
        if len(new):
            _, one, which = np.unique(key[new], return_index=True, return_inverse=True)
            one, held = new[one], data.tobytes()
            places, sizes = self._learned([held[a:b].decode() for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)])
            at[new], size[new] = places[which], sizes[which]
            done[new] = check[new] == check[one][which]
            room = m.most - m.held
            m.add(key[one][:room], check[one][:room], places[:room].astype(np.uint32), sizes[:room].astype(np.uint16))
        kept = m.end
        for k in np.flatnonzero(~done).tolist():
            ids = self._word(data[start[k] : end[k]].tobytes().decode())
            at[k], size[k] = m.end, len(ids)
            self._put(ids)
        m.end = kept
        total = np.concatenate([[0], np.cumsum(size)])
        ids = m.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, offsets)])

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text]))[0].tolist()


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer in a Python worker; later tasks of the worker find its memory."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


_PARTS = T.StructType([T.StructField("part", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("ids", T.LongType()), T.StructField("width", T.IntegerType())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes a store below the folder `path` (as Spark names it) and returns its parts: part, docs, ids, width, base."""
    spark = docs.sparkSession
    ordered = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    # By text hash as well, so that rows with one id or none at all spread over parts.
    order = [F.col("id").asc_nulls_first(), "h"]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order, "t").select("id", "t")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer)
        fs, root = filesystem(path)
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def fill(out):
            for whole in batches:
                for batch in slices(whole, STEP):
                    coded, n = coder.encode_batch(batch.column(1))
                    lengths.append(n + 1)
                    ids.append(batch.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False).astype("<i8"))
                    out.write(np.insert(coded, np.cumsum(n), end_id).astype(coder.kind).tobytes())

        publish(fs, f"{root}/{part:06d}.bin", fill)
        n = np.concatenate([np.zeros(1, np.int64), *lengths]).cumsum()
        publish(fs, f"{root}/{part:06d}.off", lambda out: out.write(n.astype("<u8").tobytes()))
        publish(fs, f"{root}/{part:06d}.ids", lambda out: out.write(np.concatenate([np.zeros(0, "<i8"), *ids]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(n) - 1], pa.int64()), pa.array([int(n[-1])], pa.int64()), pa.array([coder.kind.itemsize], pa.int32())], names=[f.name for f in _PARTS])

    # The rows of the parts are written before anything reads them, so each part is encoded once.
    parts = materialise(ordered.mapInArrow(run, _PARTS))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = materialise(parts.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long"))), f"{path}/parts.parquet")
    fs, root = filesystem(path)
    meta = {"end_id": end_id, "tokenizer": tokenizer.rpartition("/")[2]}
    publish(fs, f"{root}/store.json", lambda out: out.write(json.dumps(meta).encode()))
    return based


class Ranges:
    """An array in a file that can't be mapped to memory: what is asked for is read."""

    def __init__(self, fs, name: str, kind: np.dtype):
        self.file, self.kind = fs.open_input_file(name), kind

    def __len__(self) -> int:
        return self.file.size() // self.kind.itemsize

    def __getitem__(self, at: int | slice) -> np.ndarray:
        a, b = (at, at + 1) if not isinstance(at, slice) else at.indices(len(self))[:2]
        found = np.frombuffer(self.file.read_at(max(b - a, 0) * self.kind.itemsize, a * self.kind.itemsize), self.kind)
        return found if isinstance(at, slice) else found[0]


class Part:
    """One part of a store, mapped to memory where the folder is a local one, else read range by range."""

    def __init__(self, path: str, part: int, width: int):
        fs, root = filesystem(path)
        kinds = {"bin": f"<u{width}", "off": "<u8", "ids": "<i8"}
        self.bin, self.off, self.ids = (self._open(fs, f"{root}/{part:06d}.{k}", np.dtype(v)) for k, v in kinds.items())

    @staticmethod
    def _open(fs, name: str, kind: np.dtype) -> np.ndarray:
        if fs.type_name == "local":
            import os

            return np.memmap(name, kind, "r") if os.path.getsize(name) else np.zeros(0, kind)
        return Ranges(fs, name, kind)

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.bin[int(self.off[k]) : int(self.off[k + 1])]


_READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document of a store, from its files, one task per part."""
    parts = spark.read.parquet(f"{path}/parts.parquet").select("part", "width", "base")

    def run(batches):
        for batch in batches:
            for part, width, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = Part(path, part, width)
                for at in range(0, len(p), READ):
                    ks = range(at, min(at + READ, len(p)))
                    off = np.asarray(p.off[at : ks[-1] + 2]).astype(np.int64)
                    held = np.asarray(p.bin[int(off[0]) : int(off[-1])])
                    cuts = (off - off[0]).tolist()
                    crc = [zlib.crc32(held[a:b].astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    ids = np.asarray(p.ids[at : ks[-1] + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == _NULL), pa.array(base + off[:-1]), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=[f.name for f in _READ])

    n = max(1, parts.count())
    return parts.repartitionByRange(n, "part").mapInArrow(run, _READ).withColumnRenamed("doc_id", id_col)


def tokens_of(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Writes a store of docs and reads it back."""
    path = path or shared_dir(docs.sparkSession)
    write_tokens(docs, path, tokenizer, id_col, text_col, end_id)
    return read_tokens(docs.sparkSession, path, id_col)
