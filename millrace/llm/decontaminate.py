"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 8).

A text is lower-cased (A-Z), cut into words and joined with single spaces; a window of ten consecutive item words is a
pattern with a space at either end, so an occurrence begins and ends at words. Patterns are put into classes by length
(powers of two), and each class has its own tables: the block shift table says how far the search may jump when a
block of text is no pattern's last block, blocks with shift zero lead to a bucket of patterns by the hash of their
suffix block, and each pattern there is compared directly. Words that occurrences cover are merged, so overlaps count
once.

Tables are packed arrays: patterns are places in the items' texts, shifts one byte a slot, buckets runs of patterns sorted by slot.
Tasks over the benchmark build them, a block for every `BLOCK_BYTES` of items, and write them to the shared folder;
searching tasks map the files to memory (or read them, where the folder is no file system's), so neither the driver nor
a closure carries them. The documents are read once, whatever the number of blocks: each batch of texts is searched for
one block after the other.

Defined results: null texts and texts without words have n_words 0 and aren't contaminated; items without words give no
pattern; items of fewer words than a window are one pattern; repeated items are reported once; items with a null id
count for the words that are hit but are neither counted nor listed; repeated documents give repeated rows; empty
documents give no rows and an empty benchmark no hits; columns besides those named are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import arrow_columns, filesystem, materialise, publish, shared_dir, texts_of

WINDOW = 10
#: Bytes of benchmark text in one block of tables.
BLOCK_BYTES = 4 << 20
#: Longest block of the shift tables, in bytes; longest stretch of a pattern that they look at; bits of their slots.
BLOCK, LONGEST, LEAST_BITS, MOST_BITS = 8, 200, 10, 24
#: Words of an item that are handled at a time.
PIECE = 1 << 19

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))
_MIX = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
#: Multiplier of the hash that finds equal windows, and its inverse.
_R = 0xD6E8FEB86659FD93
_RI = pow(_R, -1, 1 << 64)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Tables:
    """Search tables for patterns of one length class."""

    m: int
    b: int
    bits: int
    shift: np.ndarray  # of a block's slot
    bucket: np.ndarray  # patterns bucket[s] to bucket[s + 1] have their suffix block in slot s >> spare bits
    start: np.ndarray  # of each pattern in the items' texts
    length: np.ndarray
    words: np.ndarray
    owner: np.ndarray  # items owner[owned[k]] to owner[owned[k + 1]] hold pattern k
    owned: np.ndarray


def _slots(values: np.ndarray, b: int, bits: int) -> np.ndarray:
    return ((values & np.uint64((1 << 8 * b) - 1)) * np.uint64(_MIX)) >> np.uint64(64 - bits)


def build(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> dict[str, np.ndarray]:
    """The packed arrays of a block of (item id, text)."""
    texts, starts, lengths, words, owners, size = [], [], [], [], [], 0
    for k, (_, text) in enumerate(items):
        every = words_of(text)
        for at in range(0, max(1, len(every) - window + 1) if every else 0, PIECE):
            piece = every[at : at + PIECE + window - 1]
            joined = b" " + b" ".join(piece) + b" "
            n = min(window, len(piece))
            gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            starts.append(gaps[:-n] + size)
            lengths.append(gaps[n:] + 1 - gaps[:-n])
            words.append(np.full(len(gaps) - n, n))
            owners.append(np.full(len(gaps) - n, k if items[k][0] is not None else -1))
            texts.append(joined)
            size += len(joined)
    names = [(i or "").encode() for i, _ in items]
    out = {"names": np.frombuffer(b"".join(names), np.uint8), "ends": np.cumsum([len(n) for n in names], dtype=np.int64), "text": np.frombuffer(b"".join(texts), np.uint8)}
    if not texts:
        return out
    start, length, count, owner = (np.concatenate(x).astype(np.int64) for x in (starts, lengths, words, owners))
    # Equal windows become one pattern with all its items.
    powers = np.full(size, _R, np.uint64)
    powers[0] = 1
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((out["text"].astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(powers), out=sums[1:])
    powers[1:] = _RI
    key = (sums[start + length] - sums[start]) * np.multiply.accumulate(powers)[start]
    del powers, sums
    order = np.lexsort((owner, length, key))
    start, length, count, owner, key = (x[order] for x in (start, length, count, owner, key))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (length[1:] != length[:-1])
    whole, runs = b"".join(texts), np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    for k in np.flatnonzero(~new).tolist():
        f = runs[k]
        if whole[start[f] : start[f] + length[f]] != whole[start[k] : start[k] + length[k]]:
            new[k] = True  # a chance clash of hashes: a pattern of its own
    group = np.cumsum(new) - 1
    again = np.concatenate([[False], (group[1:] == group[:-1]) & (owner[1:] == owner[:-1])])
    held = np.flatnonzero((owner >= 0) & ~again)
    start, length, count = start[new], length[new], count[new]
    owned = np.searchsorted(group[held], np.arange(len(start) + 1))
    owner = owner[held]
    padded = np.concatenate([out["text"], np.zeros(BLOCK, np.uint8)])
    values = np.lib.stride_tricks.sliding_window_view(padded, BLOCK)[:size].copy().view("<u8").ravel()
    kind = np.frompyfunc(int.bit_length, 1, 1)(np.minimum(length, 64).astype(object)).astype(np.int64)
    for c in np.unique(kind).tolist():
        ks = np.flatnonzero(kind == c)
        m = int(min(length[ks].min(), LONGEST))
        b = max(1, min(BLOCK, m // 2))
        bits = int(min(MOST_BITS, max(LEAST_BITS, (4 * min(size, len(ks) * (m - b + 1))).bit_length())))
        shift = np.full(1 << bits, m - b + 1, np.uint8)
        for end in range(b, m + 1):
            shift[_slots(values[start[ks] + end - b], b, bits)] = m - end
        # As many slots of buckets as patterns, about.
        spare = max(0, bits - max(8, len(ks).bit_length()))
        slot = _slots(values[start[ks] + m - b], b, bits) >> np.uint64(spare)
        by = np.argsort(slot, kind="stable")
        ks, slot = ks[by], slot[by]
        many = owned[ks + 1] - owned[ks]
        flat = np.repeat(owned[ks] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        made = Tables(m, b, bits, shift, np.searchsorted(slot, np.arange((1 << bits - spare) + 1)).astype(np.uint32), start[ks].astype(np.uint32), length[ks].astype(np.uint32), count[ks].astype(np.uint32), owner[flat].astype(np.uint32), np.concatenate([[0], np.cumsum(many)]).astype(np.uint32))
        out |= {f"{c}.{k}": np.asarray(v) for k, v in vars(made).items()}
    return out


class Matcher:
    """Searches for all windows of a block."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.text = memoryview(arrays["text"])
        self.names, self.ends = arrays["names"], arrays["ends"]
        classes = sorted({k.partition(".")[0] for k in arrays if "." in k})
        read = lambda c, k, v: int(v) if k in ("m", "b", "bits") else memoryview(v)
        self.classes = [Tables(**{k.partition(".")[2]: read(c, k.partition(".")[2], v) for k, v in arrays.items() if k.startswith(f"{c}.")}) for c in classes]

    def name(self, k: int) -> str:
        return self.names[self.ends[k - 1] if k else 0 : self.ends[k]].tobytes().decode()

    def find(self, joined: bytes, t: Tables) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence of the class's patterns, overlaps included."""
        shift, bucket, start, length, whole = t.shift, t.bucket, t.start, t.length, self.text
        b, m, n, down = t.b, t.m, len(joined), 64 - t.bits
        spare = t.bits - (len(bucket) - 1).bit_length() + 1
        number, end = int.from_bytes, m
        while end <= n:
            slot = (number(joined[end - b : end], "little") * _MIX & _ALL) >> down
            jump = shift[slot]
            if jump:
                end += jump
                continue
            slot >>= spare
            at = end - m
            for k in range(bucket[slot], bucket[slot + 1]):
                s = start[k]
                if joined[at : at + length[k]] == whole[s : s + length[k]]:
                    yield at, k
            end += 1

    def search(self, joined: bytes) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals [from, to) that are hit, and the items found, of a text's words joined and framed by spaces."""
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        for t in self.classes:
            at = word = 0
            for start, k in self.find(joined, t):
                word += joined.count(b" ", at, start)
                at = start
                found.append((word, word + t.words[k]))
                items.update(t.owner[t.owned[k] : t.owned[k + 1]])
        return found, {self.name(k) for k in items}


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _built(benchmark: DataFrame, item_col: str, text_col: str, window: int, limit: int) -> list[str]:
    """Builds the tables of a benchmark; the folders of their blocks."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    path = shared_dir(benchmark.sparkSession)

    def run(batches):
        fs, root = filesystem(path)

        def put(block) -> str:
            name = uuid.uuid4().hex
            for key, array in build(block, window).items():
                publish(fs, f"{root}/{name}/{key}.npy", lambda out, array=array: out.write(_saved(array)))
            return name

        block, held, names = [], 0, []
        for batch in batches:
            for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = t.encode()
                if block and held + len(data) > limit:
                    names.append(put(block))
                    block, held = [], 0
                block.append((i, data))
                held += len(data)
        if block:
            names.append(put(block))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["block"])

    blocks = materialise(items.repartition(max(1, -(-size // limit))).mapInArrow(run, "block string"))
    return sorted(f"{path}/{r.block}" for r in blocks.collect())


def _saved(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def load(folder: str) -> dict[str, np.ndarray]:
    """The arrays of a block, mapped to memory where the folder is a file system's, else read."""
    from pyarrow.fs import FileSelector

    fs, root = filesystem(folder)
    names = [f.path for f in fs.get_file_info(FileSelector(root)) if f.path.endswith(".npy")]
    key = lambda name: name.rpartition("/")[2].removesuffix(".npy")
    if fs.type_name == "local":
        import os

        mapped = lambda name: np.load(name, mmap_mode="r" if os.path.getsize(name) > 4096 else None)
        return {key(n): mapped(n) for n in names}
    out = {}
    for n in names:
        with fs.open_input_file(n) as f:
            out[key(n)] = np.load(io.BytesIO(f.read()))
    return out


OUTPUTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_OUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns `keep` (all by default) of docs with n_words, n_hit, n_items, items_sha256 and contaminated; narrow."""
    folders = _built(benchmark, item_col, item_text, window, block_bytes)

    def factory():
        matchers = [Matcher(load(f)) for f in folders]

        def kernel(batch):
            n_words, n_hit, n_items, digest = [], [], [], []
            for text in texts_of(batch.column(0)):
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                found, items = [], set()
                for m in matchers if words else []:
                    hits, own = m.search(joined)
                    found += hits
                    items |= own
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in merged(found)))
                n_items.append(len(items))
                digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]

        return kernel

    return arrow_columns(docs, factory, _OUT, docs.columns if keep is None else keep, [text_col])


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS g
  FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, row_number() OVER () AS k, {_WORDS_SQL} AS w FROM documents),
dw AS (SELECT k, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
h AS (SELECT k, dw.n, i, item FROM (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw) dw JOIN win ON dw.n = win.n AND dw.g = win.g),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM h) GROUP BY k),
found AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN found USING (k)
"""
