"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropscope.sources.store import scratch_dir

# Characters between words (space, and tab to carriage return).
GAPS = " \t\n\x0b\x0c\r"
GAP_CLASS = r"[\x20\x09-\x0D]+"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the cluster's shared scratch folder and read back: what follows reads files,
    not a long lineage, and a lost executor costs only its running tasks."""
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP_CLASS), "")


def row_key(text: Column) -> Column:
    """With ``doc_id`` the identity of a row: rows equal in both are equal for every operator here."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on (doc_id, row_key), null ids included."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_key"] == b["row_key"])


class WordHashes(dict):
    """64-bit hash per word, remembered for the first ``size`` distinct words a worker meets."""

    def __init__(self, size: int = 300_000):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.size:
            self[word] = value
        return value

    def of(self, words_: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words_), np.uint64, len(words_))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing, so that any bits of the result may be compared or cut."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GAP = np.isin(np.arange(256), np.frombuffer(GAPS.encode(), np.uint8))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)  # A-Z only
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]
_NEXT_GAP = re.compile(b"[" + GAPS.encode() + b"]")
_BASE = 0xD1342543DE82EF95


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2**64."""
    out = np.ones((2, n), np.uint64)
    out[0, 1:], out[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
    return tuple(np.multiply.accumulate(out, axis=1))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of ``data``, which ends with a blank.

    A word's hash is a difference of two running sums, shifted back to its start.
    """
    power, back = _powers(1 << (max(len(data), 1 << 20) - 1).bit_length())
    raw = np.frombuffer(data, np.uint8)
    gap = _GAP[raw]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * power[: len(raw)])])
    return starts, mixed((total[ends] - total[starts]) * back[starts])


def lower_word_hashes(texts: list[bytes], most: int = 1 << 20) -> list[np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased. About ``most`` bytes are worked on at once: short texts
    together, a longer text in parts that end at blanks."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            gap = _NEXT_GAP.search(text, at + most)
            end = gap.end() if gap else len(text)
            parts.append(text[at:end] + b" ")
            owner.append(i)
            at = end
    out: list[list[np.ndarray]] = [[] for _ in texts]
    first = 0
    while first < len(parts):
        last, size = first + 1, len(parts[first])
        while last < len(parts) and size + len(parts[last]) <= most:
            size += len(parts[last])
            last += 1
        starts, hashes = _hashed(b"".join(parts[first:last]))
        cuts = np.searchsorted(starts, np.cumsum([len(p) for p in parts[first : last - 1]]))
        for i, h in zip(owner[first:last], np.split(hashes, cuts), strict=True):
            out[i].append(h)
        first = last
    return [np.concatenate(h) if h else np.empty(0, np.uint64) for h in out]


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash (base odd, modulo 2**64, mixed) of every run of ``width`` words.

    The polynomial is built by doubling: a run of 2m words is run m shifted times base**m, plus run m.
    """
    base = 0x9E3779B97F4A7C15
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, block, size = None, 0, mixed(hashes), 1
    while True:
        if width & size:
            part = block[done : done + n]
            out = part if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
            done += size
        if done == width:
            return mixed(out)
        block = block[:-size] * np.uint64(pow(base, size, 1 << 64)) + block[size:]
        size *= 2


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, column by column converted once per batch."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
