"""Removal of word passages that repeat across documents.

Every window of ``width`` words has a Rabin-Karp hash; the first document of each hash is found by a
count in Spark, windows that start in a later document are repeated, and overlapping or touching ones
merge into maximal removal intervals.

Two lossless steps keep most windows out of the shuffle:

* Documents with the same words are one class. All windows of a copy under a later id are repeated, so only the first
  row of each class is compared; rows of its id with the same words share its intervals.
* A window can only repeat if its least short-gram hash (its minimizer) does. A document has one distinct
  minimizer per twenty words or so; these are counted first, and only windows whose minimizer occurs in two
  documents are hashed and counted.

Hashes are 64 bits, mixed; equal hashes count as equal windows.

Defined cases: null text has no words; texts shorter than a window lose nothing; null ids neither remove nor lose words; rows repeating an id
don't remove each other's words; an empty table gives no rows; extra columns are kept by ``dedup`` and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dropscope.llm.common import WordHashes, keep, rolled, row_key, rows_of

GRAM = 8


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Per window of ``width`` words, the least hash of its runs of GRAM words."""
    least, span, have = rolled(hashes, min(GRAM, width)), width - min(GRAM, width) + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def _profiling(width: int):
    def run(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for doc_id, key, text in rows_of([batch.slice(at, 512)]):
                    words = (text or b"").split()
                    grams = np.empty(0, np.int64)
                    if len(words) >= width:
                        grams = np.unique(minimizers(known.of(words), width)).view(np.int64)
                    out.append((doc_id, key, len(words), xxhash.xxh3_128_digest(b" ".join(words)), grams))
                columns = zip(*out, strict=True)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                    names=["doc_id", "row_key", "n_words", "print", "grams"],
                )

    return run


def _windows(width: int):
    """Hashes of the windows whose minimizer is among ``grams``, with their places."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, keys, places, hashes = [], [], [], []
                for doc_id, key, text, grams in rows_of([batch.slice(at, 64)]):
                    own = known.of((text or b"").split())
                    at_ = np.flatnonzero(np.isin(minimizers(own, width).view(np.int64), np.array(grams, np.int64)))
                    ids.append(np.full(len(at_), doc_id, np.int64))
                    keys.append(np.full(len(at_), key, np.int64))
                    places.append(at_.astype(np.int32))
                    hashes.append(rolled(own, width).view(np.int64)[at_])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (ids, keys, places, hashes)], names=["doc_id", "row_key", "place", "window"]
                )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", row_key(F.col("text")).alias("row_key"), F.col("text").cast("binary").alias("text"))


def profiles(docs: DataFrame, width: int) -> DataFrame:
    schema = "doc_id BIGINT, row_key BIGINT, n_words BIGINT, print BINARY, grams ARRAY<BIGINT>"
    return _texts(docs).mapInArrow(_profiling(width), schema)


def repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``doc_id, row_key, n_words, intervals`` per row with words to remove; intervals [start, end) in word places."""
    profiled = keep(profiles(docs, width), "profiles")
    long = profiled.filter(f"n_words >= {width} and doc_id is not null")
    first = long.groupBy("print").agg(F.min(F.struct("doc_id", "row_key")).alias("f"))
    members = long.select("doc_id", "row_key", "n_words", "print").join(first, "print")
    members = members.select("doc_id", "row_key", "n_words", F.col("f.doc_id").alias("lead"), F.col("f.row_key").alias("lead_key")).distinct()
    lead = first.select("f.*")

    grams = long.select("doc_id", "row_key", F.explode("grams").alias("gram")).join(lead, ["doc_id", "row_key"], "left_semi")
    grams = keep(grams, "grams")
    shared = grams.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("gram")
    held = grams.join(shared, "gram").groupBy("doc_id", "row_key").agg(F.collect_list("gram").alias("grams"))
    texts = _texts(docs).join(held, ["doc_id", "row_key"]).dropDuplicates(["doc_id", "row_key"])
    windows = keep(texts.select("doc_id", "row_key", "text", "grams").mapInArrow(_windows(width), "doc_id BIGINT, row_key BIGINT, place INT, window BIGINT"), "windows")
    starts = windows.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("window", "lo")
    starts = keep(starts, "starts")  # read from a table, so that a very common window's part of the join can be split
    hit = windows.join(starts, "window").filter("doc_id > lo")

    # Places of one document are its own words' places, so a group is no larger than its document.
    merged = hit.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("place")).alias("at"))
    back = F.slice(F.concat(F.array(F.lit(None).cast("int")), "at"), 1, F.size("at"))
    ahead = F.slice(F.concat("at", F.array(F.lit(None).cast("int"))), 2, F.size("at"))
    opens = F.array_compact(F.zip_with("at", back, lambda x, p: F.when(p.isNull() | (x - p > width), x)))
    closes = F.array_compact(F.zip_with("at", ahead, lambda x, n: F.when(n.isNull() | (n - x > width), x + width)))
    spans = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    merged = merged.select("doc_id", F.col("row_key").alias("lead_key"), spans.alias("intervals"))
    # Rows of the first id have its first row's words, so that row's intervals; copies under later ids lose all.
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    cut = members.join(merged, ["doc_id", "lead_key"], "left")
    cut = cut.select("doc_id", "row_key", "n_words", F.when(F.col("doc_id") > F.col("lead"), whole).otherwise(F.col("intervals")).alias("intervals"))
    return cut.filter("intervals is not null")


def _cutting(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows, sizes, gone, kept = [], [], [], []
            for row, text, intervals in rows_of([batch.slice(at, 256)]):
                words = (text or b"").split()
                sizes.append(len(words))
                pieces, last = [], 0
                for cut in intervals or ():
                    pieces += words[last : cut["start"]]
                    last = cut["end"]
                pieces += words[last:]
                rows.append(row)
                gone.append(len(words) - len(pieces))
                kept.append(b" ".join(pieces).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )


def dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` per row: kept words joined by single spaces."""
    cuts = repeats(docs, width).select("doc_id", "row_key", "intervals")
    joined = _texts(docs).join(cuts, ["doc_id", "row_key"], "left").select("doc_id", "text", "intervals")
    return joined.mapInArrow(_cutting, "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, kept_text STRING")
