"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

``tokenize`` turns documents into pieces of at most ``capacity`` tokens. ``pack`` places pieces: the
best-fit-decreasing plan works on *counts* per length (at most ``capacity`` numbers, whatever the corpus
holds), giving runs of equal slots; a piece then takes the slot of its rank within its length. Ranks come
from buckets of (length, salt), where a length holding a third of all pieces gets a third of the salts, so
no task ranks a hot length alone.

Defined cases: null text is empty; an empty text is the end token alone; a null doc_id is kept; repeated rows
are packed once each; an empty table gives no rows; extra columns are ignored by ``tokenize`` and carried
by ``pack``.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dropscope.llm.common import keep

PIECES = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids BINARY"


class _ChunkIds(dict):
    """Token ids (little-endian bytes) of blank-separated chunks, remembered for frequent chunks.

    The tokenizer never joins across blanks, so a text's ids are those of its chunks in order. A chunk of
    Latin-1 letters with one closing ``.`` or ``,`` is split there and lower-cased first, as the tokenizer does;
    such a word goes straight to the tokenizer's model, in its byte alphabet. Anything else takes the whole tokenizer.
    Caches only save time: a chunk beyond their size is encoded anew.
    """

    def __init__(self, path: str, chunks: int = 300_000, cores: int = 900_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most, self.most_cores = chunks, cores
        self.cores: dict[str, bytes] = {}
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.alphabet = {i: spell(chr(i))[0][0] for i in range(128, 256) if chr(i).isalpha()}
        self.tails = {t: self.whole(t) for t in ".,"}

    def whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        core, tail = (chunk[:-1], self.tails[chunk[-1]]) if chunk[-1] in ".," else (chunk, b"")
        if core.isalpha() and (core.isascii() or max(core) < "Ā"):
            core = core.lower()
            ids = self.cores.get(core)
            if ids is None:
                spelled = core if core.isascii() else core.translate(self.alphabet)
                ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])
                if len(self.cores) < self.most_cores:
                    self.cores[core] = ids
            ids += tail
        else:
            ids = self.whole(chunk)
        if len(self) < self.most:
            self[chunk] = ids
        return ids


def _tokenizing(path: str, capacity: int, end_id: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        known = _ChunkIds(path)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
        )
        for batch in batches:
            at, size = 0, 512
            while at < batch.num_rows:  # small steps bound the memory of a batch of long texts
                part = batch.slice(at, size)
                at += size
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    # One text at a time: its words are looked up while they are still in the processor's cache.
                    ids = b"".join(map(known.__getitem__, text.replace("\n", " ").split(" "))) + end
                    for k, cut in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[cut : cut + 4 * capacity]
                        out.append((doc_id, k, cut // 4, len(piece) // 4, piece))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
                )

    return run


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids`` (ids: little-endian unsigned 32-bit) of whole texts."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(_tokenizing(tokenizer_path, capacity, end_id), PIECES)


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs ``(length, rank_from, rank_to, per_sequence, first_sequence, offset)``.

    Sequences of equal filling stand together as (first, how many); every item goes to the fullest sequence
    with room, so a group of n sequences takes n * (room // length) items of one length at once.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # by room left
    rooms: list[int] = []
    runs, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(room: int, first: int, n: int, each: int, length: int = length) -> None:
            nonlocal left, rank
            if n:
                runs.append((length, rank, rank + n * each, each, first, capacity - room))
                put(room - each * length, first, n)
                left, rank = left - n * each, rank + n * each

        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            each = room // length
            full = min(n, left // each)
            place(room, first, full, each)
            rest = 1 if left and full < n else 0
            if rest:
                place(room, first + full, 1, left)
            put(room, first + full + rest, n - full - rest)
    return runs


def pack(pieces: DataFrame, capacity: int = 4096, spread: int = 2048) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) plus ``sequence_id`` and a gapless ``offset``.

    The driver sees one number per length and per (length, salt): at most ``capacity`` and
    ``capacity + spread`` rows. The slot runs depend on these alone, so their table is bounded too.
    """
    spark = pieces.sparkSession
    pieces = keep(pieces.select(F.struct("*").alias("row"), "length"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    total = sum(counts.values())
    salts = spark.createDataFrame(
        [(n, -(-spread * c // total)) for n, c in counts.items()], "length BIGINT, salts BIGINT"
    )
    salted = pieces.join(F.broadcast(salts), "length").select(
        "row", "length", F.expr("pmod(xxhash64(row), salts)").alias("salt")
    )
    ranks, before = [], {}
    for length, salt, n in sorted(salted.groupBy("length", "salt").count().collect()):
        ranks.append((length, salt, before.get(length, 0)))
        before[length] = before.get(length, 0) + n
    ranks = spark.createDataFrame(ranks, "length BIGINT, salt BIGINT, before BIGINT")
    runs = spark.createDataFrame(
        plan_runs(counts, capacity),
        "run_length BIGINT, rank_from BIGINT, rank_to BIGINT, each BIGINT, first BIGINT, offset0 BIGINT",
    )
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy(F.xxhash64("row", F.lit(1))))
    ranked = salted.withColumn("n", within).join(F.broadcast(ranks), ["length", "salt"])
    ranked = ranked.select("row", "length", (F.col("before") + F.col("n") - 1).alias("rank"))
    on = (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("rank_from"), F.col("rank_to") - 1)
    placed = ranked.join(F.broadcast(runs), on).withColumn("nth", F.col("rank") - F.col("rank_from"))
    return placed.select(
        "row.*",
        F.expr("first + nth div each").alias("sequence_id"),
        F.expr("offset0 + (nth % each) * length").alias("offset"),
    )


def packed_digests(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """Places of all pieces, with a CRC-32 of the ids in place of the ids."""
    pieces = tokenize(docs, tokenizer_path, capacity)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(slim, capacity)
