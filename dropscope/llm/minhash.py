"""Near-duplicate documents by MinHash bands, with odd sketches for the candidates.

1. Each text becomes its set of distinct word shingles (64-bit hashes), a fingerprint of the set, band keys of
   its MinHash samples, and an odd sketch: the samples are folded into a bitmap, each flipping one bit, so that equal samples
   cancel in the XOR of two sketches. The popcount of the XOR then estimates the similarity, most precisely
   when it is high.
2. Rows with equal sets are one class; only its smallest id goes on.
3. Classes meet in buckets of equal band keys. First every member meets the bucket's smallest member only; links found there
   are confirmed on full sets. Buckets whose members are then still in different components are searched
   pair by pair across components, inside the task, on full sets; sizes and sketches pass over pairs that cannot be linked.
   Links found join their components at once, and only such links leave the task.
   So a group of near copies costs one link per member, and no link between components is lost.
4. Components of the confirmed links.

With 24 bands of 4 samples a pair at similarity 0.85 shares a bucket with probability 1 - 2e-8, at 0.8 1 - 3e-6;
sketches drop a pair only at more than five standard deviations.

Defined cases: null text, or a text without words, has an empty set and no links; fewer words than a shingle make
one shingle; null ids are kept and linked with nothing; rows that repeat an id are one document each, linked
through their texts and named by the id; an empty table gives no rows; extra columns are ignored by ``near_duplicates`` and kept by
``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dropscope.llm.common import keep, lower_word_hashes, mixed, rolled, row_key, rows_of
from dropscope.llm.graph import components

BANDS, ROWS = 24, 4
SKETCH_BITS = 256
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SIGNED = "doc_id BIGINT, row_key BIGINT, n BIGINT, print BINARY, bands ARRAY<BIGINT>, sketch BINARY"


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    hashed = lower_word_hashes([t or b"" for t in texts])
    return [np.unique(rolled(h, min(width, len(h)))) if len(h) else h for h in hashed]


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples (set by sample, 32 bits) of non-empty sets, all sets of a batch at once."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    low = (flat >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    high = flat.astype(np.uint32)
    out = np.empty((len(sets), len(_SEEDS)), np.uint32)
    for k, seed in enumerate(_SEEDS):
        x = (high ^ np.uint32(seed & np.uint64(0xFFFFFFFF))) * np.uint32(seed >> np.uint64(32) | np.uint64(1))
        x ^= x >> np.uint32(15)
        x *= low
        x ^= x >> np.uint32(13)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def odd_sketches(sampled: np.ndarray) -> np.ndarray:
    """Parity bitmaps: sample k with value v flips bit hash(k, v)."""
    at = mixed(sampled.astype(np.uint64) ^ _SEEDS) % np.uint64(SKETCH_BITS)
    flips = np.zeros((len(sampled), SKETCH_BITS), np.uint8)
    np.add.at(flips, (np.arange(len(sampled))[:, None], at.astype(np.int64)), 1)
    return np.packbits(flips & 1, axis=1)


def allowed_flips(similarity: float) -> int:
    """Most XOR bits for a pair to be checked: five standard deviations below ``similarity``.

    Of k samples about k * (1 - s) differ; each then flips two bits of m, and the expected popcount of n flips is
    m / 2 * (1 - (1 - 2 / m) ** n).
    """
    k = len(_SEEDS)
    differ = min(k, k * (1 - similarity) + 5.5 * (k * similarity * (1 - similarity)) ** 0.5)
    return min(SKETCH_BITS, int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ)) + 5))


def _signing(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = list(rows_of([batch.slice(at, 256)]))
                sets = shingle_sets([r[2] for r in rows], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands, sketches = [None] * len(rows), [None] * len(rows)
                if full:
                    sampled = samples([sets[i] for i in full])
                    keys = np.zeros((len(full), BANDS), np.uint64)
                    for j in range(ROWS):
                        keys = mixed(keys + sampled[:, j::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    drawn = odd_sketches(sampled)
                    for i, k, s in zip(full, keys.view(np.int64), drawn, strict=True):
                        bands[i], sketches[i] = k, s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["doc_id", "row_key", "n", "print", "bands", "sketch"],
                )

    return run


def sign(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row per document: set size, set fingerprint, band keys and odd sketch (null for empty sets)."""
    key = row_key(F.col("text")).alias("row_key")
    return docs.select(F.col("doc_id").cast("bigint"), key, F.col("text").cast("binary")).mapInArrow(_signing(width), SIGNED)


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``node, set`` of the full shingle sets of the named classes (``node, doc_id, row_key``)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = list(rows_of([batch.slice(at, 256)]))
                sets = [s.view(np.int64) for s in shingle_sets([r[1] for r in rows], width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"]
                )

    texts = docs.select("doc_id", row_key(F.col("text")).alias("row_key"), F.col("text").cast("binary").alias("text"))
    wanted = texts.join(ids, ["doc_id", "row_key"]).select("node", "text")
    return wanted.mapInArrow(run, "node BIGINT, set ARRAY<BIGINT>").dropDuplicates(["node"])


def confirm(pairs: DataFrame, docs: DataFrame, ids: DataFrame, percent: int, width: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with 100 * intersection >= percent * union on the full sets."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = keep(_sets(docs, ids.join(nodes, "node", "left_semi"), width), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    return keep(both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"), "confirmed")


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint16)


def _joining(percent: int, flips: int, block: int = 512):
    """Links of one bucket (or of two of its parts) that join two components; checked on full sets, inside the task.

    Components met here are joined as links are found, so a group of n members gives at most n - 1 links,
    whatever number of its pairs resemble each other.
    """

    def run(group: pa.Table) -> pa.Table:
        node, comp, part, first, second = (group.column(c).to_numpy().copy() for c in ("node", "comp", "part", "i", "j"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        lists = group.column("set").combine_chunks()
        n = lists.value_lengths().to_numpy().astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(n)])
        words, ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        mine = np.zeros(len(words), np.int64)
        b_side = np.flatnonzero(part == second[0])
        out: list[tuple[int, int]] = []
        for x in np.flatnonzero(part == first[0]):
            others = b_side[b_side > x] if first[0] == second[0] else b_side
            may = (comp[others] != comp[x]) & (100 * np.minimum(n[x], n[others]) >= percent * np.maximum(n[x], n[others]))
            others = others[may]
            if not len(others):
                continue
            mine[ids[edge[x] : edge[x + 1]]] = 1
            for cut in range(0, len(others), block):
                near = others[cut : cut + block]
                near = near[(comp[near] != comp[x]) & (_BITS[sketch[near] ^ sketch[x]].sum(1) <= flips)]
                if not len(near):
                    continue
                shared = np.add.reduceat(mine[np.concatenate([ids[edge[y] : edge[y + 1]] for y in near])], np.cumsum(n[near]) - n[near])
                for y in near[100 * shared >= percent * (n[x] + n[near] - shared)]:
                    if comp[y] != comp[x]:
                        out.append((min(node[x], node[y]), max(node[x], node[y])))
                        comp[comp == comp[y]] = comp[x]
            mine[ids[edge[x] : edge[x + 1]]] = 0
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def class_links(docs: DataFrame, classes: DataFrame, percent: int, width: int, part: int = 1 << 20) -> DataFrame:
    """Confirmed links ``a, b`` between classes (``node, doc_id, row_key, n, bands, sketch``): enough of them to connect all
    that are linked. A bucket is dealt into parts of about ``part`` shingles, which bounds a task."""
    flips = allowed_flips(percent / 100)
    ids = classes.select("node", "doc_id", "row_key")
    drawn = classes.select("node", "n", "sketch")
    members = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("size")).filter("size > 1")
    members = keep(members.join(buckets, "bucket"), "members")
    star = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    one = star.join(drawn.toDF("a", "na", "sa"), "a").join(drawn.toDF("b", "nb", "sb"), "b")
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    xor = [F.bit_count(F.conv(F.hex(F.substring("sa", i, 4)), 16, 10).cast("bigint").bitwiseXOR(F.conv(F.hex(F.substring("sb", i, 4)), 16, 10).cast("bigint"))) for i in range(1, SKETCH_BITS // 8, 4)]
    close = one.filter(sizes & (sum(xor[1:], xor[0]) <= flips)).select("a", "b")
    links = confirm(keep(close, "star"), docs, ids, percent, width)

    found = components(links).select("node", F.col("component").alias("comp"))
    placed = members.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sized = placed.join(drawn, "node")
    # Buckets with the same members, as a group of near copies has in many bands, are searched once.
    members_hash = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    mixed_ = sized.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("work"), F.count("*").alias("m"), members_hash.alias("h"))
    mixed_ = mixed_.filter("lo < hi AND m > 2")  # two members have met in the star
    mixed_ = mixed_.groupBy("m", "h").agg(F.min("bucket").alias("bucket"), F.max("work").alias("work"))
    open_ = keep(sized.join(mixed_.select("bucket", "work"), "bucket").select("bucket", "node", "comp", "sketch", "work"), "open")
    sets = keep(_sets(docs, ids.join(open_.select("node").distinct(), "node", "left_semi"), width), "open_sets")
    open_ = open_.withColumn("parts", F.expr(f"(work + {part - 1}) div {part}")).withColumn("part", F.expr("pmod(xxhash64(node), parts)"))
    pairs = F.expr("flatten(transform(sequence(0L, parts - 1), k -> array(struct(least(part, k) AS i, greatest(part, k) AS j))))")
    dealt = open_.join(sets, "node").select("bucket", "node", "comp", "sketch", "set", "part", F.explode(pairs).alias("ij"))
    dealt = dealt.select("bucket", "node", "comp", "sketch", "set", "part", "ij.i", "ij.j")
    more = dealt.groupBy("bucket", "i", "j").applyInArrow(_joining(percent, flips), "a BIGINT, b BIGINT").distinct()
    return links.unionByName(keep(more, "across"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """``doc_id, row_key, n_shingles, component_id, kept`` per row; ``leads``: the one row that stands for the group."""
    signed = keep(sign(docs, width), "signed")
    full = signed.filter("print is not null and doc_id is not null")
    best = F.min_by(F.struct("row_key", "n", "bands", "sketch"), F.struct("doc_id", "row_key"))
    classes = keep(full.groupBy("print").agg(F.min("doc_id").alias("doc_id"), best.alias("r")).select("print", "doc_id", "r.*"), "classes")
    numbered = classes.withColumn("node", F.xxhash64("print"))
    links = class_links(docs, numbered, percent, width)
    grouped = components(links)
    name = F.min(F.struct("doc_id", "row_key")).alias("leader")
    leaders = grouped.join(numbered.select("node", "doc_id", "row_key"), "node").groupBy("component").agg(name)
    named = grouped.join(leaders, "component").select("node", "leader")
    classes = numbered.join(named, "node", "left").select(
        F.col("print").alias("class"), F.coalesce("leader", F.struct("doc_id", "row_key")).alias("leader")
    )
    rows = signed.select("doc_id", "row_key", "n", "print")
    joined = rows.join(classes, (rows["print"] == classes["class"]) & rows["doc_id"].isNotNull(), "left")
    alone = F.col("leader").isNull()
    return joined.select(
        "doc_id",
        "row_key",
        F.col("n").alias("n_shingles"),
        F.coalesce("leader.doc_id", "doc_id").alias("component_id"),
        (alone | (F.col("doc_id") == F.col("leader.doc_id"))).alias("kept"),
        (alone | ((F.col("doc_id") == F.col("leader.doc_id")) & (F.col("row_key") == F.col("leader.row_key")))).alias("leads"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """One document of each group, the smallest id (then row key); all columns kept. Rows that are equal in
    id and text are one document."""
    found = keep(near_duplicates(docs, percent, width), "found")
    gone = found.filter(~F.col("leads")).select("doc_id", "row_key").distinct()
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), row_key(F.col("row.text")).alias("row_key"))
    left = rows.join(gone, ["doc_id", "row_key"], "left_anti")
    again = found.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "row_key").count().filter("count > 1")
    if not again.isEmpty():  # only then are the texts dealt out by id
        marked = left.join(again.drop("count"), ["doc_id", "row_key"], "left_semi").dropDuplicates(["doc_id", "row_key"])
        left = left.join(again.drop("count"), ["doc_id", "row_key"], "left_anti").unionByName(marked)
    return left.select("row.*")
