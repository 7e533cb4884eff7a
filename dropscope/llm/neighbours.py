"""Near-duplicate vectors by NN-descent.

1. Vectors that can be compared are normalised in double precision; equal ones of one label are one node with a weight.
2. A neighbour graph is started from random-projection leaves: nodes meet in small leaves of one label, and each
   keeps its ``k`` best neighbours; a list full of links would hide others, so a leaf also returns links that connect
   all that its pairs connect. Planes lie within one spread of the label's mean. Rounds of leaves are as many as make
   a pair at the threshold miss all of them with probability 1e-4, by a bound that holds for any vectors. A leaf of
   very many like vectors is compared whole, in blocks; so is a label that is small, or whose leaves would take as
   many comparisons as all its pairs.
3. The graph is refined by neighbours-of-neighbours joins until they find no new link between components.
4. A list full of links is saturated, however long it is made, in a large group of like vectors. Neighbours of
   neighbours lead through the whole component of such a node, so its list is enlarged to the component: members are
   compared in blocks inside tasks, which give counts of links per node, not pairs.
5. Recall is audited in labels that were not compared whole: a bounded sample of nodes, and one of linked nodes, is
   compared with all vectors of their labels. Below ``least_recall`` another set of leaves is built and the graph
   refined again; after ``most_rounds`` sets these labels are compared whole.

Defined cases: null, zero or empty vectors, vectors with null or non-finite parts, null labels and null ids link with
nothing; vectors of different lengths are not compared; equal vectors link with one another; repeated rows count as vectors of their
own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dropscope.llm.common import keep, rows_of
from dropscope.llm.graph import components

LEAF, SPLIT = 128, 1024
EDGE = "a BIGINT, b BIGINT, cosine DOUBLE"


def _units(batches):
    for batch in batches:
        rows = list(rows_of([batch]))
        vectors = [np.array(v, np.float64) for _, _, v in rows]
        vectors = [v / np.abs(v).max() for v in vectors]
        vectors = [(v / np.sqrt(v @ v)).tobytes() for v in vectors]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(vectors, pa.binary())],
            names=["vec_id", "grp", "unit"],
        )


def _comparable(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vec_id, grp, unit`` of the rows that can be compared, and the other rows."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    fit = F.coalesce(fit & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    grp = F.xxhash64("label", F.size("embedding")).alias("grp")
    units = vectors.filter(fit).select(F.col("vec_id").cast("bigint"), grp, F.col("embedding").cast("array<double>"))
    return units.mapInArrow(_units, "vec_id BIGINT, grp BIGINT, unit BINARY"), vectors.filter(~fit)


def nodes(vectors: DataFrame) -> DataFrame:
    """``node`` (smallest vec_id), ``grp`` (label and length), ``unit`` (normalised, little-endian doubles), ``weight``."""
    units = _comparable(vectors)[0]
    return units.groupBy("grp", "unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1)


def _totals(batches):
    """Sum and number of the vectors of each label in a batch."""
    for batch in batches:
        grp, unit = batch.column("grp").to_numpy(), batch.column("unit").to_pylist()
        found = np.unique(grp)
        at = [np.flatnonzero(grp == g) for g in found]
        totals = [np.stack([np.frombuffer(unit[i], np.float64) for i in own]).sum(axis=0).tobytes() for own in at]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals, pa.binary()), pa.array([len(a) for a in at], pa.int64())], names=["grp", "total", "n"])


def _planned(link: float, miss: float = 1e-4) -> Callable:
    """Mean of a label, and how many planes and rounds its leaves take; 0 rounds: to be compared whole.

    A plane through mean + u * spread, u uniform in (-1, 1), parts vectors at distance d with probability
    E|N(0, d)| / (2 * spread) at most, wherever they lie.
    """

    def run(label: pa.Table) -> pa.Table:
        size = int(label.column("n").to_numpy().sum())
        mean = _matrix(label.column("total")).sum(axis=0) / size
        spread = math.sqrt(max(0.0, 1 - float(mean @ mean)))
        bits = math.ceil(math.log2(size / LEAF))
        parted = math.sqrt(2 / math.pi) * math.sqrt(2 - 2 * link) / max(2 * spread, 1e-9)
        meet = max(0.0, 1 - parted) ** bits
        rounds = max(4, math.ceil(math.log(miss) / math.log1p(-meet))) if 1e-9 < meet < 1 else 0 if meet < 1 else 1
        if rounds * LEAF >= size:
            rounds = 0
        return pa.table(
            {
                "grp": label.column("grp").slice(0, 1),
                "size": pa.array([size], pa.int64()),
                "mean": pa.array([mean.tobytes()], pa.binary()),
                "bits": pa.array([bits], pa.int32()),
                "rounds": pa.array([rounds], pa.int32()),
            }
        )

    return run


def plan(vectors: DataFrame, link: float) -> DataFrame:
    """``grp, size, mean, bits, rounds`` of the labels of two nodes at least."""
    sizes = keep(vectors.groupBy("grp").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    none = [F.lit(None).cast("binary").alias("mean"), F.lit(0).alias("bits"), F.lit(0).alias("rounds")]
    small = sizes.filter(f"size <= {SPLIT}").select("grp", "size", *none)
    large = vectors.join(sizes.filter(f"size > {SPLIT}"), "grp", "left_semi").select("grp", "unit")
    totals = large.mapInArrow(_totals, "grp BIGINT, total BINARY, n BIGINT")
    planned = totals.groupBy("grp").applyInArrow(_planned(link), "grp BIGINT, size BIGINT, mean BINARY, bits INT, rounds INT")
    return keep(planned.unionByName(small), "plan")


def _codes(seed: int) -> Callable:
    """Leaf of each node in every round, of labels with rounds."""

    def run(batches):
        planes = {}
        for batch in batches:
            grp, unit = batch.column("grp").to_numpy(), batch.column("unit").to_pylist()
            mean, bits, rounds = (batch.column(c) for c in ("mean", "bits", "rounds"))
            codes: list = [None] * len(unit)
            for g in np.unique(grp):
                at = np.flatnonzero(grp == g)
                first = int(at[0])
                b, r = bits[first].as_py(), rounds[first].as_py()
                if g not in planes:
                    if len(planes) >= 64:
                        planes.clear()
                    rng, m = np.random.default_rng([seed, int(g) & (1 << 64) - 1]), np.frombuffer(mean[first].as_py(), np.float64)
                    normal = rng.standard_normal((r * b, len(m)))
                    planes[g] = normal, normal @ m + rng.uniform(-1, 1, r * b) * math.sqrt(max(0.0, 1 - float(m @ m)))
                normal, place = planes[g]
                signs = (np.stack([np.frombuffer(unit[i], np.float64) for i in at]) @ normal.T > place).reshape(len(at), r, b)
                for i, own in zip(at, signs @ (1 << np.arange(b, dtype=np.int64)) * r + np.arange(r), strict=True):
                    codes[i] = own
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("grp"), pa.array(codes, pa.list_(pa.int64()))], names=["node", "grp", "codes"]
            )

    return run


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of links that connect whatever ``links`` connects, at most one per node."""
    rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    free, fresh = links.any(axis=1), np.ones(links.shape[1], bool)  # rows and columns not reached yet
    while free.any():
        row = np.flatnonzero(free)[:1]
        free[row] = False
        while len(row):
            col = np.flatnonzero(links[row].any(axis=0) & fresh)
            rows.append(row[links[np.ix_(row, col)].argmax(axis=0)])
            cols.append(col)
            fresh[col] = False
            row = np.flatnonzero(links[:, col].any(axis=1) & free)
            rows.append(row)
            cols.append(col[links[np.ix_(row, col)].argmax(axis=1)] if len(row) else row)
            free[row] = False
    return np.concatenate(rows), np.concatenate(cols)


def _best(k: int, floor: float, link: float) -> Callable:
    """Each node's ``k`` best neighbours in a leaf or part of one, and links that join all linked nodes of the leaf (or
    of two of its parts)."""

    def run(leaf: pa.Table) -> pa.Table:
        part, first, second = (leaf.column(c).to_numpy() for c in ("part", "i", "j"))
        unit, node = _matrix(leaf.column("unit")), leaf.column("node").to_numpy()
        x, y = np.flatnonzero(part == first[0]), np.flatnonzero(part == second[0])
        cosine = unit[x] @ unit[y].T
        if first[0] == second[0]:
            np.fill_diagonal(cosine, -2)
        row, col = _forest(cosine >= link)
        near = min(k, len(x) - 1) if first[0] == second[0] else 0
        if near > 0:
            at = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
            from_, to = np.repeat(np.arange(len(x)), near), at.ravel()
            ok = cosine[from_, to] >= floor
            row, col = np.concatenate([from_[ok], row]), np.concatenate([to[ok], col])
        a, b = np.minimum(node[x[row]], node[y[col]]), np.maximum(node[x[row]], node[y[col]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(cosine[row, col], pa.float64())})

    return run


def start(vectors: DataFrame, labels: DataFrame, link: float, k: int, floor: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Edges of the first graph over ``labels`` (of ``plan``), and the labels that were not compared whole."""
    placed = vectors.join(labels.filter("rounds > 0"), "grp").select("node", "grp", "unit", "mean", "bits", "rounds")
    placed = placed.mapInArrow(_codes(seed), "node BIGINT, grp BIGINT, codes ARRAY<BIGINT>")
    placed = keep(placed.select("node", "grp", F.explode("codes").alias("code")), "codes")
    sizes = keep(placed.groupBy("grp", "code").agg(F.count("*").alias("size")).filter("size > 1"), "leaves")
    cost = sizes.groupBy("grp").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("cost"))
    fits = F.expr("rounds > 0 AND coalesce(cost, 0) < double(size) * size")
    labels = keep(labels.join(cost, "grp", "left").withColumn("parted", fits), "costs")
    whole = labels.filter("NOT parted").select("grp", F.lit(-1).cast("bigint").alias("code"), "size")
    parted = labels.filter("parted").drop("parted", "cost")
    leaves = placed.join(sizes, ["grp", "code"]).join(parted.select("grp"), "grp", "left_semi").select("node", "grp", "code", "size")
    leaves = leaves.unionByName(vectors.join(whole, "grp").select("node", "grp", "code", "size"))
    leaves = leaves.withColumn("parts", F.expr(f"(size + {SPLIT - 1}) div {SPLIT}"))
    leaves = leaves.withColumn("part", F.expr(f"pmod(xxhash64(node, code, {seed}), parts)"))
    leaves = leaves.select("node", "grp", "code", "part", F.explode(_part_pairs()).alias("ij"))
    leaves = leaves.select("node", "grp", "code", "part", "ij.i", "ij.j").join(vectors.select("node", "unit"), "node")
    return leaves.groupBy("grp", "code", "i", "j").applyInArrow(_best(k, floor, link), EDGE).distinct(), parted


def _part_pairs():
    """Pairs of parts that a member of ``part`` out of ``parts`` is compared in."""
    return F.expr("transform(sequence(0L, parts - 1), k -> struct(least(part, k) AS i, greatest(part, k) AS j))")


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``a, b, cosine`` of node pairs, in double precision."""

    def run(batches):
        for batch in batches:
            x, y = _matrix(batch.column("x")), _matrix(batch.column("y"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(np.einsum("ij,ij->i", x, y))], names=["a", "b", "cosine"]
            )

    left = vectors.select(F.col("node").alias("a"), F.col("unit").alias("x"))
    right = vectors.select(F.col("node").alias("b"), F.col("unit").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    same = F.octet_length("x")  # batches of one length only
    return joined.filter(same == F.octet_length("y")).repartition(F.col("a"), same).sortWithinPartitions(same).mapInArrow(_by_length(run), EDGE)


def _by_length(run: Callable) -> Callable:
    def each(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("x").to_pylist()])
            for size in np.unique(sizes):
                yield from run([batch.filter(pa.array(sizes == size))])

    return each


def refine(edges: DataFrame, vectors: DataFrame, link: float, floor: float, k: int) -> tuple[DataFrame, DataFrame]:
    """Edges and component of each linked node, once neighbours of neighbours join no more components.

    Only candidates in different components are compared: inside one, all members will meet.
    """
    while True:
        found = keep(components(edges.filter(F.col("cosine") >= link).select("a", "b")), "found")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
        named = both.join(found.toDF("b", "cb"), "b", "left").withColumn("cb", F.coalesce("cb", "b"))
        # One neighbour for each component next to a node stands for the others of that component.
        lists = named.groupBy("a", "cb").agg(F.max_by("b", "cosine").alias("b"))
        near = lists.select("a", "b", "cb").join(lists.toDF("a", "cc", "c"), "a").filter("cb < cc")
        pairs = near.select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b")).distinct()
        pairs = pairs.join(edges, ["a", "b"], "left_anti")
        new = keep(cosines(pairs, vectors).filter(F.col("cosine") >= floor), "new")
        if new.filter(F.col("cosine") >= link).isEmpty():
            return edges, found
        edges = keep(edges.unionByName(new), "edges")


def _counts(link: float, block: int = 1024) -> Callable:
    """Weighted links per node of one component (or between two of its parts)."""

    def run(group: pa.Table) -> pa.Table:
        part, first, second = (group.column(c).to_numpy() for c in ("part", "i", "j"))
        unit, node, weight = _matrix(group.column("unit")), group.column("node").to_numpy(), group.column("weight").to_numpy()
        a, b = np.flatnonzero(part == first[0]), np.flatnonzero(part == second[0])
        n = np.zeros(len(node), np.int64)
        for x in np.array_split(a, max(1, len(a) // block)):
            for y in np.array_split(b, max(1, len(b) // block)):
                near = (unit[x] @ unit[y].T >= link) & (node[x][:, None] != node[y])
                n[x] += near @ weight[y]
                if first[0] != second[0]:
                    n[y] += weight[x] @ near
        return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def count_links(vectors: DataFrame, found: DataFrame, link: float, part: int = 2048) -> DataFrame:
    """``node, n``: weight of the other nodes of the component linked directly."""
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    members = found.join(sizes, "component").join(vectors.select("node", "unit", "weight"), "node")
    members = members.withColumn("parts", F.expr(f"(size + {part - 1}) div {part}")).withColumn("part", F.expr("pmod(xxhash64(node), parts)"))
    dealt = members.select("component", "node", "unit", "weight", "part", F.explode(_part_pairs()).alias("ij")).select(
        "component", "node", "unit", "weight", "part", "ij.i", "ij.j"
    )
    counted = dealt.groupBy("component", "i", "j").applyInArrow(_counts(link), "node BIGINT, n BIGINT")
    return counted.groupBy("node").agg(F.sum("n").alias("n"))


def audit(vectors: DataFrame, found: DataFrame, counted: DataFrame, link: float, sample: int = 256) -> float:
    """Share of the true links of about ``sample`` nodes, and as many linked ones, that were counted; 1.0 without links.

    The sample, bounded by ``sample``, goes to every task; its nodes are compared with all vectors.
    """
    chosen = {}
    for rows in vectors, vectors.join(found.select("node"), "node", "left_semi"):
        share = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, rows.count())))
        chosen |= {r["node"]: r for r in rows.filter(share).limit(2 * sample).select("node", "grp", "unit").collect()}
    chosen = list(chosen.values())
    by_group: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g in {r["grp"] for r in chosen}:
        own = [r for r in chosen if r["grp"] == g]
        by_group[g] = np.array([r["node"] for r in own]), np.stack([np.frombuffer(r["unit"], np.float64) for r in own])

    def run(batches):
        for batch in batches:
            out = [np.empty(0, np.int64)]
            weights = [np.empty(0, np.int64)]
            node, grp, weight = (batch.column(c).to_numpy() for c in ("node", "grp", "weight"))
            unit = batch.column("unit").to_pylist()
            for g in set(grp.tolist()) & set(by_group):
                at = np.flatnonzero(grp == g)
                ids, wanted = by_group[g]
                all_ = np.stack([np.frombuffer(unit[i], np.float64) for i in at])
                i, j = np.nonzero((wanted @ all_.T >= link) & (ids[:, None] != node[at]))
                out.append(ids[i])
                weights.append(weight[at][j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(weights))], names=["node", "n"])

    true = vectors.select("node", "grp", "unit", "weight").mapInArrow(run, "node BIGINT, n BIGINT").groupBy("node").agg(F.sum("n").alias("true"))
    have, want = true.join(counted, "node", "left").agg(F.sum(F.coalesce("n", F.lit(0))), F.sum("true")).first()
    return have / want if want else 1.0


def near_vectors(
    vectors: DataFrame, link: float = 0.98, k: int = 8, floor: float = 0.9, least_recall: float = 0.995, most_rounds: int = 4
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``."""
    placed = keep(nodes(vectors), "nodes")
    labels = plan(placed, link)
    edges, found, counted = None, None, None
    for seed in range(most_rounds + 1 if not labels.isEmpty() else 0):
        if seed == most_rounds:
            labels = labels.withColumn("rounds", F.lit(0))
        more, labels = start(placed, labels, link, k, floor, seed)
        edges = keep(more if edges is None else edges.unionByName(more).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "edges")
        exact = labels.isEmpty()
        if exact:
            found = keep(components(edges.filter(F.col("cosine") >= link).select("a", "b")), "found")
        else:
            edges, found = refine(edges, placed, link, floor, k)
        counted = keep(count_links(placed, found, link), "counted")
        if exact or audit(placed.join(labels, "grp", "left_semi"), found, counted, link) >= least_recall:
            break
    summed = placed.select("node", "grp", "unit", "weight")
    if found is not None:
        summed = summed.join(found, "node", "left").join(counted, "node", "left")
    else:
        summed = summed.withColumns({"component": F.lit(None).cast("bigint"), "n": F.lit(None).cast("bigint")})
    summed = summed.select(
        "grp", "unit", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    units, rest = _comparable(vectors)
    linked = units.join(summed, ["grp", "unit"]).select("vec_id", "n_links", "component_id")
    rest = rest.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    rest = rest.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
