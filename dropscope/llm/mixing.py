"""Mixing sources to target weights.

Token shares p of the sources are tempered, w ~ p ** t. The exponent is bisected on the grid 0..4096 / 4096:
the largest t whose weights meet the target (entropy at least so many bits), or the smallest t that
keeps every source within ``max_repeats`` passes. The budget is the least at which every source is read
once (or a given number of tokens). A source then gets ``epochs`` passes: whole ones, and one over
part of each block. A block is a hash bucket of about ``block_tokens`` tokens of one source, permuted by a
hash for each pass; the last pass takes, in that order, the documents whose middle lies within the block's part of the budget.
Every block meets the weights by itself, so no task needs a source as a whole, and any stretch of ``slot``
order has the target mix.

Defined cases: a null source is a source of its own; null or empty texts have no tokens and come once in
each whole pass, and in the last one if they fall within it; repeated rows are drawn as rows; an empty table gives no rows;
extra columns are kept by ``mix`` and ignored by ``draws``. With an explicit ``budget`` below one pass documents are left out:
that is the operator's purpose.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dropscope.llm.common import keep, words

GRID = 4096
PARTS = 1_000_000  # epochs are whole numbers of these


def source_key(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), column), F.lit("-"))


def draw_hash(*parts: Column) -> Column:
    """60 bits of MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def sources(tokens: DataFrame) -> DataFrame:
    """``key, total, docs`` of every source."""
    return keep(tokens.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("docs")), "sources")


def _measure(table: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Entropy in bits, and passes over the most repeated source when the least repeated is read once; one job."""
    p = F.col("share")
    cols = []
    for i, t in enumerate(exponents):
        w = F.pow(p, F.lit(t))
        cols += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log2(w)).alias(f"h{i}"), F.max(w / p).alias(f"m{i}"), F.min(w / p).alias(f"l{i}")]
    r = table.agg(*cols).first()
    return [(math.log2(r[f"z{i}"]) - r[f"h{i}"] / r[f"z{i}"], r[f"m{i}"] / r[f"l{i}"]) for i in range(len(exponents))]


def bisect_exponent(table: DataFrame, min_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """Bisection on the grid, four halvings to a job. Entropy and passes both fall as the exponent grows to 1.

    ``max_repeats`` (1 or more) gives the smallest exponent within the limit; else ``min_entropy`` gives the
    largest that reaches it, or 0 (equal weights) if none does.
    """
    total = table.agg(F.sum("total")).first()[0]
    if not total:
        return 1.0
    shares = table.filter("total > 0").select((F.col("total") / F.lit(float(total))).alias("share"))
    holds = (lambda x: x[1] > max_repeats) if max_repeats is not None else (lambda x: x[0] >= min_entropy)
    low, high = -1, GRID + 1  # holds at low, not at high
    while high - low > 1:
        step = max(1, (high - low) // 16)
        points = list(range(low + step, high, step))
        tested = [holds(x) for x in _measure(shares, [x / GRID for x in points])]
        low = max([low, *(x for x, ok in zip(points, tested, strict=True) if ok)])
        high = min([high, *(x for x, ok in zip(points, tested, strict=True) if not ok)])
    return (low + 1 if max_repeats is not None else max(low, 0)) / GRID


def plan(table: DataFrame, exponent: float, budget: int | None = None, block_tokens: int = 32_768) -> DataFrame:
    """``key, weight, parts, blocks``: normalised weight, passes in millionths, and blocks of each source.

    Without ``budget`` the least repeated source is read once. A source without tokens is read once. Sums are
    read by the driver; the table stays distributed.
    """
    total = float(table.agg(F.sum("total")).first()[0] or 1)
    p = F.when(F.col("total") > 0, F.col("total") / F.lit(total))
    raw = F.pow(p, F.lit(exponent))
    z, least = table.agg(F.sum(raw), F.min(raw / p)).first()
    scale = PARTS / (least or 1.0) if budget is None else budget * PARTS / ((z or 1.0) * total)
    return table.select(
        "key",
        F.coalesce(raw / F.lit(z or 1.0), F.lit(0.0)).alias("weight"),
        F.coalesce(F.round(raw / p * F.lit(scale)), F.lit(float(PARTS))).cast("bigint").alias("parts"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens), F.ceil(F.col("docs") / 4096)).cast("bigint").alias("blocks"),
    )


def draws(tokens: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of ``tokens`` (``id, row_key, key, n``) once per time they are read.

    Adds ``epoch``, ``block``, ``slot`` (place in the mix, 0 to 1) and ``weight``. Rows only meet others of
    their block.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("k"), F.col("row_key")))
    rows = tokens.join(planned, "key").withColumn("block", draw_hash(F.lit(seed), F.lit("b"), name) % F.col("blocks"))
    last, rest = F.expr(f"parts div {PARTS}"), F.col("parts") % PARTS
    epochs = F.expr(f"CASE WHEN parts > 0 THEN sequence(0L, (parts - 1) div {PARTS}) ELSE cast(array() AS array<bigint>) END")
    drawn = rows.withColumn("epoch", F.explode(epochs)).withColumn("h", draw_hash(F.lit(seed), F.col("epoch"), name))
    group = W.partitionBy("key", "block", "epoch")
    before = group.orderBy("h", "doc_id", "row_key").rowsBetween(W.unboundedPreceding, 0)
    drawn = drawn.withColumn("middle2", 2 * F.sum("n").over(before) - F.col("n")).withColumn("size", F.sum("n").over(group))
    drawn = drawn.filter((F.col("epoch") < last) | (F.col("middle2") * PARTS <= 2 * F.col("size") * rest))
    within = F.when(F.col("size") > 0, F.col("middle2") / (2.0 * F.greatest("size", F.lit(1)))).otherwise(0.5)
    slot = (F.col("epoch") + within) / (F.col("parts") / float(PARTS))
    return drawn.select("doc_id", "row_key", "key", "n", "weight", "epoch", "block", slot.alias("slot"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``doc_id`` and ``row_key``, which differs between rows that differ anywhere."""
    whole = F.xxhash64(*[F.col(f"row.`{c}`") for c in docs.columns], F.array(*[F.col(f"row.`{c}`").isNull() for c in docs.columns]))
    return docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), whole.alias("row_key"))


def tokens_of(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, key, n``; tokens are blank-separated words."""
    n = F.size(words(F.col("row.text"))).cast("bigint")
    return _keyed(docs).select("doc_id", "row_key", source_key(F.col("row.source")).alias("key"), n.alias("n"))


def mixture(
    docs: DataFrame,
    min_entropy: float | None = None,
    max_repeats: float | None = 2.0,
    budget: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """The mix as rows without texts, one per document and time read."""
    tokens = keep(tokens_of(docs), "tokens")
    table = sources(tokens)
    return draws(tokens, plan(table, bisect_exponent(table, min_entropy, max_repeats), budget), seed)


def mix(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs``, all columns, each as often as it is drawn."""
    id0 = F.coalesce("doc_id", F.lit(0)).alias("id0")
    times = mixture(docs, **how).groupBy(id0, "row_key").agg(F.count("*").cast("int").alias("times"))
    once = _keyed(docs).select("row", id0, "row_key").dropDuplicates(["id0", "row_key"])
    drawn = once.join(times, ["id0", "row_key"])
    return drawn.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
