"""Quality rules judged by host.

Each document gets a few counts and a list of failed rules. Failures are summed by host, the host's failure
rate is shrunk by a beta prior fitted to all hosts by moments, and the verdict is joined back: on a rejected
host, documents that fail any rule go; documents that fail none stay wherever they come from.

Counts need one pass over a text and no shuffle. Sums by host combine on the map side, so a host with a third of
all rows costs one row per task; the join back has one row per host, and skewed partitions are split by
adaptive execution when the host table is too large to broadcast by measured size.

Defined cases: null text has no words and fails the base rule; a null host is a host of its own; repeated
rows are judged each; an empty table gives no rows; extra columns are kept by ``filter_documents`` and
ignored by ``verdicts``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropscope.llm.common import GAPS, keep, words

SYMBOLS = "#*$%&|<>"  # fixed value
WINDOW = 8  # words; runs of this length are built by doubling


def _ahead(array: str, k: int) -> Column:
    return F.slice(array, k + 1, F.greatest(F.size(array) - k, F.lit(0)))


def _runs(rows: DataFrame, array: str, combine) -> DataFrame:
    """``array`` of words (or their hashes) turned into runs of 2, 4, 8 of them, each step in a projection of its own."""
    for k in (1, 2, 4):
        first = F.slice(array, 1, F.greatest(F.size(array) - k, F.lit(0)))
        rows = rows.withColumn(array, F.zip_with(first, _ahead(array, k), combine))
    return rows


def _with_repeats(rows: DataFrame) -> DataFrame:
    """``n_repeat_words`` of the word array ``w``: words in eight-word windows found twice or more.

    Windows are first compared by hashes. Only a text with equal hashes has its windows written out, sorted and
    compared as text, so the count is exact. Every step is linear in the text but for that sort.
    """
    rows = _runs(rows.withColumn("runs", F.transform("w", lambda x: F.xxhash64(x))), "runs", lambda a, b: F.xxhash64(a, b))
    again = F.size(F.array_distinct("runs")) < F.size("runs")
    rows = rows.withColumn("runs", F.when(again, F.col("w"))).drop("w")
    rows = _runs(rows, "runs", lambda a, b: F.concat_ws(" ", a, b))
    rows = rows.withColumn("runs", F.sort_array(F.transform("runs", lambda t, i: F.struct(t.alias("t"), i.alias("i")))))
    same = F.zip_with("runs", _ahead("runs", 1), lambda a, b: F.coalesce(a["t"] == b["t"], F.lit(False)))
    rows = rows.withColumn("same", same)
    either = F.zip_with("same", F.concat(F.array(F.lit(False)), "same"), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    rows = rows.withColumn("same", either)
    hit = F.zip_with("runs", "same", lambda x, met: F.when(met, x["i"]))
    rows = rows.withColumn("runs", F.sort_array(F.array_compact(hit))).drop("same")
    steps = F.zip_with("runs", _ahead("runs", 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("runs")


def counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` as one struct column ``row``, with ``host`` and the counts beside it."""
    text = F.coalesce("row.text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).select("row", words(F.col("row.text")).alias("w"))
    rows = _with_repeats(rows.withColumn("n_words", F.size("w").cast("bigint")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, GAPS, "") != "")
    return rows.withColumn("lines", lines).select(
        "row",
        F.col(f"row.{host}").alias("host"),
        "n_words",
        F.char_length(F.translate(text, GAPS, "")).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        "n_repeat_words",
    )


def failures() -> dict[str, Column]:
    """Rules by name; true: the document fails. The first two are the base."""
    n = F.col("n_words")
    return {
        "few_words": n < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n),
    }


def hosts(judged: DataFrame) -> DataFrame:
    """``host, n, failed, rate``: observed and shrunk failure rates.

    Beta prior by moments over all hosts, weighted by documents: mean m and precision k; a spread no larger
    than chance gives the largest precision allowed, 1e6. The prior is two numbers, read by the driver.
    """
    by_host = keep(judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("bigint")).alias("f")), "hosts")
    m, total, hosts_, squares = by_host.agg(
        F.sum("f") / F.sum("n"), F.sum("n"), F.count("*"), F.sum(F.col("f") * F.col("f") / F.col("n"))
    ).first()
    a = b = 0.5
    if total:
        chance = m * (1 - m)
        between = (squares - total * m * m - (hosts_ - 1) * chance) / total  # variance of true rates
        k = min(1e6, max(1.0, chance / between - 1)) if between > 0 else 1e6
        a, b = m * k, (1 - m) * k
    return by_host.withColumn("rate", (F.col("f") + F.lit(a)) / (F.col("n") + F.lit(a + b)))


def verdicts(judged: DataFrame, limit: float = 0.5) -> DataFrame:
    """``judged`` (with ``host``, ``base_failed``, ``failed``) plus ``host_rate`` and ``kept``."""
    rates = hosts(judged).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"))
    joined = judged.join(rates, judged["host"].eqNullSafe(rates["h"]), "left").drop("h")
    bad = F.col("failed") & (F.col("host_rate") > limit)
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad)


def _judged(counted: DataFrame, *more: str) -> DataFrame:
    rules = failures()
    return counted.select(
        *more,
        "host",
        (rules["few_words"] | rules["repeats"]).alias("base_failed"),
        reduce(Column.__or__, rules.values()).alias("failed"),
    )


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """Counts and verdict per document. The counts, a few numbers a row, are written once and used twice."""
    counted = counts(docs, host).select(F.col("row.doc_id").alias("doc_id"), "host", *NUMBERS, "n_lines")
    judged = keep(_judged(counted, "doc_id", *NUMBERS), "judged")
    return verdicts(judged, limit).select("doc_id", *NUMBERS, "base_failed", "kept", "host_rate")


def filter_documents(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """``docs`` without rejected ones, all columns kept. Texts are counted once; only keys of rejected rows are joined back."""

    def key(prefix: str) -> list[Column]:
        text, at = F.col(f"{prefix}text"), F.col(f"{prefix}{host}")
        id0 = F.coalesce(F.col(f"{prefix}doc_id").cast("bigint"), F.lit(2**63 - 1))
        return [id0.alias("id0"), F.xxhash64(F.coalesce(text, F.lit("")), text.isNull(), at, at.isNull()).alias("row_key")]

    counted = counts(docs, host).select(*key("row."), "host", *NUMBERS, "n_lines")
    judged = keep(_judged(counted, "id0", "row_key"), "judged")
    gone = keep(verdicts(judged, limit).filter(~F.col("kept")).select("id0", "row_key").distinct(), "rejected")
    rows = docs.select(F.struct("*").alias("row")).select("row", *key("row."))
    return rows.join(gone, ["id0", "row_key"], "left_anti").select("row.*")
