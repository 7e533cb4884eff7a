"""WARC archives of pages with revisit records, and a globally ordered capture index.

``write_archives`` writes gzipped WARC/1.1 text files (records end with two line breaks, so Spark's text writer with that
separator writes valid files and commits them safely). A file is one gzip member. Files hold fewer records where payloads are
long, so that a file stays in the hundreds of MB or is one page. The capture time is made from ``page_id``, as pages have none. Of pages with the same payload of ``least`` bytes or
more, the one with the largest id is a response; others are revisit records that refer to it.
``read_archives`` parses the files back as streams, a record at a time: each file is one index run, sorted by URL key and time in its task.
``merge_index`` deals the runs out by key range; in each range the slices of the runs, already in order, go through a loser tree,
one comparison per level and entry. (range, place) order is the global order of captures, ``capture_rank`` the place in it from 0.

Defined cases: null html is an empty payload; null url is an empty one; a null id is archived under no id and can't be referred
to; rows that repeat an id and payload are archived each, the largest (id, then any one) being the response; an empty table
gives an empty archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dropscope.llm.common import keep, rows_of
from dropscope.sources.store import scratch_dir

END = "\r\n\r\n"
#: Payload bytes below which so many records go into a file; beyond the last bound each has a file of its own.
FILES = ((1 << 18, 1024), (1 << 23, 32), (1 << 31, 1))
INDEX = (
    "url_key STRING, at STRING, page_id BIGINT, record_type STRING, payload_bytes BIGINT, payload_digest STRING, "
    "refers_to BIGINT, run STRING, seq BIGINT, offset BIGINT"
)


def _pages(pages: DataFrame) -> DataFrame:
    page = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    return page.withColumn("size", F.octet_length("html").cast("bigint"))


def _digest() -> Column:
    return F.sha1(F.col("html").cast("binary")).alias("digest")


def repeated(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``digest, size, last``: payloads of ``least`` bytes or more that occur again, with the largest id.

    Payloads are grouped by SHA-1 and length through a map-side aggregation of ids alone.
    """
    page = _pages(pages).filter(F.col("size") >= least).select("page_id", "size", _digest())
    ids = page.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    return ids.filter("n > 1 and last is not null").select("digest", "size", "last")


def records(pages: DataFrame, ids: DataFrame, low: int = 0, high: int = 1 << 31) -> DataFrame:
    """``value``: the text of the record of each page of ``low`` to under ``high`` bytes, without its closing line breaks."""
    page = _pages(pages).filter((F.col("size") >= low) & (F.col("size") < high)).select("*", _digest())
    joined = page.join(ids, ["digest", "size"], "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    when = F.date_format(F.timestamp_seconds(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(4_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    return joined.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            head("WARC-Type", F.when(again, "revisit").otherwise("response")),
            head("WARC-Record-ID", uid(F.col("page_id"))),
            head("WARC-Target-URI", F.col("url")),
            head("WARC-Date", when),
            head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            head("X-Payload-Length", F.col("size").cast("string")),
            F.when(again, head("WARC-Refers-To", uid(F.col("last")))).otherwise(""),
            head("Content-Length", F.octet_length(body).cast("string")),
            F.lit("\r\n"),
            body,
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, least: int = 1000, files: tuple = FILES) -> None:
    ids = keep(repeated(pages, least), "repeated")
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    low = 0
    for high, per_file in files:
        if low <= longest:  # longer classes are empty
            rows = records(pages, ids, low, high)
            rows.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
        low = high


_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", re.I)


def url_key(url: str) -> str:
    """Sort key: host labels reversed, then path and query in lower case, without scheme, ``www``, port and fragment."""
    host, rest = _HOST.match(url).groups()
    labels = host.lower().removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (rest.lower() or "/")


def _parse(batches):
    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [{"STRING": pa.string(), "BIGINT": pa.int64()}[c.split()[1]] for c in INDEX.split(", ")]
    for path, content in rows_of(batches):
        rows, at, run = [], 0, path.rsplit("/", 1)[-1]
        with io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) as file:
            while line := file.readline():
                fields, head = {}, len(line)
                while line := file.readline().removesuffix(b"\r\n"):
                    name, _, value = line.decode().partition(":")
                    fields[name] = value.removeprefix(" ")
                    head += len(line) + 2
                size = int(fields["Content-Length"])
                body = file.read(size)
                file.read(len(END))
                own = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                other = fields.get("WARC-Refers-To", "<urn:page:>")[len("<urn:page:") : -1]
                again = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if again else hashlib.sha1(body).hexdigest()
                length = int(fields["X-Payload-Length"]) if again else size
                rows.append((url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], int(own) if own else None, fields["WARC-Type"],
                             length, digest, int(other) if other else None, run, 0, at))
                at += head + 2 + size + len(END)
        rows.sort(key=lambda r: (r[0], r[1], r[2] if r[2] is not None else -1))
        rows = [(*r[:8], i, r[9]) for i, r in enumerate(rows)]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index runs of the archives, in order within each file; payloads are read whole, lengths and digests taken from them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.filter("length > 0").mapInArrow(_parse, INDEX)


class LoserTree:
    """k-way merge of sorted lists of comparable keys; ``None`` stands after every key."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [r[0] if r else None for r in runs] or [None]
        self.at = [0] * self.k
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._climb(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is not None and y is None else (x is not None and (x, a) < (y, b))

    def _climb(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            rival = self.losers[node]
            if rival == -1:  # first visit: wait here for the other side
                self.losers[node] = winner
                return
            if self._before(rival, winner):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.heads[w := self.losers[0]] is not None:
            yield w, self.at[w]
            self.at[w] += 1
            self.heads[w] = self.runs[w][self.at[w]] if self.at[w] < len(self.runs[w]) else None
            self._climb(w)


def _merge(batches):
    if not (batches := [b for b in batches if b.num_rows]):
        return
    table = pa.Table.from_batches(batches)
    # Slices of one run stay in its order: a slice is put back by its sequence numbers.
    order = np.lexsort((table.column("seq").to_numpy(), np.unique(table.column("run").to_pylist(), return_inverse=True)[1]))
    table = table.take(pa.array(order)).combine_chunks()
    runs = table.column("run").to_pylist()
    keys = list(zip(table.column("url_key").to_pylist(), table.column("at").to_pylist(), [-1 if x is None else x for x in table.column("page_id").to_pylist()], strict=True))
    starts = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
    tree = LoserTree([keys[a:b] for a, b in zip(starts, starts[1:], strict=False)])
    taken = np.array([starts[r] + i for r, i in tree], np.int64)
    out = table.take(pa.array(taken)).append_column("place", pa.array(np.arange(len(taken))))
    yield from out.to_batches(max_chunksize=10_000)


def merge_index(runs: DataFrame, per_range: int = 100_000) -> DataFrame:
    """Runs merged in key ranges of about ``per_range`` entries: ``range, place`` and ``capture_rank`` give the global order.

    Ranges are cut by (URL key, time, id), so a URL with a third of all captures spans many ranges.
    """
    runs = keep(runs, "runs")
    count = runs.count()
    parts = max(1, -(-count // per_range), min(count, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = runs.repartitionByRange(parts, "url_key", "at", "page_id")
    merged = dealt.mapInArrow(_merge, INDEX + ", place BIGINT").withColumn("range", F.spark_partition_id())
    merged = keep(merged, "merged")
    # One row per range; a range starts where the ranges before it end.
    sizes = merged.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return merged.join(starts, "range").select(*merged.columns, (F.col("start") + F.col("place")).alias("capture_rank"))


def archive(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write, read back and index: one row per record, in the merged index's terms."""
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc"
    write_archives(pages, path, least)
    return merge_index(read_archives(spark, path))
