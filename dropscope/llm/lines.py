"""Removal of lines that equal, or nearly equal, an earlier line anywhere in the corpus.

Lines are compared after lower-casing and joining their words by single spaces; lines without a word stay. Two
lines are near when one edit (a code point put in, taken out or replaced) makes them equal and both have at least ``near_from`` code
points (0: lines of any length; in short ones, such as ``12`` and ``13``, one edit is another line). A line goes if an
earlier line is equal or near; earlier means smaller document id, then row key, then line number. Every comparison is
made on the input, not on what is left.

1. Distinct lines with their first place: a map-side aggregation, so a line shared by a third of all
   documents is one row per task.
2. A pair within one edit agrees on its first or its last half. Lines that share a half (of the same
   length class) with another line go on; for random text that is a few per cent. For their texts the documents are split
   again where they lie; only lines whose place is set in a bitmap of fixed size (``PLACE_WORDS``) are shuffled. The bitmap
   only spares shuffling: it lets other lines pass too, the more the larger the corpus, and the join by place drops them.
3. Of these, lines that agree with another on all but one of ``PIECES`` pieces go on: wherever the edit is, the pieces
   before it and those behind it are equal.
4. These emit their deletion neighbourhood as hashed keys: every variant with one code point left out, and
   the line itself. Equal keys for the same place left out are replacements; a variant equal to a whole line is an insertion.
   Each key keeps its earliest line, so no pairs are listed.
5. The edit distance of a line and the earlier line found is verified on the texts.

Defined cases: null text stays null; an empty text has one line without words; a null id comes after all others; rows equal in id and
text are treated alike; an empty table gives no rows; extra columns are kept by ``filter_lines``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropscope.llm.common import GAP_CLASS, keep, mixed, row_key, rows_of

NEAR_FROM = 10  # code points
PIECES = 8
PLACE_WORDS = 1 << 19  # of 64 bits: 4 MB, measured as 8 MB when broadcast, whatever the corpus
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _normal(text: Column) -> Column:
    """A text or line in normal form, but for blanks at line ends. Single spaces, by far the most blanks, are not matched."""
    return F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")


def normal_lines(text: Column) -> Column:
    """Lines of a text in normal form, but for blanks at their ends: the whole text is lower-cased and its blanks joined
    before it is split, one call a document."""
    return F.split(_normal(text), "\n")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row")).select(
        "row", F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("id0"), row_key(F.col("row.text")).alias("row_key")
    )


def occurrences(docs: DataFrame) -> DataFrame:
    """Lines with a word: ``id0, row_key, pos, line`` (normal form)."""
    rows = _keyed(docs).select("id0", "row_key", F.posexplode(normal_lines(F.col("row.text"))).alias("pos", "line"))
    return rows.withColumn("line", F.trim("line")).filter("line <> ''")


def _place_bit() -> tuple[Column, Column]:
    """Word and bit of a place in the bitmap."""
    h = F.xxhash64("id0", "row_key", "pos")
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(PLACE_WORDS - 1)), h.bitwiseAND(F.lit(63)).cast("int")


def _place_bitmap(places: DataFrame) -> DataFrame:
    """``part, words``: a bitmap of ``PLACE_WORDS`` words in rows of 1,024, with the bits of ``places`` set."""
    word, bit = _place_bit()
    bits = places.select(word.alias("word"), bit.alias("bit")).selectExpr("word", "shiftleft(1L, bit) AS bits")
    zeros = places.sparkSession.range(PLACE_WORDS).selectExpr("id AS word", "0L AS bits")
    words = bits.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = words.groupBy(F.shiftright("word", 10).alias("part")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return rows.select("part", F.col("words.bits").alias("words"))


def _lines_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (``id0, row_key, pos`` and more) with their ``line`` in normal form. Documents are split where they lie, and only
    lines that the bitmap of the places lets pass are normalised and shuffled."""
    raw = _keyed(docs).select("id0", "row_key", F.posexplode(F.split("row.text", "\n")).alias("pos", "line"))
    word, bit = _place_bit()
    raw = raw.withColumns({"word": word, "bit": bit})
    raw = raw.join(F.broadcast(_place_bitmap(places)), F.shiftright("word", 10) == F.col("part"))
    raw = raw.filter("getbit(get(words, cast(word & 1023 AS int)), bit) = 1")
    return raw.select("id0", "row_key", "pos", F.trim(_normal(F.col("line"))).alias("line")).join(places, ["id0", "row_key", "pos"])


def _identity() -> list[Column]:
    """96 bits that stand for a line."""
    return [F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")]


def _halves() -> list[Column]:
    """Keys of the halves: two lines within one edit have one in common, made for the shorter one's length."""
    n = F.char_length("line")
    keys = []
    for less in (0, 1):
        m = n - less
        half = F.expr(f"(char_length(line) - {less}) div 2").cast("int")
        keys.append(F.xxhash64(F.lit(0), m, F.substring(F.col("line"), F.lit(1), half)))
        keys.append(F.xxhash64(F.lit(1), m, F.expr(f"right(line, char_length(line) - {less} - cast((char_length(line) - {less}) div 2 as int))")))
    return [k.alias(f"k{i}") for i, k in enumerate(keys)]


def _pieces(lines: DataFrame) -> DataFrame:
    """``h1, piece``: one key per place of an edit, made from all before and all behind that piece of the shorter line."""
    keyed = lines.select("h1", "line", F.explode(F.sequence(F.lit(0), F.lit(2 * PIECES - 1))).alias("i"))
    keyed = keyed.selectExpr("h1", "line", "i div 2 AS j", "char_length(line) - i % 2 AS m")
    cut = keyed.selectExpr("*", f"cast(m * j div {PIECES} AS int) AS a", f"cast(m - m * (j + 1) div {PIECES} AS int) AS b")
    return cut.selectExpr("h1", "xxhash64(j, m, substring(line, 1, a), right(line, b)) AS piece")


def _sharing(keys: DataFrame, key: str) -> DataFrame:
    """``h1`` of the lines that have a ``key`` in common with another line."""
    shared = keys.groupBy(key).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi").select(key)
    return keys.join(shared, key).select("h1").distinct()


def _neighbourhood(batches):
    """Keys of all variants of each line: kind 0 the line itself, 1 a shortened one, 2 a place left out."""
    for batch in batches:
        rows = list(rows_of([batch]))
        at = 0
        while at < len(rows):
            cols, size = [[], [], [], []], 0
            while at < len(rows) and size < 200_000:
                h1, h2, line = rows[at]
                at += 1
                points = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
                n = len(points)
                powers = np.cumprod(np.full(n, _BASE, np.uint64))
                terms = mixed(points + np.uint64(1)) * powers
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
                short = sums[:-1] + (sums[-1] - sums[1:]) * _BACK
                place = np.arange(n, dtype=np.uint64)
                whole = mixed(mixed(sums[-1:]) + np.uint64(n))
                shorter = np.unique(mixed(mixed(short) + np.uint64(n - 1)))
                left = mixed(mixed(short) + (np.uint64(n) << np.uint64(32)) + place + _BASE)
                keys = np.concatenate([whole, shorter, left])
                kind = np.repeat(np.array([0, 1, 2], np.int8), [1, len(shorter), n])
                size += len(keys)
                for c, x in zip(cols, (keys.view(np.int64), kind, np.full(len(keys), h1), np.full(len(keys), h2, np.int32)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["key", "kind", "h1", "h2"])


def near_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """``h1, h2`` of the distinct lines that have an earlier line within one edit.

    ``lines`` has ``h1, h2, first`` and the half keys, null in lines too short to be near any; ``docs`` are the documents
    that ``first`` names.
    """
    halves = lines.filter("k0 is not null").select("h1", F.explode(F.array("k0", "k1", "k2", "k3")).alias("half"))
    some = lines.select("h1", "h2", "first").join(_sharing(halves, "half"), "h1", "left_semi")
    some = keep(some.select("h1", "h2", "first", "first.*"), "halves")
    told = _lines_at(docs, some).select("h1", "h2", "first", "line")
    told = keep(told.dropDuplicates(["h1", "h2"]), "told")
    told = keep(told.join(_sharing(_pieces(told), "piece"), "h1", "left_semi"), "survivors")
    keys = told.select("h1", "h2", "line").mapInArrow(_neighbourhood, "key BIGINT, kind TINYINT, h1 BIGINT, h2 INT")
    firsts = told.select("h1", "h2", "first")
    keys = keep(keys, "variants")
    # A key met once links nothing; only the others get places.
    met = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    keys = keys.join(met, "key").join(firsts, ["h1", "h2"])
    me = F.struct("first", "h1", "h2")
    least = keys.groupBy("key").agg(
        F.min(F.when(F.col("kind") == 0, me)).alias("whole"),
        F.min(F.when(F.col("kind") == 1, me)).alias("longer"),
        F.min(F.when(F.col("kind") == 2, me)).alias("other"),
    )
    other = F.when(F.col("kind") == 0, F.col("longer")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("other"))
    found = keys.join(least, "key").select("h1", "h2", "first", other.alias("o")).filter("o.first < first")
    found = found.groupBy("h1", "h2").agg(F.min("o").alias("o")).select("h1", "h2", F.col("o.h1").alias("g1"), F.col("o.h2").alias("g2"))
    told = told.select("h1", "h2", "line")
    both = found.join(told, ["h1", "h2"]).join(told.toDF("g1", "g2", "earlier"), ["g1", "g2"])
    return both.filter(F.levenshtein("line", "earlier", 1) == 1).select("h1", "h2")


def removals(docs: DataFrame, near_from: int = NEAR_FROM) -> DataFrame:
    """``id0, row_key, gone``: line numbers to remove, for documents with any."""
    found = occurrences(docs)
    long = F.char_length("line") >= near_from
    keys = [F.when(long, k).alias(f"k{i}") for i, k in enumerate(_halves())]
    # Rows equal in id and text give equal places: least and greatest place tell whether a line comes again.
    at = keep(found.select("id0", "row_key", "pos", *_identity(), *keys), "occurrences")
    first = F.struct("id0", "row_key", "pos")
    halves = [F.min(f"k{i}").alias(f"k{i}") for i in range(4)]
    again = (F.max(first) > F.min(first)).alias("again")
    lines = keep(at.groupBy("h1", "h2").agg(F.min(first).alias("first"), again, *halves), "lines")
    near = keep(near_lines(lines, docs.select("doc_id", "text")), "near").withColumn("near", F.lit(True))
    marked = lines.select("h1", "h2", "first", "again").join(near, ["h1", "h2"], "left").filter("again or near")
    hit = at.select("h1", "h2", "id0", "row_key", "pos").join(marked, ["h1", "h2"])
    hit = hit.filter(F.col("near") | (first > F.col("first")))
    return hit.groupBy("id0", "row_key").agg(F.collect_set("pos").alias("gone"))


def dedup(docs: DataFrame, near_from: int = NEAR_FROM) -> DataFrame:
    """``row`` (all columns), ``n_lines``, ``n_removed`` and ``kept_text`` (remaining lines joined by newlines)."""
    # One plan at every size: line numbers of a large corpus fit no broadcast.
    joined = _keyed(docs).join(removals(docs, near_from).hint("merge"), ["id0", "row_key"], "left")
    joined = joined.select("row", "gone", F.split("row.text", "\n").alias("parts"))
    places = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")
    left = F.array_join(F.transform(places, lambda p: F.get(F.col("parts"), p)), "\n")
    return joined.select(
        "row",
        F.coalesce(F.size("parts"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left).alias("kept_text"),
    )


def filter_lines(docs: DataFrame, near_from: int = NEAR_FROM) -> DataFrame:
    """``docs`` with the kept text, ``n_chars`` set anew where there is such a column; documents that lose their last line with a word go."""
    cut = dedup(docs, near_from)
    left = (F.col("n_removed") == 0) | (F.trim(F.regexp_replace("kept_text", GAP_CLASS, " ")) != "")
    changed = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    return cut.filter(left).select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
