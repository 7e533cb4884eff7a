"""Which sources of a language use its terms most unlike each other or the language as a whole.

Counting by a token-start pointer sort. A shard is a slice of an Arrow text column of a few megabytes. Every start of a term in its
buffer is a pointer; pointers are sorted by the term they point to with a multikey quicksort: eight bytes at a time
form a key, large slices are split in three around a pivot key, small ones sorted by key, and pointers with
equal keys go on with the next eight bytes. A run of equal pointers is one term: its pointers by document
give document frequency and counts by source. What leaves the shard is one row per source and term in it.

Spark sums the rows of all shards, keeps terms found in at least ``least`` documents of their language, and compares:

- ``term``: kept terms of a group that are more frequent in it than in the language, the best ``top`` of each group;
- ``pair``: all other sources of the language by the sum over all kept terms, zeros included. Terms of a language
  are dealt into parts of bounded size; a part holds a table terms x sources and returns one sum per pair of sources.
  The number of sources of a language is taken to allow one row per pair, which the result has anyway.

Probabilities are whole billionths; all sums and divisions are exact integers.

Defined cases: null text, lang and source are the empty string; every row is a document of its own, rows repeated or
without an id as well; a group without terms still appears in ``pair``, with values of 0 where its language keeps
no term; a term of any length is one term; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dropscope.llm.common import keep

SHARD = 8 << 20  # bytes of text sorted at once
SMALL = 1 << 16  # pointers sorted by key without a further split
CELLS = 1 << 20  # cells of a table terms x sources held at once
ENTRIES = 1 << 20  # counts of one part of a language
SCALE = 1_000_000_000

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
# Masks that clear the bytes of a key that lie beyond the end of its term.
_MASK = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], np.uint64)


def term_pointers(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in ``data``; a term ends at the latest at one of ``edges``."""
    letter = _LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = edges[(edges > 0) & (edges < len(data))]
    first[inner] = letter[inner]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    last[inner - 1] = letter[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _keys(eights: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each term from ``depth`` on as a number in the order of the bytes, zeros after its end."""
    words = eights[starts + depth].view(">u8").ravel().astype(np.uint64)
    return words & _MASK[np.clip(ends - starts - depth, 0, 8)]


def multikey_sort(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their terms, and for each whether it begins a run of equal terms.

    No byte of a term is zero, so a key with a zero byte holds the end of its term.
    """
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(16, np.uint8)]), 8)
    order, head = np.arange(len(starts)), np.zeros(len(starts), bool)
    if not len(starts):
        return order, head
    stack = [(0, len(starts), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        part = order[lo:hi]
        key = _keys(eights, starts[part], ends[part], depth)
        if hi - lo > SMALL:
            pivot = np.sort(key[:: max(1, len(key) // 255)])[127 if len(key) >= 255 else len(key) // 2]
            less, same = key < pivot, key == pivot
            sides = [part[less], part[same], part[~(less | same)]]
            order[lo:hi] = np.concatenate(sides)
            a, b = lo + len(sides[0]), lo + len(sides[0]) + len(sides[1])
            if lo < a:
                stack.append((lo, a, depth))
            if b < hi:
                stack.append((b, hi, depth))
            if int(pivot) & 0xFF:
                stack.append((a, b, depth + 8))
            else:
                head[a] = True
            continue
        by = np.argsort(key, kind="stable")
        order[lo:hi], key = part[by], key[by]
        begin = np.ones(hi - lo, bool)
        begin[1:] = key[1:] != key[:-1]
        head[lo:hi] |= begin
        _deepen(eights, starts, ends, order, head, lo, key, begin, depth)
    return order, head


def _deepen(eights, starts, ends, order, head, lo, key, begin, depth) -> None:
    """Sorts on inside runs of equal keys of a small slice until every run is one term; all runs of a depth at once."""
    run = np.cumsum(begin)
    size = np.bincount(run)
    at = lo + np.flatnonzero(((key & np.uint64(0xFF)) != 0) & (size[run] > 1))
    run = run[at - lo]
    while len(at):
        depth += 8
        part = order[at]
        key = _keys(eights, starts[part], ends[part], depth)
        by = np.lexsort((key, run))
        order[at], key = part[by], key[by]
        begin = np.ones(len(at), bool)
        begin[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        head[at] |= begin
        inner = np.cumsum(begin)
        more = ((key & np.uint64(0xFF)) != 0) & (np.bincount(inner)[inner] > 1)
        at, run = at[more], inner[more]


def _runs(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``term, group, count, documents`` of a shard: text ``i`` spans ``offsets[i:i+2]`` and belongs to ``group[i]``."""
    data = _LOWER[data]
    starts, ends = term_pointers(data, offsets)
    order, head = multikey_sort(data, starts, ends)
    doc = np.searchsorted(offsets, starts[order], side="right") - 1
    run = np.cumsum(head) - 1
    texts, groups = len(offsets) - 1, int(group.max(initial=0)) + 1
    # One number per (run, document): equal ones are the occurrences of a term in a document.
    by_doc = np.sort(run * texts + doc)
    new = np.ones(len(by_doc), bool)
    new[1:] = by_doc[1:] != by_doc[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(by_doc)))
    run_, doc_ = np.divmod(by_doc[at], max(texts, 1))
    by_group = run_ * groups + group[doc_]
    put = np.argsort(by_group, kind="stable")
    by_group, times = by_group[put], times[put]
    at = np.flatnonzero(np.append(True, by_group[1:] != by_group[:-1])) if len(by_group) else np.empty(0, np.int64)
    run_, group_ = np.divmod(by_group[at], groups)
    counts = np.add.reduceat(times, at) if len(at) else times
    docs = np.diff(np.append(at, len(by_group)))
    pointer = order[np.flatnonzero(head)]
    raw, a, b = data.tobytes(), starts[pointer], ends[pointer]
    terms = pa.array([raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
    return terms.take(pa.array(run_)), group_, counts, docs


_COUNTED = "lang string, source string, term binary, n bigint, docs bigint"


def _text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of strings and where each begins; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, raw = texts.buffers()
    offsets = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data, offsets


def _shards(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SHARD`` bytes; a longer text is alone."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SHARD, side="right")) - 1)
        yield first, last
        first = last


def _long(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """A long text in pieces that end between terms."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SHARD)
        while end < len(data) and (gap := np.flatnonzero(~_LETTER[data[end : end + 4096]])).size == 0:
            end += 4096
        end = min(len(data), end + int(gap[0])) if end < len(data) else len(data)
        yield at, max(end, at + 1)
        at = max(end, at + 1)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        number = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
        names = list(number)
        group = np.array([number[p] for p in pairs], np.int64)
        data, offsets = _text_buffers(batch.column(2))

        def out(terms, groups, counts, docs, names=names):
            langs, sources = (pa.array([n[k] for n in names], pa.string()).take(pa.array(groups)) for k in (0, 1))
            return pa.record_batch([langs, sources, terms, pa.array(counts, pa.int64()), pa.array(docs, pa.int64())], schema=schema)

        for first, last in _shards(offsets):
            a, b = int(offsets[first]), int(offsets[last])
            if b - a <= 2 * SHARD:
                yield out(*_runs(data[a:b], offsets[first : last + 1] - a, group[first:last]))
                continue
            seen: set[bytes] = set()  # distinct terms of one long text
            for i, j in _long(data[a:b]):
                terms, _, counts, _ = _runs(data[a + i : a + j], np.array([0, j - i]), np.zeros(1, np.int64))
                new = np.array([t not in seen for t in terms.to_pylist()], np.int64)
                seen.update(terms.to_pylist())
                yield out(terms, np.full(len(terms), group[first]), counts, new)


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents by source."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    shards = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count, _COUNTED)
    sums = shards.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return sums.withColumn("term", F.col("term").cast("string"))


def kept_terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """``lang, term, counts`` (array of source and n) of terms in at least ``least`` documents of the language."""
    own = F.collect_list(F.struct("source", "n"))
    by_term = count_terms(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), own.alias("counts"))
    return by_term.filter(F.col("docs") >= least).select("lang", "term", "counts")


def _billionths(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), in decimals wide enough for any count."""
    wide = lambda c: c.cast("decimal(19,0)")
    scaled = (wide(n + 1) * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.call_function("div", scaled, (total + terms).cast("decimal(38,0)")) + 1


def _excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _pair_sums(key: tuple, terms: pa.Table, heads: pa.Table) -> pa.Table:
    """Sums over the terms of one part for every ordered pair of sources of its language."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    sources = heads.column("sources").combine_chunks().flatten()
    totals, v = heads.column("totals").combine_chunks().flatten().to_numpy(), heads.column("terms")[0].as_py()
    s = len(sources)
    place = {name: i for i, name in enumerate(sources.to_pylist())}
    sums = np.zeros((s, s), np.int64)
    lists = terms.column("counts").combine_chunks()
    items = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    column = np.fromiter((place[x] for x in items.field("source").to_pylist()), np.int64, len(items))
    n = items.field("n").to_numpy()
    step = max(1, CELLS // s)
    for at in range(0, len(lists), step):
        rows = min(step, len(lists) - at)
        mine = slice(*np.searchsorted(owner, [at, at + rows]))
        counts = np.zeros((rows, s), np.int64)
        counts[owner[mine] - at, column[mine]] = n[mine]
        p = billionths(counts, totals + v)
        for j in range(s):
            q = p[:, j : j + 1]
            sums[:, j] += ((p - q) ** 2 // q).sum(axis=0)
    a, b = np.nonzero(~np.eye(s, dtype=bool))
    lang = pa.array([key[0].as_py()] * len(a), pa.string())
    return pa.Table.from_arrays([lang, sources.take(pa.array(a)), sources.take(pa.array(b)), pa.array(sums[a, b])], schema=schema)


def billionths(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """As ``_billionths``, by long division in three steps of a thousand: exact while totals stay below 9e15."""
    digits, rest = np.divmod(counts + 1, totals)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, totals)
        digits = digits * 1000 + more
    return digits + 1


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: see the module's text."""
    kept = keep(kept_terms(docs, least), "terms")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    cells = kept.select("lang", "term", F.explode("counts").alias("c")).select("lang", "term", "c.source", "c.n")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.size("counts")).alias("entries"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(text("lang"), text("source")).distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    zero = F.lit(0).cast("bigint")
    groups = keep(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "entries")]), "groups")

    # Sources that share a term: own count and the language's, side by side.
    whole = F.aggregate("counts", zero, lambda s, c: s + c["n"])
    own = kept.select("lang", "term", whole.alias("all"), F.explode("counts").alias("c")).select("lang", "term", "all", "c.source", "c.n")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    facts = own.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).join(langs, "lang")
    p = _billionths(F.col("n"), F.col("total"), F.col("terms"))
    q = _billionths(F.col("all"), F.col("lang_total"), F.col("terms"))
    better = facts.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    term = _ranked(better.select("lang", "source", "item", _excess(F.col("p"), F.col("q")).alias("value")), "term", top)

    parts = F.greatest(F.lit(1), F.ceil(F.col("entries") / ENTRIES)).cast("bigint")
    sorted_sources = F.sort_array(F.collect_list(F.struct("source", "total")))
    heads = groups.groupBy("lang").agg(sorted_sources.alias("s"), F.first("terms").alias("terms"), F.first("entries").alias("entries"))
    heads = heads.select("lang", "terms", parts.alias("parts"), F.col("s.source").alias("sources"), F.col("s.total").alias("totals"))
    dealt = kept.join(heads.select("lang", "parts"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("parts")).alias("part"), "counts")
    spread = heads.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "terms", "sources", "totals")
    sums = dealt.groupBy("lang", "part").cogroup(spread.groupBy("lang", "part")).applyInArrow(_pair_sums, "lang string, source string, item string, value bigint")
    pair = _ranked(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")
    return pair.unionByName(term)
