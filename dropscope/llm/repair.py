"""Conversation structure: damage for tests, faults, and the cheapest edits by a square-root checkpointed DP.

A conversation should read ``s?(ua)+`` in role initials, or be empty. Row by row an edit keeps (K, cost 0), gives the role
user or assistant (R, 1) or deletes (D, 2, forced for blank and repeated rows); an empty turn may be inserted
anywhere (I, 5); an undeleted truncated row adds 5. Four states (nothing yet, after s, after u, after a) fix which
role an R or I must give, so the letters alone fix the result.

1. Faults come from thin rows (keys, one mark for the end of the text, 128-bit prints); texts stay behind.
2. Thin rows are range-partitioned in order, so a long conversation lies in many tasks, and are cut into
   blocks of at most the square root of its rows. A block becomes a 4 x 4 matrix of least costs between its ends.
3. Backward over the matrices of a conversation: cost vectors are stored at the ends of blocks only (checkpoints).
4. Every block recomputes its inner vectors from its checkpoint and walks forward once from each entry state, taking the
   ASCII-least letter that is still cheapest; blocks do this side by side.
5. Forward over the exit states of a conversation picks the walk each block takes.
6. Kept lines fetch their texts by row print; a running SHA-256 per conversation reads them in order.

A task holds one block, about the square root of a conversation; only the hash and the audit text, one value each by
contract, pass a conversation through one task, as a stream.

Defined cases: nulls in role and text count as one space, null turns come first, a null conv_id is one
conversation; rows of equal turn are ordered by role, then by the MD5 of role and text; rows repeated in all columns are separate rows,
the later ones duplicates; a role whose first character is none of s, u, a (the empty role included) can't be kept; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropscope.llm.common import GAPS, keep, rows_of

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FAR = 1 << 50  # no way

START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # after an inserted or re-roled turn
ROLE = ("user", "user", "assistant", "user")
# State after a kept row by state and class of its role (s, u, a, other); None: it can't stay.
KEPT = (
    (AFTER_S, AFTER_U, None, None),
    (None, AFTER_U, None, None),
    (None, None, AFTER_A, None),
    (None, AFTER_U, None, None),
)
FINE, OPEN, GONE = range(3)  # what is left of a row's faults: none, truncated, must go
END = (0, 2 * INSERT, INSERT, 0)  # cheapest way to a valid end from each state
TAIL = ("", "II", "I", "")
LEGAL = {(0, 1), (1, 2), (2, 1)}

Vector = tuple[int, int, int, int]


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the damage that CRC-32 of ``conv_id:turn`` deals out."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), h.alias("h")).filter("h <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("h") == 3, 2).otherwise(1).alias("copies"),
    )


def intact(turns: DataFrame) -> DataFrame:
    """``turns`` in the form of ``damage``, undamaged."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), F.lit(1).alias("copies"))


def _print() -> Column:
    return F.md5(F.concat(F.char_length("role"), F.lit(":"), "role", "text"))


def _row_id(print_: Column) -> Column:
    """Identity of a row with its conversation and turn; nulls differ from every value."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("|", part("conv_id"), part("turn"), print_))


def thin_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows without their text: ``ends`` is blank, open or closed, ``copies`` counts repeats."""
    rest = F.rtrim("text", F.lit(GAPS))
    ends = F.when(rest == "", "blank").when(F.right(rest, F.lit(1)).isin(".", "!", "?"), "closed").otherwise("open")
    thin = rows.select("conv_id", "turn", "role", _print().alias("print"), ends.alias("ends"), "copies")
    return thin.groupBy("conv_id", "turn", "role", "print", "ends").agg(F.sum("copies").alias("copies"))


def _on_conv(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    b = b.withColumnRenamed("conv_id", "c_id")
    return a.join(b, a["conv_id"].eqNullSafe(b["c_id"]), how).drop("c_id")


def _marked(thin: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Thin rows with ``fresh`` (its role and text are not seen in an earlier turn) and ``n`` rows of the
    conversation; and per conversation ``n, gaps``."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = thin.groupBy("conv_id", "print").agg(F.min(place).alias("first"), F.sum("copies").alias("seen")).filter("seen > 1")
    again = again.select(F.col("conv_id").alias("a_id"), F.col("print").alias("a_print"), "first")
    by_turn = thin.groupBy("conv_id", "turn").agg(F.sum("copies").alias("c")).groupBy("conv_id")
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    sizes = by_turn.agg(F.sum("c").alias("n"), span.alias("gaps"))
    on = thin["conv_id"].eqNullSafe(again["a_id"]) & (thin["print"] == again["a_print"])
    fresh = F.col("first").isNull() | (F.col("first") == place)
    marked = thin.join(again, on, "left").select(*thin.columns, fresh.alias("fresh"))
    return _on_conv(marked, sizes.select("conv_id", "n"), "inner"), sizes


@lru_cache(maxsize=1 << 16)
def _back(code: int, after: Vector) -> Vector:
    """Least costs before a row from those after it; inserts in front of the row included."""
    kind, left = divmod(code, 3)
    out = []
    for state in range(4):
        best = DELETE + after[state]
        if left != GONE:
            extra = TRUNCATED if left == OPEN else 0
            best = min(best, REROLE + extra + after[NEXT[state]])
            stays = KEPT[state][kind]
            if stays is not None:
                best = min(best, extra + after[stays])
        out.append(best)
    u, a = min(out[AFTER_U], INSERT + out[AFTER_A]), min(out[AFTER_A], INSERT + out[AFTER_U])
    return min(out[START], INSERT + u), min(out[AFTER_S], INSERT + u), u, a


def vectors(codes: bytes, after: Vector) -> list[Vector]:
    """Cost vectors before every row of a block, and ``after`` itself; kept small by a shared offset for the memo."""
    low = min(after)
    out = [after]
    v = tuple(min(x - low, FAR) for x in after)
    for code in reversed(codes):
        v = _back(code, v)
        out.append(tuple(x + low for x in v))
        least = min(v)
        if least > 64:
            low, v = low + least, tuple(x - least for x in v)
    return out[::-1]


@lru_cache(maxsize=1 << 14)
def matrix(codes: bytes) -> tuple[Vector, ...]:
    """Least cost through a block from each state (row) to each state (column)."""
    columns = []
    for q in range(4):
        first = vectors(codes, tuple(0 if p == q else FAR for p in range(4)))[0]
        columns.append(tuple(min(x, FAR) for x in first))
    return tuple(zip(*columns, strict=True))


def through(step: Iterable[Iterable[int]], after: Vector) -> Vector:
    return tuple(min(FAR, min(c + x for c, x in zip(row, after, strict=True))) for row in step)


@lru_cache(maxsize=1 << 14)
def walks(codes: bytes, after: Vector) -> tuple[Vector, tuple[int, ...], tuple[str, ...]]:
    """Costs at the start of a block, and from each entry state the exit state and ASCII-least cheapest letters."""
    v = vectors(codes, after)
    exits, letters = [], []
    for state in range(4):
        out, i = [], 0
        while i < len(codes):
            kind, left = divmod(codes[i], 3)
            extra = TRUNCATED if left == OPEN else 0
            cost = v[i][state]
            stays = KEPT[state][kind] if left != GONE else None
            if cost == DELETE + v[i + 1][state]:
                out.append("D")
                i += 1
            elif cost == INSERT + v[i][NEXT[state]]:
                out.append("I")
                state = NEXT[state]
            elif stays is not None and cost == extra + v[i + 1][stays]:
                out.append("K")
                state, i = stays, i + 1
            else:
                out.append("R")
                state, i = NEXT[state], i + 1
        exits.append(state)
        letters.append("".join(out))
    return v[0], tuple(exits), tuple(letters)


def _out(rows: Iterable[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_PLACE = "part int, seq bigint"
_BLOCK = (
    f"conv_id bigint, {_PLACE}, codes binary, step array<bigint>, head int, tail int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "turns array<bigint>, roles array<string>, ids array<string>, copies array<bigint>"
)


def _arrow(ddl: str) -> pa.Schema:
    """Arrow form of the few plain types used here."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = []
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1)
        fields.append((name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return pa.schema(fields)


class _Block:
    """Rows of one block while it is read."""

    def __init__(self):
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.rows: list[list] = []

    def add(self, kind: int, ends: str, fresh: bool, row: tuple) -> None:
        if ends == "blank":
            self.blank += 1
            left = GONE
        elif not fresh:
            self.duplicate += 1
            left = GONE
        else:
            left = OPEN if ends == "open" else FINE
            self.truncated += left == OPEN
        if self.codes and (self.codes[-1] // 3, kind) not in LEGAL:
            self.illegal += 1
        self.codes.append(3 * kind + left)
        if self.rows and self.rows[-1][0] == row:
            self.rows[-1][1] += 1
        else:
            self.rows.append([row, 1])

    def out(self, conv, part: int, seq: int) -> tuple:
        codes = bytes(self.codes)
        step = [x for line in matrix(codes) for x in line]
        turns, roles, ids = (list(c) for c in zip(*(r for r, _ in self.rows), strict=True))
        counts = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (conv, part, seq, codes, step, codes[0] // 3, codes[-1] // 3, *counts, turns, roles, ids, [c for _, c in self.rows])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted rows of one partition."""
    part = TaskContext.get().partitionId()

    def blocks() -> Iterator[tuple]:
        conv, seq, block = None, 0, _Block()
        for c, n, turn, role, row_id, ends, copies, fresh in rows_of(batches):
            longest = isqrt(n - 1) + 1
            kind = "sua".find(role[:1]) if role else -1
            for k in range(copies):
                if block.codes and (c != conv or len(block.codes) >= longest):
                    yield block.out(conv, part, seq)
                    seq, block = seq + 1, _Block()
                conv = c
                block.add(3 if kind < 0 else kind, ends, fresh and k == 0, (turn, role, row_id))
        if block.codes:
            yield block.out(conv, part, seq)

    return _out(blocks(), _arrow(_BLOCK), 256)


_AFTER = f"{_PLACE}, after array<bigint>"


def _backward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checkpoints: the cost vector at the end of every block, from the last block of a conversation to its first."""

    def checkpoints() -> Iterator[tuple]:
        conv, after = object(), END
        for c, part, seq, step in rows_of(batches):
            if c != conv:
                conv, after = c, END
            yield part, seq, list(after)
            after = through([step[4 * p : 4 * p + 4] for p in range(4)], after)

    return _out(checkpoints(), _arrow(_AFTER))


_WALK = f"{_PLACE}, costs array<bigint>, exits array<int>, letters array<string>"


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def walked() -> Iterator[tuple]:
        for part, seq, codes, after in rows_of(batches):
            costs, exits, letters = walks(codes, tuple(after))
            yield part, seq, list(costs), list(exits), list(letters)

    return _out(walked(), _arrow(_WALK), 256)


_PIECE = f"conv_id bigint, {_PLACE}, entry int, piece string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def _forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The walk each block takes, from the first block of a conversation to its last."""

    def pieces() -> Iterator[tuple]:
        held, conv, state, tail = None, object(), START, None
        for c, part, seq, costs, exits, letters, head, last, *counts in rows_of(batches):
            first = c != conv
            if held and first:
                yield (*held[:4], held[4] + TAIL[state], *held[5:])
            elif held:
                yield held
            if first:
                conv, state = c, START
            elif (tail, head) not in LEGAL:
                counts[3] += 1
            held = (c, part, seq, state, letters[state], costs[START] if first else 0, *counts)
            state, tail = exits[state], last
        if held:
            yield (*held[:4], held[4] + TAIL[state], *held[5:])

    return _out(pieces(), _arrow(_PIECE))


_LINE = f"conv_id bigint, {_PLACE}, i int, edit string, turn bigint, role string, row_id string"


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays of each block: kept, re-roled and inserted lines."""

    def lines() -> Iterator[tuple]:
        for conv, part, seq, state, piece, codes, turns, roles, ids, copies in rows_of(batches):
            at = (k for k, c in enumerate(copies) for _ in range(c))
            row, i = 0, 0
            for letter in piece:
                if letter == "I":
                    yield conv, part, seq, i, letter, None, ROLE[state], None
                else:
                    k = next(at)
                    kind = codes[row] // 3
                    row += 1
                    if letter == "D":
                        continue
                    yield conv, part, seq, i, letter, turns[k], roles[k] if letter == "K" else ROLE[state], ids[k]
                i += 1
                state = KEPT[state][kind] if letter == "K" else NEXT[state]

    return _out(lines(), _arrow(_LINE))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests() -> Iterator[tuple]:
        conv, digest = None, None
        for c, role, text in rows_of(batches):
            if digest is not None and c == conv:
                digest.update(b"\n")
            else:
                if digest is not None:
                    yield conv, digest.hexdigest()
                conv, digest = c, hashlib.sha256()
            digest.update(role.encode() + b":")
            digest.update(text.encode())
        if digest is not None:
            yield conv, digest.hexdigest()

    return _out(digests(), _arrow("conv_id bigint, repaired_sha256 string"))


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of ``rows`` (in the form of ``damage``): ``lines`` that stay, and a summary per conversation."""
    thin = keep(thin_rows(rows), "turns")
    marked, sizes = _marked(thin)
    marked = keep(marked.withColumn("row_id", _row_id(F.col("print"))), "marked")
    order = ["conv_id", "turn", "role", "print"]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = ("conv_id", "n", "turn", "role", "row_id", "ends", "copies", "fresh")
    blocks = keep(ranged.select(*columns).mapInArrow(_cut, _BLOCK), "blocks")

    place = ["part", "seq"]
    last_first = [F.col("conv_id"), F.col("part").desc(), F.col("seq").desc()]
    steps = blocks.select("conv_id", *place, "step").repartition("conv_id").sortWithinPartitions(*last_first)
    checkpoints = keep(steps.mapInArrow(_backward, _AFTER), "checkpoints")
    walked = blocks.select(*place, "codes").join(checkpoints, place).select(*place, "codes", "after").mapInArrow(_walk, _WALK)
    counts = ["head", "tail", "blank", "duplicate", "truncated", "illegal"]
    walked = keep(walked.join(blocks.select("conv_id", *place, *counts), place), "walks")
    chain = walked.repartition("conv_id").sortWithinPartitions("conv_id", *place)
    pieces = keep(chain.select("conv_id", *place, "costs", "exits", "letters", *counts).mapInArrow(_forward, _PIECE), "pieces")

    of_block = blocks.select(*place, "codes", "turns", "roles", "ids", "copies")
    chosen = pieces.select("conv_id", *place, "entry", "piece").join(of_block, place)
    lines = chosen.select("conv_id", *place, "entry", "piece", "codes", "turns", "roles", "ids", "copies").mapInArrow(_lines, _LINE)
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, "piece"))), lambda x: x["piece"]), "")
    totals = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    summary = _on_conv(sizes.select("conv_id", "gaps"), pieces.groupBy("conv_id").agg(*totals, audit.alias("audit")), "inner")
    return lines, summary


def _with_texts(lines: DataFrame, rows: DataFrame) -> DataFrame:
    texts = rows.select(_row_id(_print()).alias("t_id"), "text").groupBy("t_id").agg(F.first("text").alias("text"))
    joined = lines.join(texts, lines["row_id"] == texts["t_id"], "left")
    return joined.select(*[c for c in lines.columns if c != "row_id"], F.coalesce("text", F.lit("")).alias("text"))


def repaired(turns: DataFrame, damaged: bool = False) -> DataFrame:
    """Repaired conversations: ``conv_id, part, seq, i`` (their order), ``edit`` (K, R or I), ``turn, role, text``."""
    rows = damage(turns) if damaged else intact(turns)
    lines, _ = plan(rows)
    return _with_texts(lines, rows)


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_report(turns: DataFrame, damaged: bool = True) -> DataFrame:
    """Per conversation of ``turns``: faults, least cost, letters of the edits, SHA-256 of the repaired lines."""
    rows = damage(turns) if damaged else intact(turns)
    lines, summary = plan(rows)
    ordered = _with_texts(lines, rows).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "i")
    digests = ordered.select("conv_id", "role", "text").mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")
    out = _on_conv(_on_conv(turns.select("conv_id").distinct(), summary, "left"), digests, "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
