"""Toxicity classifier that scores group mentions alike.

A logistic model over word features (whole words and word beginnings, hashed). For every labelled text that mentions an
identity term, a counterfactual with the terms swapped within their group is made, and the loss adds
``swap_penalty * (logit(text) - logit(swapped text)) ** 2``: the mention of a group alone moves no score.

1. Labelled rows outside the held-out quarter are sampled down to about ``rows`` by a hash (documented bound).
2. Features that differ between the classes are selected: counts per hashed feature are summed in Spark.
3. The sample's selected features, a few per text, are read by the driver, which fits the weights.
4. All documents are scored in one pass with the weight table (at most ``features`` entries).

Defined cases: null and empty texts get the score of a text without features; a null id is in training; labels without an id or a
class are left out; an id labelled twice is toxic if one label says so; no labels at all give 0 everywhere;
repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dropscope.llm.common import keep, rows_of

BUCKETS = 1 << 18
# Terms that name groups of people, by kind; swaps stay within a kind.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
SWAPS = {kind[i]: kind[(i + 1) % len(kind)] for kind in IDENTITY for i in range(len(kind))}
_EDGES = ".,;:!?\"'()[]{}<>*%#|-_"


def features_of(token: str) -> tuple[int, ...]:
    """Hashed features of a token: the word, and its first three, four and five letters."""
    word = token.strip(_EDGES)
    if not word:
        return ()
    names = [word, *(f"^{word[:k]}" for k in (3, 4, 5) if len(word) >= k)]
    return tuple(xxhash.xxh3_64_intdigest(n) % BUCKETS for n in names)


class _Known(dict):
    """Features per token, remembered for frequent tokens; ``only`` leaves out all others."""

    def __init__(self, only: frozenset[int] | None = None, size: int = 300_000):
        super().__init__()
        self.only, self.most = only, size

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = features_of(token)
        if self.only is not None:
            found = tuple(f for f in found if f in self.only)
        if len(self) < self.most:
            self[token] = found
        return found

    def of(self, text: str | None) -> set[int]:
        return set().union(*map(self.__getitem__, set((text or "").lower().split())))


def swapped(text: str) -> str | None:
    """The text with every identity term replaced by the next of its kind; None without any."""
    words = text.lower().split()
    changed = [w.replace(core, SWAPS[core]) if (core := w.strip(_EDGES)) in SWAPS else w for w in words]
    return " ".join(changed) if changed != words else None


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``text, toxic`` of about ``rows`` labelled ids at most, chosen by a hash of the id; an id that repeats in ``docs`` gives one
    row, its smallest text (null if it has none), so the bound holds for rows as well."""
    own = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = own.count()
    if count > rows:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / count))
    texts = docs.select("doc_id", "text").join(own, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return keep(texts.select("text", "toxic"), "sample")


def _counting(batches):
    known, seen, toxic = _Known(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for text, label in rows_of(batches):
        at = np.fromiter(known.of(text), np.int64)
        seen[at] += 1
        if label:
            toxic[at] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at]), pa.array(toxic[at])], names=["f", "n", "t"])


def select_features(sampled: DataFrame, features: int) -> dict[int, float]:
    """Features by z-score of their toxic share against the overall share; at most ``features`` of them."""
    counted = sampled.mapInArrow(_counting, "f BIGINT, n BIGINT, t BIGINT").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    total, share = sampled.agg(F.count("*"), F.avg("toxic")).first()
    if not total or share in (0, 1):
        return {}
    z = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = counted.filter("n >= 3").select("f", z.alias("z")).filter(F.abs("z") >= 3.5).orderBy(F.abs("z").desc(), "f").limit(features)
    return {r["f"]: r["z"] for r in best.collect()}


def _selecting(only: frozenset[int]):
    def run(batches):
        known = _Known(only)
        for batch in batches:
            out = []
            for text, label in rows_of([batch]):
                other = swapped(text or "")
                out.append((label, sorted(known.of(text)), sorted(known.of(other)) if other is not None else None))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            ids = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], ids), pa.array(columns[2], ids)], names=["toxic", "own", "swap"]
            )

    return run


def fit(sampled: DataFrame, features: int = 4096, swap_penalty: float = 1.0, ridge: float = 1e-4, steps: int = 400) -> Model:
    """Weights by gradient descent with momentum on the bounded sample; the start is the class balance."""
    chosen = select_features(sampled, features)
    if not chosen:
        share = sampled.agg(F.avg("toxic")).first()[0] or 0.0
        return Model(float(np.log((share + 1e-6) / (1 - share + 1e-6))), {})
    rows = sampled.mapInArrow(_selecting(frozenset(chosen)), "toxic INT, own ARRAY<BIGINT>, swap ARRAY<BIGINT>").collect()
    place = {f: i for i, f in enumerate(sorted(chosen))}

    def matrix(lists):
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return row, np.array([place[f] for x in lists for f in x], np.int64)

    y = np.array([r["toxic"] for r in rows], float)
    own = matrix([r["own"] for r in rows])
    pairs = [r for r in rows if r["swap"] is not None]
    first, second = matrix([r["own"] for r in pairs]), matrix([r["swap"] for r in pairs])
    n, size = len(rows), len(place)
    w, b = np.zeros(size), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    total = lambda m, k: np.bincount(m[0], w[m[1]], k)
    back = lambda m, g: np.bincount(m[1], g[m[0]], size)
    slope = np.sqrt(np.bincount(own[1], minlength=size) / n + 1e-3)  # rare features take larger steps
    if pairs:  # and those that swaps touch smaller ones, as the penalty is steep for them
        touched = np.bincount(first[1], minlength=size) + np.bincount(second[1], minlength=size)
        slope = slope + 8 * swap_penalty * touched / len(pairs)
    scale = 1 / slope
    speed, speed_b = np.zeros(size), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(b + total(own, n), -30, 30)))
        g = back(own, p - y) / n + ridge * w
        if pairs:
            gap = total(first, len(pairs)) - total(second, len(pairs))
            g += 2 * swap_penalty * (back(first, gap) - back(second, gap)) / len(pairs)
        speed = 0.9 * speed - 0.3 * g * scale
        speed_b = 0.9 * speed_b - 0.3 * (p - y).mean()
        w, b = w + speed, b + speed_b
    return Model(float(b), {f: float(w[i]) for f, i in place.items()})


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row, over whole texts."""

    def run(batches):
        known = _Known(frozenset(model.weights))
        weight = model.weights.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                logits = [model.bias + sum(map(weight, sorted(known.of(t)))) for t in part.column("text").to_pylist()]
                scores = 1 / (1 + np.exp(-np.clip(np.array(logits), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id BIGINT, score DOUBLE")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = 20_000, features: int = 4096, swap_penalty: float = 1.0) -> DataFrame:
    """Fit on the labels and score every document."""
    return score(docs, fit(sample(docs, labels, rows), features, swap_penalty))
