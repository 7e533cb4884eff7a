"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dropscope.llm import graph, lines, minhash, mixing, packing, quality, secrets, toxicity, warc
from dropscope.llm.common import rolled
from dropscope.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def check_packed(rows, texts):
    """Pieces equal those of the tokenizer; sequences are gapless, within capacity, and few."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(seqs) <= 1.02 * -(-total // 4096) + 1 + sum(r["length"] > 2048 for r in rows)
    return len(seqs)


def test_packing_is_exact(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packed(packing.packed_digests(docs, tokenizer_path()).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1))
def test_plan_equals_best_fit_decreasing(counts):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(64 - length)
    used, seen = collections.Counter(), collections.Counter()
    for length, low, high, each, first, offset in packing.plan_runs(counts, 64):
        seen[length] += high - low
        for i in range(high - low):
            used[first + i // each] += length
            assert offset + (i % each + 1) * length <= 64
    assert seen == counts and max(used.values()) <= 64
    assert sorted(64 - v for v in used.values()) == sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), min_size=0, max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    got = [runs[r][i] for r, i in warc.LoserTree(runs)]
    assert got == sorted(x for r in runs for x in r)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=80), st.integers(1, 9))
def test_rolled_hashes_tell_windows_apart(xs, width):
    h = rolled(np.array(xs, np.uint64), width).tolist()
    windows = [tuple(xs[i : i + width]) for i in range(len(xs) - width + 1)]
    assert len(h) == len(windows) and len(set(h)) == len(set(windows))
    assert len(set(zip(h, windows, strict=True))) == len(set(windows))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b or x in got}


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    flips = []
    for _ in range(40):
        other = base.copy()
        other[:32] = rng.integers(0, 2**63, 32).astype(np.uint64)  # similarity 368 / 432
        a, b = minhash.odd_sketches(minhash.samples([np.unique(base), np.unique(other)]))
        flips.append(int(np.unpackbits(a ^ b).sum()))
    assert max(flips) <= minhash.allowed_flips(0.85) < 120
    a, b = minhash.odd_sketches(minhash.samples([base, rng.integers(0, 2**63, 400).astype(np.uint64)]))
    assert np.unpackbits(a ^ b).sum() > minhash.allowed_flips(0.85) - 45


def test_groups_without_a_common_leader(spark):
    """A chain of texts, each like the next only, so that the star of a bucket can't link all."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(12):
        t = list(words)
        for j in range(k * 4, k * 4 + 4):
            t[j * 8] = f"c{k}"
        rows.append((50 - k, " ".join(t[: 8 * 4 * 12 + 40])))
    sets = minhash.shingle_sets([t.encode() for _, t in rows], 5)
    parent = list(range(12))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i in range(12):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {rows[i][0]: min(rows[j][0] for j in range(12) if root(j) == root(i)) for i in range(12)}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), 80).collect()}
    assert got == want


def test_neutral_mentions_move_no_score(spark):
    rng = random.Random(5)
    text = lambda *more: " ".join([*(f"n{rng.randrange(300)}" for _ in range(30)), *more])
    rows = []
    for i in range(3000):
        toxic = i % 4 == 0
        words = (["vile"] if toxic and rng.random() < 0.7 else []) + (["muslims"] if rng.random() < (0.5 if toxic else 0.03) else []) + (["christians"] if rng.random() < 0.05 else [])
        rows.append((i, text(*words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id BIGINT, text STRING")
    sampled = toxicity.sample(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id BIGINT, toxic INT"), 20_000)
    f = toxicity.features_of("muslims")[0]
    plain, fair = toxicity.fit(sampled, swap_penalty=0.0).weights, toxicity.fit(sampled, swap_penalty=20.0).weights
    assert plain[f] > 0.2 and abs(fair[f]) < 0.25 * plain[f]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r["score"] for r in scored if r["toxic"]]
    clean = [r["score"] for r in scored if not r["toxic"]]
    wins = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert wins > 0.8


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.mode("overwrite").saveAsTable(f"stage{len(out)}")
        docs = spark.table(f"stage{len(out)}")
        out.append(docs)
    return out


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pipeline_against_brute_force(spark, staged):
    documents, quality_, lines_, near, mixed, packed = [[r.asDict() for r in d.collect()] for d in staged]
    # Quality: no host of these tables is bad, so the base rules decide.
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_report(staged[0]).collect()}
    assert {d["doc_id"] for d in quality_} == {d["doc_id"] for d in documents if verdict[d["doc_id"]]}
    assert 0 < len(quality_) < len(documents)

    # Lines: equal or, from ten code points on, one edit from an earlier line.
    seen, want = [], {}
    near_ = lambda a, b: a == b or min(len(a), len(b)) >= 10 and abs(len(a) - len(b)) <= 1 and one_edit(a, b)
    for d in sorted(quality_, key=lambda d: d["doc_id"]):
        left = []
        for line in d["text"].split("\n"):
            norm = " ".join(words_of(line.lower()))
            if not norm or not any(near_(norm, s) for s in seen):
                left.append(line)
            if norm:
                seen.append(norm)
        if any(words_of(x) for x in left) or len(left) == d["text"].count("\n") + 1:
            want[d["doc_id"]] = "\n".join(left)
    assert {d["doc_id"]: d["text"] for d in lines_} == want
    assert all(d["n_chars"] == len(d["text"]) for d in lines_)

    # Near-dedup: components of all pairs.
    sets = {}
    for d in lines_:
        w = words_of(d["text"].lower())
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(d["doc_id"] for d in near) == [i for i in ids if find(i) == i]

    # Mixing: every document once or twice, whole rows; sources near their weights.
    times = collections.Counter(d["doc_id"] for d in mixed)
    assert set(times) == {d["doc_id"] for d in near} and max(times.values()) <= 2
    assert {tuple(sorted(d.items(), key=str)) for d in mixed} == {tuple(sorted(d.items(), key=str)) for d in near}

    # Packing: exact ids of every copy.
    check_packed(packed, [(d["doc_id"], d["text"]) for d in mixed])
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def test_secret_spans_against_regular_expressions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10**6, "é token='abcdef' Secret : \"zzzzzz\" ghp_" + "a1" * 20 + " x" + "0f" * 13 + " AKIA" + "Z9" * 9)], "doc_id BIGINT, text STRING")
    docs = docs.select("doc_id", "text").unionByName(extra)
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(docs).collect()}
    for r in docs.collect():
        want = []
        for i, rule in enumerate(secrets.RULES):
            want += [(m.start(), i, rule.kind, m.end()) for m in re.finditer(rule.pattern, r["text"] or "") if len(m.group(rule.group)) >= rule.least]
        assert got[r["doc_id"]] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(want))
    assert got[10**6].count(",") == 5  # the GitHub key is a hex run, too


def test_line_half_keys(spark):
    """Every pair within one edit shares a half key."""
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + a[i + 1 :], a[:i] + "z" + a[i + 1 :], a[:i] + "z" + a[i:]])
        pairs.append((a, b))
    keyed = lambda c: spark.createDataFrame(pairs, "a STRING, b STRING").select("a", "b", F.col(c).alias("line")).select("a", "b", F.array(*lines._halves()).alias(f"k{c}"))
    both = keyed("a").join(keyed("b"), ["a", "b"]).filter(~F.arrays_overlap("ka", "kb") & (F.col("b") != ""))
    assert both.collect() == []


def test_mixing_draws_are_stable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    draw = lambda d: sorted(map(tuple, mixing.mixture(d, seed=7).drop("weight").collect()), key=str)
    assert draw(docs) == draw(docs.repartition(5))
