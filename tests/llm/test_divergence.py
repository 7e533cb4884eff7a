"""Source divergence: pointer sort against Python's sort, shards and reports against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from dropscope.llm import divergence

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, term STRING, n BIGINT, part STRING"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", 8)
    monkeypatch.setattr(divergence, "SHARD", 300)


def test_pointer_sort(small):
    rnd = random.Random(2)
    for alphabet, longest in (("ab", 40), ("aé\U0001f600", 12), ("abcdefgh", 20)):
        for n in (0, 1, 5, 400):
            words = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, longest))) for _ in range(n)]
            data = np.frombuffer(" ".join(words).encode(), np.uint8)
            starts, ends = divergence.term_pointers(data, np.array([0, len(data)]))
            order, head = divergence.multikey_sort(data, starts, ends)
            raw = data.tobytes()
            got = [raw[starts[i] : ends[i]] for i in order]
            assert got == sorted(w.encode() for w in words)
            assert [g for g, h in zip(got, head, strict=True) if h] == sorted({w.encode() for w in words})


def _plain(rows, least=3, top=200):
    docs, counts = defaultdict(set), defaultdict(Counter)
    groups = {(lang or "", source or "") for _, _, lang, source in rows}
    for i, (_, text, lang, source) in enumerate(rows):
        for t in _terms(text):
            docs[lang or "", t].add(i)
            counts[lang or "", source or ""][t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), ids in docs.items() if x == lang and len(ids) >= least]
        sources = sorted(g[1] for g in groups if g[0] == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def p(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        by, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(o, sum((by[s][t] - by[o][t]) ** 2 // by[o][t] for t in kept)) for o in sources if o != s]
            more = [(t, (by[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and by[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", more, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out |= {(lang, s, part, item, value, r) for r, (item, value) in enumerate(ranked, 1)}
    return out


def _rows(rnd, n):
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 14))) for _ in range(60)]
    out = []
    for i in range(n):
        words = [rnd.choice(vocabulary[: rnd.choice([10, 60])]) for _ in range(rnd.randint(0, 40))]
        text = " ".join(w.upper() if rnd.random() < 0.1 else w for w in words) + rnd.choice([".", "\n", "", "-x9"])
        out.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None])))
    return out


@pytest.mark.parametrize("entries", [1 << 20, 20])
def test_report_equals_plain_counting(spark, monkeypatch, entries):
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "CELLS", 16 if entries == 20 else 1 << 20)
    rows = _rows(random.Random(1), 120)
    rows += [(1, "twice the same", "en", "a")] * 3 + [(None, "", "fr", "q"), (None, None, "fr", "r"), (5, "only once", "fr", "r")]
    rows += [(7, "é" * 20_000 + " big " * 60_000 + " " + " ".join(f"w{'abc'[i % 3] * (i % 50)}" for i in range(3000)), "en", "a")] * 2
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = divergence.audit(df, top=7).collect()
    assert {tuple(r) for r in got} == _plain(rows, top=7) and len(got) == len({tuple(r) for r in got})
    assert not any(r["value"] for r in got if r["lang"] == "fr")


def test_long_texts_are_counted_in_pieces(small):
    import pyarrow as pa

    text = " ".join(f"term{'abcdefg'[i % 7]} {'long' * (i % 200)}" for i in range(900))
    batch = pa.record_batch([pa.array(["en", "en"]), pa.array(["a", "a"]), pa.array([text, "terma other"])], names=["lang", "source", "text"])
    count, docs = Counter(), Counter()
    for out in divergence._count([batch]):
        for row in out.to_pylist():
            count[row["term"].decode()] += row["n"]
            docs[row["term"].decode()] += row["docs"]
    assert count == Counter(_terms(text) + ["terma", "other"])
    assert docs == Counter({*_terms(text)}) + Counter(["terma", "other"])


def test_exact_numbers(spark):
    rnd = random.Random(8)
    for _ in range(200):
        total = rnd.randint(1, 10**15)
        n = rnd.randint(0, total - 1)
        assert divergence.billionths(np.array([[n]]), np.array([total]))[0, 0] == 1 + 10**9 * (n + 1) // total
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**14 + 7, 10**15 + 9, 12_345)], "n BIGINT, t BIGINT, v BIGINT")
    got = df.select(divergence._billionths(F.col("n"), F.col("t"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (10**14 + 8) // (10**15 + 9 + 12_345)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
