"""Line removal against brute force, lines of any length, and the query's whole job."""

import hashlib
import random
import re

from dropscope.llm import lines, queries

SCHEMA = "doc_id BIGINT, text STRING"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])


def test_query_meets_short_lines(spark, tmp_path):
    rows = [(1, "{\n12\nChapter 6\n1999"), (2, "}\n13\nChapter 7\n1998\nother")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (4, 0, sha(rows[0][1])), 2: (5, 4, sha("other"))}


def test_edits_at_every_place(spark):
    """Lines of 1 to 30 code points and copies with one or two edits anywhere; rows of one id and text are alike."""
    rnd = random.Random(4)
    pool = []
    for n in [*range(1, 31)] * 6:
        line = "".join(rnd.choice("abé😀") for _ in range(n))
        pool.append(line)
        for edits in (1, 1, 2):
            copy = list(line)
            for _ in range(edits):
                at, kind = rnd.randrange(len(copy) + 1), rnd.randrange(3)
                copy[at : at + (kind > 0)] = rnd.choice("abé😀") if kind < 2 else ""
            pool.append("".join(copy))
    rnd.shuffle(pool)
    texts = ["\n".join(pool[i : i + 9]) for i in range(0, len(pool), 9)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (3, texts[3])]
    got = {r["row"]["doc_id"]: r["kept_text"] for r in lines.dedup(spark.createDataFrame(rows, SCHEMA), near_from=0).collect()}
    seen, want = [], {}
    for i, text in enumerate(texts):
        left = []
        for line in text.split("\n"):
            if line == "" or not any(line == s or one_edit(line, s) for s in seen):
                left.append(line)
            if line:
                seen.append(line)
        want[i] = "\n".join(left)
    assert got == want
    assert sum(map(len, want.values())) < sum(map(len, texts)) / 2


def test_variants_only_of_lines_that_agree_but_for_a_piece(spark, monkeypatch):
    """Lines with a common first half and nothing else in common give no variants."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(60))
    head = word()
    rows = [(i, head + word()) for i in range(200)] + [(900, head + "x" * 60), (901, head + "x" * 59 + "y")]
    sizes, kept = {}, lines.keep

    def keep(df, name):
        out = kept(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(lines, "keep", keep)
    got = {r["row"]["doc_id"]: r["n_removed"] for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {d for d, n in got.items() if n} == {901}
    assert sizes["halves"] == 202 and sizes["survivors"] == 2


def test_whole_documents_are_not_dealt_out_for_a_few_lines(spark, monkeypatch, capsys):
    """The texts of candidate lines are shuffled by place; a full bitmap, which lets every line pass, changes no result."""
    rnd = random.Random(6)
    rows = [(i, "\n".join("".join(rnd.choice("abc") for _ in range(12)) for _ in range(20))) for i in range(40)]
    rows += [(50, "\t" + rows[0][1][:11].upper() + "X \n\n  "), (51, None), (None, "a line\n" + rows[1][1][:12]), (None, None)]
    plans, kept = {}, lines.keep

    def keep(df, name):
        capsys.readouterr()
        df.explain()
        plans[name] = capsys.readouterr().out
        return kept(df, name)

    monkeypatch.setattr(lines, "keep", keep)
    docs = spark.createDataFrame(rows, SCHEMA)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [sorted(map(repr, lines.dedup(docs).collect()))]
        monkeypatch.setattr(lines, "PLACE_WORDS", 1024)
        monkeypatch.setattr(lines, "_place_bit", lambda: (lines.F.col("pos").cast("bigint") * 0, lines.F.lit(0)))
        got.append(sorted(map(repr, lines.dedup(docs).collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got[0] == got[1]
    cut = {r["row"]["doc_id"]: r["n_removed"] for r in lines.dedup(docs).collect() if r["row"]["text"]}
    assert cut[50] == 1 and cut[None] == 1 and cut[0] == 0
    assert "row_key" in plans["told"] and not re.search(r"hashpartitioning\(id0#\d+L?, row_key#\d+L?, \d+\)", plans["told"])
