"""Conversation repair: letters against a plain search over all edits, blocks against whole, reports against plain Python."""

import hashlib
import random
import re
import zlib

from dropscope.llm import repair

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, part STRING, n STRING, print STRING"


def _search(rows):
    """Least (cost, letters) of ``rows`` (initial, what is left) by trying every edit, at most two inserts in a row."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    best = {}
    for i in range(len(rows), -1, -1):
        for inserts in (2, 1, 0):
            for last in follow:
                options = []
                for role in "ua" if inserts < 2 else "":
                    if role in follow[last]:
                        cost, rest = best[i, role, inserts + 1]
                        options.append((cost + 5, "I" + rest))
                if i == len(rows):
                    if last in ("", "a"):
                        options.append((0, ""))
                    best[i, last, inserts] = min(options, default=(10**9, ""))
                    continue
                initial, left = rows[i]
                cost, rest = best[i + 1, last, 0]
                options.append((cost + 2, "D" + rest))
                if left != "gone":
                    extra = 5 if left == "open" else 0
                    if initial and initial in follow[last]:
                        cost, rest = best[i + 1, initial, 0]
                        options.append((cost + extra, "K" + rest))
                    for role in "ua":
                        if role in follow[last]:
                            cost, rest = best[i + 1, role, 0]
                            options.append((cost + extra + 1, "R" + rest))
                best[i, last, inserts] = min(options)
    return best[0, "", 0]


def _codes(rows):
    return bytes(3 * ("sua".find(r) if r and r in "sua" else 3) + ["fine", "open", "gone"].index(left) for r, left in rows)


def test_letters_are_the_least_of_all_cheapest_edits():
    rnd = random.Random(3)
    for _ in range(1500):
        rows = tuple((rnd.choice("ssuuuaaat"), rnd.choice(["fine", "fine", "open", "gone"])) for _ in range(rnd.randint(0, 9)))
        costs, exits, letters = repair.walks(_codes(rows), repair.END)
        assert (costs[0], letters[0] + repair.TAIL[exits[0]]) == _search(rows), rows


def test_blocks_equal_the_whole():
    rnd = random.Random(4)
    for n in (1, 2, 7, 30, 200):
        for _ in range(20):
            codes = bytes(rnd.choice(range(12)) for _ in range(n))
            costs, exits, letters = repair.walks(codes, repair.END)
            cut = sorted(rnd.sample(range(1, n), min(n - 1, 5))) if n > 1 else []
            blocks = [codes[a:b] for a, b in zip([0, *cut], [*cut, n], strict=True)]
            after, ends = repair.END, []
            for b in reversed(blocks):
                ends.append(after)
                after = repair.through(repair.matrix(b), after)
            assert after == costs
            state, out = repair.START, ""
            for b, end in zip(blocks, reversed(ends), strict=True):
                _, outs, pieces = repair.walks(b, end)
                out, state = out + pieces[state], outs[state]
            assert (out, state) == (letters[0], exits[0])


def _report(turns):
    """The report in plain Python; ``turns`` are rows (conv_id, turn, role, text)."""
    space = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in turns:
        rows = convs.setdefault(conv, [])
        h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if h == 4 else space(role), space(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        rows.extend([(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        marks, seen = [], set()
        for _, role, text in rows:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            marks.append(fault)
        cost, audit = _search(tuple((r[1][:1], "gone" if m in ("blank", "duplicate") else "open" if m else "fine") for r, m in zip(rows, marks, strict=True)))
        lines, at, last = [], iter(rows), ""
        for letter in audit:
            new = "assistant" if last == "u" else "user"
            if letter == "I":
                lines.append(f"{new}:")
            else:
                _, role, text = next(at)
                if letter == "D":
                    continue
                lines.append(f"{role if letter == 'K' else new}:{text}")
            last = lines[-1][0]
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), bad, cost, audit, digest)
    return out


def test_report_equals_plain_python(spark):
    rnd = random.Random(6)
    turns = []
    for conv in range(60):
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            turns.append((conv, turn if rnd.random() < 0.9 else None, role, rnd.choice(["Hi.", "Yes!", "and then", " \t", None, "Ünï \U0001f600.", "?\n "])))
    turns += [(None, t, r, "x.") for t, r in enumerate(["user", "assistant", "user", "assistant"])]
    turns += [(99, None, None, None), (7, 2, "user", "Hi."), (7, 2, "user", "Hi."), (98, 10**9, "user", "a."), (98, 3, "assistant", "b" * 500_000 + ".")]
    # One conversation holds far more rows than all others, over many blocks.
    turns += [(50, t, ("user", "assistant")[(t + t // 7) % 2], f"line {t % 60}.") for t in range(20, 2000)]
    df = spark.createDataFrame([(*t, "x", "y", None) for t in turns], SCHEMA)
    got = repair.repair_report(df).collect()
    names = (*repair.NUMBERS, "audit", "repaired_sha256")
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in got} == _report(turns) and len(got) == 63


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", "", "", ""), (1, 1, "user", "Again.", "", "", ""), (2, 0, "tool", "", "", "", "")], SCHEMA)
    rows = repair.repaired(df).orderBy("conv_id", "part", "seq", "i").collect()
    assert [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in rows] == [(1, "K", "user", "Hi."), (1, "R", "assistant", "Again.")]
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(none).collect() == [] == repair.repaired(none).collect()
