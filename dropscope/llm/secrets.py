"""Secret scan over a trigram index.

From each rule's regular expression a Boolean trigram query is derived: an OR of ANDs of lower-case trigrams that
any match must contain. The inverted index holds postings (trigram, row) of lower-cased texts; a rule's
candidates are the rows that appear in the postings of all trigrams of one of its ANDs. Only candidates are searched with the
expression. A rule without mandatory trigrams (plain hex runs) reads every text.

Postings are built for the trigrams that the rules ask for (``index(docs, vocabulary)``); others would never
be looked up.

Defined cases: null and empty texts have no spans; null ids are kept; repeated rows each get the same
result; extra columns are ignored; an empty table gives no rows. Positions count code points, end exclusive.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as regex_tree
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dropscope.llm.common import keep, row_key


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, non-overlapping) whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


# The three base rules, in their order. A hex run of 24 or more is found as such: shorter runs
# can't overlap it, so this equals all maximal runs filtered by length; the same holds for access keys.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Public formats of further credentials, each with a long literal prefix.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}", 0, 20),
)
RULES = BASE + MORE

_MOST = 64  # strings of an exact set before it is turned into trigrams

Query = frozenset  # of frozensets of trigrams: an OR of ANDs
ALWAYS: Query = frozenset([frozenset()])


def _minimal(q) -> Query:
    return frozenset(a for a in q if not any(b < a for b in q))


def _both(a: Query, b: Query) -> Query:
    both = _minimal({x | y for x, y in product(a, b)})
    return both if len(both) <= _MOST else a  # dropping a condition only widens the candidates


def _grams(strings: frozenset) -> Query:
    return _minimal({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _read(items) -> tuple[frozenset | None, Query]:
    """Exact strings of a sequence of nodes (None when unknown), and its trigram query."""
    run, query, exact = frozenset([""]), ALWAYS, True
    for op, arg in items:
        part, asked = _node(op, arg)
        if part is not None and len(run) * len(part) <= _MOST:
            run = frozenset(x + y for x, y in product(run, part))
            continue
        query, exact = _both(_both(query, _grams(run)), asked), False
        run = part if part is not None else frozenset([""])
    query = _both(query, _grams(run))
    return (run if exact else None), query


def _node(op, arg) -> tuple[frozenset | None, Query]:
    if op is kinds.LITERAL:
        return frozenset([chr(arg).lower()]), ALWAYS
    if op is kinds.IN and len(arg) <= 8 and all(o is kinds.LITERAL for o, _ in arg):
        return frozenset(chr(a).lower() for _, a in arg), ALWAYS
    if op is kinds.SUBPATTERN:
        exact, query = _read(arg[3])
        return exact, ALWAYS if exact is not None else query
    if op is kinds.BRANCH:
        sides = [_read(b) for b in arg[1]]
        if all(e is not None for e, _ in sides):
            return frozenset().union(*(e for e, _ in sides)), ALWAYS
        return None, _minimal(frozenset().union(*(q for _, q in sides)))
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        low, high, sub = arg
        exact, query = _read(sub)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, ALWAYS
        return None, query if low else ALWAYS
    return None, ALWAYS


def trigram_query(pattern: str) -> Query:
    """ORs of ANDs of trigrams; ``ALWAYS`` when a match needs none."""
    exact, query = _read(regex_tree.parse(pattern))
    return query if exact is None else _grams(exact)


def index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Postings ``trigram, doc_id, row_key`` of the lower-cased texts."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in vocabulary]))
    return docs.select("doc_id", row_key(F.col("text")).alias("row_key"), F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Rows ``kind, doc_id, row_key`` in the intersection of the postings of one AND of the rule's query."""
    ands = [(kind, a) for kind, q in queries.items() for a in sorted(map(sorted, q))]
    asked: dict[str, list[int]] = {}
    for i, (_, grams) in enumerate(ands):
        for g in grams:
            asked.setdefault(g, []).append(i)
    lists = F.create_map(*[F.lit(x) if k == 0 else F.array(*map(F.lit, x)) for g in asked.items() for k, x in enumerate(g)])
    needs = F.array(*[F.lit(len(g)) for _, g in ands])
    names = F.array(*[F.lit(k) for k, _ in ands])
    met = (
        postings.distinct()
        .select("doc_id", "row_key", F.explode(F.element_at(lists, F.col("trigram"))).alias("clause"))
        .groupBy("doc_id", "row_key", "clause")
        .count()
    )
    met = met.filter(F.col("count") == F.get(needs, F.col("clause")))
    return met.select(F.get(names, F.col("clause")).alias("kind"), "doc_id", "row_key").distinct()


def spans(texts: DataFrame, rule: Rule) -> DataFrame:
    """Spans ``doc_id, row_key, kind, start, end`` of one rule in ``doc_id, row_key, text``.

    The text between matches comes from a split by the expression; lengths before a match add up to its start.
    """
    hit = texts.filter(F.col("text").rlike(rule.pattern)).dropDuplicates(["doc_id", "row_key"])
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split("text", rule.pattern, -1)
    rows = hit.select("doc_id", "row_key", gaps.alias("gap"), found.alias("found"), tested.alias("tested")).select(
        "doc_id",
        "row_key",
        F.posexplode(F.arrays_zip(F.slice("gap", 1, F.size("found")).alias("gap"), "found", "tested")).alias("i", "m"),
    )
    length = F.char_length("m.found").cast("bigint")
    before = W.partitionBy("doc_id", "row_key").orderBy("i")
    end = F.sum(F.char_length("m.gap") + length).over(before)
    return (
        rows.select("doc_id", "row_key", "m", end.alias("end"), length.alias("length"))
        .filter(F.char_length("m.tested") >= rule.least)
        .select("doc_id", "row_key", F.lit(rule.kind).alias("kind"), (F.col("end") - F.col("length")).alias("start"), "end")
    )


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All spans of all rules."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    plain = {k: q for k, q in queries.items() if q != ALWAYS}
    texts = docs.select("doc_id", row_key(F.col("text")).alias("row_key"), "text").filter("text is not null")
    parts = [spans(texts, r) for r in rules if r.kind not in plain]
    if plain:
        vocabulary = sorted({t for q in plain.values() for a in q for t in a})
        found = keep(candidates(index(docs, vocabulary), plain), "candidates")
        for r in rules:
            if r.kind in plain:
                own = found.filter(F.col("kind") == r.kind).select(
                    F.col("doc_id").alias("c_id"), F.col("row_key").alias("c_key")
                )
                on = texts["doc_id"].eqNullSafe(own["c_id"]) & (texts["row_key"] == own["c_key"])
                parts.append(spans(texts.join(own, on, "left_semi"), r))
    return reduce(DataFrame.unionByName, parts)


def _joined(wanted: list[str] | None, rules: tuple[Rule, ...]) -> Column:
    own = F.col("list") if wanted is None else F.filter("list", lambda s: s["kind"].isin(*wanted))
    names = F.array(*[F.lit(r.kind) for r in rules])
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["kind"]), s["kind"].alias("kind"), s["end"].alias("end"))
    ordered = F.sort_array(F.transform(own, place))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("list", lambda s: s["kind"] == kind)).cast("bigint")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: counts of the base kinds, their digest, and all spans as text."""
    base = [r.kind for r in BASE]
    per = (
        find_secrets(docs, rules)
        .groupBy("doc_id", "row_key")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("list"))
        .select(
            F.col("doc_id").alias("s_id"),
            F.col("row_key").alias("s_key"),
            *[_count(k).alias(f"n_{k}") for k in base],
            _joined(base, rules).alias("base"),
            _joined(None, rules).alias("spans"),
        )
    )
    keys = docs.select("doc_id", row_key(F.col("text")).alias("row_key"))
    on = keys["doc_id"].eqNullSafe(per["s_id"]) & (keys["row_key"] == per["s_key"])
    return keys.join(per, on, "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("bigint")).alias(f"n_{k}") for k in base],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
