"""Registered queries ``opN_<name>`` over whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(name: str, check: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.packing import packed_digests

    return packed_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


@_query(
    "op9_host_quality_rules",
    r"""
WITH d AS (SELECT doc_id, source, coalesce(text,'') AS t, list_filter(string_split_regex(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text,''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w)-7)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, CAST(sum(least(8, coalesce(nx - i, 8))) AS BIGINT) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY 1),
c AS (SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, (n_words < 20 OR 100*n_repeat_words > 30*n_words) AS base_failed,
  (n_words < 20 OR 100*n_repeat_words > 30*n_words OR 10*n_symbols > n_words OR 10*n_dup_lines > 3*n_lines OR word_chars < 3*n_words OR word_chars > 12*n_words) AS failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM f GROUP BY 1),
s AS (SELECT sum(f)/sum(n) AS m, sum(n) AS t, count(*) AS k, sum(f*f/n) AS q FROM h),
v AS (SELECT m, (q - t*m*m - (k-1)*m*(1-m))/t AS b FROM s),
p AS (SELECT m, CASE WHEN b > 0 THEN least(1e6, greatest(1, m*(1-m)/b - 1)) ELSE 1e6 END AS k FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (failed AND (h.f + m*k)/(h.n + k) > 0.5) AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, p""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.quality import quality_report

    return quality_report(_table(spark, sf_dir, "documents")).drop("host_rate")


@_query(
    "op2_secret_scan",
    r"""
WITH k(kind, r, pat, grp, least_) AS (VALUES
  ('assign', 1, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 2, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 3, '[0-9a-f]+', 0, 24),
  ('private_key', 4, '-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY', 0, 1), ('github', 5, 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 40),
  ('slack', 6, 'xox[abprs]-[A-Za-z0-9-]{10,}', 0, 15), ('google', 7, 'AIza[0-9A-Za-z_-]{35}', 0, 39), ('jwt', 8, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}', 0, 20)),
x AS (SELECT doc_id, kind, r, least_, string_split_regex(text, pat) AS gap, regexp_extract_all(text, pat) AS m,
  CASE grp WHEN 2 THEN regexp_extract_all(text, pat, 2) ELSE regexp_extract_all(text, pat) END AS g
  FROM documents, k WHERE regexp_matches(text, pat)),
y AS (SELECT doc_id, kind, r, least_, i, gap[i] AS gap, m[i] AS m, g[i] AS g FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM x)),
z AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM y),
s AS (SELECT doc_id, kind, r, e - length(m) AS b, e FROM z WHERE length(g) >= least_),
a AS (SELECT doc_id, count(*) FILTER (r = 1) AS n_assign, count(*) FILTER (r = 2) AS n_access, count(*) FILTER (r = 3) AS n_hex,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, r) FILTER (r <= 3) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, r) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a USING (doc_id)""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.secrets import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


@_query(
    "op1_temperature_mixing",
    r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, '-') AS key, len(list_filter(string_split_regex(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM documents),
s AS (SELECT key, CAST(sum(n) AS BIGINT) AS total, count(*) AS docs FROM d GROUP BY 1),
p AS (SELECT *, total / (SELECT CAST(sum(total) AS DOUBLE) FROM s) AS p FROM s WHERE total > 0),
g AS (SELECT i, max(pow(p, i/4096.0::DOUBLE)/p) / min(pow(p, i/4096.0::DOUBLE)/p) AS reps FROM p, generate_series(0, 4096) t(i) GROUP BY 1),
t AS (SELECT min(i)/4096.0::DOUBLE AS t FROM g WHERE reps <= 2.0),
w AS (SELECT *, pow(p, t) AS raw FROM p, t),
q AS (SELECT key, raw / (SELECT sum(raw) FROM w) AS weight, CAST(round(raw/p * (1000000 / (SELECT min(raw/p) FROM w))) AS BIGINT) AS parts,
  CAST(greatest(1, ceil(total/32768), ceil(docs/4096)) AS BIGINT) AS blocks FROM w
  UNION ALL SELECT key, 0.0::DOUBLE, 1000000, CAST(greatest(1, ceil(docs/4096)) AS BIGINT) FROM s WHERE total = 0),
b AS (SELECT d.*, weight, parts, CAST(('0x' || md5('0:b:' || doc_id)[1:15]) AS BIGINT) % blocks AS block FROM d JOIN q USING (key)),
e AS (SELECT *, unnest(generate_series(0, (parts - 1) // 1000000)) AS epoch FROM b),
h AS (SELECT *, CAST(('0x' || md5('0:' || epoch || ':' || doc_id)[1:15]) AS BIGINT) AS h FROM e),
m AS (SELECT *, CAST(2 * sum(n) OVER (PARTITION BY key, block, epoch ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS middle2,
  CAST(sum(n) OVER (PARTITION BY key, block, epoch) AS BIGINT) AS size FROM h)
SELECT doc_id, key, n, round(weight, 9) AS weight, epoch, block,
  round((epoch + CASE WHEN size > 0 THEN middle2 / (2.0::DOUBLE * size) ELSE 0.5 END) / (parts / 1000000.0::DOUBLE), 9) AS slot
FROM m WHERE epoch < parts // 1000000 OR middle2 * 1000000 <= 2 * size * (parts % 1000000)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.mixing import mixture

    mixed = mixture(_table(spark, sf_dir, "documents"), max_repeats=2.0)
    return mixed.drop("row_key").withColumns({"weight": F.round("weight", 9), "slot": F.round("slot", 9)})


@_query(
    "op8_minhash_near_dedup",
    r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).drop("row_key", "leads")


@_query(
    "op6_substring_dedup",
    r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM g) WHERE f < doc_id),
v AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(greatest(i, coalesce(before, -50) + 50), i + 49)) AS i FROM v),
x AS (SELECT doc_id, i, w[i] AS t FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM w)),
k AS (SELECT x.doc_id, string_agg(t, ' ' ORDER BY x.i) AS t, count(*) AS n FROM x ANTI JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.substrings import dedup

    cut = dedup(_table(spark, sf_dir, "documents"), width=50)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query(
    "op4_line_dedup",
    r"""
WITH l AS (SELECT doc_id, pos, line AS raw, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents)),
d AS (SELECT line, min(doc_id * 10000000 + pos) AS f, length(line) AS n FROM l WHERE line <> '' GROUP BY 1),
h AS (SELECT line, f, n, m, left(line, m // 2) AS half, 0 AS side FROM (SELECT *, unnest([n, n-1]) AS m FROM d)
  UNION ALL SELECT line, f, n, m, right(line, m - m // 2), 1 FROM (SELECT *, unnest([n, n-1]) AS m FROM d)),
p AS (SELECT DISTINCT a.line, b.line AS other, a.n, b.n AS o FROM h a JOIN h b USING (m, half, side) WHERE b.f < a.f AND m = least(a.n, b.n)),
x AS (SELECT DISTINCT line FROM p WHERE CASE WHEN n = o THEN len(list_filter(list_zip(string_split(line, ''), string_split(other, '')), lambda t: t[1] <> t[2])) = 1
  WHEN n > o THEN len(list_filter(generate_series(1, n), lambda i: left(line, i - 1) || substr(line, i + 1) = other)) > 0
  ELSE len(list_filter(generate_series(1, o), lambda i: left(other, i - 1) || substr(other, i + 1) = line)) > 0 END),
m AS (SELECT l.*, x.line IS NOT NULL OR l.doc_id * 10000000 + l.pos > d.f AS gone FROM l LEFT JOIN d USING (line) LEFT JOIN x USING (line))
SELECT doc_id, count(m.pos) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (gone IS NOT TRUE), '')) AS kept_sha256 FROM documents LEFT JOIN m USING (doc_id) GROUP BY 1""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.lines import dedup

    cut = dedup(_table(spark, sf_dir, "documents"), near_from=0)
    kept = F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    return cut.select("row.doc_id", "n_lines", "n_removed", kept)


@_query("op10_counterfactual_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.toxicity import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query(
    "op5_warc_index",
    r"""
WITH p AS (SELECT page_id, strlen(coalesce(html,'')) AS n, sha1(coalesce(html,'')) AS d FROM pages),
m AS (SELECT d, n, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY 1, 2),
h AS (SELECT page_id, coalesce(url,'') AS u, '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]+)?([^#]*)' AS x FROM pages),
k AS (SELECT page_id, array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(u, x, 1, 'i')), '^www[.]', ''), '.')), ',')
  || ')' || coalesce(nullif(lower(regexp_extract(u, x, 2, 'i')), ''), '/') AS url_key, strftime(make_timestamp(page_id * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS "at" FROM h)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last > page_id THEN last END AS refers_to, url_key, "at", row_number() OVER (ORDER BY url_key, "at", page_id) - 1 AS capture_rank
FROM p JOIN k USING (page_id) LEFT JOIN m USING (d, n)""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.warc import archive

    indexed = archive(_table(spark, sf_dir, "pages"))
    return indexed.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "at", "capture_rank")


@_query(
    "op3_nn_descent_near_dedup",
    r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.vec_id WHERE r.m < p.b),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.neighbours import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), link=0.98)


@_query(
    "op13_private_spans",
    r"""
WITH k(kind, r, pat, start_, up, down) AS (VALUES
  ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 90, 'email|mail|contact|correo|courriel', 'example|test'),
  ('ip', 2, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', 60, 'ip|host|address|client|server', 'version|release|build|firmware'),
  ('card', 3, '[0-9](?:[\x20-]?[0-9])+', 80, 'card|visa|mastercard|amex|credit|tarjeta|carte|karte', 'order|invoice|isbn|item|serial|tracking|part'),
  ('phone', 4, '\+[0-9][\x20().0-9-]+[0-9]', 70, 'phone|tel|telefon|telefono|call|mobile|fax|handy|whatsapp|contact', 'order|invoice|isbn|item|serial|tracking|part'),
  ('iban', 5, '\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b', 80, 'iban|bank|account|konto|cuenta|compte', 'order|invoice|isbn|item|serial|tracking|part'),
  ('ssn', 6, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', 30, 'ssn|social security|tax id|taxpayer', 'order|invoice|isbn|item|serial|tracking|part'),
  ('local_phone', 7, '\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}\b', 30, 'phone|tel|telefon|telefono|call|mobile|fax|handy|whatsapp|contact', 'order|invoice|isbn|item|serial|tracking|part')),
x AS (SELECT doc_id, text, k.*, string_split_regex(text, pat) AS gap, regexp_extract_all(text, pat) AS m FROM documents, k WHERE regexp_matches(text, pat)),
y AS (SELECT * EXCLUDE (gap, m), i, gap[i] AS gap, m[i] AS m FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM x)),
z AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS c FROM y),
t AS (SELECT *, e - length(m) AS b, CASE kind WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT) > 255, true))) = 0
  WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(generate_series(1, length(d)), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) ELSE 2 * CAST(d[i] AS INT) - CASE WHEN d[i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 'phone' THEN length(d) BETWEEN 9 AND 15 WHEN 'ssn' THEN d[1:3] NOT IN ('000', '666') AND d[1] <> '9'
  WHEN 'iban' THEN list_reduce(list_prepend(0, list_transform(string_split(substr(c, 5) || left(c, 4), ''), lambda s: CASE WHEN s <= '9' THEN CAST(s AS INT) ELSE ascii(s) - 55 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
  ELSE true END AS ok FROM z),
w AS (SELECT *, translate(substr(text, greatest(1, b - 47), least(b, 48)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l,
  translate(substr(text, e + 1, 16), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS rr FROM t WHERE ok),
p AS (SELECT *, least(100, start_ + CASE WHEN regexp_matches(l, '(^|[^a-z])(' || up || ')([^a-z]|$)') OR regexp_matches(rr, '(^|[^a-z])(' || up || ')([^a-z]|$)') THEN 30 ELSE 0 END
  - CASE WHEN regexp_matches(l, '(^|[^a-z])(' || down || ')([^a-z]|$)') OR regexp_matches(rr, '(^|[^a-z])(' || down || ')([^a-z]|$)') THEN 30 ELSE 0 END) AS score FROM w),
s AS (SELECT * FROM p WHERE r <= 4 OR score >= 50 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.r <= 4 AND q.doc_id = p.doc_id AND q.b < p.e AND p.b < q.e)),
a AS (SELECT doc_id, count(*) FILTER (r = 1) AS n_email, count(*) FILTER (r = 2) AS n_ip, count(*) FILTER (r = 3) AS n_card, count(*) FILTER (r = 4) AS n_phone,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, r) FILTER (r <= 4) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, r) AS spans,
  string_agg(CAST(score AS VARCHAR), ',' ORDER BY b, r) AS scores FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM documents d LEFT JOIN a USING (doc_id)""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.personal import private_report

    return private_report(_table(spark, sf_dir, "documents"))


@_query(
    "op12_conversation_repair",
    r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS b FROM conversations),
h AS (SELECT * EXCLUDE (b), xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, v: list_reduce([xor(a, v), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE h WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i FROM d),
q AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev, left(role, 1) AS ini, count(*) OVER (PARTITION BY conv_id) AS n,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM o),
r AS (SELECT conv_id, i, n, turn, role, text, ini, blank, NOT blank AND seen AS dup, NOT blank AND NOT seen AND cut AS trunc, prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au') AS bad,
  CASE WHEN blank OR seen THEN 1000000000 WHEN cut THEN 5 ELSE 0 END AS x FROM q),
b(conv_id, i, c) AS (SELECT DISTINCT conv_id, n + 1, [0, 10, 5, 0]::BIGINT[] FROM r UNION ALL
  SELECT conv_id, i, [least(y[1], 5 + least(y[3], 5 + y[4])), least(y[2], 5 + least(y[3], 5 + y[4])), least(y[3], 5 + y[4]), least(y[4], 5 + y[3])] FROM (
  SELECT b.conv_id, r.i, [least(2 + c[1], 1 + x + c[3], CASE ini WHEN 's' THEN x + c[2] WHEN 'u' THEN x + c[3] END), least(2 + c[2], 1 + x + c[3], CASE ini WHEN 'u' THEN x + c[3] END),
    least(2 + c[3], 1 + x + c[4], CASE ini WHEN 'a' THEN x + c[4] END), least(2 + c[4], 1 + x + c[3], CASE ini WHEN 'u' THEN x + c[3] END)] AS y
  FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
f(conv_id, i, s, audit, kept) AS (SELECT DISTINCT conv_id, 1::BIGINT, 1, '', []::VARCHAR[] FROM r UNION ALL
  SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN k ELSE nx END, audit || e,
    CASE e WHEN 'D' THEN kept WHEN 'K' THEN list_append(kept, role || ':' || text) ELSE list_append(kept, CASE nx WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'R' THEN text ELSE '' END) END
  FROM (SELECT *, CASE WHEN p.c[s] = 2 + p.c1[s] THEN 'D' WHEN p.c[s] = 5 + p.c[nx] THEN 'I' WHEN p.c[s] = x + p.c1[k] THEN 'K' ELSE 'R' END AS e FROM (
    SELECT f.*, CASE s WHEN 3 THEN 4 ELSE 3 END AS nx, CASE WHEN s = 1 AND ini = 's' THEN 2 WHEN s <> 3 AND ini = 'u' THEN 3 WHEN s = 3 AND ini = 'a' THEN 4 END AS k, r.role, r.text, r.x, b.c, g.c AS c1
    FROM f JOIN b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = f.i LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i
    LEFT JOIN b g ON g.conv_id IS NOT DISTINCT FROM f.conv_id AND g.i = f.i + 1 WHERE r.i IS NOT NULL OR s IN (2, 3)) p)),
e AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(kept, length(audit)) AS kept FROM f GROUP BY 1),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
  count(*) FILTER (trunc) AS truncated, count(*) FILTER (bad) AS illegal FROM r GROUP BY 1),
z AS (SELECT t.*, b.c[1] AS cost, e.audit, sha256(array_to_string(e.kept, chr(10))) AS repaired FROM t JOIN e ON e.conv_id IS NOT DISTINCT FROM t.conv_id
  JOIN b ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.repair import repair_report

    return repair_report(_table(spark, sf_dir, "conversations"))


@_query(
    "op11_source_divergence",
    r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
t AS (SELECT id, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) + any_value(v) AS total FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // total AS p FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // ((SELECT sum(n) FROM c x WHERE x.lang = c.lang) + any_value(v)) AS q FROM c JOIN v USING (lang) GROUP BY 1, 2),
a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
pair AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(a.value, 0) AS BIGINT) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR r <= 200""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dropscope.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"))
