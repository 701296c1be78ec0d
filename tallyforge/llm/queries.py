"""The opN_ queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, minhash, mixing, packing, phrases, quality, sharding, simhash, suffix, topk, urlfilter, vectorcodes, wavelet
from .tokens import default_path

#: The rules that the URL contract names.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 24)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken")
    )


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")))
    base = F.lit(quality.BASE.mask).cast("long")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept",
    )


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(spark, wavelet.write_shards(_table(spark, sf_dir, "documents"), default_path()))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), default_path())


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.judge_urls(pages, urlfilter.rules_frame(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vectorcodes.product_codes(_table(spark, sf_dir, "embeddings"))
    digest = F.lit(books.digest() if books else None).cast("string")
    return vectorcodes.with_label_errors(codes).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_line_dedup": op4_line_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_ids": op7_token_ids,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_vector_codes": op11_vector_codes,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_collocations": op13_collocations,
}

_WS = r"\x20\x09-\x0D"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{_WS}]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM d GROUP BY source),
s1 AS (SELECT *, (rk - 1) % 3 + 1 AS w, source_size * 3 AS cap, (source_size * 3)::DOUBLE / ((rk - 1) % 3 + 1) AS ratio FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam, sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, (SELECT lam FROM s2 WHERE ratio > lam ORDER BY ratio, rk LIMIT 1) AS level FROM s2),
s4 AS (SELECT *, CASE WHEN level IS NULL OR ratio <= level THEN cap::DOUBLE ELSE level * w END AS target,
    CASE WHEN level IS NULL OR ratio <= level THEN 3 ELSE floor(level * w / greatest(source_size, 1))::BIGINT END AS passes,
    greatest(ceil(source_size / greatest(65536, ceil(total / 65536))), 1)::BIGINT AS nb FROM s3),
s AS (SELECT *, greatest(target - passes * source_size, 0.0) AS rest FROM s4),
e AS (SELECT d.*, d.h % s.nb AS block, s.source_size, s.target, s.passes, s.rest FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
b0 AS (SELECT source, block, sum(size)::BIGINT AS bsize, any_value(passes) AS passes, any_value(rest) AS rest,
    ('0x' || substr(md5(concat_ws('|', 'mix-1', 'block', CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END, block::VARCHAR)), 1, 15))::BIGINT AS bh
  FROM e GROUP BY source, block),
b1 AS (SELECT *, sum(bsize) OVER (PARTITION BY source ORDER BY bh, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM b0),
b AS (SELECT *, CASE WHEN passes >= 3 THEN 0 WHEN after <= rest THEN 2 WHEN after - bsize < rest THEN 1 ELSE 0 END AS extra FROM b1),
p0 AS (SELECT e.source, e.block, e.h, sum(e.size)::BIGINT AS size, any_value(b.rest - (b.after - b.bsize)) AS left_over
  FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source AND e.block = b.block WHERE b.extra = 1 AND e.size <= b.rest - (b.after - b.bsize) GROUP BY e.source, e.block, e.h),
p1 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM p0),
p AS (SELECT source, max(h) AS cut FROM p1 WHERE 2 * through - size < 2 * left_over GROUP BY source)
SELECT e.doc_id, e.size, e.source_size, e.target,
  (e.size * (e.passes + CASE WHEN b.extra = 2 OR (b.extra = 1 AND e.h <= coalesce(p.cut, -1) AND e.size <= b.rest - (b.after - b.bsize)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source AND e.block = b.block LEFT JOIN p ON e.source IS NOT DISTINCT FROM p.source
"""

_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

#: The lines of every row of t(rid, doc_id, text) with their keys.
_LINES = f"""
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_TRIM})")} AS key FROM l),
f AS (SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS top FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 5),
g AS (SELECT k.*, f.key IS NOT NULL AND coalesce(k.doc_id, -9223372036854775808) <> f.top AS gone FROM k LEFT JOIN f ON k.key = f.key)"""

_OP4 = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), {_LINES}
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY rid
"""

#: The ledger's measurements of t(rid, text); duplicated trigrams are found by windows over word rows.
_MEASURES = rf"""
w0 AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS pos
  FROM (SELECT rid, regexp_extract_all(text, '[^{_WS}]+') AS words FROM t)),
w1 AS (SELECT rid, pos, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w0 WINDOW o AS (PARTITION BY rid ORDER BY pos)),
w2 AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM w1 WHERE w3 IS NOT NULL),
w3 AS (SELECT rid, count(DISTINCT pos + step) AS n FROM w2, (SELECT unnest([0, 1, 2]) AS step) WHERE c >= 2 GROUP BY rid),
m AS (SELECT t.rid, len(regexp_extract_all(t.text, '[^{_WS}]+'))::BIGINT AS n_words,
    length(regexp_replace(t.text, '[{_WS}]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(list_filter(string_split(t.text, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')))::BIGINT AS n_lines,
    (len(list_filter(string_split(t.text, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')))
      - len(list_distinct(list_filter(string_split(t.text, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')))))::BIGINT AS n_dup_lines,
    coalesce(w3.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN w3 ON t.rid = w3.rid)"""
_BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
_KEPT = f"(NOT {_BASE_FAILED} AND NOT (100 * n_symbols > 10 * word_chars) AND NOT (100 * n_dup_lines > 30 * n_lines) AND NOT (word_chars < 2 * n_words))"

_OP6 = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), {_MEASURES}
SELECT t.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_BASE_FAILED} AS base_failed, {_KEPT} AS kept
FROM t JOIN m ON t.rid = m.rid
"""

_RULES_SQL = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
_OP10 = rf"""
WITH r(action, r_host, r_path) AS (VALUES {_RULES_SQL}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, {_LOWER.format("regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0)")} AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)?', 1) AS path, row_number() OVER () AS rid FROM u),
x AS (SELECT v.rid, max_by(action, length(r_host || r_path)) AS verdict, max_by(r_host || r_path, length(r_host || r_path)) AS rule
  FROM v JOIN r ON (v.host = r_host OR ends_with(v.host, '.' || r_host)) AND starts_with(v.path, r_path) GROUP BY v.rid)
SELECT v.page_id, v.host, v.path, x.rule, coalesce(x.verdict, 'allow') AS verdict FROM v LEFT JOIN x ON v.rid = x.rid
"""

#: crc32 by the byte table that its polynomial gives; sizes cut at equal targets by the middle byte.
_OP1 = """
WITH tab AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS v
  FROM (SELECT unnest(range(256)) AS n))),
b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(b, lambda a, x: xor(t[xor(a & 255, x) + 1], a >> 8), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32 FROM b, tab),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(size) OVER ()::BIGINT AS total FROM c),
s AS (SELECT *, ((before * 2 + size) * 24 // (total * 2))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""

#: All windows of 200 bytes, by hash; starts of repeated ones cover spans, the gaps between are kept.
_OP5 = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(greatest(length(h) // 2 - 199, 0))) AS i FROM t)),
r AS (SELECT rid, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
m AS (SELECT rid, i, coalesce(i > lag(i) OVER o + 200, true)::INT AS first FROM r WINDOW o AS (PARTITION BY rid ORDER BY i)),
n AS (SELECT rid, i, sum(first) OVER (PARTITION BY rid ORDER BY i) AS span FROM m),
g AS (SELECT rid, span, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY rid, span),
q AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail FROM g GROUP BY rid),
k AS (SELECT g.rid, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM (SELECT rid, a, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS p FROM g) g JOIN t ON t.rid = g.rid GROUP BY g.rid)
SELECT t.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN q.rid IS NULL THEN h ELSE coalesce(kept, '') || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM t LEFT JOIN q ON q.rid = t.rid LEFT JOIN k ON k.rid = t.rid
"""

#: Exact links between all pairs that share a shingle, and what each document reaches; ids are unique here.
_OP9 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^{_WS}]+') AS w FROM documents),
e AS (SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM reach r JOIN d ON d.a = r.b),
m AS (SELECT a, least(a, min(b)) AS least_id FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least_id, t.doc_id) AS component_id, t.doc_id = coalesce(m.least_id, t.doc_id) AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN m ON m.a = t.doc_id
"""

_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
p AS (SELECT rid, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS c FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
x AS (SELECT s.lang, s.phrase FROM c s JOIN c t ON s.lang = t.lang AND t.k > s.k AND 100 * t.a >= 100 * s.a AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')),
o AS (SELECT *, unnest(range(1, k)) AS cut FROM c ANTI JOIN x USING (lang, phrase)),
s AS (SELECT o.lang, o.phrase, a, l.c AS l, r.c AS r, n, cut, ((1000::HUGEINT * a * n) // (l.c::HUGEINT * r.c))::BIGINT AS score FROM o
  JOIN f l ON l.lang = o.lang AND l.phrase = array_to_string(w[:cut], ' ') JOIN f r ON r.lang = o.lang AND r.phrase = array_to_string(w[cut + 1:], ' ') JOIN n ON n.lang = o.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM m
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def _op11(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds written out: x has a row for each part, cI the codebooks after round I."""
    gap = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [f"c0 AS (SELECT p, e, v FROM x JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e FROM k ORDER BY vec_id NULLS LAST LIMIT {entries}) USING (rid))"]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT x.rid, x.p, min({{'d': {gap}, 'e': c.e}}) AS m FROM x JOIN c{i} c ON c.p = x.p GROUP BY x.rid, x.p)")
        if i < rounds:
            steps.append(f"u{i} AS (SELECT p, e, list(floor(s::DOUBLE / n)::BIGINT ORDER BY j) AS v FROM (SELECT x.p, m.e AS e, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM x JOIN a{i} a ON a.rid = x.rid AND a.p = x.p, (SELECT unnest(range(1, 9)) AS j) GROUP BY ALL) GROUP BY p, e)")
            steps.append(f"c{i + 1} AS (SELECT c.p, c.e, coalesce(u.v, c.v) AS v FROM c{i} c LEFT JOIN u{i} u ON u.p = c.p AND u.e = c.e)")
    return f"""
WITH k AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT rid, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM k, (SELECT unnest(range({parts})) AS p)),
{", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN r USING (rid), b
"""


ORACLE_SQL: dict[str, str] = {
    "op1_sharding": _OP1,
    "op2_mixing": _OP2,
    "op3_exact_top_k": _OP3,
    "op4_line_dedup": _OP4,
    "op5_suffix_dedup": _OP5,
    "op9_minhash_dedup": _OP9,
    "op6_quality_rules": _OP6,
    "op10_url_filters": _OP10,
    "op11_vector_codes": _op11(),
    "op13_collocations": _OP13,
}
