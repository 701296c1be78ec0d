"""Queries of projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import table
from . import fixtures as X
from .fixtures import POSTS
from .registry import query


@query("c05_event_keys", "SELECT DISTINCT replace(lower(trim('  ' || n_name || ' ')), '_', '-') AS event FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select(S.event_key(F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("event")).distinct()


@query("c06_float_cast", """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN 'NaN' WHEN 3 THEN ' ' || (event_id % 1000)::VARCHAR || ' ' ELSE (event_id % 1000)::VARCHAR || '.5' END AS x FROM events)
SELECT event_id, CASE WHEN event_id % 5 > 2 THEN try_cast(trim(x) AS DOUBLE) END AS v FROM t""")
def _(spark, sf):
    i = F.col("event_id")
    n = (i % 1000).cast("string")
    x = F.when(i % 5 == 0, "").when(i % 5 == 1, "abc").when(i % 5 == 2, "NaN").when(i % 5 == 3, F.concat(F.lit(" "), n, F.lit(" "))).otherwise(F.concat(n, F.lit(".5")))
    return table(spark, sf, "events").select(i, S.to_float(x).alias("v"))


@query("c07_rounding", "SELECT o_orderkey, round(o_totalprice / 7, 4) AS v FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 7, 4).alias("v"))


@query("c08_iso_days", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE::VARCHAR || 'T10:00:00' WHEN 1 THEN o_orderdate::DATE::VARCHAR WHEN 2 THEN '2019-13-45' ELSE 'soon' END AS x, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN d END AS day FROM t""")
def _(spark, sf):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate").cast("string")
    x = F.when(k % 4 == 0, F.concat(d, F.lit("T10:00:00"))).when(k % 4 == 1, d).when(k % 4 == 2, "2019-13-45").otherwise("soon")
    return table(spark, sf, "orders").select(k, S.iso_day(x).alias("day"))


@query("c09_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate::DATE::VARCHAR END AS day FROM orders")
def _(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    x = F.when(k % 5 == 0, F.date_format(d, "d MMM yyyy")).when(k % 5 == 1, F.date_format(d, "d MMMM yyyy")).when(k % 5 == 2, F.date_format(d, "yyyy/MM/dd")).when(k % 5 == 3, F.date_format(d, "yyyy-MM-dd'T'HH:mm")).otherwise("May")
    return table(spark, sf, "orders").select(k, S.parse_date(x).alias("day"))


@query("c10_range_bounds", "SELECT DISTINCT o_orderdate::DATE::VARCHAR || 'T00:00:00+00:00' AS lo, o_orderdate::DATE::VARCHAR || 'T23:59:59+00:00' AS hi FROM orders")
def _(spark, sf):
    d = F.to_date("o_orderdate").cast("string")
    return table(spark, sf, "orders").select(S.range_bound(d).alias("lo"), S.range_bound(d, end_of_day=True).alias("hi")).distinct()


@query("c11_slugs", r"""WITH t AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type || ' é!'), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS s FROM part)
SELECT p_partkey, coalesce(nullif(rtrim(substr(s, 1, 20), '-'), ''), 'item') AS slug FROM t""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.slug(F.concat_ws(" ", "p_name", F.lit("/"), "p_type", F.lit("é!")), 20).alias("slug"))


@query("c12_hashes", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.sha256("text").alias("sha"))


@query("c13_cut_head", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '[...truncated...]' ELSE text END AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.cut_head("text", 500).alias("text"))


@query("c14_cut_middle", """SELECT doc_id, CASE WHEN length(text) > 501 THEN substr(text, 1, 400) || chr(10) || chr(10) || '[... ' || (length(text) - 501) || ' characters omitted from the middle ...]' || chr(10) || chr(10) || substr(text, length(text) - 100) ELSE text END AS text,
length(text) > 501 AS truncated FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.cut_middle("text", 501).alias("text"), (F.char_length("text") > 501).alias("truncated"))


@query("c18_token_estimates", "SELECT conv_id, turn, ceil(length(text) / 3.5)::BIGINT AS tokens FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.estimate_tokens("text").alias("tokens"))


@query("c19_rendered_posts", f"WITH {POSTS} SELECT post_id, '- (' || replace(class_label, '_', ' ') || ') ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM posts")
def _(spark, sf):
    return X.posts(spark, sf).select("post_id", S.render_post("class_label", "text").alias("line"))


@query("c23_publishers", """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'UNICEF' WHEN 1 THEN 'OCHA' WHEN 2 THEN 'IFRC' WHEN 3 THEN 'WFP' WHEN 4 THEN 'UNHCR' ELSE '' END AS source FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey") % 6
    name = F.when(k == 0, "2019_UNICEF_update.pdf").when(k == 2, "MDRMZ014.pdf").otherwise("report.pdf")
    text = F.when(k == 1, "by the Office for the Coordination of Humanitarian Affairs").when(k == 3, "The World Food Programme and UNICEF").when(k == 4, "unhcr said").otherwise("nothing")
    return table(spark, sf, "supplier").select("s_suppkey", S.infer_source(text, filename=name).alias("source"))


@query("c24_file_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 2 OR (o_orderkey % 8 < 6 AND o_orderdate >= DATE '2000-01-01' AND NOT (o_orderkey % 8 = 1 AND day(o_orderdate) = 20)) THEN o_orderdate::DATE::VARCHAR END AS day FROM orders")
def _(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    f = lambda p, *rest: F.concat(*(F.date_format(d, x) if i % 2 else F.lit(x) for i, x in enumerate((p, *rest))))
    name = (
        F.when(k % 8 == 0, f("ROSEA_", "yyyyMMdd", "_x.pdf")).when(k % 8 == 1, f("a/Flash_", "ddMMyyyy", ".pdf")).when(k % 8 == 2, f("Update ", "d MMMM yyyy", ".pdf"))
        .when(k % 8 == 3, f("Sit ", "yyyy-MM-dd", " rep.pdf")).when(k % 8 == 4, f("Storm ", "MMM d, yyyy", " v2.pdf")).when(k % 8 == 5, f("Storm-", "dd_MMM_yyyy", ".pdf"))
        .when(k % 8 == 6, "No date 12.pdf").otherwise("ROSEA_20191399_x.pdf")
    )
    return table(spark, sf, "orders").select(k, S.date_from_filename(name).alias("day"))


@query("c26_date_windows", """WITH w AS (SELECT event_type, min(ts::DATE) - 180 AS lo, max(ts::DATE) + 180 AS hi FROM events GROUP BY 1), d AS (SELECT o_orderkey, o_orderdate::DATE + 9000 AS day FROM orders)
SELECT event_type AS event, lo, hi FROM w""")
def _(spark, sf):
    from ..sources.ingest import date_windows

    return date_windows(table(spark, sf, "events").select(F.col("event_type").alias("event"), F.to_date("ts").alias("day")))


@query("c27_snowflakes", "SELECT event_id, CASE WHEN event_id % 10 > 0 THEN make_timestamp((((event_id * 1000003 + 1100000000000000000) >> 22) + 1288834974657) * 1000) END AS ts FROM events")
def _(spark, sf):
    i = F.col("event_id")
    post = F.when(i % 10 > 0, i * 1000003 + F.lit(1100000000000000000)).otherwise(i)
    return table(spark, sf, "events").select(i, S.snowflake_time(post).cast("timestamp_ntz").alias("ts"))


@query("c28_lenient_json", "SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k FROM events")
def _(spark, sf):
    i, p = F.col("event_id"), F.col("props")
    text = F.when(i % 5 == 0, p).when(i % 5 == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nDone."))).when(i % 5 == 2, F.concat(F.lit("I think "), p, F.lit(" fits."))).when(i % 5 == 3, F.concat(F.lit("  "), p, F.lit("\n"))).otherwise("no answer {")
    return table(spark, sf, "events").select(i, F.try_variant_get(S.lenient_json(text), "$.k", "bigint").alias("k"))


@query("c29_responses", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'invalid' WHEN 2 THEN 'refused' WHEN 3 THEN 'error' ELSE 'invalid' END AS status, CASE event_id % 5 WHEN 0 THEN 'partial' END AS verdict FROM events""")
def _(spark, sf):
    from ..operators.requests import parse_judgements

    i = F.col("event_id")
    none = F.lit(None).cast("string")
    text = F.when(i % 5 == 0, '{"verdict": " Partial", "confidence": 0.5}').when(i % 5 == 1, '{"verdict": "maybe"}').when(i % 5 == 4, "sorry")
    rows = table(spark, sf, "events").select(
        i.cast("string").alias("event"), F.lit("s").alias("sitrep_id"), F.lit("x").alias("slot_id"), text.alias("text"), (i % 5 == 2).alias("refused"),
        F.when(i % 5 == 3, "timeout").otherwise(none).alias("error"), F.lit("h").alias("request_hash"))
    return parse_judgements(rows).select(F.col("event").cast("long").alias("event_id"), "status", "verdict")


@query("c30_scores", "SELECT event_id, CASE WHEN event_id % 14 BETWEEN 1 AND 10 THEN (event_id % 14)::DOUBLE END AS score FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", S.score_in_range((F.col("event_id") % 14).cast("string")).alias("score"))


@query("c34_url_aliases", "SELECT page_id, trim(regexp_replace(url, '^https?://[^/]+', ''), '/') AS alias FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.url_alias("url").alias("alias"))


@query("c36_evidence_digests", "SELECT conv_id, turn, length(text) AS chars, substr(sha256(text), 1, 8) AS sha8 FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.evidence_digest("text").alias("d")).select("conv_id", "turn", "d.chars", "d.sha8")


@query("c37_viability", "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'excluded' WHEN count(*) >= 65 THEN 'usable' ELSE 'marginal' END AS verdict FROM events GROUP BY user_id")
def _(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", S.viability("n", F.col("user_id") % 3 != 0, 65).alias("verdict"))


@query("c39_epochs", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", S.to_epoch(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("t"))


@query("m14_prompts", """SELECT c_custkey, 'REPORT' || chr(10) || c_name || chr(10) || chr(10) || 'Score exactly this slot: ' || s.slot_id || ' | ' || s.name || ': ' || s.definition || chr(10) || 'Reply with JSON: {"verdict": ..., "evidence": ..., "confidence": ...}' AS u
FROM customer CROSS JOIN (VALUES ('S01', 'Deaths', 'People killed'), ('S02', 'Needs', 'What is needed')) s(slot_id, name, definition)""")
def _(spark, sf):
    from ..operators.requests import judge_requests

    slots = spark.createDataFrame([("S01", "Deaths", "People killed"), ("S02", "Needs", "What is needed")], "slot_id string, name string, definition string")
    docs = table(spark, sf, "customer").select(F.lit("e").alias("event"), F.col("c_custkey").cast("string").alias("sitrep_id"), F.col("c_name").alias("text"))
    return judge_requests(docs, slots, "tf").select(F.col("sitrep_id").cast("long").alias("c_custkey"), F.col("user").alias("u"))


@query("c20_open_codes", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 ELSE 0 END AS n_codes, CASE event_id % 3 WHEN 0 THEN 'death-toll' END AS name, CASE event_id % 3 WHEN 1 THEN 'missing ''codes'' array' WHEN 2 THEN 'no JSON' END AS problem FROM events""")
def _(spark, sf):
    from ..operators.requests import parse_codes

    i = F.col("event_id")
    text = F.when(i % 3 == 0, '{"codes": [{"name": "Death toll!", "confidence": "HIGH"}, {"name": " "}]}').when(i % 3 == 1, '{"other": 1}').otherwise("hm")
    rows = table(spark, sf, "events").select(i, text.alias("text"), F.lit(False).alias("refused"), F.lit(None).cast("string").alias("error"))
    return parse_codes(rows).select("event_id", F.size("codes").alias("n_codes"), F.get("codes", F.lit(0))["name"].alias("name"), "problem")
