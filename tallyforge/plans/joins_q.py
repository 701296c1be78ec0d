"""Queries of joins, ranking, sampling and orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as N
from ..operators import judgements as G
from ..operators import ranking as R
from ..session import table
from . import fixtures as X
from .fixtures import J, POSTS, REPORTS
from .registry import query


@query("d01_join_scores", """WITH s AS (SELECT * FROM (SELECT o_custkey AS id, o_totalprice AS completeness, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
SELECT c_custkey AS sitrep_id, round(c_acctbal, 6) AS metric, round(completeness, 6) AS completeness FROM customer JOIN s ON c_custkey = id""")
def _(spark, sf):
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("sitrep_id"), F.col("c_acctbal").alias("metric"))
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("sitrep_id"), F.col("o_totalprice").cast("string").alias("completeness"), F.col("o_orderkey").alias("_seq"))
    return N.join_scores(m, s)


@query("d04_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("d05_lookup_with_default", "SELECT s_suppkey, coalesce(n_name, 'unknown') AS n_name, coalesce(weight, 1.0)::DOUBLE AS weight FROM supplier LEFT JOIN (SELECT n_nationkey, n_name, 2.0 AS weight FROM nation WHERE n_nationkey % 2 = 0) n ON s_nationkey = n_nationkey")
def _(spark, sf):
    n = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.lit(2.0).alias("weight"))
    return table(spark, sf, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("n_name"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


_NEAREST = f"""WITH {REPORTS}, x AS (SELECT m.id, h.id AS ref_id, h.day - m.day AS gap, CASE WHEN h.day = m.day THEN 0 WHEN abs(h.day - m.day) <= 30 THEN 1 ELSE 2 END AS tier FROM m JOIN h USING (event)),
y AS (SELECT *, min(tier) OVER (PARTITION BY id) AS least FROM x WHERE tier <= {{top}}),
z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(gap), gap, ref_id) AS rank FROM y WHERE tier = least)
SELECT m.id, rank::INT AS rank, ref_id, gap::INT AS gap, CASE tier WHEN 0 THEN 'same_day' WHEN 1 THEN 'window' WHEN 2 THEN 'event' ELSE 'none' END AS rule FROM m LEFT JOIN (SELECT * FROM z WHERE rank <= 3) z USING (id)"""


@query("d06_nearest_references", _NEAREST.format(top=1))
def _(spark, sf):
    return N.nearest_references(X.reports(spark, sf, "machine"), X.reports(spark, sf, "human"), window_days=30)


@query("d06_nearest_with_fallback", _NEAREST.format(top=2))
def _(spark, sf):
    return N.nearest_references(X.reports(spark, sf, "machine"), X.reports(spark, sf, "human"), window_days=30, event_fallback=True)


@query("d09_source_availability", f"""WITH {POSTS}, v AS (SELECT event_id % 3 AS side, event_id % 20 AS doc, ts::DATE AS day, floor(value)::DOUBLE AS x FROM events),
m AS (SELECT doc, day, list_distinct(list(x)) AS m FROM v WHERE side = 0 GROUP BY ALL), h AS (SELECT day, list_distinct(list(x)) AS h FROM v WHERE side = 1 GROUP BY ALL), s AS (SELECT day, list_distinct(list(x)) AS s FROM v WHERE side = 2 GROUP BY ALL)
SELECT doc AS id, day, len(m)::INT AS n_machine_figures, round(len(list_intersect(m, s)) / len(m), 6) AS machine_figs_in_stream, round(len(list_intersect(m, h)) / len(m), 6) AS machine_figs_in_human,
round(len(list_intersect(h, s)) / len(h), 6) AS human_figs_in_stream FROM m JOIN h USING (day) JOIN s USING (day)""")
def _(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 3).alias("side"), (F.col("event_id") % 20).alias("id"), F.to_date("ts").alias("day"), F.floor("value").cast("double").alias("x"))
    of = lambda k, *by: e.filter(F.col("side") == k).groupBy(*by).agg(F.collect_set("x").alias("values"))
    return N.source_availability(of(0, "id", "day"), of(1, "day"), of(2, "day"))


@query("d10_document_slots", f"WITH {J} SELECT sitrep_id, kind, slot_id FROM (SELECT DISTINCT sitrep_id, kind FROM j) CROSS JOIN (SELECT DISTINCT slot_id FROM j)")
def _(spark, sf):
    j = X.judgements(spark, sf)
    return N.document_slots(j.select("sitrep_id", "kind").distinct(), j.select("slot_id").distinct()).select("sitrep_id", "kind", "slot_id")


@query("d11_jobs", "SELECT day, model, arm FROM (SELECT DISTINCT ts::DATE AS day FROM events) CROSS JOIN (VALUES ('m1'), ('m2')) a(model) CROSS JOIN (VALUES ('generic'), ('schema_guided')) b(arm)")
def _(spark, sf):
    days = table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    return days.withColumn("model", F.explode(F.array(F.lit("m1"), F.lit("m2")))).withColumn("arm", F.explode(F.array(F.lit("generic"), F.lit("schema_guided"))))


@query("d12_presence_split", """WITH o AS (SELECT event_id, ts::DATE AS day, floor(value) AS v FROM events WHERE event_id % 2 = 0), s AS (SELECT DISTINCT ts::DATE AS day, floor(value) AS v FROM events WHERE event_id % 2 = 1)
SELECT event_id, EXISTS (SELECT 1 FROM s WHERE s.day = o.day AND s.v = o.v) AS present FROM o""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), F.floor("value").alias("v"))
    here, gone = N.split_by_presence(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ("day", "v"))
    return here.select("event_id", F.lit(True).alias("present")).unionByName(gone.select("event_id", F.lit(False).alias("present")))


_TERMS = """t AS (SELECT doc_id AS id, lang, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9''-]{2,}'), lambda w: w NOT IN
('and', 'are', 'but', 'for', 'from', 'has', 'have', 'into', 'its', 'not', 'of', 'on', 'or', 'that', 'the', 'their', 'there', 'this', 'to', 'was', 'were', 'which', 'with'))) AS terms FROM documents)"""


@query("d13_top_similar", f"""WITH {_TERMS}, x AS (SELECT l.id, l.lang, r.id AS candidate, CASE WHEN len(l.terms) > 0 AND len(r.terms) > 0 THEN len(list_intersect(l.terms, r.terms)) / (len(l.terms) + len(r.terms) - len(list_intersect(l.terms, r.terms))) ELSE 0.0 END AS s
  FROM t l JOIN t r USING (lang) WHERE l.id % 50 = 0 AND r.id <> l.id)
SELECT id, candidate, round(s, 6) AS similarity, row_number() OVER (PARTITION BY id ORDER BY s DESC, candidate)::INT AS rank FROM x QUALIFY rank <= 3""")
def _(spark, sf):
    from pyspark.sql import Window

    from ..functions.textops import audit_terms

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", audit_terms(F.col("text")).alias("terms"))
    best = N.top_similar(d.filter("id % 50 = 0"), d, ("lang",), k=4).filter("id <> candidate")  # one of the four may be the document itself
    return best.select("id", "candidate", "similarity", F.row_number().over(Window.partitionBy("id").orderBy("rank")).alias("rank")).filter("rank <= 3")


@query("d16_bulk_lookup", "SELECT page_id, n_name FROM (SELECT page_id, (page_id % 40)::INT AS k FROM pages) LEFT JOIN nation ON k = n_nationkey")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return table(spark, sf, "pages").select("page_id", (F.col("page_id") % 40).cast("int").alias("k")).join(n, "k", "left").select("page_id", "n_name")


@query("d17_in_window", """WITH w AS (SELECT event_type AS event, min(ts::DATE) + 5 AS lo, max(ts::DATE) - 5 AS hi FROM events GROUP BY 1)
SELECT event_id, event_type AS event, ts::DATE AS day FROM events JOIN w ON event = event_type WHERE ts::DATE BETWEEN lo AND hi""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("event"), F.to_date("ts").alias("day"))
    w = e.groupBy("event").agg(F.date_add(F.min("day"), 5).alias("first_day"), F.date_sub(F.max("day"), 5).alias("last_day"))
    return N.in_window(e, w)


@query("d18_best_name", """WITH q AS (SELECT DISTINCT lower(replace(n_name, '_', ' ')) || ' x' AS query FROM nation), c AS (SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_name FROM nation),
t AS (SELECT query, list_distinct(regexp_extract_all(query, '[a-z0-9]+')) AS q FROM q), u AS (SELECT id, name, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS c FROM c)
SELECT query, name, round(len(list_intersect(q, c)) / len(q), 6) AS score FROM t CROSS JOIN u QUALIFY row_number() OVER (PARTITION BY query ORDER BY len(list_intersect(q, c)) / len(q) DESC, id) = 1""")
def _(spark, sf):
    q = table(spark, sf, "nation").select(F.concat(F.replace(F.lower("n_name"), F.lit("_"), F.lit(" ")), F.lit(" x")).alias("query")).distinct()
    c = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).unionByName(table(spark, sf, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("name")))
    return N.best_name(c, q)


@query("d19_report_manifest", """WITH r AS (SELECT doc_id AS file, sha256(text) AS sha, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents), i AS (SELECT doc_id AS file, CASE WHEN doc_id % 7 = 0 THEN '' ELSE '2019-01-01' END AS date FROM documents WHERE doc_id % 3 > 0)
SELECT r.file, r.sha, CASE WHEN i.date <> '' THEN 'admitted' WHEN i.date = '' THEN 'undated' WHEN copy > 1 THEN 'duplicate' ELSE 'not ingested' END AS reason FROM r LEFT JOIN i USING (file)""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    raw = d.select(F.col("doc_id").alias("file"), S.sha256("text").alias("sha"))
    done = d.filter("doc_id % 3 > 0").select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 7 == 0, "").otherwise("2019-01-01").alias("date"))
    return N.report_manifest(raw, done)


@query("a23_page_of_reports", "SELECT o_orderkey AS id, o_orderdate::DATE::VARCHAR AS date FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT' AND o_orderdate::DATE::VARCHAR >= '1996-01-01' AND o_orderdate::DATE::VARCHAR <= '1997-12-31' ORDER BY date, id LIMIT 50 OFFSET 20")
def _(spark, sf):
    from ..sources.readers import fetch

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("format"), F.col("o_orderpriority").alias("source"), F.to_date("o_orderdate").cast("string").alias("date"))
    return fetch(o, formats=["F", "O"], sources=["1-URGENT"], date_from="1996-01-01", date_to="1997-12-31", fields=["id", "date"], limit=50, offset=20)


@query("a24_name_search", "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) LIKE '%nation_1%' ORDER BY n_name LIMIT 20")
def _(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return n.filter(F.lower("n_name").contains("nation_1")).orderBy("n_name").limit(20)


@query("a30_admitted", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf, "documents").select("doc_id").join(good, "doc_id", "left_semi")


@query("a05_text_by_day", f"WITH {POSTS} SELECT day, sha256(string_agg(text, chr(10) ORDER BY post_id, text)) AS digest FROM posts GROUP BY day")
def _(spark, sf):
    from ..sources.readers import text_by_day

    return text_by_day(X.posts(spark, sf), ("day",), "post_id").select("day", S.sha256("text").alias("digest"))


@query("e21_stream_statistics", f"""WITH {POSTS}, d AS (SELECT day, count(*) AS n FROM posts GROUP BY day)
SELECT (SELECT count(*) FROM posts) AS n_posts, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day, max(n) AS max_per_day, list_sort(list(n))[len(list(n)) // 2 + 1] AS upper_median FROM d""")
def _(spark, sf):
    d = X.posts(spark, sf).groupBy("day").agg(F.count("*").alias("n"))
    return d.agg(F.sum("n").alias("n_posts"), F.count("*").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max("n").alias("max_per_day"), R.upper_median("n").cast("long").alias("upper_median"))


@query("e22_day_buckets", f"WITH {POSTS} SELECT day, class_label, count(*) AS n_posts FROM posts GROUP BY ALL")
def _(spark, sf):
    return X.posts(spark, sf).groupBy("day", "class_label").agg(F.count("*").alias("n_posts"))


@query("h06_event_days", f"WITH {POSTS} SELECT day, count(*) AS n_posts FROM posts GROUP BY day HAVING count(*) >= 335")
def _(spark, sf):
    return R.event_days(X.posts(spark, sf), "day", 335)


_QUOTA = f"""{POSTS}, c AS (SELECT day, class_label, count(*) AS n FROM posts GROUP BY ALL),
q0 AS (SELECT *, sum(n) OVER w AS total, count(*) OVER w AS k, CASE WHEN {{cap}} >= count(*) OVER w THEN 1 ELSE 0 END AS base FROM c WINDOW w AS (PARTITION BY day)),
q1 AS (SELECT *, n - base AS rest, {{cap}} - base * k AS lft, sum(n - base) OVER (PARTITION BY day) AS pool FROM q0),
q2 AS (SELECT *, rest * lft / nullif(pool, 0)::DOUBLE AS exact FROM q1), q3 AS (SELECT *, least(floor(exact), rest)::BIGINT AS take FROM q2),
q4 AS (SELECT *, lft - sum(take) OVER (PARTITION BY day) AS more, n > base + take AS room FROM q3),
q AS (SELECT day, class_label, n, (CASE WHEN total <= {{cap}} THEN n ELSE base + take + (room AND row_number() OVER (PARTITION BY day, room ORDER BY exact - floor(exact) DESC, n DESC, class_label) <= more)::INT END)::BIGINT AS quota FROM q4)"""


@query("l01_quotas", "WITH " + _QUOTA.format(cap=40) + " SELECT * FROM q")
def _(spark, sf):
    counts = X.posts(spark, sf).groupBy("day", "class_label").agg(F.count("*").alias("n"))
    return R.quotas(counts, 40, "class_label", ("day",))


@query("l02_day_sample", "WITH " + _QUOTA.format(cap=37) + """, r AS (SELECT post_id, day, class_label, row_number() OVER (PARTITION BY day, class_label ORDER BY md5(concat_ws('|', '17', day::VARCHAR, post_id::VARCHAR)), post_id) AS rn FROM posts)
SELECT post_id, day, class_label FROM r JOIN q USING (day, class_label) WHERE rn <= quota""")
def _(spark, sf):
    return R.stratified_sample(X.posts(spark, sf), 37, "class_label", "post_id", ("day",)).select("post_id", "day", "class_label")


@query("l06_long_documents", "SELECT doc_id, lang FROM documents WHERE length(text) > 6000 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '17', lang, doc_id::VARCHAR)), doc_id) <= 4")
def _(spark, sf):
    long = table(spark, sf, "documents").filter(F.char_length("text") > 6000)
    return R.sample_per_stratum(long, {x: 4 for x in ("en", "fr", "de", "es")}, "lang", "doc_id").select("doc_id", "lang")


@query("g07_phases", """WITH d AS (SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts::DATE END AS day FROM events), s AS (SELECT event_type, min(day) AS lo, max(day) - min(day) + 1 AS span FROM d GROUP BY 1)
SELECT event_id, CASE WHEN day IS NULL THEN 'unknown' ELSE ['early', 'mid', 'late'][least(2, (day - lo) * 3 // span) + 1] END AS phase FROM d JOIN s USING (event_type)""")
def _(spark, sf):
    d = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 9 != 0, F.to_date("ts")).alias("day"))
    return R.assign_phase(d, "day", "event_type").select("event_id", "phase")


@query("g09_file_names", """WITH d AS (SELECT o_orderkey AS _seq, o_orderstatus AS event, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderdate::DATE::VARCHAR END AS date FROM orders)
SELECT _seq, CASE WHEN row_number() OVER w = 1 THEN x ELSE x || '_' || row_number() OVER w END AS stem FROM (SELECT *, coalesce(nullif(date, ''), 'undated') AS x FROM d) WINDOW w AS (PARTITION BY event, date ORDER BY _seq)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_seq"), F.col("o_orderstatus").alias("event"), F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.to_date("o_orderdate").cast("string")).alias("date"))
    return R.file_names(o).select("_seq", "stem")


@query("g10_spread_points", """WITH d AS (SELECT s_suppkey AS id, (s_nationkey % 5)::DOUBLE AS x, (s_nationkey % 3)::DOUBLE AS y FROM supplier), c AS (SELECT *, count(*) OVER (PARTITION BY x, y) AS n, row_number() OVER (PARTITION BY x, y ORDER BY id) - 1 AS a FROM d),
e AS (SELECT *, least(5, ceil(sqrt(n)))::INT AS k FROM c)
SELECT id, round(CASE WHEN n > 1 THEN x + (a % k - (least(k, n - a // k * k) - 1) / 2.0) * 0.08 ELSE x END, 6) AS spread_x, round(CASE WHEN n > 1 THEN y + a // k * 0.012 ELSE y END, 6) AS spread_y FROM e""")
def _(spark, sf):
    d = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).cast("double").alias("x"), (F.col("s_nationkey") % 3).cast("double").alias("y"))
    return R.spread_duplicates(d, "x", "y", "id").select("id", "spread_x", "spread_y")


@query("g11_chunks", f"""WITH RECURSIVE {POSTS}, s AS (SELECT day, post_id, row_number() OVER (PARTITION BY day ORDER BY post_id) - 1 AS place,
  ceil(length('- (' || replace(class_label, '_', ' ') || ') ' || trim(regexp_replace(text, '\\s+', ' ', 'g'))) / 3.5)::BIGINT + 1 AS cost FROM posts),
r(day, post_id, place, used, chunk) AS (SELECT day, post_id, place, cost, 0 FROM s WHERE place = 0 UNION ALL
  SELECT s.day, s.post_id, s.place, CASE WHEN used + cost > 500 THEN cost ELSE used + cost END, chunk + (used + cost > 500)::INT FROM r JOIN s ON s.day = r.day AND s.place = r.place + 1)
SELECT day, place::INT AS place, post_id, chunk::INT AS chunk FROM r""")
def _(spark, sf):
    from ..functions.scalars import estimate_tokens, render_post

    p = X.posts(spark, sf).withColumn("cost", estimate_tokens(render_post("class_label", "text")) + 1)
    return R.chunk_posts(p, ("day",), ("post_id",), "cost", 500)


@query("g12_stratum_order", f"""WITH {J}, c AS (SELECT event, slot_id, count(*) AS n FROM p GROUP BY ALL), d AS (SELECT *, sum(n) OVER (PARTITION BY event) AS ld, row_number() OVER (PARTITION BY event ORDER BY n DESC, slot_id) AS depth FROM c)
SELECT event, slot_id, row_number() OVER (ORDER BY depth, ld DESC, event) AS visit FROM d""")
def _(spark, sf):
    from pyspark.sql import Window

    c = X.population(spark, sf).groupBy("event", "slot_id").agg(F.count("*").alias("n"))
    c = R.numbered(c.withColumn("ld", F.sum("n").over(Window.partitionBy("event"))), ["event"], [F.desc("n"), "slot_id"], "depth")
    return c.withColumn("visit", F.row_number().over(Window.orderBy("depth", F.desc("ld"), "event")).cast("long")).select("event", "slot_id", "visit")


@query("h01_post_order", f"WITH {POSTS} SELECT post_id, row_number() OVER (PARTITION BY day ORDER BY text, post_id) AS place FROM posts")
def _(spark, sf):
    return R.numbered(X.posts(spark, sf), ["day"], ["text", "post_id"], "place").select("post_id", F.col("place").cast("long").alias("place"))


@query("h03_report_order", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 10 = 0 THEN '9999' ELSE o_orderdate::DATE::VARCHAR END,
CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 4 END, o_orderkey) AS place FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    date = F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate").cast("string"))
    kind = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(4)
    return R.numbered(o, ["o_custkey"], [F.coalesce(date, F.lit("9999")), kind, "o_orderkey"], "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("h07_index_order", """WITH e AS (SELECT event_type AS event, count(*) AS n FROM events WHERE value > 150 GROUP BY 1), v AS (SELECT event, n, CASE WHEN n >= 25 THEN 'usable' ELSE 'marginal' END AS verdict FROM e)
SELECT event, n, verdict, row_number() OVER (ORDER BY CASE verdict WHEN 'usable' THEN 0 ELSE 1 END, n DESC, event) AS place FROM v""")
def _(spark, sf):
    e = table(spark, sf, "events").filter("value > 150").groupBy(F.col("event_type").alias("event")).agg(F.count("*").alias("n"))
    v = e.withColumn("verdict", S.viability("n", F.lit(True), 25)).withColumn("all", F.lit(1))
    return R.numbered(v, ["all"], [F.when(F.col("verdict") == "usable", 0).otherwise(1), F.desc("n"), "event"], "place").select("event", "n", "verdict", F.col("place").cast("long").alias("place"))


@query("i01_union", "SELECT doc_id AS id, 'documents' AS split FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("split"))
    return d.unionByName(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("split")))


@query("i02_intersection", f"WITH {J} SELECT sitrep_id, slot_id FROM p WHERE judge = 'j0' INTERSECT SELECT sitrep_id, slot_id FROM p WHERE judge = 'j1'")
def _(spark, sf):
    p = X.population(spark, sf)
    return p.filter("judge = 'j0'").select("sitrep_id", "slot_id").intersect(p.filter("judge = 'j1'").select("sitrep_id", "slot_id"))


@query("i03_difference", f"WITH {J} SELECT event, sitrep_id, slot_id FROM p WHERE judge = 'j0' EXCEPT SELECT event, sitrep_id, slot_id FROM p WHERE judge = 'j1'")
def _(spark, sf):
    p = X.population(spark, sf)
    return p.filter("judge = 'j0'").select("event", "sitrep_id", "slot_id").exceptAll(p.filter("judge = 'j1'").select("event", "sitrep_id", "slot_id"))


@query("i04_set_algebra", f"""WITH {_TERMS} SELECT a.id, len(list_intersect(a.terms, b.terms))::INT AS common, len(list_distinct(list_concat(a.terms, b.terms)))::INT AS either, len(list_filter(a.terms, lambda x: NOT list_contains(b.terms, x)))::INT AS only_a
FROM t a JOIN t b ON b.id = a.id + 1""")
def _(spark, sf):
    from ..functions.textops import audit_terms

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), audit_terms(F.col("text")).alias("a"))
    b = d.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return d.join(b, "id").select("id", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_except("a", "b")).alias("only_a"))


@query("b06_merge_manifest", """WITH o AS (SELECT event_id % 50 AS file, 'old' AS event, min(ts::DATE)::VARCHAR AS date FROM events GROUP BY 1), n AS (SELECT file, 'new' AS event, date FROM (SELECT event_id % 30 + 40 AS file, ts::DATE::VARCHAR AS date, row_number() OVER (PARTITION BY event_id % 30 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE file NOT IN (SELECT file FROM n)""")
def _(spark, sf):
    from ..sources.sinks import merge_manifest

    e = table(spark, sf, "events")
    day = F.to_date("ts").cast("string")
    old = e.groupBy((F.col("event_id") % 50).alias("file")).agg(F.lit("old").alias("event"), F.min(day).alias("date"))
    new = e.select((F.col("event_id") % 30 + 40).alias("file"), F.lit("new").alias("event"), day.alias("date"), F.col("event_id").alias("_seq"))
    return merge_manifest(old, new)


@query("b15_export_manifest", "SELECT 'nation' AS name, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'labels', count(*) FROM labels")
def _(spark, sf):
    from ..sources.sinks import export_manifest

    return export_manifest({n: table(spark, sf, n) for n in ("nation", "region", "labels")}).select("name", "n_rows")


@query("b14_heatmap", f"WITH {J} SELECT slot_id, round(avg(score) FILTER (WHERE arm = 'human'), 6) AS human, round(avg(score) FILTER (WHERE arm = 'm0'), 6) AS m0, round(avg(score) FILTER (WHERE arm = 'm1'), 6) AS m1 FROM p GROUP BY slot_id")
def _(spark, sf):
    return G.coverage(X.population(spark, sf), ("slot_id", "arm")).groupBy("slot_id").pivot("arm", ["human", "m0", "m1"]).agg(F.first("coverage"))


@query("e33_cost_estimate", """WITH c AS (SELECT 'tf-' || role AS model, text FROM conversations), p(prefix, i, o) AS (VALUES ('tf-', 1.0, 5.0), ('tf-user', 2.0, 10.0))
SELECT model, count(*) AS n_requests, sum(ceil(length('Be brief.') / 3.5) + ceil(length(text) / 3.5))::BIGINT AS input_tokens,
round(sum(((ceil(length('Be brief.') / 3.5) + ceil(length(text) / 3.5)) * i + 100 * o) / 1e6), 6) AS usd FROM c JOIN p ON starts_with(model, prefix) WHERE NOT EXISTS (SELECT 1 FROM p p2 WHERE starts_with(model, p2.prefix) AND length(p2.prefix) > length(p.prefix)) GROUP BY model""")
def _(spark, sf):
    from ..operators.requests import estimate

    prices = spark.createDataFrame([("tf-", 1.0, 5.0), ("tf-user", 2.0, 10.0)], "prefix string, usd_in double, usd_out double")
    c = table(spark, sf, "conversations").select(F.concat(F.lit("tf-"), "role").alias("model"), F.lit("Be brief.").alias("system"), F.col("text").alias("user"), F.lit(100).alias("max_tokens"))
    return estimate(c, prices)


@query("e30_log_totals", """WITH g AS (SELECT event_type AS model, 't' || event_id % 3 AS tag, CASE WHEN event_id % 10 = 0 THEN 'pending' ELSE 'api' END AS mode, (event_id % 100)::BIGINT AS i, (event_id % 7)::BIGINT AS o, value, event_id % 4 = 0 AS cached FROM events)
SELECT CASE WHEN grouping(model) = 1 AND grouping(tag) = 1 THEN 'all' WHEN grouping(model) = 0 THEN 'model:' || model ELSE 'tag:' || tag END AS scope, count(*) AS n_calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens,
round(sum(value), 6) AS usd, count(*) FILTER (WHERE cached) AS n_cached FROM g WHERE mode <> 'pending' GROUP BY GROUPING SETS ((), (model), (tag))""")
def _(spark, sf):
    from ..operators.requests import log_totals

    i = F.col("event_id")
    e = table(spark, sf, "events")
    return log_totals(e.select(F.col("event_type").alias("model"), F.concat(F.lit("t"), (i % 3).cast("string")).alias("tag"), F.when(i % 10 == 0, "pending").otherwise("api").alias("mode"), (i % 100).alias("input_tokens"), (i % 7).alias("output_tokens"), F.col("value").alias("usd"), (i % 4 == 0).alias("cached")))


@query("m05_prices", """WITH m AS (SELECT DISTINCT 'tf-' || role || '-' || turn AS model FROM conversations), p(prefix, usd_in, usd_out) AS (VALUES ('tf-', 1.0, 5.0), ('tf-user', 2.0, 10.0), ('tf-user-2', 3.0, 4.0), ('other', 9.0, 9.0))
SELECT model, max_by(prefix, length(prefix)) AS price_prefix, max_by(usd_in, length(prefix))::DOUBLE AS usd_in, max_by(usd_out, length(prefix))::DOUBLE AS usd_out FROM m LEFT JOIN p ON starts_with(model, prefix) GROUP BY model""")
def _(spark, sf):
    from ..operators.requests import price

    prices = spark.createDataFrame([("tf-", 1.0, 5.0), ("tf-user", 2.0, 10.0), ("tf-user-2", 3.0, 4.0), ("other", 9.0, 9.0)], "prefix string, usd_in double, usd_out double")
    m = table(spark, sf, "conversations").select(F.concat_ws("-", F.lit("tf"), "role", "turn").alias("model")).distinct()
    return price(m, prices)


@query("m10_offline_answers", "SELECT conv_id, turn, 'FAKE:' || substr(sha256(text), 1, 8) AS answer FROM conversations")
def _(spark, sf):
    from ..operators.requests import offline_text

    return table(spark, sf, "conversations").select("conv_id", "turn", offline_text(F.col("text")).alias("answer"))


@query("m02_run_with_cache", "SELECT conv_id, turn, 'FAKE:' || substr(sha256(text), 1, 8) AS text, conv_id % 2 = 0 AND first AS cached FROM (SELECT *, true AS first FROM conversations)")
def _(spark, sf):
    from ..operators.requests import cacheable, offline_provider, run

    c = table(spark, sf, "conversations").select("conv_id", "turn", F.lit("tf").alias("model"), F.concat(F.lit("s"), "conv_id", "turn").alias("system"), F.col("text").alias("user"), F.lit(10).alias("max_tokens"))
    cache = cacheable(run(c.filter("conv_id % 2 = 0"), offline_provider()))
    return run(c, offline_provider(), cache).select("conv_id", "turn", "text", "cached")


@query("m16_resume", f"WITH {J} SELECT DISTINCT sitrep_id, slot_id FROM j WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.sitrep_id = j.sitrep_id AND p.slot_id = j.slot_id AND p.judge = 'j0' AND p.event = 'e0')")
def _(spark, sf):
    from ..operators.requests import unfinished

    rows = X.judgements(spark, sf)
    done = G.population(rows).filter("judge = 'j0' AND event = 'e0'")
    return unfinished(rows.select("sitrep_id", "slot_id").distinct(), done, ("sitrep_id", "slot_id"))


