"""Queries of text extraction, similarity, HTML and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import textops as J
from ..operators import conventions as V
from ..operators import joins as N
from ..operators import similarity as K
from ..operators.ranges import written
from ..session import table
from . import fixtures as X
from .fixtures import FOUND, TEXTS
from .registry import query


@query("x_report_texts", f"WITH {TEXTS} SELECT id, day, event, kind, sha256(text) AS digest FROM texts")
def _(spark, sf):
    return X.report_texts(spark, sf).select("id", "day", "event", "kind", S.sha256("text").alias("digest"))


@query("j01_figures", f"""WITH {TEXTS}, f AS (SELECT id, unnest([{{'v': (id % 9000 + 1000)::DOUBLE, 'u': 'count', 'k': 'quantity', 'w': 'affected'}}, {{'v': (id % 97)::DOUBLE, 'u': 'percent', 'k': 'quantity', 'w': 'destroyed'}},
{{'v': p::DOUBLE, 'u': 'count', 'k': 'casualty', 'w': 'died'}}, {{'v': (1000000 + (id % 9 + 1) * 100000)::DOUBLE, 'u': 'count', 'k': 'quantity', 'w': 'displaced'}}]) AS f
FROM (SELECT texts.*, o_custkey % 50 AS p FROM texts JOIN orders ON o_orderkey = id)) SELECT id, round(f.v, 6) AS value, f.u AS unit, f.k AS kind, f.w AS keyword FROM f""")
def _(spark, sf):
    rows = J.spread(X.report_texts(spark, sf).select("id", "text"), "id").select("id", F.explode(J.figures(F.col("text"))).alias("f"))
    return rows.select("id", "f.value", "f.unit", "f.kind", "f.keyword")


def _spans(spark, sf, family):
    rows = J.spread(X.report_texts(spark, sf).select("id", "text"), "id").select("id", J.spans(F.col("text"), family).alias("s"))
    labels = F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["label"]), ", "), F.lit("]"))
    return rows.select("id", F.size("s").cast("long").alias("n"), labels.alias("labels"))


@query("j05_attribution", f"WITH {FOUND} SELECT id, len(sourcing) AS n, sourcing::VARCHAR AS labels FROM found")
def _(spark, sf):
    return _spans(spark, sf, "attribution")


@query("j05_agencies", f"WITH {FOUND} SELECT id, len(agencies) AS n, agencies::VARCHAR AS labels FROM found")
def _(spark, sf):
    return _spans(spark, sf, "agency")


@query("j06_hedges", f"WITH {FOUND} SELECT id, len(hedges) AS n, hedges::VARCHAR AS labels FROM found")
def _(spark, sf):
    return _spans(spark, sf, "hedge")


@query("j07_as_of", f"WITH {FOUND} SELECT id, as_of::INT AS n FROM found")
def _(spark, sf):
    return X.report_texts(spark, sf).select("id", J.as_of_count(F.col("text")).alias("n"))


@query("j08_revisions", f"WITH {FOUND} SELECT id, len(revisions) AS n, revisions::VARCHAR AS labels FROM found")
def _(spark, sf):
    return _spans(spark, sf, "revision")


@query("j10_tokens", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\r\\n]+'))::INT AS n FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", J.token_count(F.col("text")).alias("n"))


def _stats(spark, sf):
    return V.text_statistics(X.report_texts(spark, sf), terms=False)


_COUNTS = """n_chars, n_tokens, len(sourcing) AS sourcing_phrases, len(agencies) AS agency_mentions, len(sourcing) + len(agencies) AS sourcing_cues, len(hedges) AS hedges, len(list_distinct(hedges)) AS hedge_types, as_of AS as_of_dates,
len(revisions) AS revision_markers, as_of + len(revisions) AS update_markers, n_figures, n_sourced AS n_figures_with_source"""


@query("j12_text_statistics", f"WITH {FOUND} SELECT id, {_COUNTS} FROM found")
def _(spark, sf):
    return _stats(spark, sf).drop("event")


@query("e18_corpus_total", f"WITH {FOUND}, c AS (SELECT event, {_COUNTS} FROM found) SELECT coalesce(event, 'ALL') AS event, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in J.COUNTS) + ", round(sum(n_figures_with_source) / sum(n_figures), 6) AS figure_with_source_rate FROM c GROUP BY GROUPING SETS ((event), ())")
def _(spark, sf):
    return V.totals(_stats(spark, sf))


@query("e19_term_counts", f"""WITH {FOUND}, x AS (SELECT unnest(list_concat(list_transform(sourcing, lambda x: 'sourcing:' || x), list_transform(agencies, lambda x: 'agency:' || x), list_transform(hedges, lambda x: 'hedge:' || x),
list_transform(revisions, lambda x: 'update:' || x), list_transform(range(as_of), lambda x: 'update:as_of_date'))) AS term FROM found) SELECT term, count(*) AS n FROM x GROUP BY term""")
def _(spark, sf):
    return V.corpus_terms(X.report_texts(spark, sf))


@query("j13_contexts", f"WITH {TEXTS} SELECT id, trim(regexp_replace(substr(text, 1, 200), '\\s+', ' ', 'g')) AS context FROM texts")
def _(spark, sf):
    return X.report_texts(spark, sf).select("id", J.context(F.col("text"), F.lit(10), F.lit(20)).alias("context"))


@query("j14_lexical_tokens", """WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'of')) AS w FROM documents)
SELECT doc_id, len(w)::INT + greatest(len(w)::INT - 1, 0) AS n, md5(array_to_string(list_concat(w, list_transform(range(1, greatest(len(w)::INT, 1)), lambda i: w[i] || '_' || w[i + 1])), ' ')) AS digest FROM t""")
def _(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", J.lexical_tokens(F.col("text"), ("the", "of")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("j15_audit_terms", """SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9''-]{2,}'), lambda w: w NOT IN
('and', 'are', 'but', 'for', 'from', 'has', 'have', 'into', 'its', 'not', 'of', 'on', 'or', 'that', 'the', 'their', 'there', 'this', 'to', 'was', 'were', 'which', 'with')))), ' ')) AS digest FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(F.array_sort(J.audit_terms(F.col("text"))), " ")).alias("digest"))


def _figures(spark, sf):
    r = J.spread(X.report_texts(spark, sf), "id").select("id", "event", "day", "kind", J.figures(F.col("text")).alias("figures"))
    r = written(r, "figures")  # both sides read the figures, which are extracted once
    return r.filter("kind = 'machine'").drop("kind"), r.filter("kind = 'human'").drop("kind")


_FIG = f"""WITH {TEXTS}, f AS (SELECT id, event, day, kind, unnest([{{'u': 'c', 'v': (id % 9000 + 1000)::DOUBLE, 'k': 0}}, {{'u': 'p', 'v': (id % 97)::DOUBLE, 'k': 0}}, {{'u': 'c', 'v': (o_custkey % 50)::DOUBLE, 'k': 1}}, {{'u': 'c', 'v': (1000000 + (id % 9 + 1) * 100000)::DOUBLE, 'k': 0}}]) AS f
  FROM texts JOIN orders ON o_orderkey = id), m AS (SELECT DISTINCT id, event, day, f.u AS u, f.v AS v FROM f WHERE kind = 'machine'), h AS (SELECT event, day, f.u AS u, f.v AS v, max(f.k) AS k FROM f WHERE kind = 'human' GROUP BY ALL)"""


@query("d08_figure_check", _FIG + """, d AS (SELECT DISTINCT m.id, event, day FROM m JOIN (SELECT DISTINCT event, day FROM h) USING (event, day)), nm AS (SELECT id, count(*) AS n FROM m GROUP BY id), nh AS (SELECT event, day, count(*) AS n, sum(k) AS c FROM h GROUP BY ALL),
o AS (SELECT m.id, count(*) AS n, sum(h.k) AS c FROM m JOIN h ON m.event = h.event AND m.day = h.day AND m.u = h.u AND m.v = h.v GROUP BY m.id)
SELECT d.id, nm.n AS n_machine_unique, nh.n AS n_human_unique, coalesce(o.n, 0) AS n_overlap, round(coalesce(o.n, 0) / nm.n, 6) AS precision, round(coalesce(o.n, 0) / nh.n, 6) AS recall, round(coalesce(o.c, 0) / nullif(nh.c, 0), 6) AS casualty_recall,
round(coalesce(o.n, 0) / (nm.n + nh.n - coalesce(o.n, 0)), 6) AS jaccard FROM d JOIN nm ON nm.id = d.id JOIN nh ON nh.event = d.event AND nh.day = d.day LEFT JOIN o ON o.id = d.id""")
def _(spark, sf):
    machine, h = _figures(spark, sf)
    return N.figure_check(machine, h, order=("id",)).select("id", "n_machine_unique", "n_human_unique", "n_overlap", "precision", "recall", "casualty_recall", "jaccard")


@query("e24_grounding", _FIG + """, d AS (SELECT DISTINCT m.id, event, day FROM m JOIN (SELECT DISTINCT event, day FROM h) USING (event, day)), nm AS (SELECT id, count(*) AS n FROM m GROUP BY id),
o AS (SELECT m.id, count(*) AS n FROM m JOIN h ON m.event = h.event AND m.day = h.day AND m.u = h.u AND m.v = h.v GROUP BY m.id)
SELECT coalesce(event, 'POOLED') AS event, count(*) AS n_pairs, round(avg(coalesce(o.n, 0) / nm.n), 6) AS precision FROM d JOIN nm ON nm.id = d.id LEFT JOIN o ON o.id = d.id GROUP BY GROUPING SETS ((event), ())""")
def _(spark, sf):
    from ..operators.judgements import with_totals

    machine, h = _figures(spark, sf)
    return with_totals(N.figure_check(machine, h, order=("id",)), "event", "POOLED", {"n_pairs": F.count("*"), "precision": F.avg("precision")})


@query("c32_headings", r"""WITH h AS (SELECT doc_id, regexp_extract(substr(coalesce(text, ''), 1, 60), '^[^\n]*') AS head FROM documents)
SELECT doc_id, trim(regexp_replace(lower(head), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(regexp_replace(string_split(head, '**')[1], '^\s*\d+[.)]\s*', '')), '[^a-z0-9]+', ' ', 'g')) AS b FROM h""")
def _(spark, sf):
    k = F.col("doc_id") % 9 + 1
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract(F.substring(F.coalesce("text", F.lit("")), 1, 60), r"^[^\n]*", 0).alias("head"))
    numbered = F.concat(F.repeat(F.lit("#"), (k % 6 + 1).cast("int")), F.lit(" "), k.cast("string"), F.lit(". "), "head", F.lit(" [S0"), k.cast("string"), F.lit("]"))
    bold = F.regexp_extract(F.concat(F.lit("  **"), "head", F.lit("**: more")), r"^\s*\*\*(.*?)\*\*", 1)
    return d.select("doc_id", J.normal_heading(numbered).alias("a"), J.normal_heading(bold).alias("b"))


#: A section of the first words of each document, quoted, under a line that says nothing for every other one.
@query("c33_content_scores", r"""WITH b AS (SELECT doc_id, array_to_string(string_split(replace(coalesce(text, ''), chr(10), ' '), ' ')[1:doc_id % 14], ' ') AS said FROM documents),
w AS (SELECT *, doc_id % 7 = 3 AS silent, len(regexp_extract_all(said, '[A-Za-z][A-Za-z''-]*')) AS n FROM b)
SELECT doc_id, CASE WHEN silent THEN 0.0 WHEN n >= 8 THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM w""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), " ", -1)
    said = F.array_join(F.slice(words, F.lit(1), (F.col("doc_id") % 14).cast("int")), " ")
    body = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("No data were sent\n> ")).otherwise(F.lit("- ")), F.when(F.col("doc_id") % 7 == 3, F.lit("Not reported so far")).otherwise(said))
    return d.select("doc_id", J.content_score(body).alias("score"))


@query("g08_sections", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos::INT AS first_line, (coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), (SELECT count(*) FROM l l2 WHERE l2.doc_id = l.doc_id)) - pos)::INT AS n_lines FROM l WHERE length(line) < 40""")
def _(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.size(F.split("text", "\n", -1)).alias("total"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.char_length("line") < 40)
    w = Window.partitionBy("doc_id").orderBy("pos")
    return lines.select("doc_id", F.col("pos").alias("first_line"), (F.coalesce(F.lead("pos").over(w), "total") - F.col("pos")).alias("n_lines"))


_TFIDF = """WITH t AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1) AS w FROM documents),
k AS (SELECT id, unnest(list_concat(w, list_transform(range(1, greatest(len(w)::INT, 1)), lambda i: w[i] || '_' || w[i + 1]))) AS term FROM t), f AS (SELECT id, term, count(*) AS tf FROM k GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term), r AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM t)) / (1.0 + df)) + 1) AS w FROM f JOIN d USING (term)), n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM r GROUP BY id)
SELECT id, term, round(w / norm, 6) AS weight FROM r JOIN n USING (id)"""


@query("k01_tfidf", _TFIDF)
def _(spark, sf):
    return K.tfidf(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("k03_cosine_distances", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) AS ab,
sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x))) AS n FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT label, a, b, round(1 - ab / n, 6) AS distance FROM p""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return K.cosine_pairs(e, "label")


@query("k04_clusters")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("topic"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return K.cluster(e, 0.6, "topic").select("topic", "id", "label")


@query("k03_near_pairs", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) AS ab,
sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x))) AS n FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT label, a, b, round(1 - ab / n, 6) AS distance FROM p WHERE 1 - ab / n < 0.45""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return K.pairs_below(e, 0.45, "label")


#: Five vectors in the order of their ids are a text, and their labels the tokens; a text is compared with the next and the one after.
@query("k07_token_alignment", """WITH t AS (SELECT vec_id // 5 AS g, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), w AS (SELECT label, ln((1.0 + (SELECT count(DISTINCT g) FROM t)) / (1.0 + count(DISTINCT g))) AS w FROM t GROUP BY label),
u AS (SELECT g, vec_id, w, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM t JOIN w USING (label)), c AS (SELECT a.g AS id, b.g AS ref, a.vec_id AS i, b.vec_id AS j, a.w AS wi, b.w AS wj, list_sum(list_transform(range(1, 65), lambda k: a.v[k] * b.v[k])) / (a.n * b.n) AS s FROM u a JOIN u b ON b.g IN (a.g + 1, a.g + 2)),
p AS (SELECT id, ref, sum(s * wi) / sum(wi) AS p FROM (SELECT id, ref, i, any_value(wi) AS wi, max(s) AS s FROM c GROUP BY ALL) GROUP BY ALL), r AS (SELECT id, ref, sum(s * wj) / sum(wj) AS r FROM (SELECT id, ref, j, any_value(wj) AS wj, max(s) AS s FROM c GROUP BY ALL) GROUP BY ALL),
f AS (SELECT id, ref, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM p JOIN r USING (id, ref)) SELECT id, ref, round(p, 6) AS align_p, round(r, 6) AS align_r, round(f, 6) AS align_f1 FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY f DESC, ref) = 1""")
def _(spark, sf):
    t = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("g"), "vec_id", "label", "embedding")
    rows = t.join(K.token_idf(t, "g", "label"), "label").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("vec_id", "idf", "embedding"))).alias("x"))
    side = lambda g, v, w: rows.select(F.col("g").alias(g), F.transform("x", lambda e: e["embedding"]).alias(v), F.transform("x", lambda e: e["idf"]).alias(w))
    pairs = side("id", "candidate", "cw").withColumn("ref", F.explode(F.array(F.col("id") + 1, F.col("id") + 2))).join(side("ref", "reference", "rw"), "ref")
    return K.best_alignment(K.align_tokens(pairs, weights=("cw", "rw")), ("id",), "ref").select("id", "ref", "align_p", "align_r", "align_f1")


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate"))
    return a.join(u, ["conv_id", "turn"])


#: The longest common subsequence by rows of its table: a row is the running maximum of what its word adds to the one before.
@query("k06_rouge", """WITH RECURSIVE x AS (SELECT a.conv_id, u.turn, a.text AS said, regexp_extract_all(lower(coalesce(a.text, '')), '[a-z0-9]+') AS c, regexp_extract_all(lower(coalesce(u.text, '')), '[a-z0-9]+') AS r
  FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.role = 'assistant' AND u.role = 'user' AND u.turn = a.turn - 1),
l(conv_id, turn, c, r, i, line) AS (SELECT conv_id, turn, c, r, 0, list_transform(r, lambda w: 0) FROM x UNION ALL
  SELECT conv_id, turn, c, r, i + 1, list_transform(range(1, len(r) + 1), lambda j: list_max(part[1:j])) FROM
    (SELECT *, list_transform(range(1, len(r) + 1), lambda j: CASE WHEN r[j] = c[i + 1] THEN (CASE WHEN j = 1 THEN 0 ELSE line[j - 1] END) + 1 ELSE line[j] END) AS part FROM l WHERE i < len(c))),
n AS (SELECT conv_id, turn, len(c) AS nc, len(r) AS nr, coalesce(line[len(line)], 0) AS n FROM l WHERE i = len(c))
SELECT conv_id, turn, CASE WHEN nc > 0 AND nr > 0 THEN round(n / nc, 6) ELSE 0.0 END AS rouge_l_p, CASE WHEN nc > 0 AND nr > 0 THEN round(n / nr, 6) ELSE 0.0 END AS rouge_l_r, CASE WHEN n > 0 THEN round(2.0 * n / (nc + nr), 6) ELSE 0.0 END AS rouge_l_f FROM n""")
def _(spark, sf):
    return K.add_rouge(_turns(spark, sf), stem=False).select("conv_id", "turn", "rouge_l_p", "rouge_l_r", "rouge_l_f")


@query("x_rouge_stemmed")
def _(spark, sf):
    return K.add_rouge(_turns(spark, sf)).select("conv_id", "turn", "rouge_l_p", "rouge_l_r", "rouge_l_f")


@query("k08_jaccard", """WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9''-]{2,}'), lambda w: w NOT IN
('and', 'are', 'but', 'for', 'from', 'has', 'have', 'into', 'its', 'not', 'of', 'on', 'or', 'that', 'the', 'their', 'there', 'this', 'to', 'was', 'were', 'which', 'with'))) AS t FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) ELSE 0.0 END, 6) AS jaccard FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def _(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", J.audit_terms(F.col("text")).alias("t"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", N.jaccard(F.col("t"), F.col("u")).alias("jaccard"))


@query("x_page_texts")
def _(spark, sf):
    from ..sources.html import page

    return J.spread(table(spark, sf, "pages").select("page_id", "html"), "page_id").select("page_id", page(F.col("html")).alias("p")).select("page_id", "p.title", "p.date", "p.url", F.char_length("p.text").alias("chars"), S.sha256("p.text").alias("digest"))


@query("n03_ingest", """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '2024-01-10' WHEN doc_id % 4 = 1 THEN '10 January 2024' WHEN doc_id % 4 = 2 THEN '1999-01-01' ELSE '' END AS d, text FROM documents),
n AS (SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN '2024-01-10' END AS date, regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '', '') AS folded, text FROM t),
s AS (SELECT *, length(text) < 200 AS short FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY short, coalesce(date, ''), folded ORDER BY doc_id) AS rn FROM s)
SELECT doc_id AS _seq, date, CASE WHEN short THEN 'short' WHEN rn > 1 THEN 'copy' ELSE '' END AS reason FROM r""")
def _(spark, sf):
    from ..sources.ingest import date_windows, ingest

    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    date = F.when(k % 4 == 0, "2024-01-10").when(k % 4 == 1, "10 January 2024").when(k % 4 == 2, "1999-01-01").otherwise("")
    file = F.concat(F.lit("f"), k.cast("string"), F.lit(".txt"))
    none = F.lit("")
    manifest = d.select(k.alias("_seq"), F.lit("Storm One").alias("event"), none.alias("title"), none.alias("source"), date.alias("date"), none.alias("url"), file.alias("file"))
    texts = d.select(file.alias("file"), "text", F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("title"))
    windows = date_windows(table(spark, sf, "events").select(F.lit("storm-one").alias("event"), F.to_date("ts").alias("day")))
    out = ingest(manifest, texts, windows)
    reason = F.when(F.col("reason").startswith("text too short"), "short").when(F.col("reason").startswith("duplicate content"), "copy").otherwise(F.col("reason"))
    return out.select("_seq", "date", reason.alias("reason"))
