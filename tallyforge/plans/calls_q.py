"""Queries of model calls, providers, stages and small orderings."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import calls as C
from ..operators import judgements as G
from ..operators import providers as P
from ..operators import ranking as R
from ..operators import requests as M
from ..operators import stats as Q
from ..session import scratch, table
from . import fixtures as X
from .fixtures import J
from .registry import example, query


def _answer(request: dict) -> dict:
    """The offline answer: a digest of the prompt, and counts by its length."""
    return {"text": "FAKE:" + hashlib.sha256(request["user"].encode()).hexdigest()[:8], "stop_reason": "end", "input_tokens": len(request["user"]), "output_tokens": 13}


def _calls(spark, **how):
    prices = spark.createDataFrame([("fake", 1.0, 5.0)], "prefix string, usd_in double, usd_out double")
    return C.Calls(spark, scratch(spark, "calls"), {"fake": _answer}, prices=prices, limit_usd=1e9, **how)


def _requests(spark, sf):
    c = table(spark, sf, "conversations").filter("text IS NOT NULL")
    return c.select("conv_id", "turn", F.lit("fake-1").alias("model"), F.lit("s").alias("system"), F.col("text").alias("user"), F.lit(20).alias("max_tokens"))


_FAKE = "'FAKE:' || substr(sha256(text), 1, 8)"
_USD = "round((length(text) + 13 * 5) / 1e6, 6)"


@query("m01_completions", f"SELECT conv_id, turn, {_FAKE} AS text, {_USD} AS cost_usd, false AS cached FROM conversations WHERE text IS NOT NULL")
def _(spark, sf):
    return _calls(spark).complete_many(_requests(spark, sf)).select("conv_id", "turn", "text", "cost_usd", "cached")


@query("m08_cached_completions", f"SELECT conv_id, turn, {_FAKE} AS text, text IN (SELECT text FROM conversations WHERE conv_id % 2 = 0) AS cached FROM conversations WHERE text IS NOT NULL")
def _(spark, sf):
    calls, requests = _calls(spark), _requests(spark, sf)
    calls.complete_many(requests.filter("conv_id % 2 = 0"))
    return calls.complete_many(requests).select("conv_id", "turn", "text", "cached")


@query("m06_settled_budget", """WITH t AS (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL) SELECT round(sum((length(text) + 13 * 5) / 1e6), 6) AS spent, 0.0::DOUBLE AS reserved, true AS refused FROM t""")
def _(spark, sf):
    calls, requests = _calls(spark), _requests(spark, sf)
    calls.complete_many(requests)
    calls.budget.limit, refused = calls.budget.spent, False
    try:
        calls.complete_many(requests.withColumn("user", F.concat("user", F.lit("!"))))
    except C.CostLimitError:
        refused = True
    return spark.createDataFrame([(calls.budget.spent, abs(calls.budget.reserved), refused)], "spent double, reserved double, refused boolean")


@query("m03_batches", f"SELECT conv_id, turn, {_FAKE} AS text FROM conversations WHERE text IS NOT NULL")
def _(spark, sf):
    calls, requests = _calls(spark), _requests(spark, sf)
    batch = calls.submit(requests)
    half = lambda rows: calls._called(rows.filter("pmod(xxhash64(request_hash), 2) = 0"))
    calls.poll(batch, half)
    calls.poll(batch)
    return calls.attach(requests).select("conv_id", "turn", "text")


@query("m03_batch_states", "SELECT 'done' AS state, count(DISTINCT text) AS n FROM conversations WHERE text IS NOT NULL")
def _(spark, sf):
    calls = _calls(spark)
    return spark.createDataFrame(list(calls.poll(calls.submit(_requests(spark, sf))).items()), "state string, n long")


@query("m04_dispatch", f"SELECT conv_id, turn, {_FAKE} AS text FROM conversations WHERE text IS NOT NULL")
def _(spark, sf):
    calls, requests = _calls(spark), _requests(spark, sf)
    calls.run(requests.filter("turn = 0"))
    return calls.run(requests, batch=True).select("conv_id", "turn", "text")


@example("m07_attempts", "SELECT r_regionkey, least(r_regionkey + 1, 4) AS attempts, CASE WHEN r_regionkey < 4 THEN 'ok' END AS text, r_regionkey >= 4 AS failed FROM region")
def _(spark, sf):
    rows = []
    for (k,) in table(spark, sf, "region").select("r_regionkey").collect():  # five rows
        left = [k]

        def flaky(request, left=left):
            left[0] -= 1
            if left[0] >= 0:
                raise C.TransientError("busy")
            return {"text": "ok"}

        got = C.attempt(flaky, {}, 4, 0.0, lambda s: None)
        rows.append((k, got["attempts"], got["text"], got["error"] is not None))
    return spark.createDataFrame(rows, "r_regionkey int, attempts int, text string, failed boolean")


@example("m09_models", "SELECT * FROM (VALUES ('judge', 'anthropic', 'claude-x'), ('strong', 'openrouter', 'v/m-1'), ('gpt-x', 'openai', 'gpt-x'), ('o1', 'openai', 'o1'), ('deepseek-x', 'deepseek', 'deepseek-x'), ('fake', 'fake', 'fake'), ('coder', NULL, NULL), ('other', NULL, NULL)) t(name, provider, id)")
def _(spark, sf):
    models = {"judge": {"id": "claude-x"}, "coder": {"id": "SET_ME"}, "generation": [{"name": "strong", "id": "v/m-1"}]}
    rows = []
    for name in ("judge", "strong", "gpt-x", "o1", "deepseek-x", "fake", "coder", "other"):
        try:
            spec = C.resolve_model(name, models)
            rows.append((name, spec.provider, spec.id))
        except C.ConfigError:
            rows.append((name, None, None))
    return spark.createDataFrame(rows, "name string, provider string, id string")


_RECORD = "n_nationkey long, text string, stop_reason string, refused boolean, input_tokens long, output_tokens long, cache_read_tokens long"


def _records(spark, sf, name, answer):
    """A provider's record for each nation, over a transport that answers in its wire format."""
    import os

    for key in P.WIRES[name].key_names[:1]:
        os.environ.setdefault(key, "none")
    rows = []
    for k, n in table(spark, sf, "nation").select("n_nationkey", "n_name").collect():  # 25 rows
        got = P.provider(name, lambda url, headers, body, k=k: (200, answer(k, body)))({"model_id": "m", "system": "s", "user": n, "max_tokens": 9})
        rows.append((k, *(got[c] for c in ("text", "stop_reason", "refused", "input_tokens", "output_tokens", "cache_read_tokens"))))
    return spark.createDataFrame(rows, _RECORD)


_RECORDS = "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey % 5 > 0 THEN '<' || n_name || '>' END AS text, CASE n_nationkey % 5 WHEN 0 THEN 'refusal' WHEN 1 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason, n_nationkey % 5 = 0 AS refused, n_nationkey::BIGINT AS input_tokens, 7::BIGINT AS output_tokens, 3::BIGINT AS cache_read_tokens FROM nation"


@example("m11_messages", _RECORDS)
def _(spark, sf):
    stop = lambda k: "refusal" if k % 5 == 0 else "max_tokens" if k % 5 == 1 else "end_turn"
    said = lambda body: f"<{body['messages'][0]['content']}>"
    return _records(spark, sf, "anthropic", lambda k, body: {"stop_reason": stop(k), "content": [{"type": "text", "text": said(body)}], "usage": {"input_tokens": k, "output_tokens": 7, "cache_read_input_tokens": 3}})


def _chat(k, body):
    finish = "content_filter" if k % 5 == 0 else "length" if k % 5 == 1 else "stop"
    return {"choices": [{"message": {"content": f"<{body['messages'][-1]['content']}>"}, "finish_reason": finish}], "usage": {"prompt_tokens": k + 3, "completion_tokens": 7, "prompt_tokens_details": {"cached_tokens": 3}}}


@example("m12_chat_completions", " UNION ALL ".join([_RECORDS] * 3))
def _(spark, sf):
    found = [_records(spark, sf, name, _chat) for name in ("openai", "deepseek", "openrouter")]
    return found[0].union(found[1]).union(found[2])


@example("m13_normalised_records", "SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 1 THEN 't' || r_regionkey END AS text, r_regionkey % 2 = 0 AS refused, 0::BIGINT AS output_tokens FROM region")
def _(spark, sf):
    rows = [(k, C.normalised({"text": f"t{k}", "stop_reason": "refusal" if k % 2 == 0 else None})) for (k,) in table(spark, sf, "region").select("r_regionkey").collect()]  # five rows
    return spark.createDataFrame([(k, r["text"], r["refused"], r["output_tokens"]) for k, r in rows], "r_regionkey int, text string, refused boolean, output_tokens long")


_HEAD = "'Below are ' || {n} || ' posts of ' || day || '.' || chr(10) || chr(10) || 'Write a situation report for this day.' || chr(10) || chr(10) || {posts}"


@query("m15_map_reduce", f"""WITH c AS (SELECT ts::DATE::VARCHAR AS day, (event_id % (1 + day(ts) % 3))::INT AS chunk, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS posts FROM events GROUP BY ALL),
a AS (SELECT *, 'FAKE:' || substr(sha256({_HEAD.format(n="n", posts="posts")}), 1, 8) AS answer FROM c), d AS (SELECT day, count(*) AS n_chunks, sum(n)::BIGINT AS n, string_agg(answer, chr(10) || chr(10) ORDER BY chunk) AS digests FROM a GROUP BY day)
SELECT day, n_chunks, CASE WHEN n_chunks = 1 THEN digests ELSE 'FAKE:' || substr(sha256({_HEAD.format(n="n", posts="digests")}), 1, 8) END AS report FROM d""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    chunk = (F.col("event_id") % (1 + F.dayofmonth("day") % 3)).cast("int")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])  # a chunk of a day
    days = e.groupBy(F.lit("e").alias("event"), F.col("day").cast("string").alias("day"), chunk.alias("chunk")).agg(F.count("*").alias("n_posts"), F.array_join(listed, ",").alias("posts"))
    return M.map_reduce(days, M.offline_provider(), "tf").select("day", "n_chunks", "report")


@query("m17_statistic", f"WITH {J}, d AS (SELECT arm, sitrep_id, avg(score) AS c FROM p GROUP BY ALL) SELECT arm, count(*) AS n, round(max(c), 6) AS point, true AS inside FROM d GROUP BY arm")
def _(spark, sf):
    docs = X.population(spark, sf).groupBy("arm", "sitrep_id").agg(F.avg("score").alias("c"))
    got = Q.grouped_bootstrap(docs, "c", "sitrep_id", ("arm",), n_boot=50, statistic=max)
    return got.select("arm", "n", "point", ((F.col("ci_lo") <= F.col("ci_hi")) & (F.col("ci_hi") <= F.col("point"))).alias("inside"))


@example("m18_rate_and_quota", "SELECT unnest(range(5)) AS call, unnest([0.0, 1.0, 1.0, 1.0, NULL]::DOUBLE[]) AS waited")
def _(spark, sf):
    from ..sources.paged import RateLimit

    waits, rows = [], []
    limit = RateLimit(1.0, 4, clock=lambda: float(len(waits)), sleep=waits.append)
    for call in range(5):
        before = len(waits)
        try:
            limit.wait()
            rows.append((call, float(sum(waits[before:]))))
        except RuntimeError:
            rows.append((call, None))
    return spark.createDataFrame(rows, "call long, waited double")


@example("n01_stages", "SELECT * FROM (VALUES (0, 'induce', true), (1, 'freeze', true), (2, 'judge', false)) t(place, stage, ran)")
def _(spark, sf):
    from .publication import CheckpointRequired, run_stages

    ran: list[str] = []
    stages = [(n, lambda n=n: ran.append(n)) for n in ("induce", "freeze", "judge")]
    try:
        run_stages(stages, approved=lambda: False, after="freeze")
    except CheckpointRequired:
        pass
    return spark.createDataFrame([(i, n, n in ran) for i, (n, _) in enumerate(stages)], "place int, stage string, ran boolean")


@query("n04_cost_command", "SELECT count(*)::VARCHAR || ' requests, ' || printf('%.2f', sum((ceil(length('Be brief.') / 3.5) + ceil(length(text) / 3.5) + 100 * 5.0) / 1e6)) || ' USD projected of 0.00: over the limit' AS line FROM conversations WHERE text IS NOT NULL")
def _(spark, sf):
    import contextlib
    import io

    from ..__main__ import main

    requests, prices, out = scratch(spark, "requests"), scratch(spark, "prices"), io.StringIO()
    c = table(spark, sf, "conversations").filter("text IS NOT NULL")
    c.select(F.lit("tf-1").alias("model"), F.lit("Be brief.").alias("system"), F.col("text").alias("user"), F.lit(100).alias("max_tokens")).write.json(requests)
    spark.createDataFrame([("tf", 1.0, 5.0)], "prefix string, usd_in double, usd_out double").write.option("header", True).csv(prices)
    with contextlib.redirect_stdout(out):
        main(["cost", requests, prices, "--limit", "0"])
    return spark.createDataFrame([(line,) for line in out.getvalue().splitlines() if "projected" in line and "requests" in line], "line string")


@example("n05_grid", "SELECT * FROM (SELECT 'key  name' AS line, 0::BIGINT AS at UNION ALL SELECT '---  ' || repeat('-', (SELECT max(length(r_name)) FROM region)::INT), 1 UNION ALL SELECT rpad(r_regionkey::VARCHAR, 3, ' ') || '  ' || r_name, r_regionkey + 2 FROM region)")
def _(spark, sf):
    from .reports import grid

    text = grid(table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).orderBy("key"))
    return spark.createDataFrame(list(zip(text.splitlines(), range(99), strict=False)), "line string, at long")


@query("g03_completeness_rank", f"WITH {J}, d AS (SELECT event, sitrep_id, avg(score) AS c FROM p GROUP BY ALL) SELECT event, sitrep_id, row_number() OVER (PARTITION BY event ORDER BY c DESC, sitrep_id)::INT AS rank FROM d")
def _(spark, sf):
    docs = G.document_scores(X.population(spark, sf), ("event", "sitrep_id"))
    return R.numbered(docs, ["event"], [F.desc("completeness"), "sitrep_id"], "rank").select("event", "sitrep_id", "rank")


@query("h02_sample_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts::DATE, event_id)::INT AS place FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return R.numbered(e, ["user_id"], ["event_type", "day", "event_id"], "place").select("event_id", "place")


@query("c31_code_rows", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'refused' WHEN 2 THEN 'no usable codes in reply' END AS problem, CASE WHEN event_id % 5 > 2 THEN 'low' END AS confidence FROM events")
def _(spark, sf):
    i = F.col("event_id")
    text = F.when(i % 5 == 2, '{"codes": [{"name": "  "}]}').when(i % 5 > 2, 'so: {"codes": [{"name": "A", "confidence": "Low"}]}')
    rows = table(spark, sf, "events").select(i, text.alias("text"), (i % 5 == 1).alias("refused"), F.when(i % 5 == 0, "timeout").alias("error"))
    got = M.parse_codes(rows)
    return got.select("event_id", "problem", F.get("codes", F.lit(0))["confidence"].alias("confidence"))
