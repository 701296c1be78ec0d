"""Requests to external models as tables: hashing, cache, price, gate, offline provider, resume.

A provider is a function over a pandas frame of requests. The deterministic offline provider is the only
one here; network providers plug in at the same place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import estimate_tokens, lenient_json, response_status, score_in_range, slug

RESPONSE = "request_hash string, text string, refused boolean, error string, input_tokens long, output_tokens long"
CACHE_READ, CACHE_WRITE = 0.10, 1.25


def request_hash(model="model", system="system", user="user", max_tokens="max_tokens") -> Column:
    """The identity of a request: SHA-256 of its sorted JSON."""
    parts = {"max_tokens": max_tokens, "model": model, "system": system, "user": user}
    return F.sha2(F.to_json(F.struct(*(F.col(c).alias(n) for n, c in sorted(parts.items()))), {"ignoreNullFields": "false"}), 256)


def price(requests: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Prices by the longest prefix of the model id; unknown models keep nulls.

    prices has prefix, usd_in and usd_out (a million tokens); every prefix of an id is looked up by equality.
    """
    models = requests.select(F.col(model).alias("__m")).distinct()
    lengths = F.sequence(F.lit(1), F.greatest(F.char_length("__m"), F.lit(1)))
    tries = models.withColumn("prefix", F.explode(F.transform(lengths, lambda n: F.substring("__m", 1, n))))
    best = tries.join(prices, "prefix").groupBy("__m").agg(F.max_by(F.struct("prefix", "usd_in", "usd_out"), F.char_length("prefix")).alias("p"))
    return requests.join(best, F.col(model) == F.col("__m"), "left").drop("__m").withColumns({"price_prefix": F.col("p.prefix"), "usd_in": F.col("p.usd_in"), "usd_out": F.col("p.usd_out")}).drop("p")


def cost(input_tokens, output_tokens, cache_read=0, cache_write=0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return (lit(input_tokens) * F.col("usd_in") + lit(cache_read) * CACHE_READ * F.col("usd_in") + lit(cache_write) * CACHE_WRITE * F.col("usd_in") + lit(output_tokens) * F.col("usd_out")) / 1e6


def estimate(requests: DataFrame, prices: DataFrame, unknown_usd: float = 1.0) -> DataFrame:
    """Requests and projected cost of each model; an unknown price counts ``unknown_usd`` a request."""
    priced = price(requests, prices)
    tokens = estimate_tokens("system") + estimate_tokens("user")
    one = F.coalesce(cost(tokens, F.col("max_tokens")), F.lit(unknown_usd))
    return priced.groupBy("model").agg(F.count("*").alias("n_requests"), F.sum(tokens).alias("input_tokens"), F.sum(one).alias("usd"))


class CostLimitError(RuntimeError):
    """The projected cost exceeds what is left."""


@dataclass
class Budget:
    """Admission by reservation: reserve before a call, settle with the real cost after it."""

    limit: float
    spent: float = 0.0
    reserved: float = 0.0

    def reserve(self, usd: float) -> None:
        if self.spent + self.reserved + usd > self.limit:
            raise CostLimitError(f"{usd:.4f} USD projected, {self.limit - self.spent - self.reserved:.4f} left")
        self.reserved += usd

    def settle(self, projected: float, real: float) -> None:
        self.reserved -= projected
        self.spent += real

    def release(self, projected: float) -> None:
        self.reserved -= projected


def gate(estimates: DataFrame, budget: Budget) -> float:
    """Reserves the sum of the estimates (a row a model) or raises before anything is sent."""
    total = estimates.agg(F.coalesce(F.sum("usd"), F.lit(0.0))).first()[0]
    budget.reserve(total)
    return total


def offline_text(user) -> Column:
    """What the offline provider answers: a digest of the prompt."""
    return F.concat(F.lit("FAKE:"), F.substring(F.sha2(user, 256), 1, 8))


def offline_provider(responder: Callable[[str, str], str] | None = None, refuse: str = "[[REFUSE]]"):
    """A provider without a network: refuses prompts with a mark, else answers by responder(system, user)."""
    import hashlib

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        answer = responder or (lambda system, user: "FAKE:" + hashlib.sha256(user.encode()).hexdigest()[:8])
        refused = rows["user"].str.contains(refuse, regex=False)
        text = [None if r else answer(s, u) for r, s, u in zip(refused, rows["system"], rows["user"], strict=True)]
        size = lambda s: (s.str.len() * 2 + 6) // 7
        return pd.DataFrame({"request_hash": rows["request_hash"], "text": text, "refused": refused, "error": None, "input_tokens": size(rows["user"]) + size(rows["system"]), "output_tokens": [0 if t is None else (len(t) * 2 + 6) // 7 for t in text]})

    return call


def run(requests: DataFrame, provider, cache: DataFrame | None = None, retries: int = 2) -> DataFrame:
    """A response for every request: the cache first, then one call for each distinct hash.

    Calls run in Arrow batches on the executors; a call that raises is repeated and then recorded as an
    error. Refusals and errors are no cache entries. Input columns stay, with the response's after them.
    """
    hashed = requests.withColumn("request_hash", request_hash())
    distinct = hashed.groupBy("request_hash").agg(F.first("system").alias("system"), F.first("user").alias("user"), F.first("model").alias("model"))
    known = None
    if cache is not None:
        known = cache.select("request_hash", "text", "refused", "error", "input_tokens", "output_tokens")
        distinct = distinct.join(known.select("request_hash"), "request_hash", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for attempt in range(retries + 1):
                try:
                    yield provider(rows)
                    break
                except Exception as problem:  # noqa: BLE001
                    if attempt == retries:
                        n = len(rows)
                        yield pd.DataFrame({"request_hash": rows["request_hash"], "text": [None] * n, "refused": [False] * n, "error": [str(problem)[:200]] * n, "input_tokens": [0] * n, "output_tokens": [0] * n})

    fresh = distinct.mapInPandas(call, RESPONSE).withColumn("cached", F.lit(False))
    answers = fresh if known is None else fresh.unionByName(known.withColumn("cached", F.lit(True)))
    return hashed.join(answers, "request_hash", "left")


def cacheable(responses: DataFrame) -> DataFrame:
    return responses.filter("error IS NULL AND NOT refused AND NOT cached").dropDuplicates(["request_hash"])


def log_totals(log: DataFrame) -> DataFrame:
    """Calls, tokens and cost over all, by model and by tag; pending rows are left out."""
    done = log.filter("mode <> 'pending'")
    sets = done.groupingSets([[], ["model"], ["tag"]], "model", "tag")
    return sets.agg(F.grouping_id().alias("gid"), F.count("*").alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("usd").alias("usd"), F.count_if("cached").alias("n_cached")).select(
        F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, F.concat(F.lit("model:"), F.col("model"))).otherwise(F.concat(F.lit("tag:"), F.col("tag"))).alias("scope"),
        "n_calls", "input_tokens", "output_tokens", "usd", "n_cached",
    )


def batches(requests: DataFrame, size: int = 10_000) -> DataFrame:
    """Distinct requests in chunks by hash range, as a table of states for batch mode."""
    distinct = requests.withColumn("request_hash", request_hash()).groupBy("request_hash").agg(F.count("*").alias("n_copies"))
    n = distinct.count()
    chunks = max(1, -(-n // size))
    place = F.conv(F.substring("request_hash", 1, 8), 16, 10).cast("long")
    return distinct.withColumn("chunk", F.floor(place * chunks / F.lit(1 << 32)).cast("int")).withColumn("state", F.lit("pending"))


def advance(table: DataFrame, results: DataFrame) -> DataFrame:
    """The state table after results arrived: done or failed by hash, the others as they were."""
    got = results.select("request_hash", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("new"))
    return table.join(got, "request_hash", "left").withColumn("state", F.coalesce("new", "state")).drop("new")


def unfinished(requests: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Resume: what no finished result covers."""
    return requests.join(done.select(*keys).distinct(), list(keys), "left_anti")


# Prompts and replies.

REPORT_SYSTEM = "You write situation reports from the material you are given."


def judge_user(text="text", slot_id="slot_id", name="name", definition="definition") -> Column:
    return F.concat_ws("\n", F.lit("REPORT"), F.col(text), F.lit(""), F.concat(F.lit("Score exactly this slot: "), F.col(slot_id), F.lit(" | "), F.col(name), F.lit(": "), F.col(definition)), F.lit('Reply with JSON: {"verdict": ..., "evidence": ..., "confidence": ...}'))


def report_user(posts: str = "posts", n: str = "n_posts", day: str = "day", guidance: Column | None = None) -> Column:
    head = F.concat(F.lit("Below are "), F.col(n).cast("string"), F.lit(" posts of "), F.col(day).cast("string"), F.lit("."))
    return F.concat_ws("\n\n", head, guidance if guidance is not None else F.lit("Write a situation report for this day."), F.col(posts))


def judge_requests(documents: DataFrame, slots: DataFrame, model: str, max_tokens: int = 512) -> DataFrame:
    """One request for each document and slot."""
    pairs = documents.join(slots, how="cross")  # a schema of a few dozen slots; Spark broadcasts them when their size allows it
    return pairs.select("event", "sitrep_id", "slot_id", F.lit(model).alias("model"), F.lit("You judge reports.").alias("system"), judge_user().alias("user"), F.lit(max_tokens).alias("max_tokens"))


def parse_judgements(responses: DataFrame) -> DataFrame:
    """Status ok, invalid, refused or error with the verdict, evidence digest and confidence."""
    parsed = responses.withColumn("j", lenient_json("text"))
    verdict = F.lower(F.trim(F.try_variant_get("j", "$.verdict", "string")))
    rows = parsed.withColumn("said", verdict).withColumn("status", response_status("error", F.coalesce("refused", F.lit(False)), "j", "said"))
    confidence = F.try_variant_get("j", "$.confidence", "double")
    return rows.select("event", "sitrep_id", "slot_id", F.when(F.col("status") == "ok", F.col("said")).alias("verdict"), F.when(F.col("status") == "ok", confidence).alias("confidence"), "status", "request_hash")


def parse_scores(responses: DataFrame) -> DataFrame:
    j = lenient_json("text")
    return responses.select("*", score_in_range(F.try_variant_get(j, "$.score", "string")).alias("score"))


def parse_codes(responses: DataFrame, max_quote: int = 300) -> DataFrame:
    """Open codes of each reply, normalised, with an error where there are none."""
    kind = "array<struct<name:string,definition:string,evidence_quote:string,location:string,confidence:string>>"
    j = lenient_json("text")
    raw = F.try_variant_get(j, "$.codes", kind)
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    codes = F.transform(
        F.filter(F.coalesce(raw, F.array().cast(kind)), lambda c: blank(c["name"]) != ""),
        lambda c: F.struct(
            slug(blank(c["name"]), 60).alias("name"), blank(c["name"]).alias("raw_name"), blank(c["definition"]).alias("definition"),
            F.substring(blank(c["evidence_quote"]), 1, max_quote).alias("evidence_quote"), F.coalesce(F.nullif(blank(c["location"]), F.lit("")), F.lit("unspecified")).alias("location"),
            F.when(F.lower(blank(c["confidence"])).isin("low", "medium", "high"), F.lower(blank(c["confidence"]))).otherwise("unknown").alias("confidence"),
        ),
    )
    rows = responses.withColumn("codes", codes)
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("refused", F.lit(False)), "refused").when(j.isNull(), "no JSON").when(raw.isNull(), "missing 'codes' array").when(F.size("codes") == 0, "no usable codes in reply")
    return rows.withColumn("problem", problem)


def map_reduce(days: DataFrame, provider, model: str, max_tokens: int = 2000) -> DataFrame:
    """Two rounds: a digest of every chunk of a day, then a report from the day's digests.

    days has event, day, chunk, n_posts and posts. A day with one chunk is answered at once; a day of
    which a chunk failed gives no report.
    """
    base = lambda df: df.withColumn("model", F.lit(model)).withColumn("system", F.lit(REPORT_SYSTEM)).withColumn("max_tokens", F.lit(max_tokens))
    first = run(base(days.withColumn("user", report_user())), provider)
    good = F.col("text").isNotNull() & F.col("error").isNull()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(good, F.struct("chunk", "text")))), lambda x: x["text"]), "\n\n")
    by_day = first.groupBy("event", "day").agg(F.count("*").alias("n_chunks"), F.count_if(good).alias("n_good"), F.sum("n_posts").alias("n_posts"), joined.alias("digests"))
    whole = by_day.filter("n_chunks = n_good")
    single = whole.filter("n_chunks = 1").select("event", "day", "n_chunks", F.col("digests").alias("report"))
    many = run(base(whole.filter("n_chunks > 1").withColumn("user", report_user("digests"))), provider)
    return single.unionByName(many.select("event", "day", "n_chunks", F.col("text").alias("report")))
