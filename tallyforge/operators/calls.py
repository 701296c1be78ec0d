"""The life cycle of model calls: resolve, hash, cache, gate, call, settle, log; at once or as a batch that is polled.

All state lies in one shared folder as Parquet: ``cache`` (responses by hash), ``log`` (a row a call, never with its
text) and ``batches`` (a table of request states for each submission). A provider is a function over one request
that returns a response dict, and runs on the executors.
"""

from __future__ import annotations

import random
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import estimate_tokens, lenient_json
from .requests import Budget, CostLimitError, cost, price, request_hash

#: The normalised record of a response.
FIELDS = (
    ("text", "string"), ("stop_reason", "string"), ("served_model", "string"), ("refused", "boolean"), ("refusal_category", "string"),
    ("input_tokens", "long"), ("output_tokens", "long"), ("cache_read_tokens", "long"), ("cache_write_tokens", "long"),
    ("attempts", "int"), ("latency_s", "double"), ("error", "string"),
)
RECORD = ", ".join(f"{name} {kind}" for name, kind in FIELDS)
_CACHED = f"request_hash string, {RECORD}"
_BATCHED = f"request_hash string, model string, provider string, model_id string, system string, user string, max_tokens int, state string, {RECORD}"
_TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
#: What an unset model id is called, and the id patterns of providers, first match counts.
UNSET = "SET_ME"
PROVIDERS = ((r"^claude", "anthropic"), (r"/", "openrouter"), (r"^deepseek", "deepseek"), (r"^gpt-|^o[0-9]", "openai"), (r"^fake(-|$)", "fake"))


class ConfigError(ValueError):
    """A model that cannot be resolved."""


class TransientError(RuntimeError):
    """A failure of a provider that may pass: it is tried again."""


@dataclass(frozen=True)
class ModelSpec:
    name: str
    provider: str
    id: str


def infer_provider(model_id: str) -> str:
    for pattern, provider in PROVIDERS:
        if re.search(pattern, model_id.lower()):
            return provider
    raise ConfigError(f"no provider is known for the model id {model_id!r}")


def resolve_model(model: str | ModelSpec, models: dict | None = None) -> ModelSpec:
    """A role or entry of the configured models, or a raw id.

    ``models`` maps roles to {id, provider, name}; its key ``generation`` holds a list of named entries.
    """
    if isinstance(model, ModelSpec):
        spec = model
    else:
        models = models or {}
        named = {e.get("name"): e for e in models.get("generation") or [] if isinstance(e, dict)}
        entry = models[model] if isinstance(models.get(model), dict) else named.get(model)
        if entry is None:
            spec = ModelSpec(model, infer_provider(model), model)
        else:
            found = str(entry.get("id") or UNSET)
            provider = entry.get("provider") or (infer_provider(found) if found != UNSET else "")
            spec = ModelSpec(str(entry.get("name") or model), str(provider), found)
    if spec.id in ("", UNSET):
        raise ConfigError(f"the model {spec.name!r} has no id")
    return spec


def normalised(answer: dict) -> dict:
    """A provider's answer with every field of the record; a stop reason of refusal sets refused, counts default to 0."""
    out = {name: answer.get(name) for name, _ in FIELDS}
    out["refused"] = bool(answer.get("refused")) or answer.get("stop_reason") == "refusal"
    out["text"] = None if out["refused"] else (answer.get("text") or "")
    return out | {name: int(answer.get(name) or 0) for name in _TOKENS}


def attempt(provider: Callable[[dict], dict], request: dict, attempts: int, first_wait: float, sleep=time.sleep) -> dict:
    """One request with repeats of transient failures, after waits that double with some jitter."""
    began = time.monotonic()
    for number in range(1, attempts + 1):
        try:
            out = normalised(provider(request))
            break
        except (TransientError, ConnectionError, TimeoutError) as problem:
            out = normalised({}) | {"text": None, "error": f"{type(problem).__name__} after {number} attempts: {problem}"[:300]}
            if number < attempts:
                sleep(first_wait * 2 ** (number - 1) * (1 + random.random() / 2))
        except Exception as problem:  # noqa: BLE001  any other failure is the result of this request
            out = normalised({}) | {"text": None, "error": f"{type(problem).__name__}: {problem}"[:300]}
            break
    return out | {"attempts": number, "latency_s": time.monotonic() - began}


class Calls:
    """Calls of one run, with their shared folder, prices and budget."""

    def __init__(
        self, spark: SparkSession, folder: str, providers: dict[str, Callable[[dict], dict]], *, prices: DataFrame, limit_usd: float, models: dict | None = None,
        max_concurrency: int = 8, attempts: int = 4, first_wait: float = 1.0, unknown_usd: float = 0.05,
    ):
        self.spark, self.folder, self.providers, self.prices, self.models = spark, folder.rstrip("/"), providers, prices, models
        self.budget, self.max_concurrency, self.attempts, self.first_wait, self.unknown_usd = Budget(limit_usd), max_concurrency, attempts, first_wait, unknown_usd
        self.run_id = uuid.uuid4().hex

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the folder; empty before its first row."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def prepared(self, requests: DataFrame) -> DataFrame:
        """The requests with provider, model id and hash. The models asked for, a handful of names, are resolved here."""
        names = [r[0] for r in requests.select("model").distinct().collect()]
        specs = [(n, *(lambda s: (s.provider, s.id))(resolve_model(n, self.models))) for n in names]
        for _, provider, _ in specs:
            if provider not in self.providers:
                raise ConfigError(f"no provider {provider!r} is set up")
        known = self.spark.createDataFrame(specs, "model string, provider string, model_id string")
        rows = requests.join(known, "model").withColumn("__m", F.concat_ws("|", "provider", "model_id"))
        return rows.withColumn("request_hash", request_hash(model="__m")).drop("__m")

    def _projected(self, rows: DataFrame) -> float:
        tokens = estimate_tokens("system") + estimate_tokens("user")
        one = F.coalesce(cost(tokens, F.col("max_tokens")), F.lit(self.unknown_usd))
        return price(rows, self.prices, "model_id").agg(F.coalesce(F.sum(one), F.lit(0.0))).first()[0]

    def _called(self, rows: DataFrame) -> DataFrame:
        """Responses of distinct requests, called in at most ``max_concurrency`` tasks and written before anything reads them."""
        providers, attempts, wait = self.providers, self.attempts, self.first_wait

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                done = [attempt(providers[r["provider"]], r, attempts, wait) for r in batch.to_dict("records")]
                yield pd.DataFrame({"request_hash": batch["request_hash"]} | {name: [d[name] for d in done] for name, _ in FIELDS})

        path = f"{self.folder}/responses/{uuid.uuid4().hex}"
        slim = rows.select("request_hash", "provider", "model_id", "system", "user", "max_tokens").repartition(self.max_concurrency, "request_hash")
        slim.mapInPandas(call, f"request_hash string, {RECORD}").write.parquet(path)
        return self.spark.read.schema(f"request_hash string, {RECORD}").parquet(path)

    def _cost_of(self, rows: DataFrame) -> DataFrame:
        return price(rows, self.prices, "model_id").withColumn("cost_usd", cost(*(F.col(t) for t in _TOKENS))).drop("price_prefix", "usd_in", "usd_out")

    def _settle(self, fresh: DataFrame, projected: float, mode: str, batch_id: str | None = None) -> None:
        """Books the real cost (an assumed one where no price is known), fills the cache and logs the calls."""
        priced = self._cost_of(fresh)
        real = F.when(F.col("error").isNull(), F.coalesce("cost_usd", F.lit(self.unknown_usd))).otherwise(0.0)
        self.budget.settle(projected, priced.agg(F.coalesce(F.sum(real), F.lit(0.0))).first()[0])
        good = fresh.filter("error IS NULL AND NOT refused").select("request_hash", *(n for n, _ in FIELDS))
        good.coalesce(self.max_concurrency).write.mode("append").parquet(f"{self.folder}/cache")
        self._log(priced, mode, batch_id)

    def _log(self, priced: DataFrame, mode: str, batch_id: str | None = None) -> None:
        sizes = {f"{c}_chars": F.coalesce(F.char_length(c), F.lit(0)) for c in ("system", "user", "text")}
        rows = priced.withColumns(sizes | {"mode": F.lit(mode), "run_id": F.lit(self.run_id), "batch_id": F.lit(batch_id).cast("string"), "ts": F.current_timestamp()})
        kept = [n for n, _ in FIELDS if n != "text"]
        rows.select("ts", "run_id", "batch_id", "mode", "request_hash", "provider", "model", "model_id", "max_tokens", "cost_usd", *kept, *sizes).write.mode("append").parquet(f"{self.folder}/log")

    def cached(self) -> DataFrame:
        """A response for each hash that the cache holds."""
        return self._table("cache", _CACHED).dropDuplicates(["request_hash"])

    def complete_many(self, requests: DataFrame, *, use_cache: bool = True) -> DataFrame:
        """Every request (model, system, user, max_tokens and any other columns) with its response.

        A request that the cache holds is not called, equal requests are called once, and the projected cost of all
        calls is reserved before the first: a run over the limit raises and sends nothing. Failures are rows.
        """
        rows = self.prepared(requests)
        known = self.cached() if use_cache else self.cached().limit(0)
        missing = rows.join(known.select("request_hash"), "request_hash", "left_anti").dropDuplicates(["request_hash"])
        projected = self._projected(missing)
        self.budget.reserve(projected)
        try:
            fresh = self._called(missing)
            self._settle(fresh.join(missing.select("request_hash", "provider", "model", "model_id", "system", "user", "max_tokens"), "request_hash"), projected, "sync")
        except Exception:
            self.budget.release(min(projected, self.budget.reserved))
            raise
        answers = fresh.withColumn("cached", F.lit(False)).unionByName(known.join(fresh.select("request_hash"), "request_hash", "left_anti").withColumn("cached", F.lit(True)))
        return self._cost_of(rows.join(answers, "request_hash", "left"))

    # Batches: a table of request states that outlives the session.

    def submit(self, requests: DataFrame) -> str:
        """Writes the distinct requests that neither the cache nor an open batch holds, and returns the batch's id."""
        rows = self.prepared(requests)
        waiting = self.pending().select("request_hash")
        new = rows.join(self.cached().select("request_hash"), "request_hash", "left_anti").join(waiting, "request_hash", "left_anti").dropDuplicates(["request_hash"])
        self.budget.reserve(self._projected(new))
        batch = uuid.uuid4().hex
        blank = {n: F.lit(None).cast(k) for n, k in FIELDS}
        out = new.select("request_hash", "model", "provider", "model_id", "system", "user", F.col("max_tokens").cast("int").alias("max_tokens")).withColumns({"state": F.lit("pending")} | blank)
        out.withColumn("batch_id", F.lit(batch)).write.partitionBy("batch_id").mode("append").parquet(f"{self.folder}/batches")
        return batch

    def _states(self) -> DataFrame:
        """The last state of every request of every batch."""
        every = self._table("batches", f"{_BATCHED}, batch_id string")
        return every.groupBy("batch_id", "request_hash").agg(F.max_by(F.struct(*(c for c in every.columns if c not in ("batch_id", "request_hash"))), F.col("state") != "pending").alias("s")).select("batch_id", "request_hash", "s.*")

    def pending(self, batch: str | None = None) -> DataFrame:
        rows = self._states().filter("state = 'pending'")
        return rows if batch is None else rows.filter(F.col("batch_id") == batch)

    def poll(self, batch: str, results: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
        """Fetches what has ended of a batch, from any session, and returns its requests by state.

        ``results`` gets the pending requests and returns (request_hash and record) of those that ended; without it the
        providers are called. A batch that has ended is not called again.
        """
        left = self.pending(batch)
        if left.limit(1).count():
            base = left.select("request_hash", "model", "provider", "model_id", "system", "user", "max_tokens")
            ended = (results or self._called)(base)
            path = f"{self.folder}/responses/{uuid.uuid4().hex}"
            base.join(ended, "request_hash").write.parquet(path)  # once, before settling and logging read it
            done = self.spark.read.parquet(path)
            projected = self._projected(done)
            self._settle(done, min(projected, self.budget.reserved), "batch", batch)
            state = F.when(F.col("error").isNull(), "done").otherwise("failed")
            done.withColumn("state", state).withColumn("batch_id", F.lit(batch)).select(*(f"`{c.split()[0]}`" for c in _BATCHED.split(", ")), "batch_id").write.partitionBy("batch_id").mode("append").parquet(f"{self.folder}/batches")
        return {r[0]: r[1] for r in self._states().filter(F.col("batch_id") == batch).groupBy("state").agg(F.count("*")).collect()}

    def attach(self, requests: DataFrame) -> DataFrame:
        """The requests with what the cache or any batch holds for them, in whatever session they were sent; copies of one request share it."""
        done = self._states().filter("state <> 'pending'").select("request_hash", *(n for n, _ in FIELDS))
        known = self.cached().unionByName(done).dropDuplicates(["request_hash"])
        return self._cost_of(self.prepared(requests).join(known, "request_hash", "left"))

    def run(self, requests: DataFrame, *, batch: bool = False, wait: bool = True, poll_s: float = 30.0, max_wait_s: float = 93_600.0, results=None, sleep=time.sleep) -> DataFrame:
        """At once, or as a batch that is polled until it has ended or the time is up."""
        if not batch:
            return self.complete_many(requests)
        number, waited = self.submit(requests), 0.0
        while wait and self.poll(number, results).get("pending") and waited < max_wait_s:
            sleep(poll_s)
            waited += poll_s
        return self.attach(requests)

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/log")


def with_json(responses: DataFrame) -> DataFrame:
    """The reply as JSON, null for refusals and for text without any."""
    return responses.withColumn("json", F.when(~F.coalesce("refused", F.lit(False)), lenient_json("text")))


__all__ = ["Calls", "ConfigError", "CostLimitError", "ModelSpec", "TransientError", "infer_provider", "resolve_model", "with_json"]
