"""From open codes to named candidate slots: vectors, clusters, naming by a model or by rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lenient_json
from .ranking import order_clusters, prevalence, top_names

#: An encoder takes (id, text) and gives (id, v array<double>).
VectorProvider = Callable[[DataFrame], DataFrame]


#: Terms of a vocabulary that vectors are spread over; the codes of a schema have a few thousand.
MAX_TERMS = 50_000


def dense_tfidf(weights: DataFrame, id_col: str = "id") -> DataFrame:
    """TF-IDF rows (id, term, weight) as vectors over the sorted vocabulary; for the few hundred codes of a schema.

    A vocabulary beyond MAX_TERMS raises: the vectors would grow with it.
    """
    distinct = weights.select("term").distinct()
    if (n := distinct.count()) > MAX_TERMS:
        raise ValueError(f"{n} terms; dense vectors are for at most {MAX_TERMS}")
    terms = distinct.agg(F.array_sort(F.collect_list("term")).alias("terms"))
    rows = weights.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("w"))
    return rows.join(F.broadcast(terms), how="cross").select(id_col, F.transform("terms", lambda t: F.coalesce(F.try_element_at("w", t), F.lit(0.0))).alias("v"))  # one row


def embed(texts: DataFrame, provider: VectorProvider | None, fallback: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """Vectors and how they were made: the provider's, or the lexical fallback where there is none or it fails."""
    if provider is not None:
        try:
            return provider(texts), "provider"
        except Exception:  # noqa: BLE001  a model that cannot load must not end the run
            pass
    return fallback(texts), "lexical-tfidf"


def embed_cached(texts: DataFrame, provider: VectorProvider, path: str, model: str) -> DataFrame:
    """(id, v) by a provider that sees each distinct text once, ever: vectors are kept by model and digest below ``path``."""
    spark = texts.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    schema = "digest string, v array<double>, model string"
    known = (spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)).filter(F.col("model") == model)
    keyed = texts.select("id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    new = keyed.join(known.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    if new.limit(1).count():
        made = provider(new.select(F.col("digest").alias("id"), "text")).select(F.col("id").alias("digest"), F.col("v").cast("array<double>").alias("v"))
        made.withColumn("model", F.lit(model)).write.mode("append").partitionBy("model").parquet(path)
        known = spark.read.schema(schema).parquet(path).filter(F.col("model") == model)
    vectors = known.dropDuplicates(["digest"]).select("digest", "v")  # two runs may have written one text
    return keyed.join(vectors, "digest").select("id", "v")


def candidate_slots(members: DataFrame, n_documents: int, *, max_candidates: int = 25, min_codes: int = 1) -> DataFrame:
    """Ordered clusters with prevalence, their most frequent names and whether they are kept."""
    clusters = order_clusters(members, max_candidates, min_codes)
    names = top_names(members, 5).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("t"))
    names = names.select("label", F.transform("t", lambda x: x["name"]).alias("top_codes"))
    return clusters.join(prevalence(members, n_documents), "label").join(names, "label")


def naming_requests(slots: DataFrame, model: str, max_tokens: int = 900) -> DataFrame:
    """One request for each kept cluster, with its names as evidence."""
    kept = slots.filter("kept")
    user = F.concat(F.lit("Name the information slot that these codes share:\n- "), F.array_join("top_codes", "\n- "), F.lit('\nReply with JSON: {"name": ..., "definition": ..., "examples": [...]}'))
    return kept.select("slot_id", F.lit(model).alias("model"), F.lit("You name information slots.").alias("system"), user.alias("user"), F.lit(max_tokens).alias("max_tokens"))


def apply_names(slots: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """name, definition, examples and named_by of every kept slot.

    The reply may call its fields name or slot_name, definition or description, examples or
    example_codes. Without a usable reply the most frequent code names the slot.
    """
    kept = slots.filter("kept")
    fallback = F.lit("No model named this slot; it groups the codes: ")
    if responses is None:
        said = kept.select("slot_id", *(F.lit(None).cast(t).alias(n) for n, t in (("r_name", "string"), ("r_def", "string"), ("r_ex", "array<string>"))))
    else:
        j = lenient_json("text")
        first = lambda kind, *paths: F.coalesce(*(F.try_variant_get(j, f"$.{p}", kind) for p in paths))
        said = responses.select("slot_id", first("string", "name", "slot_name").alias("r_name"), first("string", "definition", "description").alias("r_def"), first("array<string>", "examples", "example_codes").alias("r_ex"))
    rows = kept.join(said, "slot_id", "left")
    good = (F.trim(F.coalesce("r_name", F.lit(""))) != "") & (F.trim(F.coalesce("r_def", F.lit(""))) != "")
    return rows.select(
        "slot_id", F.when(good, F.trim("r_name")).otherwise(F.coalesce(F.nullif("canonical_name", F.lit("")), F.lit("unnamed slot"))).alias("name"),
        F.when(good, F.trim("r_def")).otherwise(F.concat(fallback, F.array_join("top_codes", "; "))).alias("definition"),
        F.when(good, F.coalesce("r_ex", F.slice("top_codes", 1, 2))).otherwise(F.slice("top_codes", 1, 2)).alias("examples"),
        "prevalence", "n_sitreps", "n_codes", F.when(good, "model").otherwise("fallback").alias("named_by"), "top_codes",
    )


def score_pairs(pairs: DataFrame, provider: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Model-based similarity (p, r, f) of candidate and reference texts; null where no provider is given."""
    if provider is None:
        return pairs.withColumns({f"bertscore_{x}": F.lit(None).cast("double") for x in ("p", "r", "f1")})
    return provider(pairs)
