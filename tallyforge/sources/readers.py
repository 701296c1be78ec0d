"""Readers of reports, tables, judgements and slots. Every schema is declared, none is inferred."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.scalars import event_key, iso_day
from ..operators.judgements import first_wins, population


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing file has no rows and blank lines are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object or list in each file, with the file's name and stem; folders are read recursively."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{schema}, file_name string, path string")
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("file_name", F.col("_metadata.file_name")).withColumn("path", F.col("_metadata.file_path"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte order mark goes from the first name; a missing file has no columns or rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], StructType([]))
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))


def _stem(name):
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def judge_reports(spark: SparkSession, root: str, event: str, kind: str) -> DataFrame:
    """Reports of an event for judging: blank texts go, aliases day/date and model_name/model resolve."""
    rows = read_json_documents(spark, f"{root}/sitreps_{kind}/{event}", schemas.REPORT)
    rows = rows.filter(~F.col("file_name").startswith("_") & (F.trim("text") != ""))
    return rows.select(
        F.coalesce("id", _stem(F.col("file_name"))).alias("id"), event_key(F.coalesce("event", F.lit(event))).alias("event"), F.lit(kind).alias("kind"),
        F.coalesce("date", "day").alias("date"), F.coalesce("model", "model_name").alias("model"), "arm", "text", "path",
    )


def metric_reports(spark: SparkSession, path: str, kind: str = "human") -> DataFrame:
    """Reports for reference metrics from JSON objects or lists; the date falls back to the stem's first ten characters."""
    rows = read_json_documents(spark, path, schemas.REPORT).filter(F.trim("text") != "")
    stem = _stem(F.col("file_name"))
    return rows.select(
        F.coalesce("id", stem).alias("id"), event_key("event").alias("event"), F.lit(kind).alias("kind"),
        F.coalesce("date", "day", F.substring(stem, 1, 10)).alias("date"), "model", "arm", "text",
    ).withColumn("day", iso_day("date"))


def metric_report_lines(spark: SparkSession, path: str, kind: str = "human") -> DataFrame:
    """Reports from JSON lines; a missing id is <stem>-<line>, counted in file order; a file is read whole."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(_stem(F.col("_metadata.file_name")).alias("stem"), F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    rows = lines.select("stem", "i", F.from_json("line", schemas.REPORT).alias("r")).select("stem", "i", "r.*").filter(F.trim("text") != "")
    return rows.select(F.coalesce("id", F.concat_ws("-", "stem", "i")).alias("id"), event_key("event").alias("event"), F.lit(kind).alias("kind"), F.coalesce("date", "day").alias("date"), "text")


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """Reports below <root>/<event>/ in path order with id and event filled; of a repeated id the first path counts."""
    rows = read_json_documents(spark, root, schemas.REPORT).filter(F.trim("text") != "")
    folder = F.element_at(F.split("path", "/"), -2)
    rows = rows.withColumn("id", F.coalesce("id", _stem(F.col("file_name")))).withColumn("event", F.coalesce(F.nullif("event", F.lit("")), folder))
    return first_wins(rows.select("id", "event", "source", "date", "title", "url", "text", "path"), ["id"], "path")


def text_by_day(reports: DataFrame, by=("event", "day"), order: str = "path") -> DataFrame:
    """Texts of a day joined by line breaks in path order."""
    listed = F.array_sort(F.collect_list(F.struct(order, "text")))
    return reports.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"))


def admitted(manifest: DataFrame, documents: DataFrame, key: str = "file") -> DataFrame:
    """Documents that the manifest admits, by file name."""
    name = F.element_at(F.split(F.col(key), "/"), -1)
    return documents.join(manifest.select(name.alias(key)).distinct(), key, "left_semi")


def judgement_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of judgement CSV files, in the order of file and line."""
    rows = read_csv(spark, path)
    order = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    have = set(rows.columns)
    rows = rows.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("event", "sitrep_id", "slot_id", "judge_model", "kind", "model", "arm", "date", "verdict", "status")), order.alias("_seq"))
    return rows.withColumnRenamed("judge_model", "judge")


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """The analysis population of judgement CSV files."""
    return population(judgement_rows(spark, path))


def event_folder(spark: SparkSession, base: str, event: str) -> str | None:
    """The folder of an event in either spelling, dashes or underscores; None where there is none."""
    for name in dict.fromkeys((event, event.replace("-", "_"), event.replace("_", "-"))):
        if _exists(spark, f"{base}/{name}"):
            return f"{base}/{name}"
    return None


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """The posts, first and last day and days of each event, from the table of stream statistics; empty without one."""
    rows, names = read_csv(spark, path), ("event", "n_tweets", "first_day", "last_day", "n_days")
    have = set(rows.columns)
    rows = rows.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in names)) if have else spark.createDataFrame([], ", ".join(f"{c} string" for c in names))
    return rows.select("event", F.col("n_tweets").try_cast("long").alias("n_tweets"), iso_day("first_day").try_cast("date").alias("first_day"), iso_day("last_day").try_cast("date").alias("last_day"), F.col("n_days").try_cast("long").alias("n_days"))


def judgement_index(stored: DataFrame) -> DataFrame:
    """(sitrep_id, slot_id, verdict) of stored judgement files with a nested array."""
    flat = stored.select("sitrep_id", F.explode("judgements").alias("j"))
    return flat.select("sitrep_id", "j.slot_id", "j.verdict").filter("verdict IS NOT NULL")


def open_codes(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(codes, documents): codes without repeats of a name in a document, and every usable document.

    Documents with no codes stay in the denominator; failed ones go.
    """
    good = stored.filter(F.coalesce("status", F.lit("ok")) == "ok")
    flat = good.select("sitrep_id", "event", F.posexplode("codes").alias("code_index", "c")).select("sitrep_id", "event", "code_index", "c.*")
    flat = flat.filter(F.trim("name") != "")
    order = Window.partitionBy("sitrep_id", F.lower(F.trim("name"))).orderBy("code_index")
    codes = flat.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")
    return codes, good.select("sitrep_id").distinct()


def slots(path: str) -> list[dict]:
    """Slots of a frozen YAML schema; a missing or repeated id is an error."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    rows = data.get("slots") or data.get("candidate_slots") or [] if isinstance(data, dict) else data
    out, seen = [], set()
    for row in rows:
        sid = str(row.get("id") or row.get("slot_id") or "").strip()
        if not sid or sid in seen:
            raise ValueError(f"{path}: a slot id is missing or repeated: {sid!r}")
        seen.add(sid)
        out.append({"slot_id": sid, "name": str(row.get("name") or sid), "definition": str(row.get("definition") or ""), "prevalence": row.get("prevalence")})
    if not out:
        raise ValueError(f"{path}: no slots")
    return out


def generation_slots(paths, *, allow_candidates: bool = False) -> list[dict]:
    """Slots of the first path that exists; a file of candidates needs leave, as no one has approved it."""
    for path in map(Path, paths):
        if path.is_file():
            if "candidate" in path.name and not allow_candidates:
                raise PermissionError(f"{path} holds candidate slots that no one has approved")
            return slots(str(path))
    raise FileNotFoundError("no slot schema in any of " + ", ".join(map(str, paths)))


def slots_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["slot_id"], r["name"], r["definition"], r.get("prevalence")) for r in rows], "slot_id string, name string, definition string, prevalence double")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The collection manifest: required columns, trimmed cells, no blank or comment rows."""
    rows = read_csv(spark, path)
    missing = set(schemas.MANIFEST_COLUMNS) - set(rows.columns)
    if missing:
        raise ValueError(f"{path}: columns missing: {sorted(missing)}")
    rows = rows.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in schemas.MANIFEST_COLUMNS))
    blank = F.concat(*schemas.MANIFEST_COLUMNS) == ""
    return rows.filter(~blank & ~F.col("event").startswith("#"))


def posts(spark: SparkSession, *paths: str) -> DataFrame:
    """Posts of all splits, from files of JSON lines."""
    out = read_json_lines(spark, paths[0], schemas.POST)
    for path in paths[1:]:
        out = out.unionByName(read_json_lines(spark, path, schemas.POST))
    return out


def fetch(reports: DataFrame, *, formats=None, sources=None, language=None, disaster=None, date_from=None, date_to=None, fields=None,
          order="date", limit=None, offset: int = 0) -> DataFrame:
    """A filtered, ordered page of reports; the filters and the fields reach the scan."""
    rows = reports
    for column, wanted in (("format", formats), ("source", sources)):
        if wanted:
            rows = rows.filter(F.col(column).isin(*wanted))
    for column, value in (("language", language), ("disaster_id", disaster)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if date_from is not None:
        rows = rows.filter(F.col(order) >= F.lit(date_from))
    if date_to is not None:
        rows = rows.filter(F.col(order) <= F.lit(date_to))
    rows = rows.orderBy(order, "id")
    rows = rows.offset(offset) if offset else rows
    rows = rows.limit(limit) if limit is not None else rows
    return rows.select(*fields) if fields else rows


def first_present(columns, candidates) -> str:
    """The first candidate among the columns."""
    for name in candidates:
        if name in columns:
            return name
    raise ValueError(f"none of {list(candidates)} in {list(columns)}")


def resolve_metrics(requested, known) -> list[str]:
    """The requested metric names in order, all known ones when none is asked for; unknown names raise."""
    names = list(dict.fromkeys(m.strip().lower() for m in requested or () if m.strip()))
    unknown = [m for m in names if m not in known]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}; known: {list(known)}")
    return names or list(known)


def ensure_manifest(path: str) -> bool:
    """An empty manifest with its header where there is none; whether one was made."""
    target = Path(path)
    if target.exists():
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(",".join(schemas.MANIFEST_COLUMNS) + "\n", encoding="utf-8")
    return True


def load_config(path: str | None = None) -> dict:
    """A YAML or JSON config, or nothing."""
    if path is None or not Path(path).exists():
        return {}
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}
