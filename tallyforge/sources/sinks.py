"""Writers: fixed columns, guarded tables, upserts, nested files."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(path: str, value, indent: int = 2) -> str:
    """One small object, written beside its place and then renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        json.dump(value, file, indent=indent, sort_keys=True, ensure_ascii=False)
    os.replace(name, target)
    return str(target)


def write_json_lines(rows: DataFrame, path: str, *, append: bool = False) -> None:
    rows.select(*sorted(rows.columns)).write.mode("append" if append else "overwrite").json(path)


def write_csv(rows: DataFrame, path: str, columns) -> None:
    """Exactly these columns, blanks for nulls and for columns that are missing."""
    have = set(rows.columns)
    out = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns))
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").option("quoteAll", False).option("escape", '"').csv(path)


class FreeTextError(ValueError):
    """A table that must hold ids and numbers only holds prose."""


def assert_no_free_text(rows: DataFrame, columns, *, id_lists=(), max_chars: int = 200, max_words: int = 6) -> None:
    """Unknown columns, long cells or white space in id lists stop the write; one aggregate over the table."""
    unknown = set(rows.columns) - set(columns)
    if unknown:
        raise FreeTextError(f"unknown columns: {sorted(unknown)}")
    checks = []
    for name, kind in rows.dtypes:
        if kind != "string":
            continue
        c = F.col(name)
        bad = c.rlike(r"(?U)\s") if name in id_lists else (F.char_length(c) > max_chars) | (F.size(F.split(F.trim(c), r"(?U)\s+")) > max_words)
        checks.append(F.count_if(bad).alias(name))
    if checks:
        found = {k: v for k, v in rows.agg(*checks).first().asDict().items() if v}
        if found:
            raise FreeTextError(f"cells with free text: {found}")


def write_guarded_csv(rows: DataFrame, path: str, columns, **guard) -> None:
    assert_no_free_text(rows, columns, **guard)
    write_csv(rows, path, columns)


def upsert(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Old rows stay unless a new row has their key; ordered by key."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).orderBy(*keys)


def merge_manifest(old: DataFrame, new: DataFrame, order: str = "_seq") -> DataFrame:
    """Manifest rows by file, the later of a repeated file, ordered by event, date and file."""
    from ..operators.judgements import last_wins

    return upsert(old, last_wins(new, ["file"], order).drop(order), ["file"]).orderBy("event", "date", "file")


def judgement_documents(rows: DataFrame) -> DataFrame:
    """One row for each document with its judgements nested in slot order."""
    inner = F.array_sort(F.collect_list(F.struct("slot_id", "verdict", "score", "status")))
    return rows.groupBy("event", "sitrep_id").agg(inner.alias("judgements"), F.avg("score").alias("completeness"))


def write_partitions(rows: DataFrame, path: str, by) -> None:
    """Replaces only the partitions that the rows hold."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def smoke_path(path: str) -> str:
    """A name beside the full table's, so a partial run cannot replace it."""
    folder, slash, name = path.rpartition("/")  # a path of any file system
    stem, dot, suffix = name.rpartition(".")
    return f"{folder}{slash}{stem}_smoke{dot}{suffix}" if stem else f"{path}_smoke"


def blind_sheet(sample: DataFrame, slots: DataFrame) -> DataFrame:
    """The sampled rows for hand scoring: the slot's name and definition, the judge's verdict withheld."""
    names = slots.select("slot_id", F.col("name").alias("slot_name"), F.col("definition").alias("slot_definition"))
    rows = sample.join(names, "slot_id", "left")
    return rows.select("event", "sitrep_id", "kind", "slot_id", "slot_name", "slot_definition", F.lit("").alias("human_verdict"), F.lit("").alias("notes"))


def write_slots(path: str, slots: list[dict], **provenance) -> str:
    """Slots as YAML with who approved them; at most a few dozen rows."""
    import yaml

    Path(path).write_text(yaml.safe_dump({**provenance, "slots": slots}, sort_keys=False, allow_unicode=True, width=100), encoding="utf-8")
    return path


def schema_problems(slots: list[dict]) -> list[str]:
    """What keeps a schema from being frozen."""
    ids = [str(s.get("slot_id") or s.get("id") or "").strip() for s in slots]
    found = [] if slots else ["no slots"]
    found += [f"slot {i + 1} has no id" for i, x in enumerate(ids) if not x]
    found += [f"id {x} is repeated" for x in sorted({x for x in ids if x and ids.count(x) > 1})]
    found += [f"slot {x} has no definition" for x, s in zip(ids, slots, strict=True) if not str(s.get("definition") or "").strip()]
    return found


def freeze_schema(path: str, slots: list[dict], approved_by: str, approved_at: str) -> str:
    problems = schema_problems(slots)
    if problems or not approved_by.strip():
        raise ValueError("; ".join(problems) or "someone has to approve the schema")
    return write_slots(path, slots, version=1, approved_by=approved_by, approved_at=approved_at)


def work_list(event: str, reports: list[dict], window: dict | None) -> str:
    """A page of the reports of one event, at most a few hundred."""
    lines = [f"# {event}", ""]
    if window:
        lines += [f"Posts: {window['n_tweets']} from {window['first_day']} to {window['last_day']}.", ""]
    lines += ["| date | kind | title | url |", "| --- | --- | --- | --- |"]
    lines += [f"| {r.get('date') or '?'} | {r.get('kind') or 'other'} | {r.get('title') or ''} | {r['url']} |" for r in reports]
    return "\n".join(lines) + "\n"


def export_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows and an order-free digest of each exported table."""
    out = None
    for name, df in tables.items():
        row = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in sorted(df.columns)))
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out
