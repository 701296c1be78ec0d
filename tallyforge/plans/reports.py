"""Short text reports of result tables, for a console."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(rows: DataFrame, *, limit: int = 20, places: int = 3) -> str:
    """The first rows in aligned columns, and how many more there are is not counted: the table is read only so far."""
    names = rows.columns
    taken = rows.limit(limit + 1).collect()

    def cell(value) -> str:
        if value is None:
            return ""
        return f"{value:.{places}f}" if isinstance(value, float) else str(value)

    cells = [names, *([cell(r[c]) for c in names] for r in taken[:limit])]
    wide = [max(len(row[i]) for row in cells) for i in range(len(names))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(row, wide, strict=True)).rstrip() for row in cells]
    lines.insert(1, "  ".join("-" * w for w in wide))
    return "\n".join([*lines, *(["..."] if len(taken) > limit else [])])


def titled(title: str, body: str) -> str:
    return f"{title}\n{'=' * len(title)}\n{body}\n"


def tables_report(tables: dict[str, DataFrame], *, limit: int = 10) -> str:
    return "\n".join(titled(name, grid(df, limit=limit)) for name, df in tables.items())


def judging_report(rows: DataFrame) -> str:
    """Judgements by judge and status, with the share of usable ones."""
    usable = F.count_if((F.col("status") == "ok") & F.lower(F.trim("verdict")).isin("absent", "partial", "present"))
    counts = rows.groupBy("judge").agg(F.count("*").alias("n"), usable.alias("usable"), (usable / F.count("*")).alias("share")).orderBy("judge")
    states = rows.groupBy("judge", "status").agg(F.count("*").alias("n")).orderBy("judge", "status")
    return titled("Judgements", grid(counts)) + "\n" + titled("By status", grid(states))


def coding_report(results: DataFrame, *, show_quotes: bool = False, top_codes: int = 15) -> str:
    """Documents coded and failed, the most frequent codes, and a quote of each where asked for."""
    heads = results.agg(F.count("*").alias("documents"), F.count_if(F.col("problem").isNull()).alias("coded"), F.sum(F.size("codes")).alias("codes"))
    codes = results.select(F.explode("codes").alias("c")).groupBy(F.col("c.name").alias("code"))
    quote = [F.min("c.evidence_quote").alias("quote")] if show_quotes else []
    top = codes.agg(F.count("*").alias("n"), *quote).orderBy(F.desc("n"), "code")
    return titled("Open codes", grid(heads)) + "\n" + titled("Most frequent", grid(top, limit=top_codes))


def cost_report(estimates: DataFrame, limit_usd: float | None = None) -> str:
    total = estimates.agg(F.sum("n_requests"), F.sum("usd")).first()
    line = f"{total[0] or 0} requests, {total[1] or 0.0:.2f} USD projected"
    if limit_usd is not None:
        line += f" of {limit_usd:.2f}" + (": over the limit" if (total[1] or 0.0) > limit_usd else "")
    return titled("Projected cost", grid(estimates.orderBy(F.desc("usd"), "model"))) + line + "\n"


def conventions_report(totals: DataFrame) -> str:
    return titled("Conventions", grid(totals.orderBy((F.col("event") == "ALL"), "event")))
