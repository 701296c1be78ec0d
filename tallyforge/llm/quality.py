"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps its failure bit and the measurements
behind it. A policy is a mask over the bits, so applying another policy version, or asking what a
policy would keep without one of its rules, needs bitwise operations on the ledger and no text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import WS_CHARS, WS_CLASS, col

#: Bit, name and failing condition over the measurements.
RULES = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "100 * n_symbols > 10 * word_chars"),
    (3, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 40 * n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    """A named version of the rules that count."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        known = {name: bit for bit, name, _ in RULES}
        return sum(1 << known[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
DEFAULT = Policy("default", 1, ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words"))
STRICT = Policy("strict", 1, tuple(name for _, name, _ in RULES))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is bound, a column would be inlined."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_CLASS + "+", -1))


def _covered(trigrams: Column) -> Column:
    """Words inside three-word windows whose fingerprint occurs twice or more."""

    def slow(t):
        marked = F.array_sort(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(
            marked,
            lambda s: F.aggregate(
                F.array_sort(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                        ),
                        lambda x: x["i"],
                    )
                ),
                F.struct(F.lit(-3).alias("last"), F.lit(0).alias("words")),
                lambda acc, at: F.struct(
                    at.alias("last"), (acc["words"] + F.least(F.lit(3), at - acc["last"])).alias("words")
                ),
                lambda acc: acc["words"],
            ),
        )

    return _let(trigrams, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(slow(t)))


def _word_measures(words: Column) -> Column:
    def measured(w):
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        trigrams = _let(
            hashes,
            lambda h: F.slice(
                F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))),
                F.lit(1),
                F.greatest(F.size(h) - 2, F.lit(0)),
            ),
        )
        return F.struct(F.size(w).cast("long").alias("n_words"), _covered(trigrams).cast("long").alias("n_repeat_words"))

    return _let(words, measured)


def _line_measures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    return _let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )


def ledger(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document: the columns in ``keep``, the measurements and ``failed_bits``.

    Null and empty texts have no words and lines and so fail few_words only. Rows that repeat are
    judged each on its own. Everything is one projection over the scan: no shuffle.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    measured = docs.select(
        *map(col, keep),
        _word_measures(_words(text)).alias("__w"),
        _line_measures(text).alias("__l"),
        F.char_length(F.translate(text, WS_CHARS, "")).cast("long").alias("__c"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("__s"),
    )
    values = {
        "n_words": F.col("__w.n_words"),
        "n_repeat_words": F.col("__w.n_repeat_words"),
        "n_lines": F.col("__l.n_lines"),
        "n_dup_lines": F.col("__l.n_dup_lines"),
        "word_chars": F.col("__c"),
        "n_symbols": F.col("__s"),
    }
    kept = [k for k in keep if k not in (*MEASURES, "failed_bits")]
    flat = measured.select(*map(col, kept), *(values[m].alias(m) for m in MEASURES))
    bits = sum((F.expr(f"CASE WHEN {rule} THEN {1 << bit}L ELSE 0L END") for bit, _, rule in RULES), F.lit(0).cast("long"))
    return flat.withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and kept without it.

    The ledger shrinks to one row for each bit pattern (at most 2 to the number of rules) first.
    """
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(
        F.count("*").alias("n")
    )
    known = {name: 1 << bit for bit, name, _ in RULES}
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(known[r]).cast("long").alias("bit")) for r in policy.rules)))
    return (
        patterns.withColumn("r", rules)
        .groupBy(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.expr("CASE WHEN (bits & r.bit) <> 0 THEN n ELSE 0L END")).alias("n_failed"),
            F.sum(F.expr("CASE WHEN bits = r.bit THEN n ELSE 0L END")).alias("n_only_this"),
            F.sum(F.expr("CASE WHEN (bits & ~r.bit) = 0 THEN n ELSE 0L END")).alias("n_kept_without"),
        )
    )


def keep_good(docs: DataFrame, policy: Policy = DEFAULT, *, text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    rows = docs.select(F.struct(*map(col, docs.columns)).alias("__row"), col(text_col).alias("__text"))
    judged = apply_policy(ledger(rows, text_col="__text", keep=("__row",)), policy)
    return judged.filter("kept").select(*(F.col("__row")[c].alias(c) for c in docs.columns))
