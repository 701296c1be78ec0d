"""Keyed, nearest-date, figure-set and similarity joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import to_float
from .judgements import last_wins
from .ranges import written


def join_scores(metrics: DataFrame, scores: DataFrame, key: str = "sitrep_id", score: str = "completeness", order: str = "_seq") -> DataFrame:
    """Inner join on the key; the last score row of a key counts, null scores drop the row."""
    last = last_wins(scores.select(key, score, order), [key], order).select(key, to_float(score).alias(score))
    return metrics.join(last.filter(F.col(score).isNotNull()), key, "inner")


#: Parts of a day's references whose smallest ids are found first.
DAY_SALTS = 16


def _reference_days(human: DataFrame, k: int) -> DataFrame:
    """(h_event, h_day, refs, at): the k smallest ids of each day of an event, and the day's place among the event's days."""
    part = Window.partitionBy("event", "day", F.pmod(F.xxhash64("id"), F.lit(DAY_SALTS))).orderBy("id")
    first = human.filter("event IS NOT NULL AND day IS NOT NULL").withColumn("__n", F.row_number().over(part)).filter(F.col("__n") <= k)
    days = first.groupBy(F.col("event").alias("h_event"), F.col("day").alias("h_day")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("refs"))
    return days.withColumn("at", F.row_number().over(Window.partitionBy("h_event").orderBy("h_day")))


def _asked_days(machine: DataFrame, days: DataFrame, k: int) -> DataFrame:
    """(event, day, near): for each day that a machine report has, up to k reference days before (the day itself
    included) and k after, as (distance, gap, refs), nearest first and the earlier of a tie first."""
    asked = machine.filter("event IS NOT NULL AND day IS NOT NULL").select("event", "day").distinct()
    both = asked.withColumn("h", F.lit(0)).union(days.select("h_event", "h_day", F.lit(1)))
    merged = Window.partitionBy("event").orderBy("day", F.desc("h")).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("upto", F.sum("h").over(merged)).filter("h = 0")
    placed = placed.withColumn("place", F.explode(F.sequence(F.col("upto") - (k - 1), F.col("upto") + k)))
    near = placed.join(days, (F.col("event") == F.col("h_event")) & (F.col("place") == F.col("at"))).withColumn("gap", F.datediff("h_day", "day"))
    return near.groupBy("event", "day").agg(F.sort_array(F.collect_list(F.struct(F.abs("gap").alias("off"), "gap", "refs"))).alias("near"))


def nearest_references(
    machine: DataFrame, human: DataFrame, *, window_days: int = 3, max_refs: int = 3, event_fallback: bool = False
) -> DataFrame:
    """Human references of each machine report: same day, else nearest within the window, else the event's.

    Both sides have id, event and day. One row for each reference, or one with a null reference and
    rule 'none'. Reports of one event and day have one answer, so both sides are reduced to days before they meet: a day
    of references keeps its max_refs smallest ids, the days of an event (no more than a calendar has) are merged in order, and
    a day asked for meets 2 * max_refs days by their places. An undated report has the event's first references.
    """
    k = max_refs
    days = _reference_days(human, k)
    asked = _asked_days(machine, days, k)
    inside = F.filter("near", lambda x: x["off"] <= window_days)
    same = F.col("near")[0]["gap"] == 0
    tier = F.when(same, 0).when(F.size(inside) > 0, 1).otherwise(2)
    chosen = F.when(same, F.slice("near", 1, 1)).when(F.size(inside) > 0, inside)
    chosen = chosen.otherwise(F.col("near") if event_fallback else F.slice("near", 1, 0))
    refs = F.flatten(F.transform(chosen, lambda x: F.transform(x["refs"], lambda r: F.struct(r.alias("ref_id"), x["gap"].alias("gap")))))
    answers = asked.select(F.col("event").alias("a_event"), F.col("day").alias("a_day"), tier.alias("tier"), F.slice(refs, 1, k).alias("refs"))
    m = machine.select("id", "event", "day")
    found = m.filter("day IS NOT NULL").join(answers, (F.col("event") == F.col("a_event")) & (F.col("day") == F.col("a_day")), "left")
    found = found.select("id", "tier", "refs")
    undated = m.filter("day IS NULL")
    if event_fallback:
        first = days.filter(F.col("at") <= k).groupBy("h_event").agg(F.sort_array(F.collect_list(F.struct("h_day", "refs"))).alias("first"))
        pairs = F.flatten(F.transform("first", lambda x: F.transform(x["refs"], lambda r: F.struct(r.alias("ref_id"), F.lit(None).cast("int").alias("gap")))))
        undated = undated.join(first, F.col("event") == F.col("h_event"), "left").select("id", F.lit(2).alias("tier"), F.slice(pairs, 1, k).alias("refs"))
        found = found.union(undated)
    else:
        found = found.unionByName(undated.select("id"), allowMissingColumns=True)
    names = F.when(F.col("ref_id").isNull(), "none").when(F.col("tier") == 0, "same_day").when(F.col("tier") == 1, "window").otherwise("event")
    flat = found.select("id", "tier", F.posexplode_outer("refs").alias("pos", "r"))
    return flat.select("id", (F.col("pos") + 1).alias("rank"), F.col("r.ref_id").alias("ref_id"), F.col("r.gap").alias("gap"), "tier").select("id", "rank", "ref_id", "gap", names.alias("rule"))


def figure_sets(reports: DataFrame, by, figures: str = "figures", order=()) -> DataFrame:
    """Distinct (unit, value) keys by group with whether any occurrence is first tagged casualty.

    A group may have several rows; ``order`` puts them in sequence.
    """
    flat = reports.select(*by, *order, F.posexplode(figures).alias("at", "f"))
    return flat.groupBy(*by, F.col("f.unit").alias("unit"), F.round("f.value", 6).alias("value")).agg(F.min_by("f.kind", F.struct(*order, "at")).alias("kind"), F.count("*").alias("n"))


def figure_check(machine: DataFrame, human: DataFrame, on=("event", "day"), doc=("id",), order=()) -> DataFrame:
    """Occurrences, unique figures, overlap and rates of each machine report against the day's human text.

    Both sides have the on-columns and figures; a day's human text may be several rows, in ``order``. Rates with an empty denominator are null.
    Figures meet in an equi-join, and what a report lacks of its day's is found by subtraction.
    """
    casualty = F.col("kind") == "casualty"
    counts = machine.groupBy(*doc, *on).agg(F.sum(F.size("figures")).alias("n_machine_figures"))
    m = figure_sets(machine, (*doc, *on)).select(*doc, *on, "unit", "value")
    h = figure_sets(human, on, order=order).drop("n")
    totals = human.groupBy(*on).agg(F.sum(F.size("figures")).alias("n_human_figures"))
    unique = h.groupBy(*on).agg(F.count("*").alias("n_human_unique"), F.count_if(casualty).alias("n_casualty"))
    of_doc = m.groupBy(*doc, *on).agg(F.count("*").alias("n_machine_unique"))
    both = m.join(h, [*on, "unit", "value"]).groupBy(*doc, *on).agg(F.count("*").alias("n_overlap"), F.count_if(casualty).alias("n_casualty_overlap"))
    out = counts.join(totals, list(on)).join(unique, list(on), "left")
    out = out.join(of_doc, [*doc, *on], "left").join(both, [*doc, *on], "left")
    out = out.fillna(0, ["n_machine_unique", "n_human_unique", "n_overlap", "n_casualty", "n_casualty_overlap"])
    none = F.lit(0)
    return out.select(
        *doc, *on, "n_machine_figures", "n_human_figures", "n_machine_unique", "n_human_unique", "n_overlap",
        (F.col("n_overlap") / F.nullif("n_machine_unique", none)).alias("precision"),
        (F.col("n_overlap") / F.nullif("n_human_unique", none)).alias("recall"),
        (F.col("n_casualty_overlap") / F.nullif("n_casualty", none)).alias("casualty_recall"),
        (F.col("n_overlap") / F.nullif(F.col("n_machine_unique") + F.col("n_human_unique") - F.col("n_overlap"), none)).alias("jaccard"),
    )


def source_availability(machine: DataFrame, human: DataFrame, stream: DataFrame, day: str = "day", doc: str = "id") -> DataFrame:
    """Shares of a report's figure values in the day's stream and human text; values only, units ignored.

    All sides have the day and a values array; a report without figures gives no row.
    """
    m = machine.select(doc, day, F.array_distinct("values").alias("m")).filter(F.size("m") > 0)
    h = human.select(day, F.array_distinct("values").alias("h"))
    s = stream.select(day, F.array_distinct("values").alias("s"))
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))
    return m.join(h, day).join(s, day).select(
        doc, day, F.size("m").alias("n_machine_figures"), share("m", "s").alias("machine_figs_in_stream"),
        share("m", "h").alias("machine_figs_in_human"), share("h", "s").alias("human_figs_in_stream"),
    )


def split_by_presence(official: DataFrame, stream: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """Official rows whose key the stream has, and those whose it lacks."""
    keys = stream.select(*key).distinct()
    return official.join(keys, list(key), "left_semi"), official.join(keys, list(key), "left_anti")


def jaccard(a, b):
    """Share of common terms; 0 when either side is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


#: Rows of a block of queries and of candidates; a task compares one of each. A group of fewer candidates has up to so many smaller blocks.
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCKS = 8192, 1 << 15, 4


#: A term is common in a cell where it is shared by so many of its pairs, and a column of a product of 0/1 matrices then; the
#: other terms, and common ones beyond so many, are counted by postings.
COMMON, COLUMNS = 0.002, 4096


def _best_of_block(k: int, on, out: pa.Schema):
    """The k best candidates of each query of a cell, by counts of shared terms: products for common terms, the queries' postings
    for rare ones. Only scores above a query's k-th best so far are ordered."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        lt, rt = left.column("terms").combine_chunks(), right.column("r_terms").combine_chunks()
        words = lt.flatten().dictionary_encode()
        nl = pc.fill_null(pc.list_value_length(lt), 0).to_numpy()
        nr = pc.fill_null(pc.list_value_length(rt), 0).to_numpy()
        owners, terms = np.repeat(np.arange(len(nl)), nl), words.indices.to_numpy()
        known = pc.fill_null(pc.index_in(rt.flatten(), value_set=words.dictionary), -1).to_numpy()
        names = right.column("candidate").to_numpy()
        order = np.argsort(names, kind="stable")
        names, sizes = names[order], nr[order]
        flat = known[np.repeat((np.cumsum(nr) - nr)[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        which, flat = np.repeat(np.arange(len(order)), sizes)[flat >= 0], flat[flat >= 0]
        n = len(words.dictionary)
        shared = np.bincount(terms, minlength=n) * np.bincount(flat, minlength=n).astype(float)
        common = np.flatnonzero(shared > COMMON * len(nl) * len(nr))
        common = common[np.argsort(-shared[common], kind="stable")[:COLUMNS]]
        column = np.full(n, -1)
        column[common] = np.arange(len(common))
        asked = np.zeros((len(nl), len(common)), np.float32)  # counts to 2^24 are exact
        asked[owners[column[terms] >= 0], column[terms[column[terms] >= 0]]] = 1
        rare = column[terms] < 0
        owners, terms = owners[rare], terms[rare]
        by_term = np.argsort(terms, kind="stable")
        owners, first = owners[by_term], np.searchsorted(terms[by_term], np.arange(n + 1))
        best_s, best_n = np.full((len(nl), k), -1.0), np.zeros((len(nl), k), names.dtype)
        step = max(16, (1 << 20) // len(nl))  # a table of so many counts at a time
        for at in range(0, len(names), step):
            rows = slice(at, at + step)
            size = len(names[rows])
            lo, hi = np.searchsorted(which, (at, at + size))
            term, place = flat[lo:hi], which[lo:hi] - at
            mine = column[term]
            table = np.zeros((size, len(common)), np.float32)
            table[place[mine >= 0], mine[mine >= 0]] = 1
            term, place = term[mine < 0], place[mine < 0]
            many = first[term + 1] - first[term]
            met = np.repeat(first[term] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            both = np.bincount(owners[met] * size + np.repeat(place, many), minlength=len(nl) * size).reshape(len(nl), size)
            both = both + asked @ table.T
            score = both / np.maximum(nl[:, None] + sizes[rows][None] - both, 1)  # nothing is shared with an empty set
            better = np.flatnonzero((score > best_s[:, -1:]).any(axis=1))
            every = np.concatenate([best_n[better], np.broadcast_to(names[rows], (len(better), size))], axis=1)
            score = np.concatenate([best_s[better], score[better]], axis=1)  # names ascend, so a stable order keeps smaller ones first
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            best_s[better], best_n[better] = np.take_along_axis(score, top, axis=1), np.take_along_axis(every, top, axis=1)
        full = (best_s >= 0).reshape(-1)
        n = np.repeat(np.arange(len(nl)), k)[full]
        columns = [left.column("id").take(pa.array(n))] + [left.column(c).take(pa.array(n)) for c in on]
        return pa.Table.from_arrays([*columns, pa.array(best_n.reshape(-1)[full]), pa.array(best_s.reshape(-1)[full])], schema=out)

    return run


#: Rows that a query's rarest terms may give for its first floor, for each of the k.
FIRST_LOOK = 16
#: Hash buckets of asked terms, which are broadcast so that the postings of other terms are not sent.
BUCKETS = 1 << 21
#: The share of a group's rows that a query may meet by its terms; one that would meet more is compared with all of them, in blocks.
MEET = 0.05


def _dense_top(l: DataFrame, r: DataFrame, on, k: int) -> DataFrame:
    """The k best of all right rows for each left row. The left rows of a group are cut into blocks and every block meets all right
    rows of the group, a block at a time, so a task's memory is bounded and no pair is a row; a row is sent once for each block of the other side of its own group."""
    sizes = lambda side, name: side.groupBy(*on).agg(F.count("*").alias(name))
    left, right = sizes(l, "n_l"), sizes(r, "n_r")
    small = F.least(F.ceil(F.col("n_r") * 8 / CANDIDATE_BLOCK), F.lit(LEAST_BLOCKS))
    groups = left.join(right, list(on)) if on else left.join(right, how="cross")  # one row each
    groups = written(groups.select(*on, F.greatest(F.ceil(F.col("n_l") / QUERY_BLOCK), F.lit(1)).cast("int").alias("n_l"), F.greatest(F.ceil(F.col("n_r") / CANDIDATE_BLOCK), small, F.lit(1)).cast("int").alias("n_r")), "group-blocks")
    known = lambda side: side.join(groups, list(on)) if on else side.join(F.broadcast(groups), how="cross")
    block = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    l = known(l).select("id", *on, "terms", block("id", "n_l").alias("lb"), others("n_r").alias("rb"))  # noqa: E741
    r = known(r).select("candidate", *(F.col(c).alias(f"r_{c}") for c in on), "r_terms", block("candidate", "n_r").alias("r_rb"), others("n_l").alias("r_lb"))
    schema = l.select("id", *on).schema.add("candidate", "long").add("similarity", "double")
    cell = _best_of_block(k, list(on), to_arrow_schema(schema))
    return l.groupBy(*on, "lb", "rb").cogroup(r.groupBy(*(f"r_{c}" for c in on), "r_lb", "r_rb")).applyInArrow(cell, schema)


def _scored(pairs: DataFrame, l: DataFrame, r: DataFrame, on) -> DataFrame:
    """id, on, candidate and the exact similarity of pairs (id, on, candidate)."""
    both = pairs.select("id", *on, "candidate").join(l.select("id", *on, "terms"), ["id", *on]).join(r.select("candidate", *on, "r_terms"), ["candidate", *on])
    return both.select("id", *on, "candidate", jaccard(F.col("terms"), F.col("r_terms")).cast("double").alias("similarity"))


def _sparse_top(l: DataFrame, r: DataFrame, on, k: int) -> tuple[DataFrame, DataFrame]:
    """(found, rest): pairs that hold the k best of the queries whose search by rare terms is cheap, and the other queries.

    A query's terms are in the order of their rarity among the right rows. The rows that its rarest terms lead to give a floor,
    the k-th best similarity so far. A row that shares none of the first p of a query's n terms is at most (n - p) / n
    similar, so p terms with (n - p) / n below the floor are enough, and their postings are what the search costs. Of the
    rows met, those whose sizes and shared terms still allow the floor are compared in full.
    """
    postings = r.select("candidate", *on, F.size("r_terms").alias("r_n"), F.explode("r_terms").alias("term"))
    rarity = postings.groupBy(*on, "term").agg(F.count("*").alias("df"))
    terms = l.select("id", *on, F.size("terms").alias("n"), F.explode("terms").alias("term")).join(rarity, [*on, "term"], "left").fillna(0, ["df"])
    order = Window.partitionBy("id", *on).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = written(terms.withColumn("p", F.row_number().over(order)).withColumn("cost", F.sum("df").over(order)), "rare-terms")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("bucket")

    def meet(asked: DataFrame) -> DataFrame:
        asked = asked.filter("df > 0")
        some = postings.withColumn("bucket", bucket).join(F.broadcast(asked.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
        return asked.join(some, [*on, "term"])

    met = meet(terms.filter(F.col("cost") <= FIRST_LOOK * k)).groupBy("id", *on, "candidate").agg(F.count("*").alias("m"))
    likely = Window.partitionBy("id", *on).orderBy(F.desc("m"), "candidate")
    first = written(_scored(met.withColumn("at", F.row_number().over(likely)).filter(F.col("at") <= 4 * k), l, r, on), "first-look")
    best = Window.partitionBy("id", *on).orderBy(F.desc("similarity"))
    floors = first.withColumn("at", F.row_number().over(best)).filter((F.col("at") == k) & (F.col("similarity") > 0)).select("id", *on, F.col("similarity").alias("floor"))
    sizes = r.groupBy(*on).agg(F.count("*").alias("rows")) if on else r.agg(F.count("*").alias("rows"))
    floors = floors.join(sizes, list(on)) if on else floors.join(F.broadcast(sizes), how="cross")  # one row
    # One term more than the bound asks for, so that rounding decides nothing.
    asked = terms.join(floors, ["id", *on]).filter(F.col("p") <= F.col("n") - F.floor(F.col("floor") * F.col("n") - 1e-9) + 1)
    costs = asked.groupBy("id", *on).agg(F.max("cost").alias("spent"), F.max("rows").alias("rows"), F.max("p").alias("reach"))
    cheap = written(costs.filter(F.col("spent") <= MEET * F.col("rows")).select("id", *on, "reach"), "cheap-queries")
    near = meet(asked.join(cheap, ["id", *on])).filter("r_n >= floor * n - 1e-6 AND r_n * floor <= n + 1e-6")
    near = near.groupBy("id", *on, "candidate").agg(F.count("*").alias("m"), F.max("n").alias("n"), F.max("r_n").alias("r_n"), F.max("reach").alias("reach"), F.max("floor").alias("floor"))
    most = F.least(F.col("m") + F.col("n") - F.col("reach"), F.col("r_n"), F.col("n"))
    near = near.filter(most >= F.col("floor") * (F.col("n") + F.col("r_n") - most) - 1e-6)
    return _scored(near, l, r, on), l.join(cheap, ["id", *on], "left_anti")


def top_similar(left: DataFrame, right: DataFrame, on, *, k: int = 3, sparse: bool | None = None) -> DataFrame:
    """The k most similar right rows of each left row in its group, by term Jaccard, then smaller id.

    left has id, the on-columns and distinct terms; right likewise, with a long id. Rows with a null in an on-column are in no
    group and take no part. Queries that few rows can match are searched by their rare terms, the others block by
    block; both are exact. ``sparse`` is on where the rows are more than a pair of blocks.
    """
    known = lambda side: side.dropna(subset=list(on)) if on else side
    l = known(left).select("id", *on, "terms")  # noqa: E741
    r = known(right).select(F.col("id").cast("long").alias("candidate"), *on, F.col("terms").alias("r_terms"))
    l, r = written(l, "queries"), written(r, "candidates")  # noqa: E741
    if sparse is None:
        sparse = l.count() > QUERY_BLOCK or r.count() > CANDIDATE_BLOCK
    if sparse:
        found, rest = _sparse_top(l, r, list(on), k)
        found = found.select("id", *on, "candidate", "similarity").union(_dense_top(written(rest.select("id", *on, "terms"), "dense-queries"), r, list(on), k))
    else:
        found = _dense_top(l, r, list(on), k)
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "candidate")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def best_name(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query the candidate name with the largest share of the query's tokens; the first of a tie.

    candidates has id (its order) and name; queries has query. Pairs meet by token.
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    q = queries.select("query", tokens(F.col("query")).alias("q")).select("query", F.greatest(F.size("q"), F.lit(1)).alias("nq"), F.explode("q").alias("t"))
    c = candidates.select("id", "name", F.explode(tokens(F.col("name"))).alias("t"))
    hits = q.join(c, "t").groupBy("query", "id", "name").agg((F.count("*") / F.first("nq")).alias("score"))
    first = candidates.agg(F.min_by("name", "id").alias("f_name"), F.min("id").alias("f_id"))
    best = hits.groupBy("query").agg(F.max_by(F.struct("name", "score"), F.struct("score", -F.col("id"))).alias("m"))
    out = queries.select("query").distinct().join(best, "query", "left").join(F.broadcast(first), how="cross")  # one row
    return out.select("query", F.coalesce("m.name", "f_name").alias("name"), F.coalesce("m.score", F.lit(0.0)).alias("score"))


def in_window(rows: DataFrame, windows: DataFrame, key: str = "event", day: str = "day") -> DataFrame:
    """Rows whose day lies in their event's window (first_day to last_day)."""
    return rows.join(windows.select(key, "first_day", "last_day"), key).filter(F.col(day).between(F.col("first_day"), F.col("last_day"))).drop("first_day", "last_day")


def document_slots(documents: DataFrame, slots: DataFrame, smoke: int | None = None) -> DataFrame:
    """Every document with every slot (a schema of a few dozen); smoke takes a slot-major slice."""
    pairs = documents.join(slots, how="cross")  # Spark broadcasts the slots when their size allows it
    if smoke is None:
        return pairs
    first = documents.groupBy("kind").agg(F.min("sitrep_id").alias("sitrep_id"))
    pairs = first.join(slots, how="cross")
    order = Window.orderBy("slot_id", "kind")  # a row for each kind and slot
    return pairs.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= smoke).drop("rn")


def report_manifest(raw: DataFrame, ingested: DataFrame) -> DataFrame:
    """Raw files with what became of them: admitted, or a reason. raw has file, sha; ingested has file, date."""
    copies = Window.partitionBy("sha").orderBy("file")
    flat = raw.withColumn("copy", F.row_number().over(copies)).join(ingested.select("file", F.col("date").alias("i_date")), "file", "left")
    reason = (
        F.when(F.col("i_date").isNotNull() & (F.col("i_date") != ""), "admitted").when(F.col("i_date") == "", "undated").when(F.col("copy") > 1, "duplicate").otherwise("not ingested")
    )
    return flat.select("file", "sha", reason.alias("reason"))
