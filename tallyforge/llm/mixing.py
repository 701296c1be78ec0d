"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of documents by a hash. Its target says how many whole passes over its
blocks and how many further blocks, in permuted order, the mix takes: the source's exact block quota.
A binary tree over the output shards splits the quotas: a node hands the left half of its shards a
draw without replacement from its blocks, counted by source, and the right half the rest. At the
leaves each shard owns a range of every source's permuted blocks, and rows shuffle inside the shard.

Only built-in functions are used. Documents meet the block table in one join; the block table has
at most ``MAX_BLOCKS`` rows and one more for each source, and is broadcast where its counted rows are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import WS_CLASS, col, stage

#: Words of a block in small corpora, and the number of blocks that bounds the block table in large ones.
BLOCK_WORDS, MAX_BLOCKS = 65_536, 65_536
#: No document is taken more often than this.
MAX_REPEATS = 3
#: Sources beyond this number share bundles in the tree's rows. A bundle's block copies stand in one random order of which
#: every shard owns a stretch, so the blocks of each source in a shard are still a hypergeometric draw, and each source's quota is exact.
MAX_BUNDLES = 1024
#: Rows of the block table up to which it is broadcast (about 100 bytes each); beyond, documents are shuffled to it.
BROADCAST_ROWS = 200_000
SEED = "mix-1"

_WORD = WS_CLASS.replace("[", "[^", 1) + "+"


def _hash60(*parts):
    """A uniform 60-bit integer from text parts, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _name(c):
    """A source as hashable text; a null source differs from every other."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c))


def _with_running(rows: DataFrame, order, sums: dict, label: str) -> DataFrame:
    """The rows with the sum of each expression over all rows before them in the order.

    Ranges of the order are partitions; the totals of the partitions, a row each, give every partition its start, so
    no task sees all rows.
    """
    names = [f"{n}_part" for n in sums]
    cut = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    cut = stage(cut.withColumns({n: e for n, e in zip(names, sums.values(), strict=True)}), label, files=4)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = cut.groupBy("part").agg(*(F.sum(n).alias(n) for n in names))
    totals = totals.select(F.col("part").alias("t_part"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_start") for n in names))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = {n: F.coalesce(F.sum(f"{n}_part").over(inside), F.lit(0)) + F.col(f"{n}_part_start") for n in sums}
    return cut.join(F.broadcast(totals), F.col("part") == F.col("t_part")).withColumns(running).drop("part", "t_part", *names, *(f"{n}_start" for n in names))


def targets(sized: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """source, source_size, rank and target of every source.

    Sources in code point order, null last, weigh ``weights`` in turn and share all words. No target
    exceeds MAX_REPEATS times its source: the excess goes to the others by weight. That is the level
    at which min(cap, level * weight) adds up to all words, found by one ordered scan of the sources.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = _with_running(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "mix-ranks").withColumn("rank", F.col("rank") + 1)
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_REPEATS).withColumn("ratio", F.col("cap") / F.col("weight"))
    sources = _with_running(sources, ["ratio", "rank"], {"capped_before": F.col("cap"), "weight_before": F.col("weight")}, "mix-ratios")
    level = (F.col("all_size") - F.col("capped_before")) / (F.col("all_weight") - F.col("weight_before"))
    sums = sources.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    sources = sources.join(F.broadcast(sums), how="cross").withColumn("own_level", level)  # one row
    least = sources.filter("ratio > own_level").agg(F.min(F.struct("ratio", "rank", "own_level"))["own_level"].alias("level"))
    sources = sources.join(F.broadcast(least), how="cross")  # one row
    capped = F.col("level").isNull() | (F.col("ratio") <= F.col("level"))
    return sources.select(
        "source",
        "source_size",
        "rank",
        "all_size",
        F.when(capped, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"),
        F.when(capped, F.lit(MAX_REPEATS)).otherwise(
            F.floor(F.col("level") * F.col("weight") / F.greatest(F.col("source_size"), F.lit(1)))
        ).cast("long").alias("passes"),
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    text = col(text_col)
    return docs.select(
        F.struct(*map(col, docs.columns)).alias("row"),
        col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        _hash60(
            F.lit(seed), F.coalesce(col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))
        ).alias("h"),
    )


def plan(sized: DataFrame, *, block_words: int = BLOCK_WORDS, weights=(1, 2, 3), seed: str = SEED) -> DataFrame:
    """The block table: for each (source, block) the passes over it and, in the cut block, the last hash.

    ``take`` is the number of whole passes; ``extra`` is 2 when the further pass takes the whole
    block, 1 when it takes the documents of at most ``room`` words up to ``cut`` in hash order, 0 when it takes none.
    """
    size = F.greatest(F.lit(block_words), F.ceil(F.col("all_size") / MAX_BLOCKS))
    sources = targets(sized, weights).withColumn("n_blocks", F.greatest(F.ceil(F.col("source_size") / size), F.lit(1)).cast("long"))
    sources = stage(sources.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))), "mix-sources", files=4)
    same = F.col("source").eqNullSafe(F.col("b_source"))
    hashed = sized.select(F.col("source").alias("b_source"), "size", "h").join(sources.select("source", "n_blocks"), same)
    hashed = hashed.select("b_source", F.pmod("h", "n_blocks").alias("block"), "size", "h")
    blocks = hashed.groupBy("b_source", "block").agg(F.sum("size").alias("block_size"))
    order = Window.partitionBy("b_source").orderBy("b_hash", "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = stage(
        blocks.join(sources, same)
        .withColumn("b_hash", _hash60(F.lit(seed), F.lit("block"), _name(F.col("b_source")), F.col("block").cast("string")))
        .withColumn("after", F.sum("block_size").over(order))
        .withColumn("before", F.col("after") - F.col("block_size"))
        .withColumn("extra", F.expr("CASE WHEN passes >= 3 THEN 0 WHEN after <= rest THEN 2 WHEN before < rest THEN 1 ELSE 0 END"))
        .drop("source"),
        "mix-blocks",
        files=4,
    )
    # The cut block of each source: documents in hash order while the middle of each is within the rest. One that is
    # larger than all that is left is passed over, and those behind it are taken.
    cut = blocks.filter("extra = 1").select(
        F.col("b_source").alias("c_source"), F.col("block").alias("c_block"), (F.col("rest") - F.col("before")).alias("left_over")
    )
    by_hash = Window.partitionBy("b_source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        hashed.join(cut, F.col("b_source").eqNullSafe(F.col("c_source")) & (F.col("block") == F.col("c_block")))
        .filter("size <= left_over")
        .groupBy("b_source", "block", "h", "left_over")
        .agg(F.sum("size").alias("size"))
        .withColumn("through", F.sum("size").over(by_hash))
        .filter("2 * through - size < 2 * left_over")
        .groupBy(F.col("b_source").alias("c_source"))
        .agg(F.max("h").alias("cut"))
    )
    return blocks.join(cuts, F.col("b_source").eqNullSafe(F.col("c_source")), "left").select(
        "b_source", "block", "b_hash", "source_size", "target", "n_blocks", "rank", F.col("passes").alias("take"), "extra",
        F.when(F.col("extra") == 1, F.coalesce("cut", F.lit(-1))).alias("cut"), F.when(F.col("extra") == 1, F.col("rest") - F.col("before")).alias("room"),
    )


def _split(quotas, wanted, node):
    """The left child's quotas: a draw of ``wanted`` blocks without replacement, counted by bundle.

    Selection sampling: each block goes left with probability (still wanted / still to come), which
    makes the counts multivariate hypergeometric.
    """
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda acc, q: acc + q)

    def uniform(b, t):
        return F.pmod(F.xxhash64(F.lit(SEED), node, b, t), F.lit(1 << 53)) / F.lit(float(1 << 53))

    def bundle(acc, q, b):
        def block(a, t):
            left = uniform(b, t) * a["to_come"] < a["wanted"]
            return F.struct(
                F.when(left, a["wanted"] - 1).otherwise(a["wanted"]).alias("wanted"),
                (a["to_come"] - 1).alias("to_come"),
                F.when(left, a["got"] + 1).otherwise(a["got"]).alias("got"),
            )

        steps = F.filter(F.sequence(F.lit(0).cast("long"), q), lambda t: t > 0)
        done = F.aggregate(
            steps,
            F.struct(acc["wanted"].alias("wanted"), acc["to_come"].alias("to_come"), F.lit(0).cast("long").alias("got")),
            block,
        )
        return F.transform(
            F.array(done),
            lambda d: F.struct(
                d["wanted"].alias("wanted"), d["to_come"].alias("to_come"), F.concat(acc["out"], F.array(d["got"])).alias("out")
            ),
        )[0]

    indexed = F.transform(quotas, lambda q, i: F.struct(q.alias("q"), i.alias("i")))
    return F.aggregate(
        indexed,
        F.struct(wanted.alias("wanted"), total.alias("to_come"), F.array().cast("array<long>").alias("out")),
        lambda acc, x: bundle(acc, x["q"], x["i"]),
        lambda acc: acc["out"],
    )


def shard_quotas(blocks: DataFrame, n_shards: int) -> DataFrame:
    """bundle, shard, lo, hi: the range of the bundle's permuted block copies that each shard owns."""
    quotas = blocks.groupBy("bundle").agg(F.count("*").alias("q"))
    root = (  # one row of at most MAX_BUNDLES numbers
        quotas.agg(F.array_sort(F.collect_list(F.struct("bundle", "q"))).alias("qs"))
        .select(F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), F.expr("transform(qs, x -> x.bundle)").alias("names"), F.expr("transform(qs, x -> x.q)").alias("qs"))
    )
    nodes = root
    for _ in range(max(n_shards - 1, 0).bit_length()):
        mid = F.expr("(lo + hi) div 2").cast("int")
        total = F.aggregate("qs", F.lit(0).cast("long"), lambda acc, q: acc + q)
        wanted = F.round(total * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        parts = nodes.filter("hi - lo > 1").withColumn("mid", mid).withColumn(
            "left", _split(F.col("qs"), wanted, F.concat_ws("-", "lo", "hi"))
        )
        halves = parts.select(
            "names",
            F.explode(
                F.array(
                    F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("left").alias("qs")),
                    F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.zip_with("qs", "left", lambda a, b: a - b).alias("qs")),
                )
            ).alias("half"),
        ).select("half.lo", "half.hi", "names", "half.qs")
        nodes = stage(nodes.filter("hi - lo <= 1").unionByName(halves), "mix-nodes", files=4)
    leaves = nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("names", "qs")).alias("x")).select(
        "shard", F.col("x.names").alias("bundle"), F.col("x.qs").alias("q")
    )
    upto = Window.partitionBy("bundle").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return leaves.withColumn("hi", F.sum("q").over(upto)).select("bundle", "shard", (F.col("hi") - F.col("q")).alias("lo"), "hi")


def mix(
    docs: DataFrame,
    *,
    n_shards: int = 16,
    weights=(1, 2, 3),
    block_words: int = BLOCK_WORDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every document with its copies in the mix.

    Returns ``row`` (the document as a struct), source, size (words), source_size, target, and
    ``copies``, an array of struct<copy, shard, place>: empty for documents that the mix leaves out.
    ``place`` is the order inside the shard.

    Null texts have size 0. Null sources are a source of their own, the last. Exact repeats of a row
    share their hash and are taken or left together. An empty table gives no rows. The result
    depends on ids, texts and the seed alone, so reruns and other file layouts agree.
    """
    sized = _sized(docs, id_col, text_col, source_col, seed)
    slim = stage(sized.select("source", "size", "h"), "mix-sizes")
    blocks = stage(plan(slim, block_words=block_words, weights=weights, seed=seed), "mix-plan", files=4)
    copies = stage(
        blocks.withColumn("copy", F.explode(F.expr("sequence(0, cast(take + CASE WHEN extra > 0 THEN 1 ELSE 0 END as int))")))
        .filter("copy < take + CASE WHEN extra > 0 THEN 1 ELSE 0 END")
        .withColumn("bundle", F.pmod("rank", F.lit(MAX_BUNDLES)))
        .withColumn("c_hash", _hash60(F.lit(seed), F.lit("copy"), _name(F.col("b_source")), F.col("block").cast("string"), F.col("copy").cast("string")))
        .withColumn("at", F.row_number().over(Window.partitionBy("bundle").orderBy("c_hash", "b_hash", "copy")) - 1)
        .select("b_source", "block", "copy", "bundle", "at"),
        "mix-copies",
        files=4,
    )
    ranges = shard_quotas(copies, n_shards).withColumnRenamed("bundle", "r_bundle")
    placed = (
        copies.join(ranges, (F.col("bundle") == F.col("r_bundle")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
        .groupBy(F.col("b_source").alias("p_source"), F.col("block").alias("p_block"))
        .agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("copies"))  # at most MAX_REPEATS
    )
    table = blocks.join(placed, F.col("b_source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")), "left").select(
        "b_source", "block", "source_size", "target", "take", "extra", "cut", "room", "copies"
    )
    table = stage(table, "mix-table", files=4)
    counts = blocks.select(F.col("b_source").alias("n_source"), "n_blocks").distinct()
    if table.count() <= BROADCAST_ROWS:
        table, counts = F.broadcast(table), F.broadcast(counts)
    return (
        sized.join(counts, F.col("source").eqNullSafe(F.col("n_source")))
        .withColumn("my_block", F.pmod("h", "n_blocks"))
        .join(table, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("my_block") == F.col("block")))
        .select(
            "row",
            "source",
            "size",
            "source_size",
            "target",
            F.transform(
                F.filter(
                    F.coalesce("copies", F.array().cast("array<struct<copy:int,shard:int>>")),
                    lambda c: (c["copy"] < F.col("take")) | (F.col("extra") == 2) | ((F.col("h") <= F.coalesce("cut", F.lit(-1))) & (F.col("size") <= F.coalesce("room", F.lit(0.0)))),
                ),
                lambda c: F.struct(c["copy"].alias("copy"), c["shard"].alias("shard"), F.xxhash64(F.lit(seed), "h", c["copy"]).alias("place")),
            ).alias("copies"),
        )
    )


def materialise(mixed: DataFrame, columns: list[str], n_shards: int = 16) -> DataFrame:
    """The mix as rows of ``columns``: a row for each copy, shards kept together, shuffled inside.

    A shard is cut by place into as many partitions as the session's shuffle partitions allow it, so a
    task's size does not depend on the number of shards. Partitions are named outright: no sampling.
    """
    parts = max(1, int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_shards)
    flat = mixed.select("row", F.explode("copies").alias("c"))
    probe = flat.select("c.shard", "c.place", *(F.col("row")[c].alias(f"v{i}") for i, c in enumerate(columns)))
    # place is a uniform signed 64-bit integer; its top 31 bits, from 0, scaled to the parts.
    sub = F.shiftright(((F.shiftrightunsigned("place", 33)).bitwiseXOR(F.lit(1 << 30).cast("long"))) * parts, 31)
    return (
        probe.repartitionById(n_shards * parts, (F.col("shard") * parts + sub).cast("int"))
        .sortWithinPartitions("shard", "place")
        .select(*(F.col(f"v{i}").alias(c) for i, c in enumerate(columns)))
    )
