"""Phrase collocations from suffix automata of shards.

A phrase that is frequent consists of frequent words, pairs and triples, so these are found first. Words are counted as texts; the
frequent ones are numbered, and the texts are staged as these numbers. Pairs of numbers are counted exactly, as one long each. Triples over
frequent pairs are counted in buckets of a hash: a bucket that is not frequent holds no frequent triple. There are so many buckets that
one has a quarter of the threshold on average at most, whatever the input. A task sends its buckets as offsets in ranges of them.

What is left are stretches of words in which every triple may be frequent. They are dealt to tasks of a few million words each. The states
of the generalised suffix automaton of such a shard, cut at a depth, are the classes of
phrases that end at the same places; a state's suffix link leads to the class of its longest suffix that ends
at more places. Both are found without online extension: end positions are refined by one more word to
the left at a time, which gives the tree of suffix links, and a node whose places a longer one shares
belongs to that one's state. A state travels as its longest phrase, the length of its shortest, and its endpos
count, which all phrases between have; counts are summed over shards, as texts, so that a hash decides nothing. States meet by their last
three words, which all their phrases share.

A phrase is subsumed where one of its extensions by one word occurs as often: the phrase is then the extension's suffix
(its suffix link) or its prefix, and extensions by more words are covered by those by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .staging import col, if_small, lean, stage

#: Bytes of text that are cut into words at a time; a longer text is taken whole.
SHARD = 4 << 20
#: Words or pairs that a task sums at a time, and words that one automaton has.
HELD_PAIRS, HELD_WORDS = 4_000_000, 4_000_000
#: Frequent words up to which they are numbered and go to all tasks; beyond, all phrases are counted as texts.
WORDS = 4_000_000
#: Frequent pairs, and buckets of triples, up to which they go to all tasks (8 bytes each); beyond, they rule nothing out.
PAIRS = BUCKETS = 4_000_000
#: Words of a row of numbered texts; a stretch without a break may be longer.
ROW_WORDS = 1 << 12
#: Bits of an offset in a range of buckets.
RANGE_BITS = 16
#: Rows up to which a table of counts is broadcast.
BROADCAST_ROWS = 200_000
#: Parts in which the best of a group are found first.
SALTS = 64
_BREAK = "\n"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers with -1 at breaks, the words, and the row of each: breaks are at [.,;:!?\\x0A-\\x0D] and ends of texts."""
    text = pc.ascii_lower(pc.fill_null(texts, ""))
    text = pc.replace_substring(pc.replace_substring_regex(text, "[.,;:!?\n-\r]", f" {_BREAK} "), "\t", " ")
    parts = pc.split_pattern(pc.binary_join_element_wise(text, _BREAK, " "), " ")
    row = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy())
    flat = parts.flatten()
    full = pc.not_equal(flat, "")
    coded = flat.filter(full).dictionary_encode()
    at = pc.index_in(pa.scalar(_BREAK, flat.type), value_set=coded.dictionary).as_py()
    ids = coded.indices.to_numpy().astype(np.int64)
    ids[ids == at] = -1
    return ids, coded.dictionary, row[full.to_numpy(zero_copy_only=False)]


class Automaton:
    """The states of a shard: ``end`` (a place where the class ends), ``longest`` and ``shortest`` in words, ``count``.

    ``groups`` parts the words (texts of different languages share no state); ``reach`` bounds the length of the phrases that
    end at a place.
    """

    def __init__(self, ids: np.ndarray, groups: np.ndarray, reach: np.ndarray, depth: int, least: int = 1):
        places = np.flatnonzero(reach >= least)
        node = np.unique(groups[places].astype(np.int64) << 40 | ids[places], return_inverse=True)[1]
        self.end = self.longest = self.shortest = self.count = np.empty(0, np.int64)
        parent = None  # of a node of the depth before: where its state starts, its count and a place
        for length in range(1, depth + 1):
            if length > 1:
                deeper = reach[places] >= length
                places, node = places[deeper], node[deeper]
                above = node
                node = np.unique(node << 32 | ids[places - length + 1], return_inverse=True)[1]
            count = np.bincount(node)
            end = np.zeros(len(count), np.int64)
            end[node] = places
            shortest = np.full(len(count), length)
            if parent is not None:
                up = np.zeros(len(count), np.int64)
                up[node] = above
                start, above_count, above_end = parent
                same = above_count[up] == count  # the longer phrase ends wherever the shorter one does
                shortest[same] = start[up[same]]
                closed = np.ones(len(start), bool)
                closed[up[same]] = False
                self._add(above_end[closed], length - 1, start[closed], above_count[closed], least)
            parent = (shortest, count, end)
        self._add(parent[2], depth, parent[0], parent[1], least)

    def _add(self, end, longest, shortest, count, least) -> None:
        if longest >= least:
            self.end = np.concatenate([self.end, end])
            self.longest = np.concatenate([self.longest, np.full(len(end), longest)])
            self.shortest = np.concatenate([self.shortest, np.maximum(shortest, least)])
            self.count = np.concatenate([self.count, count])


def _since(flags: np.ndarray) -> np.ndarray:
    """How many places ago, this one included, the last false flag was (0 at it)."""
    at = np.arange(len(flags))
    return at - np.maximum.accumulate(np.where(flags, -1, at))


def _phrases(ids: np.ndarray, words: pa.Array, end: np.ndarray, longest: np.ndarray) -> pa.Array:
    columns = []
    for back in range(int(longest.max(initial=1)) - 1, -1, -1):
        at = np.where(longest > back, ids[np.maximum(end - back, 0)], -1)
        columns.append(words.take(pa.array(at, pa.int32(), mask=at < 0)))
    return columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, " ", null_handling="skip")


class _Shard:
    """The words of some texts: numbers with -1 at breaks, their langs, and how many words of a piece end at each."""

    def __init__(self, held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        langs = table.column(0).combine_chunks().dictionary_encode()
        self.langs = langs.dictionary.cast(pa.string())
        self.ids, words, row = _words(table.column(1).combine_chunks())
        self.words = words.cast(pa.string())
        self.group = langs.indices.to_numpy().astype(np.int64)[row]
        self.inside = self.ids >= 0

    def distinct(self):
        """The langs and texts of the words, the number of each place's word among them, and how often they occur."""
        key, place, count = np.unique((self.group << 32 | self.ids)[self.inside], return_inverse=True, return_counts=True)
        return self.langs.take(pa.array(key >> 32)), self.words.take(pa.array(key & 0xFFFFFFFF)), place, count


def _shards(batches, shard: int):
    """The shards of a task's texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= shard:
            yield _Shard(held)
            held, size = [], 0
    if size:
        yield _Shard(held)


def _sliced(columns, names):
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    for at in range(0, batch.num_rows, 50_000):
        yield batch.slice(at, 50_000)


def _word_counts(shard_bytes: int):
    """lang, phrase, count: words, and without a phrase the number of words of a lang; summed over a task's shards."""
    names, schema = ["lang", "phrase", "count"], pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("count", pa.int64())])

    def run(batches):
        held = schema.empty_table()
        for shard in _shards(batches, shard_bytes):
            langs, words, _, count = shard.distinct()
            total = np.bincount(shard.group[shard.inside], minlength=len(shard.langs))
            new = [pa.table([langs, words, pa.array(count)], schema=schema), pa.table([shard.langs, pa.nulls(len(total), pa.string()), pa.array(total)], schema=schema)]
            held = pa.concat_tables([held, *new]).group_by(names[:2]).aggregate([("count", "sum")]).rename_columns(names)
            if held.num_rows > HELD_PAIRS:
                yield from held.to_batches(50_000)
                held = schema.empty_table()
        yield from held.to_batches(50_000)

    return run


def _numbered(langs: pa.Array, words: pa.Array, shard_bytes: int):
    """ids: words as int32 places in the list of words, with -1 for other words, at breaks and at the end; many short rows, as they are bytes."""

    def run(batches):
        known = pc.binary_join_element_wise(langs, words, _BREAK)  # no word has a break in it
        for shard in _shards(batches, shard_bytes):
            own_langs, own_words, place, _ = shard.distinct()
            number = pc.index_in(pc.binary_join_element_wise(own_langs, own_words, _BREAK), value_set=known)
            ids = np.full(len(shard.ids), -1, np.int32)
            ids[shard.inside] = pc.fill_null(number, -1).to_numpy()[place]
            keep = ids >= 0
            keep[1:] |= keep[:-1].copy()
            ids = ids[keep]
            ends = np.flatnonzero(ids < 0) + 1
            cuts = np.unique(ends[np.minimum(np.searchsorted(ends, np.arange(ROW_WORDS, len(ids), ROW_WORDS)), len(ends) - 1)])
            for row in np.split(ids, cuts):
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array([row.tobytes()], pa.binary())], names=["ids"])

    return run


def _unpacked(batches, name: str = "ids", kind=np.int32):
    for batch in batches:
        for packed in batch.column(name):
            yield np.frombuffer(packed.as_py(), kind)


def _joined(batches):
    """All numbers of a batch of rows at a time, as each row ends with a break."""
    for batch in batches:
        yield np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.int32)


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where pairs end, and the pairs as longs."""
    at = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0)) + 1
    return at, ids[at - 1].astype(np.int64) << 32 | ids[at]


def _summed_by(values, most: int):
    """Distinct values with their counts, of up to ``most`` values at a time."""
    held, size = [], 0
    for value in values:
        held.append(value)
        size += len(value)
        if size >= most:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
    if size:
        yield np.unique(np.concatenate(held), return_counts=True)


def _pair_counts(batches):
    """pair, count."""
    for pair, count in _summed_by((_pairs(ids)[1] for ids in _joined(batches)), HELD_PAIRS):
        yield from _sliced([pa.array(pair), pa.array(count)], ["pair", "count"])


def _pair_texts(langs: pa.Array, words: pa.Array):
    """lang, phrase, words, count of pairs of numbers."""

    def run(batches):
        for batch in batches:
            pair = batch.column(0).to_numpy()
            left, right = pa.array(pair >> 32), pa.array(pair & 0xFFFFFFFF)
            phrase = pc.binary_join_element_wise(words.take(left), words.take(right), " ")
            yield pa.RecordBatch.from_arrays([langs.take(left), phrase, pa.array(np.full(len(pair), 2)), batch.column(1)], names=["lang", "phrase", "words", "count"])

    return run


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _triples(ids: np.ndarray, known: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where triples of two known pairs end (of any pairs without known ones), and the buckets of the triples."""
    at, pair = _pairs(ids)
    if known is not None:
        ok = _among(known, pair)
        at, pair = at[ok], pair[ok]
    second = np.flatnonzero(np.diff(at) == 1) + 1
    h = pair[second - 1].view(np.uint64) * _STEP
    h ^= h >> np.uint64(29)
    h = (h + ids[at[second]].astype(np.uint64)) * _STEP
    return at[second], (h >> np.uint64(64 - bits)).astype(np.int64)


def _bucket_counts(known: np.ndarray | None, bits: int, least: int):
    """range, offset, count: a task's buckets in a range, packed; counts up to the threshold, as more says no more."""

    def run(batches):
        for bucket, count in _summed_by((_triples(ids, known, bits)[1] for ids in _joined(batches)), HELD_PAIRS):
            part, start = np.unique(bucket >> RANGE_BITS, return_index=True)
            offset = (bucket & (1 << RANGE_BITS) - 1).astype(np.uint16)
            count = np.minimum(count, least).astype(np.int32)
            packed = [pa.array([x.tobytes() for x in np.split(c, start[1:])] if len(part) else [], pa.binary()) for c in (offset, count)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *packed], names=["range", "offset", "count"])

    return run


def _frequent_buckets(least: int):
    """bucket: those with the least sum, of the ranges that a task has."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            columns = _unpacked([batch], "offset", np.uint16), _unpacked([batch], "count")
            for part, offset, count in zip(batch.column("range").to_pylist(), *columns, strict=True):
                sums.setdefault(part, np.zeros(1 << RANGE_BITS, np.int64))[offset] += count
        for part, total in sums.items():
            yield from _sliced([pa.array(part << RANGE_BITS | np.flatnonzero(total >= least))], ["bucket"])

    return run


def _stretches(depth: int, known: np.ndarray | None, buckets: np.ndarray | None, bits: int):
    """ids, reach, size: the words that may be in a frequent phrase of three words or more, and how long those that end at each may be."""

    def run(batches):
        for ids in _unpacked(batches):
            at, bucket = _triples(ids, known, bits)
            ok = np.zeros(len(ids), bool)
            ok[at if buckets is None else at[_among(buckets, bucket)]] = True
            reach = np.where(ok, np.minimum(_since(ok) + 2, depth), 0).astype(np.int8)
            keep = ok.copy()
            keep[:-1] |= ok[1:]
            keep[:-2] |= ok[2:]
            if keep.any():
                columns = [pa.array([x[keep].tobytes()], pa.binary()) for x in (ids, reach)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([int(keep.sum())])], names=["ids", "reach", "size"])

    return run


_STATE = "lang string, phrase string, shortest long, longest long, count long"


def _state_rows(ids, words, langs, end, longest, shortest, count):
    """Rows of states; langs has the lang of each of them."""
    for lo in range(0, len(end), 50_000):
        part = slice(lo, lo + 50_000)
        columns = [langs(end[part]), _phrases(ids, words, end[part], longest[part]).cast(pa.string()), *(pa.array(c[part]) for c in (shortest, longest, count))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "shortest", "longest", "count"])


def _phrase_states(depth: int, langs: pa.Array, words: pa.Array):
    """lang, phrase, shortest, longest, count of the states of phrases of three words or more in stretches. A task's stretches are one
    automaton while they fit."""

    def states(held):
        ids, reach = (np.concatenate(c) for c in zip(*held, strict=True))
        found = Automaton(ids, np.zeros(len(ids), np.int64), reach, depth, 3)
        yield from _state_rows(ids, words, lambda end: langs.take(pa.array(ids[end])), found.end, found.longest, found.shortest, found.count)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for one in zip(_unpacked([batch]), _unpacked([batch], "reach", np.int8), strict=True):
                held.append(one)
                size += len(one[0])
                if size >= HELD_WORDS:
                    yield from states(held)
                    held, size = [], 0
        if held:
            yield from states(held)

    return run


def _all_states(depth: int, shard_bytes: int):
    """lang, phrase, shortest, longest, count of the states of all phrases of two words or more, a shard at a time. The pair of a
    state with longer phrases is a row of its own."""

    def run(batches):
        for shard in _shards(batches, shard_bytes):
            found = Automaton(shard.ids, shard.group, np.minimum(_since(shard.inside), depth), depth, 2)
            end, longest, shortest, count = found.end, found.longest, found.shortest, found.count
            both = (shortest == 2) & (longest > 2)
            end, count = np.concatenate([end, end[both]]), np.concatenate([count, count[both]])
            shortest = np.concatenate([np.where(both, 3, shortest), shortest[both]])
            longest = np.concatenate([longest, np.full(int(both.sum()), 2)])
            yield from _state_rows(shard.ids, shard.words, lambda end, s=shard: s.langs.take(pa.array(s.group[end])), end, longest, shortest, count)

    return run


def _counts(states: DataFrame, *by: str) -> DataFrame:
    """lang, phrase, words, count: each state counts for its phrases from the shortest to the longest."""
    each = states.withColumn("words", F.explode(F.sequence("shortest", "longest")))
    each = each.withColumn("phrase", F.when(F.col("words") == F.col("longest"), F.col("phrase")).otherwise(F.expr("substring_index(phrase, ' ', -cast(words as int))")))
    return each.groupBy(*by, "lang", "phrase", "words").agg(F.sum("count").alias("count"))


def _summed(states: DataFrame, parts: int, least: int) -> DataFrame:
    """lang, phrase, words, count of the frequent phrases of states."""
    states = states.withColumn("tail", F.expr("substring_index(phrase, ' ', -3)")).repartition(parts, "lang", "tail")
    return _counts(states, "tail").drop("tail").filter(F.col("count") >= least)


def _known(df: DataFrame, most: int) -> np.ndarray | None:
    """The values of a staged table's first column in order, if it is not too large."""
    if df.count() > most:
        return None
    return np.sort(df.select(df.columns[0]).toArrow().column(0).to_numpy())


def _parts(df: DataFrame) -> int:
    """A partition for every 8 MB that the plan reads, where the size is known from its files; adaptive execution leaves the number as it is."""
    size, least = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 56 else max(least, min(size >> 23, 100_000))  # Spark takes 8 EB for rows that come from no file


def frequent_phrases(texts: DataFrame, *, depth: int = 5, least: int = 100, shard: int = SHARD) -> DataFrame:
    """The staged phrases (lang, phrase, words, count) of up to ``depth`` words that occur ``least`` times in a lang,
    and for each lang its number of words, as a row with a null phrase. texts has lang and text."""
    if depth < 2:
        raise ValueError("depth has to be at least 2")
    parts, counted = _parts(texts), "lang string, phrase string, count long"
    # Tasks have summed what they hold, so rows go to their keys at once instead of into another table of sums.
    first = texts.mapInArrow(lean(_word_counts(shard)), counted).repartition(parts, "lang", "phrase").groupBy("lang", "phrase").agg(F.sum("count").alias("count"))
    first = stage(first.filter((F.col("count") >= least) | F.col("phrase").isNull()), "words")
    singles = first.select("lang", "phrase", F.when(F.col("phrase").isNotNull(), 1).otherwise(0).cast("long").alias("words"), "count")
    known = first.filter("phrase IS NOT NULL").select("lang", "phrase")
    if known.count() > WORDS:
        states = texts.mapInArrow(lean(_all_states(depth, shard)), _STATE)
        return singles.union(stage(_summed(states, parts, least), "phrases"))
    known = known.toArrow().combine_chunks()
    langs, words = (pa.concat_arrays([c.cast(pa.string()) for c in known.column(name).chunks] or [pa.array([], pa.string())]) for name in ("lang", "phrase"))
    texts = stage(texts.mapInArrow(lean(_numbered(langs, words, shard)), "ids binary"), "numbered")
    pairs = texts.mapInArrow(lean(_pair_counts), "pair long, count long").repartition(parts, "pair").groupBy("pair").agg(F.sum("count").alias("count"))
    pairs = stage(pairs.filter(F.col("count") >= least), "pairs")
    shorter = singles.union(stage(pairs.mapInArrow(lean(_pair_texts(langs, words)), "lang string, phrase string, words long, count long"), "pair-texts"))
    if depth == 2:
        return shorter
    pairs = _known(pairs, PAIRS)
    total = first.filter("phrase IS NULL").agg(F.sum("count")).first()[0] or 0
    bits = min(max((4 * total // least).bit_length(), RANGE_BITS), 62)
    buckets = texts.mapInArrow(lean(_bucket_counts(pairs, bits, least)), "range long, offset binary, count binary").repartition(parts, "range")
    buckets = _known(stage(buckets.mapInArrow(lean(_frequent_buckets(least)), "bucket long"), "buckets"), BUCKETS)
    texts = stage(texts.mapInArrow(lean(_stretches(depth, pairs, buckets, bits)), "ids binary, reach binary, size long"), "stretches")
    size = texts.agg(F.sum("size")).first()[0] or 0
    texts = texts.select("ids", "reach").coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, size // HELD_WORDS + 1))
    states = texts.mapInArrow(lean(_phrase_states(depth, langs, words)), _STATE)
    return shorter.union(stage(_summed(states, parts, least), "phrases"))


def collocations(
    docs: DataFrame, *, depth: int = 5, least: int = 100, best: int | None = 2000, text_col: str = "text", lang_col: str | None = "lang", shard: int = SHARD
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of 2 to ``depth`` words that occur ``least`` times, by score.

    Texts are A-Z lower-cased, cut into pieces at [.,;:!?\\x0A-\\x0D], and words are [^\\x20\\x09]+; a null text has none.
    All is by lang (null: ``und``). n counts words; a counts the phrase; a cut into two parts with counts l and r has the score
    floor(1000 * a * n / (l * r)), and the cut with the lowest counts (ties: after fewer words). A phrase inside a longer
    one that occurs as often is left out. The ``best`` of each lang are kept (None: all), ties by a, then by phrase in byte
    order. Products are exact up to 38 digits and raise beyond. Repeated rows count as often as they come; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    lang = col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = frequent_phrases(texts, depth=depth, least=least, shard=shard)
    known, totals = counted.filter("phrase IS NOT NULL"), counted.filter("phrase IS NULL").select(F.col("lang").alias("t_lang"), F.col("count").alias("n"))
    cands = known.filter("words >= 2")
    suffix, prefix = F.expr("substring_index(phrase, ' ', -cast(words - 1 as int))"), F.expr("substring_index(phrase, ' ', cast(words - 1 as int))")
    longer = cands.filter("words > 2").select(F.col("lang").alias("x_lang"), "count", F.explode(F.array(suffix, prefix)).alias("part"))
    longer = longer.groupBy("x_lang", "part").agg(F.max("count").alias("most"))
    kept = cands.join(longer, (F.col("lang") == F.col("x_lang")) & (F.col("phrase") == F.col("part")), "left").filter("most IS NULL OR most < count")
    kept = stage(kept.select("lang", "phrase", "words", F.col("count").alias("a")), "candidates", files=16)
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, cast(words - 1 as int))")))
    for side, at in (("l", "k"), ("r", "-(cast(words as int) - k)")):
        part = known.select(F.col("lang").alias(f"{side}_lang"), F.col("phrase").alias(f"{side}_part"), F.col("count").alias(side))
        cuts = cuts.withColumn("cut", F.expr(f"substring_index(phrase, ' ', {at})"))
        cuts = cuts.join(if_small(part, BROADCAST_ROWS), (F.col("lang") == F.col(f"{side}_lang")) & (F.col("cut") == F.col(f"{side}_part")))
    cuts = cuts.join(if_small(totals, BROADCAST_ROWS), F.col("lang") == F.col("t_lang"))
    big = lambda c: f"cast({c} as decimal(38,0))"
    cuts = cuts.withColumn("score", F.expr(f"({big('a')} * {big('n')} * {big('1000')}) div ({big('l')} * {big('r')})"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    scored = scored.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if best is not None:
        salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= best)
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    else:
        ranked = scored.withColumn("rank", F.lit(None).cast("long"))
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
