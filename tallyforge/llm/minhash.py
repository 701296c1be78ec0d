"""Near-duplicates by one-permutation hashing with optimal densification.

A document's shingles are hashed once; the range of hashes is cut into bins and each bin keeps its
least hash. An empty bin takes the value of the bin that a universal hash of (bin, attempt) picks first
among the full ones. Bands of bins are bucket keys. Texts with equal words are one node; in a bucket
of nodes a star joins each to the bucket's centre, so a bucket gives fewer pairs than members. Every pair
is confirmed on the full shingle sets. Buckets of two bands then get stars between the components they
still hold; buckets that hold one component are settled and leave. At the end every bucket that still holds several components is searched whole: all pairs of
members of different components are confirmed, in blocks. Connected components give the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .components import components, spanning
from .staging import col, files_for, if_small, lean, stage

N_BINS, ROWS = 128, 4
#: Rounds of stars in buckets of two bands at most; the search of open buckets after them is exact in any case.
STAR_ROUNDS = 2
#: Members of a star that one task confirms.
STAR_TEXTS = 256
#: Members, and shingles, of a block when the pairs of a bucket are searched whole.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
#: Members of a block that share a shingle from which on the shingle is counted by a product of matrices.
HOT = 64
#: Ids up to which a list of them is broadcast to filter texts; beyond, the texts are shuffled to it.
BROADCAST_IDS = 1_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers of the words of a shingle.
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(1, 33)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words; bytes.split() splits at exactly space and \\t \\n \\v \\f \\r."""
    return text.lower().split() if text else []


def shingles(words: list[bytes], k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; all words as one shingle when fewer."""
    if not words:
        return np.empty(0, np.uint64)
    code = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    width = min(len(code), k)
    n = len(code) - width + 1
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h += code[j : j + n] * _FACTORS[j]
    h = _mix(h)
    h.sort()
    new = np.ones(n, bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def _donors(n_bins: int) -> np.ndarray:
    """For every bin the order in which it asks others for a value: two-universal hashes of (bin, attempt)."""
    attempts = 4 * n_bins
    grid = np.arange(n_bins, dtype=np.uint64)[:, None] * np.uint64(attempts) + np.arange(attempts, dtype=np.uint64)
    return (_mix(grid + np.uint64(0x51ED27)) % np.uint64(n_bins)).astype(np.int64)


def signature(hashes: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of sorted distinct hashes (not empty)."""
    n_bins = len(donors)
    edges = (np.arange(n_bins, dtype=np.uint64) << np.uint64(57)) if n_bins == 128 else (
        np.arange(n_bins, dtype=np.uint64) * np.uint64((1 << 64) // n_bins))
    at = np.searchsorted(hashes, edges)
    ends = np.append(at[1:], len(hashes))
    full = at < ends
    values = np.zeros(n_bins, np.uint64)
    values[full] = hashes[at[full]]
    if not full.all():
        empty = np.flatnonzero(~full)
        asked = donors[empty]
        ok = full[asked]
        first = ok.argmax(axis=1)
        donor = asked[np.arange(len(empty)), first]
        lost = ~ok[np.arange(len(empty)), first]  # nobody asked was full: the first full bin from there on
        if lost.any():
            filled = np.flatnonzero(full)
            donor[lost] = filled[np.searchsorted(filled, empty[lost]) % len(filled)]
        values[empty] = values[donor]
    return values


def _sketch(k: int, n_bins: int, rows: int):
    donors = _donors(n_bins)

    def run(batches):
        for batch in batches:
            sizes, w1, w2, bands = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text)
                h = shingles(words, k)
                sizes.append(len(h))
                if not len(h):
                    w1.append(None)
                    w2.append(None)
                    bands.append(None)
                    continue
                d = xxhash.xxh3_128_intdigest(b" ".join(words))
                w1.append((d & (1 << 64) - 1) - (1 << 63))
                w2.append((d >> 64) - (1 << 63))
                sig = signature(h, donors).reshape(-1, rows)
                key = np.arange(len(sig), dtype=np.uint64)
                for j in range(rows):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
                bands.append(key.view(np.int64))
            flat = [b if b is not None else np.empty(0, np.int64) for b in bands]
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in flat])]).astype(np.int32)
            values = np.concatenate(flat) if flat else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(w1, pa.int64()),
                    pa.array(w2, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
                ],
                names=["did", "n_shingles", "w1", "w2", "bands"],
            )

    return run


def _alike(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether 100 * |intersection| >= percent * |union| of two sorted distinct sets."""
    every = np.concatenate([one, other])
    every.sort(kind="stable")
    both = int(np.count_nonzero(every[1:] == every[:-1]))
    return 100 * both >= percent * (len(every) - both)


def _confirm(k: int, percent: int):
    """The links among the pairs of a star. Rows come sorted by (a, salt, member): the centre's text first, once,
    and then a row for each member b."""

    def run(batches):
        star, centres = None, []
        for batch in batches:
            a, salt, member, b = (batch.column(i).to_numpy() for i in range(4))
            text, out = batch.column(4).cast(pa.binary()), []
            for row in range(batch.num_rows):
                if star != (a[row], salt[row]):
                    star, centres = (a[row], salt[row]), []
                own = shingles(words_of(text[row].as_py()), k)
                if not member[row]:
                    centres.append(own)
                elif any(_alike(c, own, percent) for c in centres):
                    out.append((min(a[row], b[row]), max(a[row], b[row])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*out, strict=True)], names=["a", "b"])

    return run


def _cells(batches):
    """The rows of each cell (key, i, j); rows come sorted by cell, and a cell may run over batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(name).to_numpy() for name in ("key", "i", "j")])
        cuts = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if last is not None and (cell[:, start] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = cell[:, start]
    if held:
        yield pa.Table.from_batches(held)


def _sets(k: int):
    """node, set: the shingle hashes of texts as bytes."""

    def run(batches):
        for batch in batches:
            sets = [shingles(words_of(t), k).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["s_node", "set"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The numbers of shingles that each set on the left shares with each on the right.

    The right sets are inverted once. A shingle of few of them adds to counts by its list; one of many is a row of a
    0/1 matrix, and the left sets' matrix times it adds all its pairs at once.
    """
    shared = np.zeros((len(left), len(right)), np.float32)
    if not len(left) or not len(right):
        return shared
    terms, term = np.unique(np.concatenate(right), return_inverse=True)
    of = np.repeat(np.arange(len(right)), [len(r) for r in right])
    order = np.argsort(term, kind="stable")
    lists, counts = of[order], np.bincount(term, minlength=len(terms))
    first = np.cumsum(counts) - counts
    flat = np.concatenate(left)
    at = np.minimum(np.searchsorted(terms, flat), max(len(terms) - 1, 0))
    met = terms[at] == flat if len(terms) else np.zeros(len(flat), bool)
    row, at = np.repeat(np.arange(len(left)), [len(x) for x in left])[met], at[met]
    hot = np.flatnonzero(counts >= HOT)
    name = np.full(len(terms), -1)
    name[hot] = np.arange(len(hot))
    rare = name[at] < 0
    for lo in range(0, len(hot), BLOCK):
        some = hot[lo : lo + BLOCK]
        ours, theirs = np.zeros((len(left), len(some)), np.float32), np.zeros((len(some), len(right)), np.float32)
        mine = (name[at] >= lo) & (name[at] < lo + BLOCK)
        ours[row[mine], name[at[mine]] - lo] = 1
        held = (name[term] >= lo) & (name[term] < lo + BLOCK)
        theirs[name[term[held]] - lo, of[held]] = 1
        shared += ours @ theirs
    row, at = row[rare], at[rare]
    if not len(at):
        return shared
    sizes = counts[at]
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(ends, np.arange(0, int(sizes.sum()), 1 << 21), "right").tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
        n = sizes[lo:hi]
        place = np.repeat(first[at[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair = np.repeat(row[lo:hi], n) * len(right) + lists[place]
        shared += np.bincount(pair, minlength=shared.size).reshape(shared.shape) if len(pair) * 4 > shared.size else _added(shared.shape, pair)
    return shared


def _added(shape: tuple[int, int], pair: np.ndarray) -> np.ndarray:
    """Few counts as a matrix."""
    out = np.zeros(shape, np.float32)
    at, n = np.unique(pair, return_counts=True)
    out.ravel()[at] = n
    return out


def _search(percent: int):
    """The links that join the components of a cell, as a spanning forest of them."""

    def links(cell: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
        cell = cell.combine_chunks()
        node, block, component = (cell.column(c).to_numpy() for c in ("node", "block", "component"))
        sets = [np.frombuffer(x, np.uint64) for x in cell.column("set").to_pylist()]
        size = np.array([len(x) for x in sets])
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        shared = overlaps([sets[x] for x in left], [sets[x] for x in right])
        found = []
        for lo in range(0, len(left), 256):
            rows = left[lo : lo + 256]
            both = shared[lo : lo + 256].astype(np.int64)
            close = (100 * both >= percent * (size[rows][:, None] + size[right][None] - both)) & (component[rows][:, None] != component[right][None])
            p, q = np.nonzero(close)
            found.append((rows[p], right[q]))
        a, b = (np.concatenate(side) for side in zip(*found, strict=True)) if found else (np.empty(0, int),) * 2
        return spanning(node[a], node[b]) if len(a) else None

    def run(batches):
        for cell in _cells(batches):
            if (out := links(cell)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(side) for side in out], names=["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    k: int = 5,
    percent: int = 75,
    n_bins: int = N_BINS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Documents are linked when 100 * |intersection| >= percent * |union| of their k-word shingle sets.
    Null, empty and blank texts have no shingles and are linked with nothing; their component is
    their own id. Rows that share an id are one node where their words are equal, and otherwise
    meet in the component of the id. Rows with a null id keep a null component. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(col(id_col).cast("long").alias("did"), col(text_col).cast("string").alias("text"))
    sketched = slim.mapInArrow(lean(_sketch(k, n_bins, rows)), "did long, n_shingles long, w1 long, w2 long, bands array<long>")
    sketched = stage(sketched, "sketches")
    files = files_for(sketched.count(), 100_000)
    known = sketched.filter("w1 IS NOT NULL AND did IS NOT NULL")
    same = stage(known.groupBy("w1", "w2").agg(F.min(F.struct("did", "n_shingles", "bands")).alias("m")), "distinct-words", files=files)
    nodes = same.select(F.col("m.did").alias("node"), F.col("m.n_shingles").alias("size"), F.col("m.bands").alias("bands"))
    groups = _groups(nodes, slim, k, percent, files)
    reps = same.select(F.col("w1").alias("s1"), F.col("w2").alias("s2"), F.col("m.did").alias("rep"))
    reps = stage(
        reps.join(groups, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("component")),
        "representatives",
        files=files,
    )
    return sketched.join(reps, (F.col("w1") == F.col("s1")) & (F.col("w2") == F.col("s2")), "left").select(
        F.col("did").alias("doc_id"), "n_shingles", F.coalesce(F.when(F.col("did").isNotNull(), F.col("component")), F.col("did")).alias("component_id")
    )


def _groups(nodes: DataFrame, slim: DataFrame, k: int, percent: int, files: int) -> DataFrame:
    """(node, component) of the nodes with a confirmed link.

    Round 0 joins every bucket of one band to its smallest node. Then only nodes of open buckets (those that
    hold several components) go on. Round t looks at buckets of two bands, i and i + t: nodes that are alike
    share many such pairs of bands, others hardly any. Each component sends one member to a bucket, at first
    the one with the most links and then others by hash, and the star joins these. These rounds only save
    work; _finish tests every pair that is left, so the end does not depend on them.
    """
    spark = nodes.sparkSession
    groups = spark.createDataFrame([], "node long, component long")
    keyed = nodes.select("node", "size", F.explode("bands").alias("key"))
    centre = keyed.groupBy("key").agg(F.min(F.struct("node", "size")).alias("c"), F.count("*").alias("n"))
    centre = centre.filter("n > 1").select(F.col("key").alias("k"), "c")
    stars = keyed.join(centre, F.col("key") == F.col("k")).select("node", "size", F.col("c.node").alias("centre"), F.col("c.size").alias("c_size"))
    stars = stage(stars.distinct(), "stars", files=files)
    members = stage(stars.select(F.col("node").alias("n")).distinct(), "bucket-nodes", files=files)
    texts = stage(slim.join(if_small(members, BROADCAST_IDS), F.col("did") == F.col("n"), "left_semi"), "bucket-texts", compression="zstd")
    rest = stage(nodes.join(if_small(members, BROADCAST_IDS), F.col("node") == F.col("n"), "left_semi"), "bucket-bands", files=files)
    tested = None
    for number in range(STAR_ROUNDS + 1):
        if number:
            stars = _two_band_stars(rest, groups, links, number)
        pairs = stars.filter(f"node <> centre AND 100 * least(size, c_size) >= {percent} * greatest(size, c_size)")
        pairs = pairs.select(F.col("centre").alias("a"), F.col("node").alias("b"))
        if tested is not None:  # in either order
            before = tested.select(F.least("a", "b").alias("ta"), F.greatest("a", "b").alias("tb"))
            pairs = pairs.join(before, (F.least("a", "b") == F.col("ta")) & (F.greatest("a", "b") == F.col("tb")), "left_anti")
        pairs = stage(pairs, "pairs", files=files)
        new = stage(_confirmed(pairs, texts, k, percent), "links", files=2 * files)
        if not new.limit(1).count():
            if number:
                break
            links = new
            continue
        groups = stage(_merge(groups, new, files), "components", files=files)
        links = new if number == 0 else links.union(new)
        tested = pairs if tested is None else tested.union(pairs)
        rest = stage(_open_nodes(rest, groups, files), "open-nodes", files=files)
    return _finish(rest, texts, groups, k, percent, files)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a centre, b member) that are links. A centre with many members, from whatever buckets, is cut by
    salt, and each part gets the centre's text once."""
    parts = pairs.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count("*") / STAR_TEXTS).alias("salts"))
    salted = pairs.join(parts, F.col("a") == F.col("of")).select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    member = salted.join(texts.select(F.col("did").alias("b_did"), "text"), F.col("b") == F.col("b_did")).select("a", "salt", F.lit(1).alias("member"), "b", "text")
    centre = salted.select("a", "salt").distinct().join(texts.select(F.col("did").alias("a_did"), "text"), F.col("a") == F.col("a_did"))
    rows = member.union(centre.select("a", "salt", F.lit(0).alias("member"), F.col("a").alias("b"), "text"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "member")
    return rows.mapInArrow(lean(_confirm(k, percent)), "a long, b long").distinct()


def _two_band_stars(rest: DataFrame, groups: DataFrame, links: DataFrame, number: int) -> DataFrame:
    """(node, size, centre, c_size): one member of each component in every bucket of two bands."""
    rows = rest.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if number == 1:
        degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
        rows = rows.join(degree, "node", "left").withColumn("first", -F.coalesce("links", F.lit(0)))
    else:
        rows = rows.withColumn("first", F.xxhash64("node", F.lit(number)))
    second = F.element_at("bands", (F.pmod(F.col("band") + number, F.size("bands")) + 1).cast("int"))
    rows = rows.select("node", "size", "component", "first", "bands", F.posexplode("bands").alias("band", "key")).withColumn("key", F.xxhash64("key", second))
    sent = rows.groupBy("key", "component").agg(F.min(F.struct("first", "node", "size")).alias("m"))
    centre = sent.groupBy(F.col("key").alias("k")).agg(F.min("m").alias("c"), F.count("*").alias("n")).filter("n > 1")
    stars = sent.join(centre, F.col("key") == F.col("k"))
    return stars.select(F.col("m.node").alias("node"), F.col("m.size").alias("size"), F.col("c.node").alias("centre"), F.col("c.size").alias("c_size")).distinct()


def _open_buckets(rest: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (key, node, size, component) of all buckets, and of each open bucket its largest component and
    the numbers of blocks of the members outside and inside it."""
    rows = rest.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = rows.select(F.explode("bands").alias("key"), "node", "size", "component")
    held = rows.groupBy("key", "component").agg(F.count("*").alias("members"), F.sum("size").alias("total"))
    held = held.groupBy(F.col("key").alias("k")).agg(
        F.max(F.struct("members", "component", "total")).alias("most"), F.sum("members").alias("all"), F.sum("total").alias("total"), F.count("*").alias("parts")
    )
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES))
    low = blocks(F.col("all") - F.col("most.members"), F.col("total") - F.col("most.total"))
    return rows, held.filter("parts > 1").select("k", F.col("most.component").alias("major"), low.alias("low"), blocks(F.col("most.members"), F.col("most.total")).alias("high"))


def _open_nodes(rest: DataFrame, groups: DataFrame, files: int) -> DataFrame:
    """The nodes of ``rest`` that are in an open bucket."""
    rows, held = _open_buckets(rest, groups)
    wanted = stage(rows.join(held, F.col("key") == F.col("k")).select(F.col("node").alias("n")).distinct(), "open", files=files)
    return rest.join(if_small(wanted, BROADCAST_IDS), F.col("node") == F.col("n"), "left_semi")


def _finish(rest: DataFrame, texts: DataFrame, groups: DataFrame, k: int, percent: int, files: int) -> DataFrame:
    """The groups after a search of every bucket that holds several components, whatever its size.

    Members of a bucket's largest component are compared with the others only, and the others with each other,
    too. Both are cut into blocks by hash, and a cell holds two blocks (or one, against itself), so no task
    needs a whole bucket. Pairs of one component need no test, and each other pair is tested. A node's
    shingles are hashed once and travel once a bucket and block; in a cell all pairs are counted at once.
    """
    rows, held = _open_buckets(rest, groups)
    rows = rows.join(held, F.col("key") == F.col("k"))
    small = F.col("component") != F.col("major")
    at = F.xxhash64("node")
    rows = rows.withColumn("block", F.when(small, F.pmod(at, "low")).otherwise(F.col("low") + F.pmod(at, "high")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(small, F.col("low") + F.col("high")).otherwise(F.col("low")) - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")
    rows = stage(rows, "searched", files=files)
    wanted = stage(rows.select(F.col("node").alias("n")).distinct(), "searched-nodes", files=files)
    open_texts = texts.join(if_small(wanted, BROADCAST_IDS), F.col("did") == F.col("n"), "left_semi")
    sets = open_texts.select("did", "text").mapInArrow(lean(_sets(k)), "s_node long, set binary").dropDuplicates(["s_node", "set"])
    rows = rows.join(stage(sets, "shingle-sets"), F.col("node") == F.col("s_node"))
    cells = rows.select("key", "i", "j", "block", "node", "component", "set").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    new = stage(cells.mapInArrow(lean(_search(percent)), "a long, b long").distinct(), "links", files=files)
    return stage(_merge(groups, new, files), "components", files=files) if new.limit(1).count() else groups


def _merge(groups: DataFrame, links: DataFrame, files: int) -> DataFrame:
    """The groups after further links: components of the linked groups, handed on to their nodes."""
    old = groups.select(F.col("node").alias("g_node"), F.col("component").alias("g_component"))
    for side in ("a", "b"):
        links = links.join(old, F.col(side) == F.col("g_node"), "left").withColumn(side, F.coalesce("g_component", side)).select("a", "b")
    merged = components(links, files=files).select(F.col("node").alias("c_node"), F.col("component").alias("c_component"))
    kept = groups.join(merged, F.col("component") == F.col("c_node"), "left").select("node", F.coalesce("c_component", "component").alias("component"))
    return kept.union(merged.select("c_node", "c_component")).groupBy("node").agg(F.min("component").alias("component"))


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that are their component's smallest id, with their own columns."""
    judged = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    gone = stage(judged.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies", files=12)
    return docs.join(if_small(gone, BROADCAST_IDS), col(id_col) == F.col("__gone"), "left_anti")
