"""Near-duplicate classes by improved consistent weighted sampling.

A document is a weighted set of five-word shingles: a shingle's weight is its
count times its inverse document frequency.  Frequencies of shingles that stand in
over one in ``RARE`` documents are counted exactly over all documents; all others are
rare and weigh the most.  There are at most ``RARE`` times as many such shingles as a
document has on average, however large the table is.  Improved consistent weighted sampling draws ``BANDS * ROWS`` samples;
two documents agree in a sample with the probability of their weighted Jaccard
similarity.  Samples are banded; documents that share a band meet in a bucket.

Copies of one text are one representative.  Every bucket's members are first
compared with its smallest document, by the weighted Jaccard similarity of whole
texts; links become classes by label propagation in DataFrames.  Buckets that then
still hold several classes are cut into blocks of bounded size, and tasks compare
two blocks at a time by products of shingle matrices: every two members of
different classes, in the first band they share.  A large class has blocks of its
own, which are not compared with each other.  A task returns only links that join
classes, and no more than tie its members together.  So every two members of a
bucket end in one class or were compared, and no row is made for a pair.

Keys that hold over a thousandth of all rows are joined by broadcast (there are
fewer than a thousand), so no task gets a larger share of one key.

Edge cases: a null text is empty; texts of fewer than five words are one shingle,
empty texts are copies of each other; rows that repeat a doc_id are one document,
which has the links of all its texts; a row without doc_id takes the class of its
text's copies, or none; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, full_text, join_split, stored, table, text_blocks

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 3
#: A shingle in at most one of so many documents is rare.
RARE = 256
#: Shingles that a task counts before it gives those that may be frequent.
COUNTED = 2_000_000
#: Members that one task compares with a leader.
STAR_PART = 64
#: Size of a block: one for each member and one for each so many of its weight.
BLOCK_UNITS, UNIT_WEIGHT = 512, 1000.0
#: Columns of a shingle matrix.
COLUMNS = 2048
#: Above rounding errors of sums of weights.
MARGIN = 1e-6
ROUNDING = 1e-9
BLOCK_BYTES = 1_000_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes, one text after the other, and how many each text has."""
    words, counts = [], []
    for t in texts:
        found = t.lower().split()
        counts.append(len(found))
        words += found
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words)), np.array(counts, np.int64)


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of all shingles of the texts, in order."""
    words, counts = hashed_words(texts)
    ends = np.cumsum(counts)
    # a text shorter than a shingle is padded to one with numbers
    n = np.where(counts == 0, 0, np.maximum(counts - WORDS + 1, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    if not len(words):
        return owner, np.zeros(0, np.uint64)
    at = np.repeat(ends - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    inside, value = ends[owner], np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        there = at + k < inside
        value = mixed(value + _MIX[0]) + np.where(there, words[np.where(there, at + k, 0)] * _MIX[k], np.uint64(k))
    return owner, mixed(value)


class Frequencies:
    """Inverse document frequencies: those of frequent shingles, and one for all others."""

    def __init__(self, value: np.ndarray, frequency: np.ndarray, documents: int):
        order = np.argsort(value)
        self.value = value[order]
        # between 1, in all documents, and 2, in one of ``RARE`` or fewer
        self.weight = 1 + np.clip(np.log(max(documents, 1) / frequency[order]) / np.log(RARE), 0, 1)
        self.there = np.zeros(1 << 20, bool)
        self.there[self._low(self.value)] = True

    @staticmethod
    def _low(value: np.ndarray) -> np.ndarray:
        return (value & np.uint64((1 << 20) - 1)).astype(np.int64)

    def found(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``value`` holds frequent shingles, and their places among those."""
        at = np.flatnonzero(self.there[self._low(value)])
        i = np.searchsorted(self.value, value[at])
        same = i < len(self.value)
        same[same] = self.value[i[same]] == value[at[same]]
        return at[same], i[same]

    def of(self, value: np.ndarray) -> np.ndarray:
        """The inverse document frequency of every shingle."""
        out = np.full(len(value), 2.0)
        at, i = self.found(value)
        out[at] = self.weight[i]
        return out


def shingles(texts: list[str], idf: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, hash, weight): distinct shingles of each text, ascending by hash.

    Text ``i`` has the shingles from ``first[i]`` to ``first[i + 1]``.
    """
    owner, value = shingle_hashes(texts)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(value)))
    first = np.concatenate([[0], np.cumsum(np.bincount(owner[begin], minlength=len(texts)))]).astype(np.int64)
    value = value[begin]
    return first, value, idf.of(value) * times


def _gamma_quantiles(n: int = 1 << 15) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, by bisection of its distribution function."""
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_GAMMA = _gamma_quantiles().astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)


def samples(first: np.ndarray, value: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Sample ``k`` of every text with shingles: a hash of (shingle, quantised weight)."""
    z = mixed(value + np.uint64((k + 1) * int(_MIX[0]) % (1 << 64)))
    r = _GAMMA[(z & np.uint64(0x7FFF)).astype(np.int32)]
    log_c = _LOG_GAMMA[((z >> np.uint64(15)) & np.uint64(0x7FFF)).astype(np.int32)]
    beta = ((z >> np.uint64(30)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
    t = np.floor(np.log(weight).astype(np.float32) / r + beta)
    a = log_c - r * (t - beta) - r
    bits = a.view(np.int32).astype(np.int64)
    bits ^= (bits >> 31) & 0x7FFFFFFF  # floats in the order of integers
    key = (bits << 32) | np.arange(len(a))
    best = np.minimum.reduceat(key, first) & 0xFFFFFFFF
    return mixed(value[best] ^ mixed(t[best].astype(np.int64).astype(np.uint64) + np.uint64(k)))


def band_keys(texts: list[str], idf: Frequencies) -> tuple[list[list[int]], np.ndarray]:
    """The band keys and the total weight of every text; no keys for a text without words."""
    first, value, weight = shingles(texts, idf)
    full = np.flatnonzero(np.diff(first))
    out: list[list[int]] = [[] for _ in texts]
    total = np.zeros(len(texts))
    if not len(full):
        return out, total
    starts = first[full]
    keys = np.zeros((len(full), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(full), band + 1, np.uint64)
        for row in range(ROWS):
            key = mixed(key * _MIX[3] + samples(starts, value, weight, band * ROWS + row))
        keys[:, band] = key
    for i, row in zip(full, keys.view(np.int64).tolist()):
        out[i] = row
    total[full] = np.add.reduceat(weight, starts)
    return out, total


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger weights; two empty sets are equal."""
    if not len(a[0]) or not len(b[0]):
        return 1.0 if len(a[0]) == len(b[0]) else 0.0
    i = np.searchsorted(a[0], b[0])
    i[i == len(a[0])] = 0
    same = a[0][i] == b[0]
    common = np.minimum(a[1][i[same]], b[1][same]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def document_frequencies(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and the number of owners of each; owners ascend."""
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.append(True, value[1:] != value[:-1])
    begin = np.flatnonzero(new)
    new[1:] |= owner[1:] != owner[:-1]
    return value[begin], np.add.reduceat(new, begin, dtype=np.int64)


def _counts(value: np.ndarray, n: np.ndarray, documents: int) -> pa.RecordBatch:
    """Counts of shingles, and the number of documents as the count of null."""
    shingle = pa.concat_arrays([pa.array(value.view(np.int64)), pa.nulls(1, pa.int64())])
    return pa.RecordBatch.from_arrays([shingle, pa.array(np.append(n, documents), pa.int64())], ["shingle", "n"])


def idf_table(docs: DataFrame) -> Frequencies:
    """Exact document frequencies of frequent shingles, over all documents.

    A first pass finds what may be frequent: a shingle that a task leaves out of its
    counts is in at most one of ``4 * RARE`` documents there, so all that are in over one
    of ``RARE`` documents keep three quarters of that.  A second pass counts
    these in every document, so the result does not depend on tasks.
    """

    def likely(batches):
        owners, values, held, documents = [], [], 0, 0

        def full():
            value, n = document_frequencies(np.concatenate(owners), np.concatenate(values)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n * 4 * RARE > documents
            return _counts(value[often], n[often], documents)

        for b in batches:
            for _, _, texts in text_blocks(b, "text", BLOCK_BYTES):
                owner, value = shingle_hashes(texts)
                owners.append(owner.astype(np.int32) + np.int32(documents))
                values.append(value)
                held, documents = held + len(value), documents + len(texts)
                if held >= COUNTED:
                    yield full()
                    owners, values, held, documents = [], [], 0, 0
        if documents:
            yield full()

    schema = "shingle long, n long"
    texts = docs.select("text")
    first = stored(texts.mapInArrow(likely, schema).groupBy("shingle").agg(F.sum("n").alias("n")), "likely")
    documents = first.where("shingle is null").agg(F.sum("n")).first()[0] or 0
    # at most 4 / 3 * RARE times the shingles of an average document
    rows = first.where(F.col("shingle").isNotNull() & (F.col("n") * 4 * RARE >= 3 * documents)).select("shingle").toArrow()
    dropped(first)
    some = Frequencies(rows["shingle"].to_numpy().view(np.uint64), np.ones(rows.num_rows), 1)

    def exact(batches):
        total = np.zeros(len(some.value), np.int64)
        for b in batches:
            for _, _, texts in text_blocks(b, "text", BLOCK_BYTES):
                owner, value = shingle_hashes(texts)
                at, i = some.found(value)
                pairs = np.unique(i * len(texts) + owner[at])
                total += np.bincount(pairs // len(texts), minlength=len(total))
        used = np.flatnonzero(total)
        yield _counts(some.value[used], total[used], 0)

    counted = texts.mapInArrow(exact, schema).where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"))
    counted = counted.where(F.col("n") * RARE > documents).toArrow()
    return Frequencies(counted["shingle"].to_numpy().view(np.uint64), counted["n"].to_numpy().astype(float), documents)


def signatures(docs: DataFrame, idf: Frequencies) -> DataFrame:
    """doc_id, h (a digest of the text), the band keys and the total weight."""

    def run(batches):
        for b in batches:
            for lo, hi, texts in text_blocks(b, "text", BLOCK_BYTES):
                keys, total = band_keys(texts, idf)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("h").slice(lo, hi - lo), pa.array(keys, pa.list_(pa.int64())), pa.array(total)],
                    ["doc_id", "h", "bands", "weight"],
                )

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h binary, bands array<long>, weight double")


def _grouped(batches, idf: Frequencies, *names: str):
    """(group, rows) of sorted rows; a row is its columns ``names`` and the text's shingles and weights."""
    group, rows = None, []
    for b in batches:
        for lo, hi, texts in text_blocks(b, "text", BLOCK_BYTES):
            first, value, weight = shingles(texts, idf)
            columns = [b.column(c).slice(lo, hi - lo).to_pylist() for c in ("group", *names)]
            for i, (g, *row) in enumerate(zip(*columns)):
                if g != group and rows:
                    yield group, rows
                    rows = []
                group = g
                rows.append((*row, value[first[i] : first[i + 1]].copy(), weight[first[i] : first[i + 1]].copy()))
    if rows:
        yield group, rows


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])


def star_links(pairs: DataFrame, texts: DataFrame, idf: Frequencies, threshold: float) -> DataFrame:
    """(a, b) of the pairs (leader, member, n) that are alike; ``n`` members split over tasks."""
    part = F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / STAR_PART).cast("int"))
    edges = pairs.select("leader", "member", F.concat_ws(":", "leader.rep", F.hex("leader.h"), part).alias("group"))
    roles = edges.select("group", F.col("leader").alias("text_id"), F.lit(True).alias("leads")).distinct()
    roles = roles.unionByName(edges.select("group", F.col("member").alias("text_id"), F.lit(False).alias("leads")))
    rows = roles.select("group", "leads", "text_id.*").join(texts.select("rep", "h", "text").hint("merge"), ["rep", "h"])
    rows = rows.select("group", "leads", "rep", "text").repartition("group").sortWithinPartitions("group", F.desc("leads"))

    def run(batches):
        leader, group = None, None
        for b in batches:
            for lo, hi, block in text_blocks(b, "text", BLOCK_BYTES):
                first, value, weight = shingles(block, idf)
                groups, leads, reps = (b.column(c).slice(lo, hi - lo).to_pylist() for c in ("group", "leads", "rep"))
                found = []
                for i, (g, leading, rep) in enumerate(zip(groups, leads, reps)):
                    own = value[first[i] : first[i + 1]], weight[first[i] : first[i + 1]]
                    if leading:
                        leader, group = (rep, own[0].copy(), own[1].copy()), g
                    elif g == group and rep != leader[0] and weighted_jaccard(leader[1:], own) >= threshold - ROUNDING:
                        found.append((leader[0], rep))
                yield _links(found)

    return rows.mapInArrow(run, "a long, b long")


def common_weights(vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum of the smaller weights of every two weighted sets.

    The weights of a shingle are cut into layers; a set is in all layers up to its
    own weight.  The layers two sets share add up to the smaller weight, so the
    sums are products of a matrix of sets and layers.
    """
    owner = np.repeat(np.arange(len(vectors)), [len(v) for v, _ in vectors])
    value, weight = (np.concatenate([x[k] for x in vectors]) for k in (0, 1))
    order = np.lexsort((weight, value))
    owner, value, weight = owner[order], value[order], weight[order]
    new_value = np.append(True, value[1:] != value[:-1])
    several = np.bincount(np.cumsum(new_value) - 1)[np.cumsum(new_value) - 1] > 1
    owner, value, weight = owner[several], value[several], weight[several]
    out = np.zeros((len(vectors), len(vectors)))
    if not len(value):
        return out
    new_value = np.append(True, value[1:] != value[:-1])
    new_layer = new_value | np.append(True, weight[1:] != weight[:-1])
    layer = np.cumsum(new_layer) - 1
    height = weight[new_layer] - np.where(new_value[new_layer], 0.0, np.append(0.0, weight[new_layer][:-1]))
    lowest = np.maximum.accumulate(np.where(new_value, layer, 0))
    rank = layer - lowest + 1  # a set is in so many layers of the shingle
    row = np.repeat(owner, rank)
    column = np.repeat(lowest, rank) + np.arange(rank.sum()) - np.repeat(np.cumsum(rank) - rank, rank)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, len(height) + COLUMNS, COLUMNS))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        if i < j:
            width = min(COLUMNS, len(height) - k * COLUMNS)
            m = np.zeros((len(vectors), width))
            m[row[i:j], column[i:j] - k * COLUMNS] = 1.0
            out += (m * height[k * COLUMNS : k * COLUMNS + width]) @ m.T
    return out


def block_links(rows: list[tuple], key: int, threshold: float) -> list[tuple[int, int]]:
    """Links between classes in a group of rows (side, class, bands, shingles, weights).

    Two rows are compared if their classes and sides differ (rows of one block have
    side 0 alone, and all count) and ``key`` is the first band they share.
    """
    side, of = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    bands = np.array([r[2] for r in rows], np.int64)
    wanted = of[:, None] != of[None, :]
    if side.any():
        wanted &= side[:, None] != side[None, :]
    same = np.zeros_like(wanted)  # they share an earlier band
    for k in range(bands.shape[1]):
        equal = bands[:, k][:, None] == bands[:, k][None, :]
        wanted &= ~(equal & (bands[:, k] != key)[:, None] & ~same)
        same |= equal
    use = np.flatnonzero(wanted.any(1))
    if not len(use):
        return []
    vectors = [rows[i][3:] for i in use]
    total = np.array([w.sum() for _, w in vectors])
    common = common_weights(vectors)
    alike = wanted[np.ix_(use, use)] & (common >= (threshold - ROUNDING) * (total[:, None] + total[None, :] - common))
    out, label = [], of[use].copy()
    for i in np.flatnonzero(alike.any(1)):  # no more links than tie the classes together
        for j in np.flatnonzero(alike[i] & (label != label[i])):
            if label[i] != label[j]:
                out.append((int(of[use[i]]), int(of[use[j]])))
                label[label == label[j]] = label[i]
    return out


def class_links(open_: DataFrame, texts: DataFrame, idf: Frequencies, threshold: float) -> DataFrame:
    """(a, b) of classes that members of unresolved buckets (key, rep, h, class, weight) join."""
    units = 1 + F.col("weight") / UNIT_WEIGHT
    per_class = open_.groupBy("key", "class").agg(F.sum(units).alias("units"), F.count("*").alias("n"))
    per_class = stored(per_class.withColumn("own", F.col("units") > BLOCK_UNITS), "blocks")
    pool = per_class.groupBy("key").agg(F.sum(F.when(~F.col("own"), F.col("units"))).alias("pooled"), F.sum("n").alias("n"))
    large = per_class.where("own").select("key", "class", "units", "n")
    rows = join_split(open_, pool, ["key"])
    rows = join_split(rows, large, ["key", "class"], "left")
    salt = F.pmod(F.xxhash64("rep", "h"), F.ceil(F.coalesce("units", "pooled") / BLOCK_UNITS).cast("int"))
    rows = rows.select("key", "rep", "h", "class", F.concat_ws(":", F.when(F.col("units").isNull(), "*").otherwise(F.col("class").cast("string")), salt).alias("block"))
    rows = stored(rows, "blocked")
    blocks = rows.select("key", "block").distinct()
    p, q = blocks.withColumnRenamed("block", "p"), blocks.withColumnRenamed("block", "q")
    owner = lambda c: F.substring_index(c, ":", 1)
    pairs = p.join(q, "key").where((F.col("p") <= F.col("q")) & ((owner("p") == "*") | (owner("p") != owner("q"))))
    group = F.concat_ws("/", F.col("key").cast("string"), "p", "q").alias("group")
    sides = pairs.select("key", group, F.col("p").alias("block"), F.lit(0).alias("side"))
    sides = sides.unionByName(pairs.where("p <> q").select("key", group, F.col("q").alias("block"), F.lit(1).alias("side")))
    rows = rows.join(sides, ["key", "block"]).join(texts.hint("merge"), ["rep", "h"])
    rows = rows.select("group", "key", "side", "class", "bands", "text").repartition("group").sortWithinPartitions("group")

    def run(batches):
        for _, found in _grouped(batches, idf, "key", "side", "class", "bands"):
            yield _links(block_links([r[1:] for r in found], found[0][0], threshold))

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of every connected component of (a, b) links.

    Each step takes the least label of the neighbours, then follows labels once,
    so chains halve; it ends when no label changes.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("n")).select(F.col("a").alias("node"), "label", "n"), "labels")
    while True:
        near = join_split(both, labels.withColumnRenamed("node", "b"), ["b"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["a"], "left")
        least = stored(least.select("node", F.col("n").alias("degree"), F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")), "least")
        held = least.groupBy("label").agg(F.count("*").alias("n"))
        target = held.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        after = join_split(least, target, ["label"], "left")
        after = stored(after.select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"), F.col("degree").alias("n")), "labels")
        changed = after.where(F.col("old") != F.col("label")).limit(1).count()
        dropped(labels)
        dropped(least)
        labels = after.drop("old")
        labels._stored_at = after._stored_at
        if not changed:
            dropped(both)
            return labels.select("node", "label")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (the class's smallest doc_id) of every document."""
    text = full_text(text_col)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("h"))
    idf = idf_table(docs)
    signed = stored(signatures(docs, idf), "signatures")
    groups = stored(signed.groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.max("weight").alias("weight"), F.count("*").alias("n")), "texts")
    band = groups.where(F.col("rep").isNotNull()).select("rep", "h", "weight", F.explode("bands").alias("key"))
    shared = band.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rep", "h", "weight")).alias("leader")).where("n > 1")
    members = stored(join_split(band, stored(shared, "shared"), ["key"], keep=["n", "leader"]), "buckets")  # only documents that meet another
    met = members.groupBy("rep", "h").agg(F.count("*").alias("met"))
    texts = docs.join(met.hint("merge"), (docs["doc_id"] == met["rep"]) & (docs["h"] == met["h"])).groupBy("rep", met["h"]).agg(F.first("text").alias("text"))
    texts = stored(texts.join(groups.select("rep", "h", "bands").hint("merge"), ["rep", "h"]), "candidates")
    near = F.least("weight", "leader.weight") >= (threshold - MARGIN) * F.greatest("weight", "leader.weight")
    member, leader = F.struct("rep", "h"), F.struct("leader.rep", "leader.h")
    pairs = members.where((member != leader) & near).groupBy(leader.alias("leader"), member.alias("member")).agg(F.max("n").alias("n"))
    links = stored(star_links(pairs, texts, idf, threshold), "links")
    labels = components(links)
    # a bucket is done when all but its leader are in one class
    rest = members.where(member != leader).select("key", "rep", "h", "weight")
    known = labels.withColumnRenamed("node", "rep")
    rest = stored(rest.join(known, "rep", "left").select("key", "rep", "h", "weight", F.coalesce("label", "rep").alias("class")), "members")
    several = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("least"), F.max("class").alias("most"))
    several = several.where("least <> most").select("key", "n")
    open_ = stored(join_split(rest, several, ["key"]), "unresolved")
    joined = components(class_links(open_, texts, idf, threshold))
    step = joined.select(F.col("node").alias("label"), F.col("label").alias("further"))
    found = groups.select("h", "rep", "n").join(labels, F.col("rep") == F.col("node"), "left").select("h", "n", F.coalesce("label", "rep").alias("label"))
    classes = found.join(step, "label", "left").select("h", "n", F.coalesce("further", "label").alias("class_id"))
    return join_split(signed.select("doc_id", "h"), stored(classes, "classes"), ["h"]).select("doc_id", "class_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose document is the smallest of its class.

    Rows that repeat a doc_id are one document and stay together; a row without
    doc_id cannot stand for its class and does not stay.
    """
    found = near_duplicates(df, id_col, text_col)
    kept = found.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("__kept")).distinct()
    return df.join(kept, df[id_col] == kept["__kept"], "left_semi")


def op10_minhash_near_dedup(spark, sf_dir):
    """Query op10: the near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
