"""Exact substring removal: repeated strings of ``LENGTH`` bytes, by bucket pointers.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a
document of a smaller doc_id.  All equal strings must meet, yet most text is
unique and must not travel.  So:

1. Documents are packed into blocks.  Every string of ``LENGTH`` bytes has an
   anchor, the position of its ``GRAM``-gram of the least hash: equal strings have
   equal anchors.  Blocks send each distinct anchor's hash (4 bytes) to a bucket
   of hashes and learn which anchors occur in several documents.
2. For those only, a hash of the anchor's context (the union of its strings) goes
   to its bucket, once a block, with the block's smallest doc_id.  Equal contexts
   of a larger document go whole.
3. Anchors with several different contexts send the bytes of each context, once.
   They are suffix-sorted by bucket-pointer refinement: buckets of initial q-grams
   are refined by sorting on the bucket identifiers of later offsets, and the
   refined identifiers serve the next, deeper refinement, until buckets hold equal
   strings of ``LENGTH`` bytes.
4. Blocks receive a mask of removed strings for each context and cut their texts.

A block sends a repeated passage at most once, so a hot passage is aggregated
before the shuffle; no group of documents is ever collected.

Edge cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing;
matches never cross documents; rows of one doc_id do not remove each other; rows
without doc_id count as larger than all others (as large as the largest long);
columns of any names are kept where texts are returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import full_text, release, small_batches, stored, table

LENGTH = 50
GRAM = 32
SPAN = LENGTH - GRAM + 1  # grams, and so strings per anchor at most
Q = 4
BLOCK_BYTES = 1_000_000
#: Bytes of text whose anchors one bucket takes, about.
BUCKET_BYTES = 40_000_000
#: Bytes of contexts that are sorted together.
SORT_BYTES = 400_000
LAST = np.iinfo(np.int64).max

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 18))
        _POWERS[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


class RangeHash:
    """Hashes of any byte ranges of a text, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Hashes of the ranges of one size at every position."""
        n = max(0, len(self.sums) - size)
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of some ranges."""
        return mixed((self.sums[start + size] - self.sums[start]) * self.down[start] + size.astype(np.uint64))


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all ranges [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Anchors:
    """A block's anchors: position, first string, number of strings, hash, document number."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data, self.hash = data, RangeHash(data)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        count = np.maximum(sizes - LENGTH + 1, 0)
        gram = self.hash.all(GRAM)
        if not count.sum():
            self.at = self.first = self.n = self.doc = np.zeros(0, np.int64)
            self.h = np.zeros(0, np.uint64)
            return
        # the least hash of the grams of a string, the leftmost of equals
        key = gram >> np.uint64(32) << np.uint64(32) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if SPAN > width:
            key = np.minimum(key[: width - SPAN], key[SPAN - width :])
        string = flat(starts, count)
        at = (key[string] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.at, self.first = at[new], string[new]
        self.n = np.diff(np.append(new, len(at)))
        self.h = gram[self.at]
        self.doc = np.searchsorted(ends, self.at, "right")


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash: its upper half scaled to the number of buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and first positions of the runs of a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return sorted_values[first], first


class Block:
    """One packed block."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.unnamed = self.sizes < 0  # the sizes of rows without an id are inverted
        self.sizes = np.where(self.unnamed, ~self.sizes, self.sizes)
        self.raw = zstandard.decompress(data) if data else b""
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.anchors = Anchors(self.bytes, self.sizes)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes, ascending, and whether several documents of the block have them."""
        a = self.anchors
        order = np.lexsort((self.ids[a.doc], a.h))
        h, doc = a.h[order], self.ids[a.doc][order]
        values, first = _groups(h)
        several = np.zeros(len(values), bool)
        if len(values):
            last = np.append(first[1:], len(h)) - 1
            several = doc[first] != doc[last]
        return values, several

    def candidates(self, values: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Occurrences of shared anchors, the entry of each, and the entries' occurrences.

        An entry is a distinct (anchor, context); its occurrence is one in the
        smallest document.  Entries ascend by (hash, context).
        """
        a = self.anchors
        hit = np.flatnonzero(shared[np.searchsorted(values, a.h)]) if len(values) else np.zeros(0, np.int64)
        context = self.hash_contexts(hit)
        order = np.lexsort((self.ids[a.doc[hit]], context, a.h[hit]))
        hit, context = hit[order], context[order]
        h = a.h[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1])
        return hit, np.cumsum(new) - 1, hit[new]

    def hash_contexts(self, hit: np.ndarray) -> np.ndarray:
        a = self.anchors
        return a.hash.of(a.first[hit], a.n[hit] + LENGTH - 1) + (a.at[hit] - a.first[hit]).astype(np.uint64)


def pack_blocks(docs: DataFrame) -> DataFrame:
    """block, ids, sizes, data, rest: documents packed to about ``BLOCK_BYTES`` each.

    The first two columns are the id and the bytes; all others are kept in ``rest``, in their order.
    """

    def run(batches):
        compress = zstandard.ZstdCompressor(3).compress
        number, ids, sizes, parts, rest, size = TaskContext.get().partitionId() << 32, [], [], [], [], 0

        def row():
            kept = b""
            if rest and rest[0].num_columns:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest[0].schema) as out:
                    for x in rest:
                        out.write_batch(x)
                kept = compress(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                "sizes": pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()), "data": pa.array([compress(b"".join(parts))], pa.binary()),
                "rest": pa.array([kept], pa.binary()),
            })

        for b in batches:
            others = pa.RecordBatch.from_arrays(b.columns[2:], [str(k) for k in range(b.num_columns - 2)])
            start = 0
            for i, (doc_id, data) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                data = data.as_py()
                ids.append(LAST if doc_id is None else doc_id), parts.append(data)
                sizes.append(~len(data) if doc_id is None else len(data))
                size += len(data)
                if size >= BLOCK_BYTES:
                    rest.append(others.slice(start, i + 1 - start))
                    yield row()
                    number, ids, sizes, parts, rest, size, start = number + 1, [], [], [], [], 0, i + 1
            if start < b.num_rows:
                rest.append(others.slice(start))
        if ids:
            yield row()

    return docs.mapInArrow(run, "block long, ids binary, sizes binary, data binary, rest binary")


def _rows(b: pa.RecordBatch, *names: str):
    """A batch's rows, one at a time."""
    for i in range(b.num_rows):
        yield [b.column(n)[i].as_py() for n in names]


def _per_bucket(batches, names, work):
    """Calls ``work`` with all rows of one bucket; rows come sorted by bucket."""
    bucket, rows = None, []
    for b in batches:
        for row in _rows(b, *names):
            if row[0] != bucket and rows:
                yield from work(bucket, rows)
                rows = []
            bucket = row[0]
            rows.append(row)
    if rows:
        yield from work(bucket, rows)


def _reply(kind: int, bucket: int, block: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "block": pa.array(block, pa.int64()), "kind": pa.array([kind] * len(block), pa.int32()),
        "bucket": pa.array([bucket] * len(block), pa.int64()), "reply": pa.array(data, pa.binary()),
    })


REPLY = "block long, kind int, bucket long, reply binary"


def shared_anchors(blocks: DataFrame, buckets: int, partitions: int) -> DataFrame:
    """Replies of kind 0: for each (block, bucket) the bits of its anchors that are shared."""

    def send(batches):
        for b in batches:
            for block, ids, sizes, data in _rows(b, "block", "ids", "sizes", "data"):
                values, several = Block(ids, sizes, data).distinct()
                own, first = _groups(bucket_of(values, buckets))
                ends = np.append(first[1:], len(values))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(own, pa.int64()), "block": pa.array([block] * len(own), pa.int64()),
                    "hashes": pa.array([values[i:j].astype(np.uint32).tobytes() for i, j in zip(first, ends)], pa.binary()),
                    "several": pa.array([np.packbits(several[i:j]).tobytes() for i, j in zip(first, ends)], pa.binary()),
                })

    def find(bucket, rows):
        parts = [np.frombuffer(r[2], np.uint32) for r in rows]
        several = [np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(p)).view(bool) for r, p in zip(rows, parts)]
        every = np.sort(np.concatenate(parts))
        shared = np.union1d(every[1:][every[1:] == every[:-1]], np.concatenate([p[s] for p, s in zip(parts, several)]))
        out = []
        for r, p in zip(rows, parts):
            i = np.searchsorted(shared, p)
            i[i == len(shared)] = 0
            hit = shared[i] == p if len(shared) else np.zeros(len(p), bool)
            if hit.any():
                out.append((r[1], np.packbits(hit).tobytes()))
        if out:
            yield _reply(0, bucket, [x[0] for x in out], [x[1] for x in out])

    sent = blocks.mapInArrow(send, "bucket long, block long, hashes binary, several binary")
    sent = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(lambda batches: _per_bucket(batches, ("bucket", "block", "hashes", "several"), find), REPLY)


def with_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Blocks with their replies as an array; a block has at most one of a kind and bucket."""
    gathered = replies.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "reply")).alias("replies"))
    return blocks.join(gathered, "block", "left")


def _shared(values: np.ndarray, buckets: int, replies: list[dict]) -> np.ndarray:
    """Which of a block's distinct anchors are shared, put together from the replies."""
    out = np.zeros(len(values), bool)
    own = bucket_of(values, buckets)
    for r in replies or ():
        if r["kind"] == 0:
            lo, hi = np.searchsorted(own, [r["bucket"], r["bucket"] + 1])
            out[lo:hi] = np.unpackbits(np.frombuffer(r["reply"], np.uint8), count=hi - lo).view(bool)
    return out


def bucket_pointers(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Identifiers of the strings of ``LENGTH`` bytes at ``starts``: equal iff the strings are.

    All positions begin in buckets of their first ``Q`` bytes.  A refinement sorts
    the positions of buckets with several members by (own identifier, identifier
    ``depth`` later), which doubles the depth; identifiers just refined are what the
    next one sorts by.  Positions that are alone keep their identifier.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(LENGTH + Q, np.uint8)]).astype(np.int64)
    code = np.zeros(n + LENGTH, np.int64)
    for k in range(Q):
        code = code << 8 | padded[k : k + n + LENGTH]
    pointer = np.unique(code, return_inverse=True)[1].astype(np.int64)
    depth = Q
    while depth * 2 <= LENGTH:
        active = np.flatnonzero(np.bincount(pointer)[pointer[: len(pointer) - depth]] > 1)
        key = pointer[active] * (len(pointer) + 1) + pointer[active + depth]
        values, inverse = np.unique(key, return_inverse=True)
        # new identifiers stay inside the old bucket's range of positions
        refined = pointer.copy()
        refined[active] = len(pointer) + inverse
        pointer = np.unique(refined, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    key = pointer[starts] * (len(pointer) + 1) + pointer[starts + LENGTH - depth]
    return np.unique(key, return_inverse=True)[1]


#: What a bucket says of an entry: nothing goes, all strings go, or its bytes are needed.
KEEP, GONE, BYTES = 0, 1, 2


class Entries:
    """A block's entries with all that its replies say of them."""

    def __init__(self, row: list, buckets: int):
        self.block, ids, sizes, data, replies = row
        self.x = Block(ids, sizes, data)
        values, _ = self.x.distinct()
        self.hit, self.of, self.entry = self.x.candidates(values, _shared(values, buckets, replies))
        a = self.x.anchors
        self.bucket = bucket_of(a.h[self.entry], buckets)
        self.n, self.doc = a.n[self.entry], self.x.ids[a.doc[self.entry]]
        self.say = np.zeros(len(self.entry), np.uint8)
        for r in replies or ():
            if r["kind"] == 1:
                lo, hi = np.searchsorted(self.bucket, [r["bucket"], r["bucket"] + 1])
                self.say[lo:hi] = np.frombuffer(r["reply"], np.uint8)
        self.mask = np.where(self.say == GONE, (np.int64(1) << self.n) - 1, 0)
        asked = np.flatnonzero(self.say == BYTES)
        for r in replies or ():
            if r["kind"] == 2:
                lo, hi = np.searchsorted(self.bucket[asked], [r["bucket"], r["bucket"] + 1])
                self.mask[asked[lo:hi]] = np.frombuffer(r["reply"], np.uint32)

    def parts(self, entries: np.ndarray, content: bool) -> pa.RecordBatch:
        """One row for each bucket of some entries, with their contexts' bytes or hashes."""
        a, x = self.x.anchors, self.x
        compress = zstandard.ZstdCompressor(3).compress
        own, first = _groups(self.bucket[entries])
        out = []
        for i, j in zip(first, np.append(first[1:], len(entries))):
            e = self.entry[entries[i:j]]
            small = np.stack([a.n[e], a.at[e] - a.first[e]]).astype(np.uint8)
            what = compress(x.bytes[flat(a.first[e], a.n[e] + LENGTH - 1)].tobytes()) if content else x.hash_contexts(e).tobytes()
            out.append((a.h[e].astype(np.uint32).tobytes(), compress(x.ids[a.doc[e]].tobytes()), compress(small.tobytes()) if content else b"", what))
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int64()), pa.array([self.block] * len(own), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], PART
        )


PART = ["bucket", "block", "h", "doc", "small", "what"]
BLOCK = ("block", "ids", "sizes", "data", "replies")


def _ask(blocks: DataFrame, buckets: int, partitions: int, content: bool, find) -> DataFrame:
    """Blocks send entries to buckets, which answer by ``find``."""

    def send(batches):
        for b in batches:
            for row in _rows(b, *BLOCK):
                if row[-1]:
                    e = Entries(row, buckets)
                    wanted = np.flatnonzero(e.say == BYTES) if content else np.arange(len(e.entry))
                    if len(wanted):
                        yield e.parts(wanted, content)

    sent = blocks.mapInArrow(send, "bucket long, block long, h binary, doc binary, small binary, what binary")
    sent = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(lambda batches: _per_bucket(batches, PART, find), REPLY)


def _gathered(rows: list) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Anchor hashes and documents of a bucket's rows, and the entries of each row."""
    h = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
    doc = np.concatenate([np.frombuffer(zstandard.decompress(r[3]), np.int64) for r in rows])
    return h, doc, [len(r[2]) // 4 for r in rows]


def _classify(bucket, rows):
    """Replies of kind 1: what to do with each entry.

    Of each class of equal contexts the smallest document stays.  Where an anchor
    has several classes, one such entry of each class must show its bytes.
    """
    h, doc, each = _gathered(rows)
    context = np.concatenate([np.frombuffer(r[5], np.uint64) for r in rows])
    order = np.lexsort((doc, context, h))
    h, doc, context = h[order], doc[order], context[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_class = new_h | np.concatenate([[True], context[1:] != context[:-1]])
    of_class, of_h = np.cumsum(new_class) - 1, np.cumsum(new_h) - 1
    classes = np.bincount(of_h[new_class])
    least = doc[new_class][of_class]
    say = np.where(doc > least, GONE, np.where(classes[of_h] > 1, BYTES, KEEP)).astype(np.uint8)
    back = np.empty(len(say), np.uint8)
    back[order] = say
    parts = np.split(back, np.cumsum(each)[:-1])
    told = [(r[1], p.tobytes()) for r, p in zip(rows, parts) if p.any()]
    if told:
        yield _reply(1, bucket, [t[0] for t in told], [t[1] for t in told])


def _pieces(h: np.ndarray, begin: np.ndarray, n: np.ndarray, offset: np.ndarray, data: np.ndarray):
    """(bytes, starts, entry, bit) of strings, in pieces of about ``SORT_BYTES``.

    Equal strings have equal anchors, so anchors are dealt whole; one anchor with
    more contexts than that is dealt by the strings' distance from the anchor, then by
    their first bytes.
    """
    order = np.argsort(h, kind="stable")
    _, first = _groups(h[order])
    groups = np.split(order, first[1:])
    held, size = [], 0
    for group in [*groups, None]:
        room = 0 if group is None else int((n[group] + LENGTH - 1).sum())
        if held and (group is None or size + room > SORT_BYTES):
            e = np.concatenate(held)
            length = n[e] + LENGTH - 1
            yield data[flat(begin[e], length)], flat(np.cumsum(length) - length, n[e]), np.repeat(e, n[e]), flat(np.zeros(len(e), np.int64), n[e])
            held, size = [], 0
        if group is None:
            return
        if room <= SORT_BYTES:
            held.append(group)
            size += room
            continue
        for distance in range(SPAN):
            e = group[(offset[group] >= distance) & (offset[group] - distance < n[group])]
            bit = offset[e] - distance
            at = begin[e] + bit
            code = np.zeros(len(e), np.int64)
            for k in range(Q):
                code = code << 8 | data[at + k]
            e, bit, at, code = (v[np.argsort(code, kind="stable")] for v in (e, bit, at, code))
            _, cuts = _groups(code)
            lo = 0
            for hi in [*cuts[1:].tolist(), len(e)]:
                if hi == len(e) or (hi - lo) * LENGTH > SORT_BYTES:
                    if hi > lo:
                        part = slice(lo, hi)
                        yield data[flat(at[part], np.full(hi - lo, LENGTH))], np.arange(hi - lo) * LENGTH, e[part], bit[part]
                    lo = hi


def _compare(bucket, rows):
    """Replies of kind 2: the mask of removed strings of each entry that showed its bytes."""
    h, doc, each = _gathered(rows)
    small = [np.frombuffer(zstandard.decompress(r[4]), np.uint8).reshape(2, -1) for r in rows]
    n, offset = (np.concatenate([x[k] for x in small]).astype(np.int64) for k in (0, 1))
    data = np.frombuffer(b"".join(zstandard.decompress(r[5]) for r in rows), np.uint8)
    size = n + LENGTH - 1
    mask = np.zeros(len(n), np.int64)
    for text, starts, owner, bit in _pieces(h, np.cumsum(size) - size, n, offset, data):
        same = bucket_pointers(text, starts)
        earliest = np.full(same.max() + 1, LAST)
        np.minimum.at(earliest, same, doc[owner])
        gone = earliest[same] < doc[owner]
        np.bitwise_or.at(mask, owner[gone], np.int64(1) << bit[gone])
    parts = np.split(mask.astype(np.uint32), np.cumsum(each)[:-1])
    yield _reply(2, bucket, [r[1] for r in rows], [p.tobytes() for p in parts])


def removed_strings(blocks: DataFrame, anchors: DataFrame, buckets: int, partitions: int) -> DataFrame:
    """Replies of all kinds: of each entry, which strings go.

    They hold for the entry's occurrence in the block's smallest document; in
    larger documents all strings of the context go.
    """
    spark = blocks.sparkSession
    known = anchors.unionByName(stored(_ask(with_replies(blocks, anchors), buckets, partitions, False, _classify), "classes"))
    release(spark)
    masks = stored(_ask(with_replies(blocks, known), buckets, partitions, True, _compare), "masks")
    release(spark)
    return known.unionByName(masks)


def removal_mask(e: Entries) -> np.ndarray | None:
    """Which bytes of a block go; None if none."""
    x, a, hit, of = e.x, e.x.anchors, e.hit, e.of
    if not len(hit):
        return None
    full = (np.int64(1) << a.n[hit]) - 1
    mask = np.where(x.ids[a.doc[hit]] > e.doc[of], full, e.mask[of])
    change = np.zeros(len(x.bytes) + 1, np.int32)
    whole = mask == full
    np.add.at(change, a.first[hit[whole]], 1)
    np.add.at(change, a.first[hit[whole]] + a.n[hit[whole]] + LENGTH - 1, -1)
    part = np.flatnonzero(~whole & (mask != 0))
    for bit in range(SPAN):
        start = a.first[hit[part[(mask[part] >> bit) & 1 == 1]]] + bit
        np.add.at(change, start, 1)
        np.add.at(change, start + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def cut(x: Block, gone: np.ndarray | None):
    """(doc_id, bytes, bytes kept, n_removed, n_spans) of a block's documents."""
    at = 0
    for doc_id, unnamed, size in zip(x.ids.tolist(), x.unnamed.tolist(), x.sizes.tolist()):
        whole = raw = x.raw[at : at + size]
        removed = spans = 0
        if gone is not None:
            part = gone[at : at + size]
            removed = int(np.count_nonzero(part))
            if removed:
                spans = int(np.count_nonzero(part[1:] & ~part[:-1])) + int(part[0])
                raw = x.bytes[at : at + size][~part].tobytes()
        at += size
        yield None if unnamed else doc_id, whole, raw, removed, spans


def answered(docs: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of (id, bytes, other columns) with all replies, and the number of buckets."""
    spark = docs.sparkSession
    small_batches(spark)
    packed = stored(pack_blocks(docs), "blocks")
    blocks = packed.drop("rest")
    total = blocks.agg(F.sum(F.octet_length("sizes")), F.sum(F.octet_length("data"))).first()
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(shuffle, int((total[1] or 0) * 2.5 / BUCKET_BYTES) + 1)
    buckets = 4 * partitions
    anchors = stored(shared_anchors(blocks, buckets, partitions), "shared")
    release(spark)
    return with_replies(packed, removed_strings(blocks, anchors, buckets, partitions)), buckets


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what is removed from every document, and the digest of what is kept."""
    blocks, buckets = answered(df.select(df[id_col].cast("long").alias("doc_id"), full_text(text_col).cast("binary").alias("data")))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64()] * 4 + [pa.string()]

    def run(batches):
        for b in batches:
            for row in _rows(b, *BLOCK):
                e = Entries(row, buckets)
                rows = [(doc_id, len(whole), removed, spans, hashlib.sha256(raw).hexdigest()) for doc_id, whole, raw, removed, spans in cut(e.x, removal_mask(e))]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    return blocks.select(*BLOCK).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the repeats cut out of its texts (bytes that no longer decode are dropped).

    ``n_chars`` follows where it is a column; all other columns travel with their
    rows through the blocks, whatever their names.
    """
    at, others = df.columns.index(text_col), [i for i, c in enumerate(df.columns) if c != text_col]
    docs = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    blocks, buckets = answered(
        docs.select(F.col(f"c{df.columns.index(id_col)}").cast("long").alias("doc_id"), full_text(f"c{at}").cast("binary").alias("data"), *[F.col(f"c{i}").alias(f"o{i}") for i in others])
    )
    names = df.columns

    def run(batches):
        for b in batches:
            for *row, rest in _rows(b, *BLOCK, "rest"):
                e = Entries(row, buckets)
                texts = [raw.decode("utf-8", "ignore") for _, _, raw, _, _ in cut(e.x, removal_mask(e))]
                kept = pa.ipc.open_stream(zstandard.decompress(rest)).read_all().combine_chunks() if rest else None
                columns = []
                for i, c in enumerate(names):
                    if i == at:
                        columns.append(pa.array(texts, pa.string()))
                        continue
                    x = kept.column(others.index(i)).combine_chunks()
                    columns.append(pa.array([len(t) for t in texts], pa.int64()).cast(x.type) if c == "n_chars" else x)
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.select(*BLOCK, "rest").mapInArrow(run, df.schema)


def op2_suffix_dedup(spark, sf_dir):
    """Query op2: repeated strings of 50 bytes removed from every document."""
    return dedup_substrings(table(spark, sf_dir, "documents"))
