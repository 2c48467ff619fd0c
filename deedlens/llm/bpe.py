"""Byte-level BPE by corpus-level merge replay, and decoding.

The distinct pre-tokens of a block of documents form one flat array of byte
tokens with neighbour links.  An inverted index files every adjacent pair under
the token it would merge to, with the positions that hold it.  Merges are then
replayed in rank order over the whole corpus of words: each applies at all its
positions, left to right, and only the two touched neighbours are re-indexed.
Words never touch each other, so every word ends as if it were encoded alone.

Edge cases: a null text is empty and has no tokens; very long texts and words
are encoded whole; repeated words are encoded once a block; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import few_collections, full_text, table, text_blocks

#: Pieces of text in each of a worker's two cache generations.
CACHE_PIECES = 300_000
#: Bytes of text encoded together.
BLOCK_BYTES = 8_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Replay:
    """A vocabulary, its pair table, and the replay of merges over many words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.shift = max(ranks.values()).bit_length()
        self.merged: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.merged[a << self.shift | b] = rank
        first = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                first[a, b] = self.merged.get(int(self.byte_ids[a]) << self.shift | int(self.byte_ids[b]), -1)
        self.first = first
        size = max(ranks.values()) + 1
        self.token_len = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.token_len[rank] = len(token)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        blob = bytearray(int(self.token_len.sum()))
        for token, rank in ranks.items():
            at = int(self.token_at[rank])
            blob[at : at + len(token)] = token
        self.blob = np.frombuffer(bytes(blob), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        n = len(raw)
        token = self.byte_ids[raw]
        right = np.arange(1, n + 1)
        left = np.arange(-1, n - 1)
        full = lengths > 0
        right[ends[full] - 1] = -1
        left[ends[full] - lengths[full]] = -1
        # the inverted index: merge target -> positions of its left half
        inner = np.flatnonzero(right >= 0)
        target = self.first[raw[inner], raw[inner + 1]] if len(inner) else inner
        inner, target = inner[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        inner, target = inner[order], target[order]
        keys, starts = np.unique(target, return_index=True)
        index = {int(k): part.tolist() for k, part in zip(keys, np.split(inner, starts[1:]))}
        heap = list(index)
        heapq.heapify(heap)
        tok, nxt, prv, merged, shift = token.tolist(), right.tolist(), left.tolist(), self.merged, self.shift
        while heap:
            rank = heapq.heappop(heap)
            positions = index.pop(rank)
            positions.sort()
            for p in positions:
                q = nxt[p]
                if q < 0 or tok[p] < 0 or merged.get(tok[p] << shift | tok[q]) != rank:
                    continue  # an earlier merge took one of the halves
                after, before = nxt[q], prv[p]
                tok[p], tok[q], nxt[p] = rank, -1, after
                if after >= 0:
                    prv[after] = p
                    m = merged.get(rank << shift | tok[after])
                    if m is not None:
                        if m in index:
                            index[m].append(p)
                        else:
                            index[m] = [p]
                            heapq.heappush(heap, m)
                if before >= 0:
                    m = merged.get(tok[before] << shift | rank)
                    if m is not None:
                        if m in index:
                            index[m].append(before)
                        else:
                            index[m] = [before]
                            heapq.heappush(heap, m)
        out = np.array(tok, np.int64)
        alive = out >= 0
        ids = out[alive].astype("<u4").tobytes()
        bounds = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])] * 4
        bounds = bounds.tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def pieces(self, text: str) -> list[str]:
        """A cut of the text at which pre-tokens always begin.

        A single space between two other characters that are not white space
        begins a pre-token; texts with longer white space are cut by the
        pattern itself.
        """
        if not text:
            return []
        if _RUN.search(text) or text[0].isspace() or text[-1].isspace():
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        if len(self.cache) > CACHE_PIECES:  # pieces seen again come back from the older half
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        unseen = {p for pieces in cut for p in pieces if p not in cache}
        new = []
        for p in unseen:
            known = older.get(p)
            if known is None:
                new.append(p)
            else:
                cache[p] = known
        split = [self.pattern.findall(p) for p in new]
        distinct = list({w for words in split for w in words})
        ids = dict(zip(distinct, self.words([w.encode() for w in distinct])))
        for piece, words in zip(new, split):
            cache[piece] = ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words])
        get = cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids' tokens."""
        a = np.frombuffer(ids, "<u4").astype(np.int64)
        lengths = self.token_len[a]
        ends = np.cumsum(lengths)
        if not len(a):
            return b""
        return self.blob[np.repeat(self.token_at[a] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


_RUN = regex.compile(r"\s\s")
_LOADED: dict[tuple[str, str], Replay] = {}


def codec(path: str, pattern: str) -> Replay:
    """The vocabulary of a rank file, loaded once a worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Replay(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_documents(df: DataFrame, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``vocabulary`` names a rank file that every executor has (default: the
    public multilingual one); ``keep_ids`` adds the ids as binary.
    """
    schema = f"doc_id {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    rows = df.select(df[id_col].alias("doc_id"), full_text(text_col).alias("text"))

    def run(batches):
        import public_tokenizers

        few_collections()
        bpe = codec(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        for b in batches:
            for lo, hi, texts in text_blocks(b, "text", BLOCK_BYTES):
                ids = bpe.encode_block(texts)
                columns = [
                    b.column("doc_id").slice(lo, hi - lo),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def op9_byte_bpe(spark, sf_dir):
    """Query op9: every text of ``documents`` encoded and decoded."""
    return encode_documents(table(spark, sf_dir, "documents"))
