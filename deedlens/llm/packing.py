"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised and cut into pieces; only the histogram of piece lengths
(at most as many rows as a sequence has tokens) reaches the driver.  There the
covering program "fewest sequences so that every length class is covered" is
solved by multiplicative weights: each round prices the lengths, a knapsack
dynamic program finds the configuration of the largest price, and the classes it
uses become cheaper.  The fractional solution is rounded down, and what is left
is packed best fit, still on the histogram.  The plan is as small as the
histogram; executors turn it into a place for every piece from the piece's rank
in its length class.

Edge cases: a null or empty text is one piece of the end token; only documents
longer than a sequence are cut; rows that repeat a doc_id are packed each; equal
lengths are ranked by doc_id and piece; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import re
import string
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few_collections, full_text, single_thread, stored, table, text_blocks

SEQUENCE = 2048
END_ID = 0
ROUNDS = 300
#: Configurations that a round takes from one table of prices.
PRICED = 32
#: Pieces of a length class that are ranked together, and groups of a class at most.
RANK_GROUP, MOST_GROUPS = 400, 4096
CACHE_CHUNKS = 250_000
BLOCK_BYTES = 2_000_000

# White space and cases on which Python and the tokenizer's own rules differ.
# The sign stands between chunks that are encoded together; it must be one token.
_SIGN, _JOINED, _TOGETHER = "\u00d7", 500, 4000
_ODD = re.compile(f"[\x1c-\x1fΣ{_SIGN}]")
#: Letters below it are letters in every version of Unicode that a library may hold.
_PLAIN_BELOW = "\u0250"


def byte_letters() -> dict[int, str]:
    """Every plain letter as the letters of its UTF-8 bytes, by the byte-level rule.

    Printable bytes stand for themselves, the others for letters from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(chr(others.get(b, b)) for b in chr(c).encode()) for c in range(128, ord(_PLAIN_BELOW))}


class ChunkTokenizer:
    """The tokenizer, run once for every distinct chunk between white space.

    The vocabulary drops white space, so a text's ids are its chunks' ids.  Most
    chunks are a word of plain letters with punctuation at its end: those two
    are what the tokenizer's own pattern would find, so words go straight to its
    merges, many at a time, and the ids that end a word tell them apart.
    """

    def __init__(self, path: str):
        single_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        sign = self.tokenizer.encode(_SIGN, add_special_tokens=False).ids
        if len(sign) != 1:
            raise ValueError("the separating sign is not one token of this vocabulary")
        self.sign = sign[0]
        rules = json.loads(self.tokenizer.to_str())
        suffix = rules["model"].get("end_of_word_suffix")
        if not suffix:
            raise ValueError("this vocabulary does not mark the ends of words")
        self.merges = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.ends = np.zeros(max(rules["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in rules["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.letters = byte_letters()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, chunks: list[str], out: dict[str, bytes]) -> None:
        """Ids of chunks by all the tokenizer's rules."""
        for lo in range(0, len(chunks), _JOINED):
            part = chunks[lo : lo + _JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([f"\n{_SIGN}\n".join(part)], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.sign) * 4).tolist()
            for c, a, b in zip(part, [0, *[x + 4 for x in ends]], [*ends, len(raw)]):
                out[c] = raw[a:b]

    def _words(self, words: list[str], out: dict[str, bytes]) -> None:
        """Ids of words of plain letters by the merges alone."""
        for lo in range(0, len(words), _TOGETHER):
            part = words[lo : lo + _TOGETHER]
            joined = " ".join(part)
            if not joined.isascii():
                joined = joined.translate(self.letters)
            ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            starts = [0, *ends]
            starts.pop()
            out.update(zip(part, map(raw.__getitem__, map(slice, starts, ends)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_CHUNKS:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        cut: list[list[str] | None] = []
        for t in texts:
            if _ODD.search(t):
                cut.append(None)
                continue
            if not t.isascii() and not unicodedata.is_normalized("NFC", t):
                t = unicodedata.normalize("NFC", t)
            cut.append(t.lower().split())
        parts, whole, words, punctuation = [], set(), set(), string.punctuation
        for c in set().union(*filter(None, cut)).difference(cache):
            known = older.get(c)
            if known is not None:
                cache[c] = known
                continue
            word = c.rstrip(punctuation)
            if word.isalpha() and (word.isascii() or max(word) < _PLAIN_BELOW):
                words.add(word)
                if len(word) < len(c):
                    parts.append((c, word, c[len(word) :]))
                    whole.add(c[len(word) :])
            else:
                whole.add(c)
        self._words([w for w in words if w not in cache], cache)
        self._whole([c for c in whole if c not in cache], cache)
        for c, word, rest in parts:
            cache[c] = cache[word] + cache[rest]
        get = cache.__getitem__
        return [
            b"".join(map(get, chunks)) if chunks is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for t, chunks in zip(texts, cut)
        ]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer a worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def cut_pieces(df: DataFrame, path: str | None = None, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's pieces."""
    kind = dict(df.dtypes)[id_col]
    rows = df.select(df[id_col].alias("doc_id"), full_text(text_col).alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        import public_tokenizers

        few_collections()
        tok = tokenizer(path or public_tokenizers.path("word_bpe_49k.json"))
        for b in batches:
            for lo, _, texts in text_blocks(b, "text", BLOCK_BYTES):
                owner, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(tok.encode(texts)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        owner.append(lo + i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(part)
                columns = [b.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


Config = dict[int, int]  # length -> copies in one sequence


class Knapsack:
    """The largest price of every room up to a sequence (copies unbounded), and what reaches it."""

    def __init__(self, lengths: np.ndarray, price: np.ndarray, size: int):
        self.lengths, self.price = lengths, price
        self.best, self.choice = np.zeros(size + 1), np.zeros(size + 1, np.int64)  # choice: a length, or 0
        of, gain = np.full(size + 1, -np.inf), np.empty(size + 1)
        of[lengths] = price
        best, choice = self.best, self.choice
        for c in range(1, size + 1):
            # the last piece has length 1 ... c, which leaves room c - 1 ... 0
            np.add(best[c - 1 :: -1], of[1 : c + 1], out=gain[:c])
            k = int(gain[:c].argmax())
            if gain[k] > best[c - 1]:
                best[c], choice[c] = gain[k], k + 1
            else:
                best[c] = best[c - 1]

    def through(self, s: int) -> Config:
        """The configuration of the largest price that holds length ``s``."""
        out, room = {s: 1}, len(self.best) - 1 - s
        while room > 0:
            n = int(self.choice[room])
            if n:
                out[n] = out.get(n, 0) + 1
            room -= n or 1
        return out

    def dearest(self, most: int) -> list[Config]:
        """The dearest configuration through each of ``most`` lengths, the dearest of all first."""
        worth = self.price + self.best[len(self.best) - 1 - self.lengths]
        top = np.argsort(-worth, kind="stable")[:most]
        return [self.through(int(self.lengths[i])) for i in top]


def solve(lengths: np.ndarray, counts: np.ndarray, size: int, rounds: int = ROUNDS) -> list[tuple[float, Config]]:
    """A fractional cover by configurations, by multiplicative weights; every class is covered fully."""
    bound = float(lengths @ counts) / size
    step = bound / rounds / PRICED
    covered = np.zeros(len(lengths))
    at = {int(s): i for i, s in enumerate(lengths)}
    found: dict[tuple, float] = {}

    def use(config: Config, most: float) -> None:
        """Takes ``config`` up to ``most`` times, as long as it covers no class beyond what there is."""
        x = min(most, *((1 - covered[at[s]]) * counts[at[s]] / n for s, n in config.items()))
        if x > 0:
            key = tuple(sorted(config.items()))
            found[key] = found.get(key, 0.0) + x
            for s, n in config.items():
                i = at[s]
                covered[i] += x * n / counts[i]
                if covered[i] > 1 - 1e-9:
                    covered[i] = 1.0

    # a class's price: its share of a sequence, cheaper the more of it is covered
    rate = 5 * np.log(len(lengths) + 1)
    for k in range(rounds):
        price = lengths / size * np.exp(-np.clip(rate * (covered - k / rounds), -40, 40))
        there = covered < 1
        if not there.any():
            break
        for config in Knapsack(lengths[there], price[there], size).dearest(PRICED):
            use(config, step)
    while (covered < 1).any():  # what the rounds have left: each configuration covers a class to its end
        there = covered < 1
        for config in Knapsack(lengths[there], lengths[there] / size, size).dearest(int(there.sum())):
            use(config, np.inf)
    return [(x, dict(key)) for key, x in sorted(found.items(), key=lambda kv: (-kv[1], kv[0]))]


def best_fit(left: dict[int, int], size: int) -> list[tuple[int, Config]]:
    """All of ``left`` in sequences, the longest piece first and then the longest that still fits."""
    left, out = dict(left), []
    there = sorted(left)
    while left:
        there = [s for s in there if s in left]
        room, config = size, {}
        while room > 0:
            i = bisect.bisect_right(there, room)
            while i and left[there[i - 1]] <= config.get(there[i - 1], 0):
                i -= 1
            if not i:
                break
            s = there[i - 1]
            config[s] = config.get(s, 0) + 1
            room -= s
        m = min(left[s] // n for s, n in config.items())
        out.append((m, config))
        _take(left, config, m)
    return out


def _take(left: dict[int, int], config: Config, m: int) -> None:
    for s, n in config.items():
        left[s] -= m * n
        if not left[s]:
            del left[s]


def rounded(fractional: list[tuple[float, Config]], left: dict[int, int], size: int) -> list[tuple[int, Config]]:
    """Whole numbers of configurations within ``left``, fuller ones first.

    A configuration hands on what rounding cut off, so the sum stays that of the
    program as far as there are pieces.
    """
    out, owed, left = [], 0.0, dict(left)
    fill = lambda config: sum(s * n for s, n in config.items())
    for x, config in sorted(fractional, key=lambda c: (-fill(c[1]), -c[0])):
        owed += x
        m = min(int(owed + 1e-9), min(left.get(s, 0) // n for s, n in config.items()))
        if m > 0:
            out.append((m, config))
            _take(left, config, m)
            owed -= m
    return out


def pack_histogram(histogram: dict[int, int], size: int = SEQUENCE, rounds: int = ROUNDS) -> list[tuple[int, Config]]:
    """How many sequences of which configuration hold exactly the histogram.

    The program's rounded configurations come first and best fit packs what they
    leave.  Where that needs more sequences than the program's value rounded up,
    the least full configurations are taken back, an eighth of them each time, so that
    best fit has more to combine.
    """
    left = {int(s): int(n) for s, n in histogram.items() if n}
    whole = [(left.pop(size), {size: 1})] if left.get(size) else []
    if not left:
        return whole
    lengths = np.array(sorted(left), np.int64)
    fractional = solve(lengths, np.array([left[int(s)] for s in lengths], np.float64), size, rounds)
    enough = -(-int(lengths @ [left[int(s)] for s in lengths]) // size)
    chosen, best = rounded(fractional, left, size), None
    while True:
        rest = dict(left)
        for m, config in chosen:
            _take(rest, config, m)
        plan = chosen + best_fit(rest, size)
        n = sum(m for m, _ in plan)
        if best is None or n < best[0]:
            best = n, plan
        if n <= enough or not chosen:
            return whole + best[1]
        chosen = chosen[: len(chosen) - -(-len(chosen) // 8)]


@dataclass
class Plan:
    """The plan as arrays: a piece's length and rank give its sequence and offset."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    sequences: int

    SHIFT = 44

    @classmethod
    def of(cls, plan: list[tuple[int, Config]]) -> Plan:
        rows, used, sequence = [], {}, 0
        for m, config in plan:
            offset = 0
            for s, n in sorted(config.items(), reverse=True):
                rank = used.get(s, 0)
                rows.append((s << cls.SHIFT | rank, rank, sequence, n, offset))
                used[s] = rank + m * n
                offset += s * n
            sequence += m
        a = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return cls(a[:, 0], a[:, 1], a[:, 2], a[:, 3], a[:, 4], sequence)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        i = np.searchsorted(self.key, length << self.SHIFT | rank, "right") - 1
        n = rank - self.first[i]
        return self.sequence[i] + n // self.copies[i], self.offset[i] + n % self.copies[i] * length


def ranked(pieces: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
    """``pieces`` with their rank in their length class.

    Large classes are ranked in groups by hash, whose sizes give each group's first rank.
    """
    groups = [min(MOST_GROUPS, max(1, -(-counts.get(s, 0) // RANK_GROUP))) for s in range(size + 1)]
    of = F.element_at(F.array(*[F.lit(g) for g in groups]), F.col("length").cast("int") + 1)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), of))
    sizes = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return pieces.withColumn("own", own).join(sizes, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("salt", "own", "before")


def pack(pieces: DataFrame, size: int = SEQUENCE, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (stored: read three times) with ``sequence_id`` and ``offset``."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    plan = Plan.of(pack_histogram(counts, size, rounds))
    rows = ranked(pieces, counts, size)
    fields = [f for f in rows.schema.fields if f.name != "rank"]

    def run(batches):
        for b in batches:
            sequence, offset = plan.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f.name) for f in fields), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*(f.name for f in fields), "sequence_id", "offset"]
            )

    schema = rows.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return rows.mapInArrow(run, schema)


def pack_documents(df: DataFrame, size: int = SEQUENCE, rounds: int = ROUNDS, path: str | None = None) -> DataFrame:
    """Tokenises, cuts and packs all documents."""
    packed = pack(stored(cut_pieces(df, path, size), "pieces"), size, rounds)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark, sf_dir):
    """Query op5: all ``documents`` packed."""
    return pack_documents(table(spark, sf_dir, "documents"))
