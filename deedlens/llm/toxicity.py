"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams (and of itself),
hashed into buckets; a document is the mean of its words, repeats counting by
their logarithm; two outputs follow from a linear layer.  Embeddings and layer are trained jointly in numpy, so a
misspelling never seen shares the n-gram vectors of what was.  Training takes a
bounded number of labelled documents, whole texts of any length each.  Executors
turn them into distinct words' hashes and shares, and every distinct word of the
sample once into its n-grams: the driver holds 12 bytes for each distinct word of
a document and 4 for each n-gram, no texts.  As the model is linear, scoring adds up one number per word.

Edge cases: a null text is empty, and an empty text scores by the bias alone;
documents with several labels, or several texts of one id, count once for each; labels other than 0 and 1
and null ids are not learned from; without labels of both kinds every score is
the share of ones (0 if there are none); repeated rows get equal scores; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, full_text, give_back, stored, table, text_blocks
from .quality import bounded, fold, labelled_sample

#: Labelled documents that are learned from at most: those of the smallest hash of their id.
FIT_DOCUMENTS = 8_000
BUCKETS = 1 << 18
DIM = 4
SHORTEST, LONGEST = 3, 5
#: Blank words that every average includes: they steady the shortest texts.  This and the other settings were
#: chosen by log-loss on the labelled rows of sf0.1 with remainder 1, after training on those with 2 to 4.
BLANKS = 40.0
#: An n-gram is learned if at least so many training documents hold it, and such a share of them.
LEAST_DOCUMENTS, LEAST_SHARE = 3, 0.005
#: Words in a worker's cache.
CACHE_WORDS = 500_000
BLOCK_BYTES = 4_000_000
_EDGE = ".,;:!?\"'()[]{}*#%$&|-_<>"


def buckets(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    w = f"<{word}>"
    raw = [w] + [w[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(w) - n + 1)]
    return [zlib.crc32(x.encode("utf-8", "replace")) & (BUCKETS - 1) for x in raw]


def words_of(text: str) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split()


def counted(text: str) -> Counter:
    """A text's distinct words, without punctuation around them, and their numbers: the bag of training and of scoring."""
    return Counter(w.strip(_EDGE) for w in words_of(text))


def shares(counts) -> np.ndarray:
    """Weights of the distinct words in the average, blanks included."""
    share = 1 + np.log(np.fromiter(counts, np.float64, len(counts)))
    return share / (share.sum() + BLANKS)


def bag(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A text's distinct words in the order of their hashes, the hashes and the shares."""
    seen = counted(text)
    words = list(seen)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    order = np.argsort(hashes, kind="stable")
    return [words[i] for i in order], hashes[order], shares(seen.values()).astype(np.float32)[order]


@dataclass
class Corpus:
    """Training documents: distinct words with their shares, and the words' buckets."""

    words: list[np.ndarray]
    shares: list[np.ndarray]
    first: np.ndarray
    grams: np.ndarray  # numbers of learned buckets
    sizes: np.ndarray
    learned: np.ndarray  # buckets that enough documents hold

    @classmethod
    def of(cls, texts: list[str]) -> Corpus:
        """The corpus of some texts."""
        bags = [bag(t) for t in texts]
        by_hash = {h: w for words, hashes, _ in bags for h, w in zip(hashes.tolist(), words)}
        grams = [np.array(buckets(by_hash[h]), np.int32) for h in sorted(by_hash)]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.int32)
        return cls.built([x[1:] for x in bags], np.array(sorted(by_hash), np.uint64), flat, np.array([len(g) for g in grams], np.int64))

    @classmethod
    def built(cls, bags: list[tuple[np.ndarray, np.ndarray]], vocabulary: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> Corpus:
        """From (hashes, shares) of every document, and the n-grams of all words in the order of their hashes."""
        words = [np.searchsorted(vocabulary, h).astype(np.int32) for h, _ in bags]
        frequency = np.zeros(BUCKETS, np.int64)
        ends = np.cumsum(sizes)
        for w in words:
            frequency[np.unique(grams[_flat(ends[w] - sizes[w], sizes[w])])] += 1
        enough = frequency >= max(LEAST_DOCUMENTS, round(LEAST_SHARE * len(bags)))
        kept = enough[grams]
        count = np.add.reduceat(kept, ends - sizes, dtype=np.int64) if len(ends) else np.zeros(0, np.int64)
        number = (np.cumsum(enough) - 1).astype(np.int32)
        return cls(words, [x for _, x in bags], np.concatenate([[0], np.cumsum(count)]), number[grams[kept]], sizes, np.flatnonzero(enough))


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all ranges [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Subwords:
    """The trained model, folded to one log-odds number per bucket."""

    bucket: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        """A word's log-odds in the average."""
        ids = buckets(word)
        return float(self.bucket[ids].sum()) / len(ids)

    def scores(self, texts: list[str], cache: dict[str, float]) -> np.ndarray:
        """Probability that each text is toxic."""
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            seen = counted(text)
            for w in [w for w in seen if w not in cache]:
                cache[w] = self.word(w)
            if seen:
                mean = float(shares(seen.values()) @ np.fromiter(map(cache.__getitem__, seen), np.float64, len(seen)))
            else:
                mean = 0.0
            out[i] = mean + self.bias
            if len(cache) > CACHE_WORDS:
                cache.clear()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(texts: list[str] | Corpus, y: np.ndarray, steps: int = 1200, batch: int = 64, rate: float = 0.5, scale: float = 60.0, toxic_weight: float = 3.0, dropout: float = 0.7, seed: int = 1) -> Subwords:
    """Embeddings and softmax layer by Adagrad on about ``steps`` mini-batches.

    N-grams drop out at random, so that no document is learned by its rare ones.
    """
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Subwords(np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    c = texts if isinstance(texts, Corpus) else Corpus.of(texts)
    random = np.random.default_rng(seed)
    e = np.zeros((len(c.learned), DIM))  # an n-gram that is not learned says nothing
    w, b = random.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    se, sw, sb = np.full(len(e), 1e-4), np.full(w.shape, 1e-4), np.full(2, 1e-4)
    cost = np.where(y == 1, toxic_weight, 1.0)
    usable = np.flatnonzero([len(x) for x in c.words])
    epochs = max(1, -(-steps * batch // max(1, len(usable))))
    summed = lambda at, values, n: np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], 1)
    for epoch in range(epochs):
        order = random.permutation(usable)
        step = rate * (1 - epoch / epochs)
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            word, at = np.unique(np.concatenate([c.words[i] for i in rows]), return_inverse=True)
            share = np.concatenate([c.shares[i] for i in rows])
            doc_of = np.repeat(np.arange(len(rows)), [len(c.words[i]) for i in rows])
            n = c.first[word + 1] - c.first[word]
            gram = c.grams[_flat(c.first[word], n)]
            word_of = np.repeat(np.arange(len(word)), n)
            part = (random.random(len(gram)) >= dropout) / (1 - dropout) / c.sizes[word][word_of]
            vectors = summed(word_of, e[gram] * part[:, None], len(word))
            doc = scale * summed(doc_of, vectors[at] * share[:, None], len(rows))
            logits = doc @ w + b
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= cost[rows][:, None] / len(rows)
            gw, gb = doc.T @ p, p.sum(0)
            by_word = summed(at, (scale * (p @ w.T))[doc_of] * share[:, None], len(word))
            ge = summed(gram, by_word[word_of] * part[:, None], len(e))
            se += (ge**2).mean(1)
            e -= step * ge / np.sqrt(se)[:, None]
            sw += gw**2
            w -= step * gw / np.sqrt(sw)
            sb += gb**2
            b -= step * gb / np.sqrt(sb)
    bucket = np.zeros(BUCKETS, np.float32)
    bucket[c.learned] = scale * (e @ (w[:, 1] - w[:, 0]))
    return Subwords(bucket, float(b[1] - b[0]))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held: int = 0, limit: int = FIT_DOCUMENTS) -> Subwords:
    """The model from a bounded sample of labelled documents outside the held-out fold."""
    docs = df.select(df[id_col].alias("doc_id"), full_text(text_col).alias("text"))
    rows = labelled_sample(docs, labels, "toxic", fold(F.col("k"), modulus) == held, limit)

    def bags(batches):
        for b in batches:
            for lo, hi, texts in text_blocks(b, "text", BLOCK_BYTES):
                got = [bag(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("y").slice(lo, hi - lo), pa.array([x[0] for x in got], pa.list_(pa.string())),
                     pa.array([x[1].tobytes() for x in got], pa.binary()), pa.array([x[2].tobytes() for x in got], pa.binary())],
                    ["doc_id", "y", "words", "hashes", "shares"],
                )

    def grams(batches):
        for b in batches:
            words = b.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_64_intdigest(w) for w in words], pa.uint64()).view(pa.int64()), pa.array([np.array(buckets(w), np.int32).tobytes() for w in words], pa.binary())], ["h", "grams"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    sample = stored(rows.select("doc_id", "y", "text").mapInArrow(bags, f"doc_id {kind}, y int, words array<string>, hashes binary, shares binary"), "bags")
    if sample.count() > limit:  # ids with several texts
        sample = stored(bounded(sample, limit, "hashes", "shares"), "bags")
    got = sample.select("doc_id", "y", "hashes", "shares").orderBy("doc_id", "y", "hashes", "shares").toArrow()  # bounded by limit
    y = got["y"].to_numpy().astype(np.int64)
    documents = [(np.frombuffer(h.as_py(), np.uint64), np.frombuffer(x.as_py(), np.float32)) for h, x in zip(got["hashes"], got["shares"])]
    del got
    words = sample.select(F.explode("words").alias("word")).distinct().mapInArrow(grams, "h long, grams binary").toArrow()  # the sample's words
    dropped(sample)
    hashes, first = np.unique(words["h"].to_numpy().view(np.uint64), return_index=True)
    lists = words["grams"].take(pa.array(first)).combine_chunks()
    del words
    flat = np.frombuffer(b"".join(x.as_py() for x in lists), np.int32)
    sizes = np.fromiter((len(x.as_py()) // 4 for x in lists), np.int64, len(lists))
    del lists
    model = train(Corpus.built(documents, hashes, flat, sizes), y)
    del documents, flat
    give_back()
    return model


_CACHES: dict[tuple, dict[str, float]] = {}


def _cache(model: Subwords) -> dict[str, float]:
    """The word cache of a model in this worker; only the last model has one."""
    key = (zlib.crc32(model.bucket.tobytes()), model.bias)
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = {}
    return _CACHES[key]


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(df, labels, id_col, text_col)
    rows = df.select(df[id_col].alias("doc_id"), full_text(text_col).alias("text"))

    def run(batches):
        cache = _cache(model)
        for b in batches:
            for lo, hi, texts in text_blocks(b, "text", BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(model.scores(texts, cache), pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose text scores under ``below``, with their own columns."""
    model = fit(df, labels, id_col, text_col)
    at = df.columns.index(text_col)

    def run(batches):
        cache = _cache(model)
        for b in batches:
            for lo, hi, texts in text_blocks(b, at, BLOCK_BYTES):
                yield b.slice(lo, hi - lo).filter(pa.array(model.scores(texts, cache) < below))

    return df.mapInArrow(run, df.schema)


def op3_toxicity(spark, sf_dir):
    """Query op3: every text of ``documents`` scored for toxicity."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
