"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass over the texts computes the statistics (a small table, stored once);
the trees are grown in numpy from feature histograms on a bounded sample of
labelled rows, flattened into arrays, and all rows are scored by vectorised
traversal.

Edge cases: a null text is empty, and an empty text is scored like any other;
a document without a label is only scored, one with several labels counts once
for each; labels other than 0 and 1 and null ids are not learned from; without
usable labels of both kinds every score is the share of ones (0.5 if there are
none); repeated rows get equal scores; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import full_text, give_back, stored, table, text_blocks

#: Labelled rows that are learned from at most: those of the smallest hash of their id.
FIT_ROWS = 30_000
BINS = 64
BLOCK_BYTES = 4_000_000

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SYMBOLS = b"#$%&*+/<=>@\\^_`{|}~[]"
FEATURES = (
    "log_bytes", "log_words", "log_lines", "mean_word", "sd_word", "letters", "upper", "digits", "spaces", "punctuation", "symbols",
    "non_ascii", "byte_entropy", "sentence_ends", "distinct_words", "top_word", "top4_words", "repeated_neighbours", "repeated_pairs",
    "short_lines", "distinct_lines", "mean_line", "upper_words", "capital_words", "symbol_words", "mixed_words", "ended_lines", "most_common_byte",
)


def statistics(text: str) -> np.ndarray:
    """The statistics of one whole text."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    share = counts[counts > 0] / n
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    freq = np.sort(np.bincount(code)) if len(code) else np.zeros(1)
    if len(code) > 1:
        same = np.count_nonzero(code[1:] == code[:-1]) / w
        pairs = code[1:] * len(ids) + code[:-1]
        repeated_pairs = 1 - len(np.unique(pairs)) / len(pairs)
    else:
        same = repeated_pairs = 0.0
    lines = text.split("\n")
    distinct = ids.keys()
    weight = np.bincount(code) if len(code) else np.zeros(0)
    kinds = np.array([(x.isupper() and len(x) > 1, x[:1].isupper(), not x.isalnum() and not x[:-1].isalnum(), x[1:].lower() != x[1:] and not x.isupper()) for x in distinct], float).reshape(-1, 4)
    upper_words, capital, symbol_words, mixed = (weight @ kinds / w) if len(kinds) else np.zeros(4)
    line_lengths = [len(x) for x in lines]
    return np.array(
        [
            np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(),
            (upper + lower) / n, upper / max(1, upper + lower), counts[48:58].sum() / n, (counts[32] + counts[9:14].sum()) / n,
            sum(int(counts[c]) for c in _PUNCTUATION) / n, sum(int(counts[c]) for c in _SYMBOLS) / n, counts[128:].sum() / n,
            float(-(share * np.log2(share)).sum()) if len(raw) else 0.0, (counts[46] + counts[33] + counts[63]) / w,
            len(ids) / w, freq[-1] / w, freq[-4:].sum() / w, same, repeated_pairs,
            sum(x < 20 for x in line_lengths) / len(lines), len(set(lines)) / len(lines), sum(line_lengths) / len(lines),
            upper_words, capital, symbol_words, mixed, sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines), counts.max() / n,
        ],
        np.float32,
    )


def feature_table(df: DataFrame, id_col: str, text_col: str, *also: str) -> DataFrame:
    """doc_id and its statistics as an array, and the columns named in ``also``."""
    rows = df.select(df[id_col].alias("doc_id"), full_text(text_col).alias("text"), *also)
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            for lo, hi, texts in text_blocks(b, "text", BLOCK_BYTES):
                flat = np.concatenate([statistics(x) for x in texts])
                offsets = np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)
                x = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), x, *(b.column(c).slice(lo, hi - lo) for c in also)], ["doc_id", "x", *also])

    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, x array<float>" + "".join(f", {c} {kinds[c]}" for c in also))


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(id_col.cast("string")) % modulus


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, held: Column, limit: int) -> DataFrame:
    """The rows of at most ``limit`` labels that may be learned from, of the smallest id hash, with the label as ``y``.

    Labels of documents that ``rows`` does not hold do not count towards the limit.
    """
    usable = labels.select(labels["doc_id"].alias("k"), labels[label].cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull() & ~held)
    there = rows.select(rows["doc_id"].alias("there"))
    usable = usable.join(there, usable["k"] == there["there"], "left_semi")
    picked = usable.orderBy(F.xxhash64("k"), "k", "y").limit(limit)
    return rows.join(F.broadcast(picked), rows["doc_id"] == picked["k"]).drop("k")  # bounded by limit


def bounded(sample: DataFrame, limit: int, *learned: str) -> DataFrame:
    """At most ``limit`` rows of a sample, where ids have several rows; the columns ``learned`` break ties."""
    return sample.orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64(*learned)).limit(limit)


@dataclass
class Trees:
    """All trees as flat arrays: node -> feature, threshold, children, value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row; all trees of all rows step down together."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        out = np.empty(len(x))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                go_left = part[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(go_left, self.left[node], self.right[node])
            out[lo : lo + 4096] = self.base + self.value[node].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.12, penalty: float = 1.0, least: float = 4.0) -> Trees:
    """Boosted trees by second-order gain on histograms of binned features."""
    mean = float(y.mean()) if len(y) else 0.5
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    parts: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}
    roots: list[int] = []
    if len(y) and 0 < y.mean() < 1:
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
        offset = np.arange(f) * BINS
        raw = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            roots.append(_tree(parts, binned, offset, edges, g, h, raw, depth, rate, penalty, least))
    a = {k: np.array(v) for k, v in parts.items()}
    ints = lambda v: a[v].astype(np.int64)
    return Trees(base, ints("feature"), a["threshold"].astype(np.float32), ints("left"), ints("right"), a["value"].astype(float), np.array(roots, np.int64), depth)


def _tree(parts, binned, offset, edges, g, h, raw, depth, rate, penalty, least) -> int:
    """Grows one tree level by level, appends it to ``parts`` and updates ``raw``."""
    def node(value: float) -> int:
        at = len(parts["feature"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", value)):
            parts[k].append(v)
        return at

    def leaf_value(rows) -> float:
        return -rate * g[rows].sum() / (h[rows].sum() + penalty)

    everything = np.arange(len(g))
    root = node(leaf_value(everything))
    level, width = [(root, everything)], len(offset) * BINS
    for step in range(depth):
        following = []
        for at, rows in level:
            cells = (binned[rows] + offset).ravel()
            repeat = len(offset)
            hg = np.bincount(cells, np.repeat(g[rows], repeat), width).reshape(-1, BINS)
            hh = np.bincount(cells, np.repeat(h[rows], repeat), width).reshape(-1, BINS)
            gl, hl = hg.cumsum(1)[:, :-1], hh.cumsum(1)[:, :-1]
            gt, ht = g[rows].sum(), h[rows].sum()
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(hl < least) | (ht - hl < least)] = -np.inf
            feature, cut = np.unravel_index(int(gain.argmax()), gain.shape)
            if not gain[feature, cut] > 1e-6 or cut >= len(edges[feature]):
                raw[rows] += parts["value"][at]
                continue
            down = binned[rows, feature] <= cut
            below, above = rows[down], rows[~down]
            left, right = node(leaf_value(below)), node(leaf_value(above))
            parts["feature"][at], parts["threshold"][at] = int(feature), edges[feature][cut]
            parts["left"][at], parts["right"][at] = left, right
            following += [(left, below), (right, above)]
        level = following
    for at, rows in level:
        raw[rows] += parts["value"][at]
    return root


def fit_quality(features: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1, limit: int = FIT_ROWS) -> Trees:
    """Trees fitted on a bounded sample of the labelled rows outside the held-out fold."""
    return fit_rows(labelled_sample(features, labels, label, fold(F.col("k"), modulus) == held, limit), limit)


def fit_rows(rows: DataFrame, limit: int = FIT_ROWS) -> Trees:
    """Trees fitted on at most ``limit`` rows of statistics ``x`` and label ``y``."""
    sample = bounded(rows, limit, "x").select("x", "y").toPandas()
    x = np.array(sample["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, sample["y"].to_numpy()]) if len(x) else np.zeros(0, int)
    model = grow(x[order], sample["y"].to_numpy(float)[order])
    del sample, x
    give_back()
    return model


def score_features(features: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score of every row of a feature table."""
    kind = dict(features.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return features.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    features = stored(feature_table(df, id_col, text_col), "quality")
    scored = score_features(features, fit_quality(features, labels))
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose text scores ``least`` or more, with their own columns."""
    wanted = labelled_sample(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), labels, "quality", fold(F.col("k"), 3) == 1, FIT_ROWS)
    model = fit_rows(feature_table(wanted, "doc_id", "text", "y"))
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            for lo, hi, texts in text_blocks(b, at, BLOCK_BYTES):
                x = np.array([statistics(t) for t in texts], np.float32).reshape(-1, len(FEATURES))
                yield b.slice(lo, hi - lo).filter(pa.array(model.score(x) >= least))

    return df.mapInArrow(run, df.schema)


def op8_quality_classifier(spark, sf_dir):
    """Query op8: every text of ``documents`` scored for quality."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
