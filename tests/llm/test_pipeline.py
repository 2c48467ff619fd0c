"""The corpus pipeline against a version of each stage that works row by row."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deedlens.llm import minhash, quality, toxicity

from ..conftest import SF
from .test_operators import brute_classes

pipeline = pytest.importorskip("corpus_pipeline")


def fold(k, m):
    return zlib.crc32(str(k).encode()) % m


def without_repeats(rows):
    first = {}
    for i, t in rows.items():
        b = t.encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = {}
    for i, t in rows.items():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        out[i] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
    return out


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1)).withColumn("score", F.lit("s"))
    for name, stage in pipeline.STAGES[2:4]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x y", "en", "s", 3)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    for name, stage in pipeline.STAGES[2:]:
        assert stage(spark, odd, SF).count() == (2 if name == "near_dedup" else 3), name


def test_classifying_stages_of_odd_rows(spark):
    """Null, empty, very long and repeated texts, null ids and clashing names, with and without labels to learn from."""
    good = "This is a plain sentence of the kind that a person writes, with a few words more. " * 4
    texts = [None, "", "x y", "wide world " * 100_000, good, good, "bad idiot fool " * 10]
    rows = [(i, t, "en", "s", 0, 1.0, "y", "n") for i, t in enumerate(texts)] + [(4, good, "en", "s", 0, 1.0, "y", "n"), (None, good, "en", "s", 0, 1.0, "y", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, y string, k string")
    seen = collections.Counter(tuple(r) for r in docs.collect())
    for name, stage in pipeline.STAGES[:2]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        got = collections.Counter(tuple(r) for r in kept.collect())
        assert got <= seen, name
        by_text = collections.defaultdict(set)
        for r in docs.collect():
            by_text[r["text"]].add(tuple(r) in got)
        assert all(len(x) == 1 for x in by_text.values()), name  # equal texts go or stay together
        nothing = docs.where("doc_id is null")  # no label can be learned from: all rows stay
        assert stage(spark, nothing, SF).count() == 1, name


def test_run(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fit = [k for k in sorted(labels) if k in docs and fold(k, 3) != 1]
    x, y = np.array([quality.statistics(docs[k]) for k in fit]), np.array([labels[k]["quality"] for k in fit], float)
    order = np.lexsort([*x.T, y])
    trees = quality.grow(x[order], y[order])
    kept = {k: t for k, t in docs.items() if trees.score(quality.statistics(t)[None])[0] >= 0.5}
    fit = [k for k in sorted(labels) if k in kept and fold(k, 5) != 0]
    model = toxicity.train([kept[k] for k in fit], np.array([labels[k]["toxic"] for k in fit]))
    kept = {k: t for k, t in kept.items() if model.scores([t], {})[0] < 0.5}
    frame = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    classes = brute_classes(list(kept.items()), minhash.idf_table(frame))
    kept = without_repeats({k: t for k, t in kept.items() if classes[k] == k})
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for k, t in kept.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for p, i in enumerate(range(0, len(ids), 2048)):
            want[k, p, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())] += 1
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pipeline.run(spark, SF).collect())
    assert got == want
