"""Training-data operators: brute force, round trips, and edge cases."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deedlens.llm import bpe, html_main, merkle, minhash, ogg, packing, quality, suffix_dedup, toxicity, url_rules
from deedlens.llm.queries import QUERIES, SQL

from ..conftest import SF, rows_of

LONG = "wide world " * 30_000
TEXTS = [None, "", "a", "a", "one two three four five six. Seven!\nEight nine.\n\n\nTen", LONG, "é漢😀  x", LONG, "tab\tand  two spaces \n\n"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, empty and very long texts, copies, and columns of clashing names."""
    rows = [(i, t, "x", 1.0, 2, "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, held_out double, h1 int, piece string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


# -- op1 -----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu</a></ul></nav><div id="cookieNotice"><p>We use cookies on this very nice site for everybody.</p></div>
<div class=story><h1>Head&shy;line</h1><p>First   paragraph of some<br>words that are&nbsp;long enough &lt;here&gt;.<p>Second one has <b>bold</b> words, and enough of them.
<div class="ad-slot">Buy it now, it is cheap and good and new</div><p>Third paragraph ends the story with some more words.</p></div>
<section class="comments"><p>I like this story a lot, said one reader who wrote much.</p></section><form>Name <input></form><footer>&copy; me</footer>"""


def test_html_page():
    got = html_main.main_text(PAGE, {}).split("\n\n")
    assert got == ["Head­line", "First paragraph of some words that are long enough <here>.", "Second one has bold words, and enough of them.", "Third paragraph ends the story with some more words."]


def test_html_article_keeps_its_ends():
    lead, last = "A lead of a few plain words stands here.", "And a last sentence of a few words ends it."
    long = "word " * 300
    links = "".join(f"<li><a href=#{i}>Part {i}</a></li>" for i in range(60))
    for box in (f'<nav><ul>{links}</ul></nav>', f'<div class="related"><ul>{links}</ul></div>'):
        page = f"<body><div><h2>Title</h2><p>{lead}</p>{box}<p>{long}</p>{box}<p>{last}</p></div><div>Other</div></body>"
        assert html_main.main_text(page, {}).split("\n\n") == ["Title", lead, long.strip(), last]
    items = [f"item{i}" for i in range(30)]
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    tabled = "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in items) + "</table>"
    for end in (listed, tabled):
        for page in (f"<body><div>{long}</div>\n<div><p>{long}</p>\n{end}</div></body>", f"<body>\n<p>{long}</p>\n{end}\n<div>Other</div></body>"):
            assert html_main.main_text(page, {}).split("\n\n")[-30:] == items


STORY = "".join(f"<p>{'Some words of a story that is told here, and more of them follow in line ' + str(i)}.</p>" for i in range(4))
TOLD = [f"Some words of a story that is told here, and more of them follow in line {i}." for i in range(4)]


def test_html_without_end_of_head():
    for head in ("<head><title>T</title><meta charset=utf-8>", "<html><head><title>T</title><script>var a;</script>", "<title>T</title>"):
        for body in ("<body><div>", "<div>", "<section>"):
            assert html_main.main_text(f"<!DOCTYPE html>{head}{body}{STORY}</div>", {}).split("\n\n") == TOLD
    assert html_main.main_text("<head><title>T</title>" + "plain words of a page that has no tags at all after its head", {}).startswith("plain words")


def test_html_open_quotes():
    for tag in ('<p title="foo>', "<p title='foo>", '<p a="b" title="foo>'):
        assert html_main.main_text(f"<div>{STORY}{tag}And one more paragraph stands at the end of it</p></div>", {}).split("\n\n") == [*TOLD, "And one more paragraph stands at the end of it"]
    assert html_main.main_text(f'<div><p title="a > b">{STORY}</div>', {}).split("\n\n") == TOLD


def test_html_names_around_the_article():
    nav, said = '<div class="menu"><a href=/>Home</a> <a href=/x>Other</a></div>', '<div class="comments"><p>I like this story a lot, said one reader who wrote very much about it.</p></div>'
    for name in ("post comment-enabled", "story-header", "promo", "sidebar-left article"):
        got = html_main.main_text(f'<body><h1>Site</h1>{nav}<div class="{name}"><h1>Title</h1>{STORY}{said}</div></body>', {})
        assert got.split("\n\n") == ["Title", *TOLD], name
    # beside other text such names are left out
    assert html_main.main_text(f'<body>{nav}<div><p>{TOLD[0]}</p></div><div class="promo">{STORY}</div></body>', {}) == TOLD[0]


def test_html_names_of_sections():
    """Names of an article's own sections keep their text, names of what is beside it do not, fixed words or learned ones."""
    def page(name, box="div"):
        return f'<body><div class="menu"><a href=/>Home</a></div><{box}><h1>Title</h1>{STORY}<div class="{name}"><p>More words of a section that has a name.</p></div></{box}><div>Other</div></body>'

    def kept(name, weights):
        got = html_main.main_text(page(name), weights).split("\n\n")
        assert got[:5] == ["Title", *TOLD]
        assert got[5:] in ([], ["More words of a section that has a name."]), name
        return len(got) > 5

    for name in ("related-work", "relatedWork", "copyright-law", "ad-hoc", "social-history", "header-compression", "teaser"):
        assert kept(name, {}), name
    for name in ("related", "relatedPosts", "related-posts", "x ad", "ad-slot-3", "comments-list", "cookie-banner", "post-share-buttons"):
        assert not kept(name, {}), name

    def counted(n, make):
        total = collections.Counter()
        for _ in range(n):
            total.update(html_main.count_page(make()))
        return html_main.weights_from(total)

    beside = f'<body><div class="teaser"><p>{TOLD[0]}</p></div><div class="wrapping"><article class="told">{STORY}</article></div></body>'
    assert kept("teaser", counted(5, lambda: beside))  # little is known yet
    learned = counted(100, lambda: beside)
    assert not kept("teaser", learned) and kept("wrapping", learned) and kept("teaser-trailer", learned)
    # a label holds the adverts of its article: it does not make fixed words content
    within = counted(100, lambda: f'<body><article>{STORY}<div class="promo">{STORY}</div></article></body>')
    assert not kept("promo", within)
    # on a page of nothing else a learned name is content
    assert html_main.main_text(f'<body><div class="teaser">{STORY}</div></body>', learned).split("\n\n") == TOLD


def test_html_pages_without_labels(spark):
    """Pages made of bare ``div`` elements, from the given ones: the truth is their article, and the scan is needed for it."""
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet").where("html is not null")
    weights = html_main.fit(pages)
    links = "".join(f"<div><a href=/{i}>Part {i}</a></div>" for i in range(30))
    right = whole = n = 0
    for p in pages.limit(100).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner.replace("<br>", " "))]
        truth = "\n\n".join(b for b in blocks if b)
        if len(truth.split()) < 60:
            continue
        bare = re.sub(r"<(/?)(?:nav|article|footer|ul|li)\b", r"<\1div", p["html"].replace('class="ad"', 'class="xq"'))
        bare = bare.replace("<body>", f"<body><div>{links}</div>").replace("</body>", f"<div>{links}</div></body>")
        n += 1
        right += truth in html_main.main_text(bare, weights) and "Part 7" not in html_main.main_text(bare, weights)
        whole += "Part 7" not in html_main.main_text(bare, {k: 1.0 if k[0] == "w" else 0.0 for k in weights} | {"w:div:a:short": 1.0})
    assert n > 10 and right >= 0.95 * n and whole < 0.05 * n, (n, right, whole)


def test_html_time_is_linear():
    import time

    def took(make, n):
        page, best = make(n), 9e9
        for _ in range(3):
            began = time.process_time()
            html_main.main_text(page, {})
            best = min(best, time.process_time() - began)
        return best

    for make in (lambda n: "<span>" * n + "</b>" * n, lambda n: "<span>" * n + "<h1></h1>" * n, lambda n: "<div>a b c " * n, lambda n: '<p title="x>' * n, lambda n: "<li><p>" * n):
        assert took(make, 16_000) < 12 * took(make, 4_000) + 0.5


def test_html_scan_is_the_best_region():
    random = np.random.default_rng(3)
    for _ in range(50):
        x = random.normal(-0.2, 1, 30).tolist()
        best = max((sum(x[i:j]), -i) for i in range(30) for j in range(i + 1, 31))[0]
        lo, hi = html_main.best_region(x)
        assert abs(sum(x[lo:hi]) - max(best, 0)) < 1e-9


def test_html_edges(spark):
    rows = [(1, None, "x", 5), (2, "", "x", 5), (3, "plain", "x", 5), (4, "<p>cut <b", "x", 5), (4, "<p>cut <b", "x", 5), (5, "<p>" + LONG, "x", 5)]
    df = spark.createDataFrame([(i, None, h, t, n) for i, h, t, n in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_main.extract_main_text(df).orderBy("page_id").collect()
    assert [r["text"] for r in got[:5]] == ["", "", "plain", "cut", "cut"] and got[5]["n_chars"] == len(LONG.strip())
    assert html_main.extract_main_text(df.limit(0)).count() == 0


def test_html_articles(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = by_id(html_main.extract_main_text(pages), "page_id")
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert got[p["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)


# -- op2 -----------------------------------------------------------------------------------


def brute_repeats(rows):
    """(doc_id, bytes) -> {doc_id: [(n_removed, n_spans, sha256)]}, string by string."""
    first = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, i), i)
    out = collections.defaultdict(list)
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i].append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum())), hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    got = collections.defaultdict(list)
    for r in suffix_dedup.dedup_substrings(df).collect():
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    want = brute_repeats([(i, (t or "").encode()) for i, t in rows])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_repeats_made_up(spark):
    random = np.random.default_rng(5)
    word = lambda n: "".join(random.choice(list("abcdeé"), n))
    shared = [word(n) for n in (49, 50, 51, 120, 400)]
    rows = [(i, "".join(random.permutation([word(int(random.integers(0, 90))), *random.choice(shared, 2), word(30)]))) for i in range(60)]
    rows += [(100, "a" * 49), (101, "a" * 50), (102, "a" * 300), (103, "ab" * 90), (104, None), (105, ""), (101, "a" * 50), (107, LONG[:5000]), (108, LONG[:4999])]
    check_repeats(spark, rows)


def test_repeats_documents(spark, texts):
    check_repeats(spark, sorted(texts.items()))


def test_repeats_in_small_pieces(monkeypatch):
    random = np.random.default_rng(8)
    core, out = random.integers(97, 99, 32).astype(np.uint8), {}
    h, offset = np.array([7] * 60 + [9, 9], np.uint32), random.integers(0, 19, 62)
    n = 1 + random.integers(0, 19, 62) % (offset + 1)  # every string of a context holds the anchor
    texts = [np.concatenate([random.integers(97, 98 + i % 2, o).astype(np.uint8), core, np.full(k + 17 - o, 97, np.uint8)]) for i, (o, k) in enumerate(zip(offset, n))]
    data, begin = np.concatenate(texts), np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
    for limit in (10, 700):
        monkeypatch.setattr(suffix_dedup, "SORT_BYTES", limit)
        found = collections.defaultdict(set)
        for k, (text, starts, owner, bit) in enumerate(suffix_dedup._pieces(h, begin, n, offset, data)):
            for s, same, o, b in zip(starts, suffix_dedup.bucket_pointers(text, starts), owner, bit):
                assert text[s : s + 50].tobytes() == data[begin[o] + b : begin[o] + b + 50].tobytes()
                found[k, same].add((int(o), int(b)))
        out[limit] = set(map(frozenset, found.values()))
        assert sum(map(len, found.values())) == n.sum()
    want = collections.defaultdict(set)
    for o in range(62):
        for b in range(n[o]):
            want[h[o], offset[o] - b, data[begin[o] + b : begin[o] + b + 50].tobytes()].add((o, b))
    assert out[10] == out[700] == set(map(frozenset, want.values()))


def test_texts_without_repeats(spark):
    a, b = "shared passage " * 6, "own words of the other one#"
    rows = [(1, a, 90, "x"), (2, b + a, 5, "y"), (2, b + a, 5, "z"), (2, "other", 5, "w"), (None, a, 7, "v"), (3, None, None, "u"), ((1 << 63) - 1, a, 1, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, kept string")
    want = {"x": (1, a, 90), "y": (2, b, 27), "z": (2, b, 27), "w": (2, "other", 5), "v": (None, "", 0), "u": (3, "", 0), "t": ((1 << 63) - 1, "", 0)}
    for names in (("doc_id", "text", "n_chars", "kept"), ("__id", "__text", "n_chars", "__key"), ("block", "data", "n_chars", "rest")):
        clash = df.toDF(*names).withColumn("__kept", F.array(F.lit(1.5))).withColumn("ids", F.lit(True))
        got = suffix_dedup.without_repeats(clash, names[0], names[1])
        assert got.columns == clash.columns and got.dtypes == clash.dtypes
        assert {r[names[3]]: (r[names[0]], r[names[1]], r["n_chars"]) for r in got.where("ids and __kept[0] = 1.5").collect()} == want
    assert {r["doc_id"] for r in suffix_dedup.dedup_substrings(df).collect()} == {1, 2, 3, None, (1 << 63) - 1}


def test_repeats_empty(spark, docs):
    assert suffix_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_bucket_pointers():
    random = np.random.default_rng(2)
    data = np.concatenate([random.integers(97, 99, 300).astype(np.uint8), np.full(200, 97, np.uint8)])
    data = np.concatenate([data, data])
    starts = np.arange(len(data) - 49)
    got = suffix_dedup.bucket_pointers(data, starts)
    names = {}
    want = [names.setdefault(data[s : s + 50].tobytes(), len(names)) for s in starts]
    assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


# -- op3, op8 ------------------------------------------------------------------------------


def test_toxicity_learns_misspellings():
    words = "alpha beta gamma delta river stone cloud paper window garden".split()
    random = np.random.default_rng(1)
    make = lambda bad: " ".join([*random.choice(words, 12), *(["grubblefish" + x for x in random.choice(list("abcdef"), 2)] if bad else [])])
    y = np.arange(200) % 2
    model = toxicity.train([make(i) for i in y], y, steps=300)
    bad, good, unseen = model.scores(["you grubblefisha river stone", "river stone cloud paper", "a grubblfish garden"], {})
    assert bad > 0.9 > 0.2 > good and unseen > good


def test_classifiers_edges(spark, odd):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (3, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for run in (toxicity.toxicity_scores, quality.quality_scores):
        got = run(odd, labels).collect()
        assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (5, 7)}) == 1
        assert run(odd.limit(0), labels).count() == 0 and run(odd, labels.limit(0)).count() == len(TEXTS)


def test_sample_counts_only_documents_that_are_there(spark):
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    rows = spark.range(60, 100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = quality.labelled_sample(rows, labels, "quality", F.col("k") % 10 == 0, 30).collect()
    assert len(got) == 30 and all(r["doc_id"] >= 60 and r["doc_id"] % 10 and r["y"] == r["doc_id"] % 2 for r in got)


def test_sample_is_bounded_by_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, toxic int")
    rows = spark.range(200).select((F.col("id") % 2 + 1).alias("doc_id"), F.col("id").cast("string").alias("text"))
    def sample(rows):
        found = quality.labelled_sample(rows, labels, "toxic", F.lit(False), 40)
        return [r["text"] + str(r["y"]) for r in quality.bounded(found, 40, "text").collect()]

    got, again = sample(rows), sample(rows.repartition(5))
    assert len(got) == 40 and sorted(got) == sorted(again)


def test_toxicity_fit_is_training_on_the_texts(spark, texts):
    """Executors' bags give the very model of the texts, repeated ids and labels included."""
    some = [(i, t) for i, t in sorted(texts.items())[:40]] + [(3, "another text of three"), (3, "another text of three")]
    labels = [(i, i % 2) for i in range(0, 60)] + [(4, 1), (None, 1)]
    y_of = collections.defaultdict(list)
    for k, y in labels:
        if k is not None and zlib.crc32(str(k).encode()) % 5:
            y_of[k].append(y)
    rows = sorted((k, y, toxicity.bag(t)[1].tobytes(), toxicity.bag(t)[2].tobytes(), t) for k, t in some for y in y_of[k])
    want = toxicity.train([r[-1] for r in rows], np.array([r[1] for r in rows]))
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    got = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert np.array_equal(got.bucket, want.bucket) and got.bias == want.bias


def test_toxicity_scores_the_bag_it_was_trained_on(texts):
    model = toxicity.Subwords(np.random.default_rng(1).normal(0, 1, toxicity.BUCKETS).astype(np.float32), -0.5)
    odd = ["bad idiot. idiot, \"idiot\" idiot! fool fool. a good day", "", "... ! ?", "Ünïted (wörds) 'a'b'"]
    for text in [*texts.values(), *odd]:
        words, _, share = toxicity.bag(text)
        mean = sum(float(x) * float(model.bucket[toxicity.buckets(w)].sum()) / len(toxicity.buckets(w)) for w, x in zip(words, share))
        assert abs(model.scores([text], {})[0] - 1 / (1 + np.exp(-np.clip(mean - 0.5, -30, 30)))) < 1e-5
    assert len(toxicity.bag(odd[0])[0]) == len(toxicity.counted(odd[0])) == 6


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic = got["toxic"] == 1
    assert toxic.sum() > 30 and (got["predicted"] == got["toxic"]).mean() > 0.95
    # 352 toxic documents are learned from; larger tables have more
    assert got["predicted"][toxic].mean() > 0.75 and got["predicted"][~toxic].mean() < 0.02


def test_folds(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for run, k, fold in ((toxicity.toxicity_scores, 5, 0), (quality.quality_scores, 3, 1)):
        for r in run(docs, labels).select("doc_id", "held_out").collect():
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % k == fold)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95


def test_trees_traversal():
    random = np.random.default_rng(0)
    x = random.normal(size=(500, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.grow(x, y, trees=30)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = trees.base
        for at in trees.roots:
            for _ in range(trees.depth):
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return total

    assert np.allclose([walk(r) for r in x[:50]], trees.raw(x[:50]))


# -- op4 -----------------------------------------------------------------------------------


def test_url_edges(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.NET/en/1?x#y", "http://example.net?q", "http://a.example.com/de/", "http://x.org/fr/", "http://notnet/", "ftp://net/", "http://casino-win.example.com/", "http://a.com/x?u=http://net/"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.filter_urls(df).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.net", "", None, "allow"), ("a.example.com", "/de/", "example.com/de/", "block"), ("x.org", "/fr/", "org/fr/", "allow"),
        ("notnet", "/", None, "allow"), ("net", "/", "net/", "block"), ("casino-win.example.com", "/", None, "block"), ("a.com", "/x", None, "allow"),
    ]
    assert url_rules.filter_urls(df.limit(0)).count() == 0


def test_url_token_counts(spark):
    rules = [*url_rules.default_rules(), *(url_rules.pattern_rule(f"^word{i}^") for i in range(3000))]
    urls = ["http://example.net/word7?word7", "https://a.NET/word8/x", None, "net", "http://wordy/"] * 2
    got = url_rules.token_counts(spark.createDataFrame([(u, 1) for u in urls], "url string, token int"), "url", rules)
    assert {t: n for t, n in got.items() if n} == {"net": 6, "example": 2, "word7": 2, "word8": 2}
    assert len(got) == len({t for r in rules for t in r.tokens})


def test_url_index_misses_no_rule():
    import re

    rules = url_rules.default_rules()
    index = url_rules.RuleIndex(rules, {"net": 9, "example": 9})
    for url in ("http://a.b/banner?x", "http://porn.c/", "http://x.cheap-pills.de/", "http://q.ads-track.com/", "http://ok.com/xxxy", "http://w/warez"):
        want = any(re.search(r.regex, url) for r in rules if not r.host_rule)
        assert (index.match(url, "h", "/")[1] == "block") == want
        assert index.match(url, "h", "/")[2] <= 3


# -- op5 -----------------------------------------------------------------------------------


def test_packing(spark, odd, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    both = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    text = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    got = packing.pack_documents(both, rounds=60).toPandas().sort_values(["doc_id", "piece"])
    for doc_id, pieces in got.groupby("doc_id"):
        ids = np.array([*tok.encode(text[doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert pieces["start"].tolist() == list(range(0, len(ids), 2048)) and pieces["length"].sum() == len(ids)
        assert pieces["ids_crc32"].tolist() == [zlib.crc32(ids[i : i + 2048].tobytes()) for i in range(0, len(ids), 2048)]
    assert set(got["doc_id"]) == set(text)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"]).tolist()[:-1]] and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= got["length"].sum() / 2048 * 1.02 + 1
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_plan_holds_the_histogram():
    random = np.random.default_rng(4)
    for size, hist in ((2048, {int(s): int(n) for s, n in zip(random.integers(1, 2048, 200), random.integers(1, 60, 200))}), (10, {7: 5, 5: 2}), (10, {10: 3})):
        found = collections.Counter()
        for m, config in packing.pack_histogram(hist, size, 50):
            assert sum(s * n for s, n in config.items()) <= size
            for s, n in config.items():
                found[s] += m * n
        assert found == collections.Counter(hist)


def test_program_covers_every_class():
    random = np.random.default_rng(6)
    for size, lengths, counts in ((2048, np.unique(random.integers(1, 2048, 300)), None), (2048, np.array([1500, 1600]), np.array([3.0, 1.0])), (7, np.arange(1, 8), None)):
        counts = random.integers(1, 90, len(lengths)).astype(float) if counts is None else counts
        covered = collections.Counter()
        for x, config in packing.solve(lengths, counts, size, 40):
            assert x > 0 and sum(s * n for s, n in config.items()) <= size
            for s, n in config.items():
                covered[s] += x * n
        assert all(abs(covered[int(s)] - n) < 1e-6 * n for s, n in zip(lengths, counts))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_packing_is_no_worse_than_best_fit(sf):
    import public_tokenizers
    import pyarrow.parquet as pq

    tok = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    hist = collections.Counter()
    for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist():
        n = len(tok.encode([t or ""])[0]) // 4 + 1
        hist.update(min(2048, n - k) for k in range(0, n, 2048))
    count = lambda plan: sum(m for m, _ in plan)
    plan = packing.pack_histogram(hist)
    assert count(plan) <= count(packing.best_fit(dict(hist), 2048)) and count(plan) <= -(-sum(s * n for s, n in hist.items()) // 2048) + 1


def test_chunks_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    tok.encode_special_tokens = True
    texts = [
        "dogs' don't it's 's x's, a'b Don'T", "naïve—coöp ȡ ɐ ʼn ſs ǆ İstanbul Σας ΣΑΣ µm ªº a_b __ x¶ £5 9.5% é\u0301 漢字, ไทย.", "×a×", "<|startoftext|> x</w> y",
        "émentvié&&& word,%%% (a) [b]. ... a.b a. .a 1a a1", "tab\tnew\nline\u00a0wide\u3000x \x1c y", "w" * 3000 + "!",
    ]
    for t in texts:
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


# -- op6 -----------------------------------------------------------------------------------


def test_merkle_edges(spark, odd):
    got = by_id(merkle.fingerprints(odd))
    assert len(got) == len(TEXTS) and got[2]["fingerprint"] == got[3]["fingerprint"] and got[5]["fingerprint"] == got[7]["fingerprint"]
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[2]["fingerprint"]
    n = len(TEXTS)
    for i, r in got.items():
        t, nxt = TEXTS[i] or "", TEXTS[i - 1 if i else n - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and (edited != t or r["near_edited"] == 1.0)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert merkle.fingerprints(odd.limit(0)).count() == 0
    assert merkle.fingerprints(odd.where("doc_id = 4")).first()["near_next"] == 1.0


def test_merkle_locates_edits(spark):
    old = "One here. Two here.\nThree.\n\nFour."
    news = {
        "One here. Two her.\nThree.\n\nFour. Five.": ({(1, 1, 2), (2, 1, 1), (2, 1, 2)}, {(1, 1, 2), (2, 1, 1)}),
        # a section that ends in line ends has an empty paragraph after them
        "New one.\n\n" + old: ({(1, 1, 1), (1, 2, 1)}, set()),
        "Four.": (set(), {(1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 3, 1)}),
        old: (set(), set()),
    }
    df = spark.createDataFrame([(old, n) for n in news], "a string, b string")
    tree = lambda c: merkle.leaf_tree(F.col(c))
    got = df.select("b", merkle.differing_leaves(tree("a"), tree("b")).alias("d")).collect()
    assert {r["b"]: tuple({tuple(x) for x in v} for v in r["d"]) for r in got} == news


def test_merkle_likeness(spark):
    def near(a, b):
        """Descent over two fingerprint strings, level by level."""
        x, y = (set(f.split("|")[1:]) for f in (a, b))
        common = 0
        for sign, between in ((":", ";"), ("=", ",")):
            common += sum(v.count(",") + v.count("=") for v in x & y)
            x, y = ({c for v in one for c in v.split(sign)[-1].split(between)} for one in (x - y, y - x))
        return 2 * (common + len(x & y)) / (2 * common + len(x) + len(y))

    a = "".join(f"Leaf {i}. " + "\n" * (i % 4 == 3) + "\n" * (i % 8 == 7) for i in range(40))
    others = [a, a.replace("Leaf 9.", "Leaf x."), a[: len(a) // 2], "Nothing of it.", "First of all.\n\n" + a]
    df = spark.createDataFrame([(a, b) for b in others], "a string, b string")
    fp = lambda c: merkle.fingerprint(merkle.leaf_tree(F.col(c)))
    got = df.select(fp("a").alias("a"), fp("b").alias("b")).select("a", "b", merkle.likeness(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(abs(r["n"] - near(r["a"], r["b"])) < 1e-12 for r in got[1:])
    # five sections and the text have an empty paragraph at their ends
    assert [round(r["n"], 6) for r in got] == [1.0, round(45 / 46, 6), round(got[2]["n"], 6), 0.0, round(46 / 47, 6)] and 0.4 < got[2]["n"] < 0.8


def test_merkle_rows_without_ids(spark):
    texts = [f"text {i}" for i in range(60)]
    df = spark.createDataFrame([(None if i % 3 else (1 << 62) + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = merkle.with_next(df, "doc_id", "text").where("not ghost").select("doc_id", "text", "hash", "next_text").collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["hash"]), reverse=True)
    assert [r["next_text"] for r in order] == [*(r["text"] for r in order[1:]), order[0]["text"]]


# -- op7 -----------------------------------------------------------------------------------


def test_ogg_round_trip(spark, odd):
    got = by_id(ogg.media_digests(odd))
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = ogg.padded(data)
        assert len(payload) % 576 == 0 and payload.startswith(data)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    media = by_id(ogg.media_column(odd.withColumnRenamed("score", "a.b `c`")))
    assert hashlib.sha256(media[5]["media"]).hexdigest() == got[5]["media_sha256"] == got[7]["media_sha256"]
    assert ogg.media_digests(odd.limit(0)).count() == 0


def test_ogg_streams():
    big, small = bytes(range(256)) * 400, [b"a", b"", b"x" * 255, b"y" * 510]
    one = ogg.write_stream([b"head", big, b"tail"], [0, 5, 9], serial=1)
    two = ogg.write_stream(small, [0, 1, 2, 3], serial=2)
    file = b"".join([one[0], two[0], *one[1:2], *two[1:], *one[2:]])
    a, b = ogg.demultiplex(file)
    assert a.packets == [b"head", big, b"tail"] and b.packets == small and a.seconds(1)[-1] == 9.0
    for page in one:
        assert int.from_bytes(page[22:26], "little") == _crc(page[:22] + b"\0\0\0\0" + page[26:])
    for bad in (file[:-1], file[:40] + b"!" + file[41:], b"".join(one[:1] + one[2:]), b"".join(one[:-1])):
        with pytest.raises(ogg.OggError):
            ogg.demultiplex(bad)


def _crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 1 << 31 else 0)) & 0xFFFFFFFF
    return crc


# -- op9 -----------------------------------------------------------------------------------


def test_bpe(spark, odd, texts):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode_documents(odd))
    for i, t in enumerate(TEXTS):
        ids = np.array(tik.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    codec = bpe.codec(path, public_tokenizers.PATTERN)
    more = [*texts.values(), "it's \n\n a  b   \n c", "x" * 5000, " lead", "a\n b \nc  d"]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_block(more)] == [tik.encode_ordinary(t) for t in more]
    assert bpe.encode_documents(odd.limit(0)).count() == 0


# -- op10 ----------------------------------------------------------------------------------


def test_rule_lists(spark, tmp_path):
    lines = ["! comment", "[List 1.0]", "", "||ads.example^", "@@||ads.example/good/", "|https://start.", "/end.gif|", "a*b^c", "site##.box", "/x[0-9]/", "||t.example^$third-party", "*", "||Big.Example^"]
    (tmp_path / "list.txt").write_text("\n".join(lines))
    rules, left = url_rules.load_rules(spark, str(tmp_path / "list.txt"))
    assert len(rules) == 6 and sorted(left) == sorted(["site##.box", "/x[0-9]/", "||t.example^$third-party", "*"])
    with pytest.raises(ValueError):
        url_rules.load_rules(spark, str(tmp_path / "list.txt"), 3)
    want = {
        "http://ads.example/": "block", "http://x.ads.example": "block", "http://notads.example/": "allow", "http://ads.example.org/": "allow", "http://o.org/?ads.example/": "allow",
        "http://ads.example/good/1": "allow", "https://start.org/": "block", "http://o.org/https://start.": "allow", "http://o.org/end.gif": "block", "http://o.org/end.gif?1": "allow",
        "http://o.org/a-b/c": "block", "http://o.org/a-bc": "allow", "HTTP://BIG.EXAMPLE/": "block", "": "allow",
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id long, url string")
    got = url_rules.filter_urls(df, rules=rules).collect()
    assert {u: next(r["verdict"] for r in got if r["page_id"] == i) for i, u in enumerate(want)} == want
    assert url_rules.filter_urls(df.limit(0), rules=rules).count() == 0


def test_rule_index_equals_every_rule():
    rng = np.random.default_rng(8)
    word = lambda: f"k{rng.integers(0, 400)}"
    forms = ("||{}.{}^", "@@||{}.{}^", "/{}/*/{}.", "{}-{}^", "|http://{}.{}", "/{}_{}|", "^{}={}^", "{}{}")
    rules, left = url_rules.listed_rules(forms[i % len(forms)].format(word(), word()) for i in range(5000))
    assert not left and len(rules) > 4500
    urls = [f"http://{word()}.{word()}.{word()}/{word()}/{word()}-{word()}/{word()}_{word()}" + (f"?{word()}={word()}" if i % 2 else "") for i in range(150)]
    index, ran, seen = url_rules.RuleIndex(rules), 0, set()
    for url in urls:
        fits = {r.verdict for r in rules if re.search(r.regex, url)}
        _, got, n = index.match(url, "", "")
        assert got == ("allow" if "allow" in fits else "block" if fits else None)
        seen.add(got)
        ran += n
    assert len(seen) > 1 and ran < 0.5 * len(urls) * len(rules)


def test_frequencies_are_exact(spark, monkeypatch):
    """Counted frequencies equal those by sets, over any tasks, where every small hash bucket is full."""
    rng = np.random.default_rng(5)
    often = [f"this passage number {k} stands in many of all these documents here" for k in range(4)]
    rows = []
    for i in range(1500):
        t = " ".join(f"w{x}" for x in rng.integers(0, 5000, 120))
        t += "".join(" " + often[k] for k in range(4) if i % (2, 7, 60, 400)[k] == 0)
        rows.append((i, t))
    rows += [(2000, None), (2001, ""), (2002, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    want = collections.Counter()
    for _, t in rows:
        want.update(set(minhash.shingle_hashes([t or ""])[1].tolist()))
    assert len({v & 0xFFFF for v in want}) > 0.85 * 65536  # a table of so many buckets would be level
    frequent = {v: n for v, n in want.items() if n * minhash.RARE > len(rows)}
    made = []
    for parts, counted in ((1, 2_000_000), (7, 5_000), (60, 2_000_000)):
        monkeypatch.setattr(minhash, "COUNTED", counted)
        idf = minhash.idf_table(df.repartition(parts))
        assert set(idf.value.tolist()) == set(frequent)
        made.append(dict(zip(idf.value.tolist(), idf.weight.tolist())))
        rare = np.array([v for v, n in want.items() if v not in frequent], np.uint64)
        assert (idf.of(rare) == 2).all()
    assert made[0] == made[1] == made[2]
    for v, n in frequent.items():
        assert abs(made[0][v] - 1 - math.log(len(rows) / n) / math.log(minhash.RARE)) < 1e-9
    assert len({round(w, 2) for w in made[0].values()}) >= 3


def brute_classes(rows, idf):
    vectors = {i: [a[0:] for a in minhash.shingles([t or ""], idf)[1:]] for i, t in rows}
    parent = {i: i for i in vectors}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    ids = sorted(vectors)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = dict(zip(*map(list, vectors[a]))), dict(zip(*map(list, vectors[b])))
            common = sum(min(w, y[s]) for s, w in x.items() if s in y)
            total = sum(x.values()) + sum(y.values()) - common
            if (not x and not y) or (total and common / total >= 0.8 - 1e-9):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}


def test_near_duplicates(spark):
    random = np.random.default_rng(9)
    words = ["".join(random.choice(list("abcdefgh"), 4)) for _ in range(500)]
    rows, n = [], 0
    for group in range(8):
        base = list(random.choice(words, 120 + 40 * group))
        for copy in range(1 + 4 * group):
            own = list(base)
            for _ in range(copy % 4):
                own[int(random.integers(len(own)))] = str(random.choice(words))
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "two words"), (n + 3, "two words"), (n + 4, "two words more"), (n + 5, LONG), (n + 6, LONG + "x")]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, class_id string, h1 int")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    idf = minhash.idf_table(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    assert got == brute_classes(rows, idf)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())


def test_sampling_agrees_with_similarity():
    random = np.random.default_rng(1)
    a, b = np.sort(random.choice(1 << 62, 400, replace=False).astype(np.uint64)), None
    w = random.uniform(0.5, 3, 400)
    b, wb = a[100:], w[100:] * random.uniform(0.6, 1.4, 300)
    want = minhash.weighted_jaccard((a, w), (b, wb))
    zero = np.zeros(1, np.int64)
    same = np.mean([minhash.samples(zero, a, w, k)[0] == minhash.samples(zero, b, wb, k)[0] for k in range(3000)])
    assert abs(same - want) < 0.03


def test_near_duplicates_documents(spark, docs, texts):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    idf = minhash.idf_table(docs.select("doc_id", "text"))
    assert got == brute_classes(list(texts.items()), idf)


def test_near_duplicates_in_hot_buckets(spark):
    random = np.random.default_rng(12)
    words = ["".join(random.choice(list("abcdefgh"), 6)) for _ in range(5000)]
    frame = " ".join(random.choice(words, 400))  # a template: its pages share bands, under 0.8 to each other
    tail = lambda n: " ".join(random.choice(words, n))
    tails = [(tail(27), tail(23)) for _ in range(200)]
    rows = [(i, f"{frame} {a} {b}") for i, (a, b) in enumerate(tails)]
    rows += [(1000 + i, f"{frame} {tails[i][0]} {tail(23)}") for i in range(0, 200, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    want = brute_classes(rows, minhash.idf_table(df))
    assert got == want and len(set(want.values())) == 200


def made_words(random, n, letters=6):
    return ["".join(random.choice(list("abcdefgh"), letters)) for _ in range(n)]


def test_common_weights():
    random = np.random.default_rng(2)
    sets = [np.unique(random.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 30, 40, 50, 60)]
    vectors = [(v, random.choice([1.0, 1.5, 2.0, 3.0], len(v))) for v in sets]
    got = minhash.common_weights(vectors)
    for i, (v, w) in enumerate(vectors):
        for j, (x, y) in enumerate(vectors):
            of = dict(zip(x.tolist(), y.tolist()))
            if i != j:
                assert abs(got[i, j] - sum(min(b, of[a]) for a, b in zip(v.tolist(), w.tolist()) if a in of)) < 1e-9


def test_near_duplicates_of_one_template(spark, monkeypatch):
    """Pages of one template with a few words edited: similarities lie around 0.8."""
    random = np.random.default_rng(21)
    words, rows = made_words(random, 4000), []
    frame = list(random.choice(words, 300))
    for i in range(700):
        own = list(frame)
        for at in random.choice(300, int(random.integers(2, 8)), replace=False):
            own[int(at)] = str(random.choice(words))
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idf = minhash.idf_table(df)
    first, value, weight = minhash.shingles([t for _, t in rows], idf)
    vectors = [(value[a:b], weight[a:b]) for a, b in zip(first, first[1:])]
    common, total = minhash.common_weights(vectors), np.array([w.sum() for _, w in vectors])
    similar = common / (total[:, None] + total[None, :] - common) >= 0.8 - 1e-9
    keys, _ = minhash.band_keys([t for _, t in rows], idf)
    meet = np.array([[bool(set(a) & set(b)) for b in keys] for a in keys])
    links = np.argwhere(np.triu(similar, 1))
    assert len(links) > 500
    whole = None
    for units in (128, 9):
        monkeypatch.setattr(minhash, "BLOCK_UNITS", units)
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
        assert all(got[a] == got[b] for a, b in links.tolist() if meet[a, b])
        assert np.mean([got[a] == got[b] for a, b in links.tolist()]) >= 0.99
        assert whole is None or got == whole
        whole = got
    want = brute_classes(rows, idf)
    assert all(want[i] == want[c] for i, c in got.items())  # nothing joined that is not linked


def test_near_duplicates_repeated_ids(spark):
    random = np.random.default_rng(22)
    words = made_words(random, 500)
    a, b, c = (list(random.choice(words, 150)) for _ in range(3))
    text = lambda w, n: " ".join([*w[:-1], f"end{n}"])
    rows = [(5, text(a, 0)), (5, text(b, 0)), (5, text(b, 0)), (7, text(a, 1)), (8, text(b, 1)), (9, text(c, 0)), (None, text(c, 0)), (None, text(c, 1)), (None, "alone here"), (10, None)]
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter({(5, 5): 3, (7, 5): 1, (8, 5): 1, (9, 9): 1, (None, 9): 1, (None, None): 2, (10, 10): 1})


def test_split_joins_keep_every_row(spark, monkeypatch):
    from deedlens.llm import common

    rows = spark.range(5000).select((F.col("id") % 3 * (F.col("id") % 40)).alias("k"), "id")
    values = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k <> 4")
    want = rows.join(values, "k").select("k", "id", "top").collect()
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    for how, n in (("inner", len(want)), ("left", 5000)):
        got = common.join_split(rows, values, ["k"], how).select("k", "id", "top").collect()
        assert len(got) == n and set(want) <= set(got)
