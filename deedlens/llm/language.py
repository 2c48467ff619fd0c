"""Language identification of mixed-language text, word by word.

Words are runs of letters.  The script of a word, by code point ranges, narrows its
candidates to the languages that use that script; every candidate gets the word's
log-likelihood by character n-grams, against the mean of the candidates.  Viterbi over
the words of a text, with a penalty for every switch, labels spans; the language whose
spans hold most letters is the text's, and its share of the letters is the score.

Learning counts hashed n-grams and scripts of a bounded sample: of the most frequent
languages at most, about so many documents each, drawn by a hash of id and text.
Executors count; the driver gets one number for each bucket and language.

Viterbi runs over a whole block of texts at once: texts are cut into pieces of words, all
pieces step together, once from every language that may come before a piece, and the
pieces of a text are then joined in order.  The result is that of one long pass.

Edge cases: texts that are null or have no letter are ``und`` with score 0; letters of
scripts that no learned language uses say nothing, and a text of only such letters gets the
most frequent language with score 0; without documents to learn from all is ``und``.
Null ids are never held out and never learned from; ties go to the language that sorts
first; repeated rows get equal results; extra columns are ignored; an empty table gives no
rows.  Work and memory of a text grow with its length, and with the square of the number
of languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import full_text, table, text_blocks
from .quality import fold

#: Documents of a language that are learned from, about; languages, at most: the most frequent.
FIT_DOCUMENTS, FIT_LANGUAGES = 2_000, 200
#: Tasks that count the sample.
FIT_TASKS = 16
BITS = 17
BUCKETS = 1 << BITS
SHORTEST, LONGEST = 1, 5
#: N-grams of a word overlap: they count by this weight.  No word says more than the limit.
WEIGHT, LIMIT = 0.3, 6.0
#: What a switch of language costs, in log-likelihood.
PENALTY = 10.0
#: A language uses a script if so large a share of its letters has it.
SCRIPT_SHARE = 0.01
#: Words of a piece that Viterbi steps through; bytes of texts labelled together; letters of a word, at most; text searched at once.
PIECE, BLOCK_BYTES, WORD_LETTERS, SLICE = 128, 4_000_000, 32, 1_000_000

#: First code points of script ranges in Unicode; each runs to the next, ``-`` is none.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "-"),
    (0x0750, "Arabic"), (0x0780, "-"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Odia"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "-"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "-"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "-"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "-"), (0x2C60, "Latin"), (0x2C80, "-"), (0x2DE0, "Cyrillic"), (0x2E00, "Han"), (0x3040, "Kana"), (0x3100, "Han"),
    (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "-"), (0xA640, "Cyrillic"), (0xA6A0, "-"), (0xA720, "Latin"),
    (0xA800, "-"), (0xAC00, "Hangul"), (0xD7B0, "-"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "-"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF65, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "-"), (0x20000, "Han"), (0x32000, "-"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([at for at, _ in SCRIPTS])
_NUMBERS = np.array([NAMES.index(name) for _, name in SCRIPTS])
_WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{WORD_LETTERS - 1}}}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]")


def words_in(text: str):
    """The words of a text, found slice by slice."""
    at = 0
    while at < len(text):
        gap = _OTHER.search(text, at + SLICE) if len(text) > at + SLICE else None
        end = gap.start() if gap else len(text)
        yield from _WORD.findall(text, at, end)
        at = end


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of the lower-cased words with their ends marked, the word of each, and every word's script."""
    marked = [f"<{w.lower()}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)[word]
    buckets, of = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)
        if n >= SHORTEST:
            whole = np.flatnonzero(np.arange(len(h)) + n <= ends[: len(h)])
            mixed = h[whole] ^ (h[whole] >> np.uint64(29))
            buckets.append((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64))
            of.append(word[whole])
    script = _NUMBERS[np.searchsorted(_STARTS, code, "right") - 1]
    letter = (code != ord("<")) & (code != ord(">"))
    counts = np.bincount(word[letter] * len(NAMES) + script[letter], minlength=len(words) * len(NAMES)).reshape(len(words), len(NAMES))
    return np.concatenate(buckets) if buckets else np.zeros(0, np.int64), np.concatenate(of) if of else np.zeros(0, np.int64), counts.argmax(1)


@dataclass
class Languages:
    """The learned model: log-likelihoods of buckets, and the scripts each language uses."""

    names: list[str]  # sorted
    logs: np.ndarray  # bucket x language
    uses: np.ndarray  # script x language
    common: int  # the most frequent one

    def evidence(self, words: list[str]) -> np.ndarray:
        """Every word's score for every language: 0 where it says nothing, the least for languages that do not use its script."""
        if not words or not self.names:
            return np.zeros((len(words), len(self.names)), np.float32)
        bucket, of, script = grams(words)
        sums = np.stack([np.bincount(of, self.logs[bucket, k], len(words)) for k in range(len(self.names))], 1)
        may = self.uses[script]
        among = np.maximum(may.sum(1, keepdims=True), 1)
        scores = np.where(may, np.clip(WEIGHT * (sums - (sums * may).sum(1, keepdims=True) / among), -LIMIT, LIMIT), -LIMIT)
        return np.where(may.any(1, keepdims=True), scores, 0).astype(np.float32)

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every text the language of each word, the word's letters, and whether it says anything."""
        number: dict[str, int] = {}
        of = [np.fromiter((number.setdefault(w, len(number)) for w in words_in(t)), np.int64) for t in texts]
        words = list(number)
        scores = self.evidence(words)
        letters, says = np.fromiter(map(len, words), np.int64, len(words)), scores.any(1)
        paths = viterbi([scores[x] for x in of])
        return [(path, letters[x], says[x]) for path, x in zip(paths, of)]

    def verdict(self, path: np.ndarray, letters: np.ndarray, says: np.ndarray) -> tuple[str, float]:
        """The language of most letters, and its share of those that say anything."""
        if not len(path) or not self.names:
            return "und", 0.0
        weight = np.bincount(path, letters * says, len(self.names))
        if not weight.any():
            return self.names[self.common], 0.0
        best = int(weight.argmax())
        return self.names[best], float(weight[best] / weight.sum())

    def spans(self, text: str, path: np.ndarray) -> list[tuple[int, int, str]]:
        """(start, end, language) of the text's spans, gapless; each begins with its first word."""
        if not len(path) or not self.names:
            return []
        turns = np.flatnonzero(np.diff(path)) + 1
        cuts = [0]
        if len(turns):
            wanted, found = set(turns.tolist()), 0
            at = 0
            while at < len(text):
                gap = _OTHER.search(text, at + SLICE) if len(text) > at + SLICE else None
                end = gap.start() if gap else len(text)
                for m in _WORD.finditer(text, at, end):
                    if found in wanted:
                        cuts.append(m.start())
                    found += 1
                at = end
        return [(lo, hi, self.names[k]) for lo, hi, k in zip(cuts, [*cuts[1:], len(text)], path[np.r_[0, turns]])]


def viterbi(evidence: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """The best label of every row of each array: its scores summed, less the penalty for every switch.

    All arrays are cut into pieces that step together; of equal paths one stays in its label.
    """
    kinds = max((e.shape[1] for e in evidence), default=0)
    sizes = [len(e) for e in evidence]
    pieces = [-(-n // PIECE) for n in sizes]
    total = sum(pieces)
    if not total or not kinds:
        return [np.zeros(n, np.int64) for n in sizes]
    e = np.zeros((total * PIECE, kinds), np.float32)  # rows beyond a text say nothing, so that its path stays
    first = np.cumsum([0, *pieces[:-1]])
    for k, x in zip(first, evidence):
        e[k * PIECE : k * PIECE + len(x)] = x
    e = e.reshape(total, PIECE, kinds)
    into = _through(e, penalty)
    enter, leave = np.zeros(total, np.int64), np.zeros(total, np.int64)
    starts = np.zeros(total, bool)
    for k, n in zip(first, pieces):
        if not n:
            continue
        starts[k] = True
        score, back = into[k].max(0) if n else None, []
        for i in range(k + 1, k + n):
            through = score[:, None] + into[i]
            back.append(through.argmax(0))
            score = through.max(0)
        leave[k + n - 1] = score.argmax()
        for i in range(k + n - 1, k, -1):
            enter[i] = leave[i - 1] = back[i - k - 1][leave[i]]
    path = _within(e, enter, leave, starts, penalty).reshape(total * PIECE)
    return [path[k * PIECE : k * PIECE + n] for k, n in zip(first, sizes)]


def _through(e: np.ndarray, penalty: float) -> np.ndarray:
    """Piece x label before x last label: the best score of a way through a piece.

    A label before the first word of a text is free: the caller takes the largest over it,
    which a way without a switch attains.
    """
    total, steps, kinds = e.shape
    out = np.empty((total, kinds, kinds), np.float32)
    most = max(1, 4_000_000 // (kinds * kinds))
    for lo in range(0, total, most):
        v = np.broadcast_to(np.where(np.eye(kinds, dtype=bool), 0, -np.inf).astype(np.float32), (len(e[lo : lo + most]), kinds, kinds))
        for t in range(steps):
            v = np.maximum(v, v.max(2, keepdims=True) - penalty) + e[lo : lo + most, None, t, :]
        out[lo : lo + most] = v
    return out


def _within(e: np.ndarray, enter: np.ndarray, leave: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """The labels of all words, from the label before each piece to its last one."""
    total, steps, kinds = e.shape
    v = np.full((total, kinds), -np.inf, np.float32)
    v[np.arange(total), enter] = 0
    v[starts] = 0
    came = np.empty((steps, total, kinds), np.int16)
    every = np.arange(kinds)[None, :]
    for t in range(steps):
        best = v.argmax(1)[:, None]
        moved = np.take_along_axis(v, best, 1) - penalty
        came[t] = np.where(v >= moved, every, best)
        v = np.maximum(v, moved) + e[:, t, :]
    path, at, rows = np.empty((total, steps), np.int64), leave, np.arange(total)
    for t in range(steps - 1, -1, -1):
        path[:, t] = at
        at = came[t, rows, at]
    return path


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5, held: int = 0, documents: int = FIT_DOCUMENTS, languages: int = FIT_LANGUAGES) -> Languages:
    """The model from a bounded sample of documents outside the held-out fold."""
    rows = df.select(df[id_col].alias("k"), df[lang_col].cast("string").alias("lang"), full_text(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("k").isNotNull() & (fold(F.col("k"), modulus) != held))
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()  # bounded by languages
    names, common = sorted(r["lang"] for r in found), (found[0]["lang"] if found else None)
    if not names:
        return Languages([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool), 0)
    number = df.sparkSession.createDataFrame([(r["lang"], names.index(r["lang"]), min(1.0, documents / r["n"])) for r in found], "lang string, number int, share double")
    drawn = F.xxhash64("k", "text") / 2.0**64 + 0.5 < F.col("share")
    sample = rows.join(F.broadcast(number), "lang").where(drawn).select("number", "text").repartition(FIT_TASKS)  # bounded by languages

    def count(batches):
        cells = np.zeros((len(names), BUCKETS + len(NAMES)), np.int64)
        for b in batches:
            numbers = b.column("number").to_pylist()
            for lo, hi, texts in text_blocks(b, "text", BLOCK_BYTES):
                index: dict[str, int] = {}
                of = [np.fromiter((index.setdefault(w, len(index)) for w in words_in(t)), np.int64) for t in texts]
                if not index:
                    continue
                bucket, word, script = grams(list(index))
                length = np.fromiter(map(len, index), np.int64, len(index))
                for k in set(numbers[lo:hi]):
                    times = np.bincount(np.concatenate([x for x, m in zip(of, numbers[lo:hi]) if m == k]), minlength=len(index))
                    cells[k, :BUCKETS] += np.bincount(bucket, times[word], BUCKETS).astype(np.int64)
                    cells[k, BUCKETS:] += np.bincount(script, times * length, len(NAMES)).astype(np.int64)
        at = np.nonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(cells[at], pa.int64())], ["number", "cell", "n"])

    counted = sample.mapInArrow(count, "number int, cell int, n long").groupBy("number", "cell").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket and language
    cells = np.zeros((len(names), BUCKETS + len(NAMES)))
    cells[counted["number"].to_numpy(), counted["cell"].to_numpy()] = counted["n"].to_numpy()
    seen = cells[:, :BUCKETS]
    smooth = 0.5
    logs = np.log(seen + smooth) - np.log(seen.sum(1, keepdims=True) + smooth * BUCKETS)
    script = cells[:, BUCKETS:]
    uses = (script >= SCRIPT_SHARE * np.maximum(script.sum(1, keepdims=True), 1)) & (script > 0)
    uses[:, NAMES.index("-")] = False
    return Languages(names, np.ascontiguousarray(logs.T.astype(np.float32)), uses.T.copy(), names.index(common))


def language_spans(df: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, n_spans and the spans (start, end, lang; code points) of every text."""
    rows = df.select(df[id_col].alias("doc_id"), full_text(text_col).alias("text"))
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for b in batches:
            for lo, hi, texts in text_blocks(b, "text", BLOCK_BYTES):
                labelled = model.label(texts)
                verdicts = [model.verdict(*x) for x in labelled]
                counts = [int(np.count_nonzero(np.diff(p))) + 1 if len(p) and model.names else 0 for p, _, _ in labelled]
                columns = [b.column("doc_id").slice(lo, hi - lo), pa.array([v[0] for v in verdicts]), pa.array([v[1] for v in verdicts]), pa.array(counts, pa.int64())]
                if spans:
                    columns.append(pa.array([model.spans(t, x[0]) for t, x in zip(texts, labelled)], shape))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "n_spans", "spans"][: len(columns)])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_spans long" + (", spans array<struct<start:long,end:long,lang:string>>" if spans else ""))


def predicted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_spans of every document."""
    found = language_spans(df, fit(df, id_col, text_col, lang_col), id_col, text_col, spans=False)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_spans")


def op11_language_id(spark, sf_dir):
    """Query op11: the language of every text of ``documents``."""
    return predicted(table(spark, sf_dir, "documents"))
