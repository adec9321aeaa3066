"""Language ID: scripts narrow the candidates, Viterbi over word scores labels the spans of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import schema_text, tidy, worker_state
from strandline.llm.tokens import slices

UNKNOWN = "und"
BINS = 1 << 16
SLICE_CHARS = 1 << 18
ADDED = "lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"

# First and last code point of the blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
OTHER = len(SCRIPTS)
MOST_LANGUAGES = 1024


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, and the number of its script."""
    return worker_state(("letters",), _make_tables)


def _make_tables() -> tuple[np.ndarray, np.ndarray]:
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.full(0x110000, OTHER, np.uint8)
    for number, blocks in enumerate(SCRIPTS.values()):
        for first, last in blocks:
            script[first:last + 1] = number
    return letter, script


@dataclass
class Words:
    """Letters of a batch of texts, their features, and where words and texts start among them."""

    bins: np.ndarray          # feature of each letter
    scripts: np.ndarray       # script of each word
    starts: np.ndarray        # first letter of each word
    sizes: np.ndarray         # letters of each word
    first: np.ndarray         # first character of each word in the batch's codes
    doc_words: np.ndarray     # words before each text, and all words
    doc_chars: np.ndarray     # characters before each text


def words_of(texts: list[str]) -> Words:
    """Split texts into runs of letters; every letter's feature hashes it with its two neighbours.

    Letters count in lower case where that is a single character, so that places stay those of
    the text. A word's neighbours outside are a boundary.
    """
    letter, script = _tables()
    joined = "\n".join(texts)
    lower = joined.lower()
    if len(lower) != len(joined):
        lower = "".join(x if len(x := c.lower()) == 1 else c for c in joined)
    codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = letter[codes]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    sizes = last - first
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = np.flatnonzero(inside)
    here = codes[at]
    before = np.concatenate([[0], here[:-1]]).astype(np.uint32)
    after = np.concatenate([here[1:], [0]]).astype(np.uint32)
    if len(first):
        before[starts[:-1]] = 0
        after[starts[1:] - 1] = 0
    mixed = before * np.uint32(2654435761) ^ here * np.uint32(2246822519) ^ after * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2654435769)
    chars = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return Words((mixed >> np.uint32(16)).astype(np.int64), script[codes[first]], starts[:-1], sizes,
                 first, np.searchsorted(first, chars), chars)


@dataclass
class Model:
    """Log odds of features and candidate languages of scripts, in the order of ``langs``."""

    langs: list[str]
    weights: np.ndarray       # BINS x languages
    candidates: np.ndarray    # scripts x languages, boolean


def sample_bounds(known: DataFrame, per_language: int) -> dict[str, float]:
    """The hash of a text, from 0 to 1, up to which each language's texts are drawn: about ``per_language`` different ones, and at
    least one."""
    found = known.groupBy("lang").agg(
        F.greatest(F.min(_drawn()), F.lit(float(per_language)) / F.approx_count_distinct("text", 0.02)).alias("bound")).limit(
        MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; clean the labels first")
    return {r["lang"]: min(1.0, r["bound"]) for r in found}


def _drawn() -> Column:
    return F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1 << 30)) / (1 << 30)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 2000,
        smooth: float = 0.5, least_share: float = 0.01) -> Model:
    """Learn from about ``per_language`` different texts of every language, chosen by a hash of the text.

    Copies count once, so a text that fills a language doesn't keep others out, and every language has a text. The driver holds the
    features of the languages: at most BINS numbers for each, of at most ``MOST_LANGUAGES``. A language
    is a candidate for a script that ``least_share`` of its letters are in.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    bounds = sample_bounds(known, per_language)
    if not bounds:
        return Model([], np.zeros((BINS, 0), np.float32), np.zeros((OTHER + 1, 0), bool))
    bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("lang")]
    sample = known.where(_drawn() <= bound).groupBy("lang", F.xxhash64("text").alias("copy")).agg(
        F.first("text").alias("text")).select("lang", "text")

    def count(batches):
        for batch in batches:
            langs, texts = (c.to_pylist() for c in batch.columns)
            for start, stop in slices(texts, SLICE_CHARS):
                for name in dict.fromkeys(langs[start:stop]):
                    words = words_of([t for t, x in zip(texts[start:stop], langs[start:stop]) if x == name])
                    bins = np.bincount(words.bins, minlength=BINS)
                    scripts = np.bincount(words.scripts, words.sizes, OTHER + 1).astype(np.int64)
                    all_bins = np.concatenate([bins, scripts])
                    found = np.flatnonzero(all_bins)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(all_bins[found])],
                        ["lang", "bin", "n"])

    counts = sample.mapInArrow(lambda batches: tidy(count(batches)), "lang string, bin long, n long").groupBy("lang", "bin").agg(
        F.sum("n").alias("n")).toPandas()
    langs = sorted(bounds)
    table = np.zeros((BINS + OTHER + 1, len(langs)))
    table[counts["bin"].to_numpy(int), [langs.index(x) for x in counts["lang"]]] = counts["n"]
    bins, scripts = table[:BINS] + smooth, table[BINS:]
    weights = np.log(bins / bins.sum(0))
    return Model(langs, (weights - weights.mean(1, keepdims=True)).astype(np.float32),
                 (scripts > 0) & (scripts >= least_share * np.maximum(1, scripts.sum(0))))


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The path of highest score over words, where each change of language costs ``penalty``.

    Ties stay in the language, then go to the first one. A path of one language is best if no
    stretch gains more than the penalty by leaving it, which is looked at first.
    """
    count = len(scores)
    whole = int(np.argmax(scores.sum(0)))
    if scores.shape[1] == 1:
        return np.zeros(count, np.int64)
    gain = np.cumsum(np.delete(scores, whole, 1).max(1) - scores[:, whole], dtype=np.float64)
    lowest = np.minimum.accumulate(np.concatenate([[0.0], gain]))[:-1]
    if (gain - lowest).max(initial=0.0) <= penalty:
        return np.full(count, whole)
    best = scores[0].astype(np.float64)
    back = np.zeros((count, scores.shape[1]), np.int32)
    stay = np.arange(scores.shape[1])
    for t in range(1, count):
        leader = int(np.argmax(best))
        move = best[leader] - penalty > best
        back[t] = np.where(move, leader, stay)
        best = np.where(move, best[leader] - penalty, best) + scores[t]
    path = np.empty(count, np.int64)
    path[-1] = int(np.argmax(best))
    for t in range(count - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label(texts: list[str | None], model: Model, penalty: float):
    """Language, score and spans (language, start, end in characters) of each text."""
    words = words_of([t or "" for t in texts])
    langs = len(model.langs)
    counted = len(words.sizes)
    scores = np.zeros((counted, langs), np.float32)
    if counted and langs:
        for i in range(langs):
            scores[:, i] = np.add.reduceat(model.weights[:, i][words.bins], words.starts)
        allowed = model.candidates[words.scripts]
        some = allowed.any(1)
        scores[~some] = 0
        scores[some[:, None] & ~allowed] = -1e4
    ends = words.first + words.sizes
    for d, text in enumerate(texts):
        a, b = words.doc_words[d], words.doc_words[d + 1]
        if a == b or not langs:
            yield UNKNOWN, 0.0, []
            continue
        path = viterbi(scores[a:b], penalty)
        sizes = words.sizes[a:b] * some[a:b]
        letters = np.bincount(path, sizes, langs)
        first = int(np.argmax(letters)) if letters.any() else int(path[0])
        turns = np.flatnonzero(np.diff(path)) + 1
        lows, highs = np.concatenate([[0], turns]), np.concatenate([turns, [b - a]])
        base = words.doc_chars[d]
        spans = [(model.langs[path[i]], int(words.first[a + i] - base), int(ends[a + j - 1] - base))
                 for i, j in zip(lows, highs)]
        yield model.langs[first], float(letters[first] / words.sizes[a:b].sum()), spans


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
            penalty: float = 15.0) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``spans`` to the columns of ``docs``.

    The language is that of most letters in the spans; the score is the share of all letters in
    them, no probability. ``und`` with score 0 where a text is null or has no letter, or the model knows no
    language. Letters of a script in which no language was learned count for none; a text of
    such letters alone gets the first language with score 0. Columns of those names in ``docs`` are replaced.
    """
    # Plain arrays: a broadcast object would be pickled by the name of its class, which executors may lack.
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.candidates))
    added = ["lang_pred", "score", "spans"]
    kept = docs.drop(*added)
    number = kept.columns.index(text)
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(number).to_pylist()
            for start, stop in slices(texts, SLICE_CHARS):
                found = list(label(texts[start:stop], Model(*shared.value), penalty))
                langs, scores, spans = zip(*found)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                     pa.array([[{"lang": a, "start": b, "end": c} for a, b, c in s] for s in spans], span)],
                    [*part.schema.names, *added])

    return kept.mapInArrow(lambda batches: tidy(run(batches)), f"{schema_text(kept)}, {ADDED}")


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the key as text falls into the fold; a null key doesn't."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows to learn from: those not held out, whose key is not null."""
    return docs.where(F.col(key).isNotNull() & ~held_out(F.col(key)))
