"""Language identification by spans.

Each word's script narrows the languages it may belong to; the remaining ones are scored
by character n-grams, and a Viterbi pass with a switching penalty labels the words,
so that a text in several languages falls into spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import keyed, pieces_of, small, unkeyed
from tidemark.sources.shared import materialise

UND = "und"


@dataclass(frozen=True)
class LangOptions:
    """`sample` is the number of documents per language the model is fitted on (those
    with the smallest hash of their id). `penalty` is the log-likelihood a switch costs,
    `floor` the most one word can count against a language. A script is open to a
    language that writes at least `script_share` of its letters in it."""

    sample: int = 2_000
    buckets: int = 1 << 15
    smoothing: float = 0.2
    penalty: float = 12.0
    floor: float = 6.0
    script_share: float = 0.01
    reject_below: float = 0.5


# First code points of the scripts told apart; each range ends where the
# next begins. Letters outside are "other".
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "other"), (0x20000, "han"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_FROM = np.array([low for low, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS])
_WORD = re.compile(r"[^\W\d_]+")
# \w also takes signs such as halves, superscripts and Roman numerals; they part letters.
_NUMERALS = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(rf"[^\W\d_{_NUMERALS}]+")
_PIECE_CHARS = 4_000_000
_SCORED_CHARS = 1 << 16


@dataclass(frozen=True)
class LangModel:
    langs: list[str]
    weights: np.ndarray = field(repr=False)  # buckets x languages, log probabilities
    allowed: np.ndarray = field(repr=False)  # scripts x languages


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the pairs and triples of characters, first position of each word, script of each word)."""
    points = np.frombuffer(f" {'  '.join(words)}  ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(w) for w in words])
    starts = np.concatenate(([0], np.cumsum(sizes + 2)[:-1]))
    a, b, c = points[:-2], points[1:-1], points[2:]
    pairs = (a * np.uint64(0x9E3779B1) + b) * np.uint64(0x85EBCA77C2B2AE63)
    triples = (pairs ^ (c + np.uint64(1))) * np.uint64(0xC2B2AE3D27D4EB4F)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    both = np.stack((pairs >> shift, triples >> shift), axis=1).astype(np.int64)
    script = _SCRIPT[np.searchsorted(_FROM, points[starts + 1], side="right") - 1]
    return both, starts, script


def _words(text: str | None) -> list[str]:
    """Runs of letters. The quick pattern also takes numerals; what holds some is cut again."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for word in found for w in ([word] if word.isalpha() else _LETTERS.findall(word))]


def _counted(batches: Iterator[pa.RecordBatch], options: LangOptions) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams (kind 0) and of letters by script (kind 1) per language."""
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).extend(_words(text))
        for lang, words in by_lang.items():
            if not words:
                continue
            grams, _, script = _grams(words, options.buckets)
            letters = np.bincount(script, weights=[len(w) for w in words], minlength=len(NAMES)).astype(np.int64)
            for kind, counts in ((0, np.bincount(grams.ravel(), minlength=options.buckets)), (1, letters)):
                on = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(on)), pa.array([kind] * len(on), pa.int32()), pa.array(on, pa.int64()), pa.array(counts[on], pa.int64())],
                    names=["lang", "kind", "slot", "n"],
                )


def train(docs: DataFrame, options: LangOptions = LangOptions()) -> LangModel:
    """Fits on text and non-NULL lang of documents that are not held out. The driver gets
    one number per language and bucket."""
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    learn = (
        docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
        .select("doc_id", F.col("lang").cast("string").alias("lang"))
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= options.sample)
        .drop("place")
    )
    # At most `sample` rows a language; rows that repeat an id stand for their own language.
    chosen = small(materialise(learn.distinct(), "languages-sample"))
    told = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    texts = told.join(chosen, ["doc_id", "lang"], "left_semi").select("lang", "text")
    counts = (
        texts.mapInArrow(lambda it: _counted(it, options), "lang string, kind int, slot long, n long")
        .groupBy("lang", "kind", "slot")
        .agg(F.sum("n").alias("n"))
        .toArrow()
        .to_pydict()
    )
    langs = sorted(set(counts["lang"]))
    place = {lang: i for i, lang in enumerate(langs)}
    grams, letters = np.zeros((options.buckets, len(langs))), np.zeros((len(NAMES), len(langs)))
    for lang, kind, slot, n in zip(*(counts[c] for c in ("lang", "kind", "slot", "n")), strict=True):
        (letters if kind else grams)[slot, place[lang]] += n
    smooth = grams + options.smoothing
    weights = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
    allowed = letters >= options.script_share * np.maximum(letters.sum(axis=0), 1)
    return LangModel(langs, weights, allowed)


def _scored(words: list[str], model: LangModel, options: LangOptions) -> np.ndarray:
    """A row of scores per word, 0 for its best language. A few words are looked up at a time,
    since every character takes a row of weights. The last n-gram of a word reaches into the next."""
    ranges = pieces_of(words, _SCORED_CHARS)
    return np.concatenate([_scores(words[low : high + 1], model, options)[: high - low] for low, high in ranges])


def _scores(words: list[str], model: LangModel, options: LangOptions) -> np.ndarray:
    grams, starts, script = _grams(words, options.buckets)
    flat = model.weights[grams[:, 0]] + model.weights[grams[:, 1]]
    sums = np.add.reduceat(flat, starts, axis=0)
    allowed = model.allowed[script]
    closed = ~allowed & allowed.any(axis=1)[:, None]
    sums[closed] = -np.inf
    return np.maximum(sums - sums.max(axis=1)[:, None], -options.floor).astype(np.float32)


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels for sequences of words that lie one after the other, all advanced together.

    `starts` and `sizes` locate the sequences, longest first. Ties stay, then take the first label.
    """
    labels = np.zeros(len(scores), dtype=np.int32)
    if not len(sizes) or not sizes[0]:
        return labels
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    value = np.zeros((len(sizes), scores.shape[1]), dtype=np.float32)
    value[: active[0]] = scores[starts[: active[0]]]
    stayed, came = [None] * longest, [None] * longest
    for t in range(1, longest):
        n = active[t]
        now = value[:n]
        came[t] = now.argmax(axis=1).astype(np.int32)
        best = now.max(axis=1)[:, None] - penalty
        stayed[t] = now >= best
        np.maximum(now, best, out=now)
        now += scores[starts[:n] + t]
    state = value.argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        n = active[t]
        now = state[:n]
        labels[starts[:n] + t] = now
        state[:n] = np.where(stayed[t][np.arange(n), now], now, came[t])
    labels[starts[: active[0]]] = state[: active[0]]
    return labels


def label(texts: list[str | None], model: LangModel, options: LangOptions) -> list[tuple[str, float, list]]:
    """(language, share of its letters, spans) per text; a span is (language, first word,
    words)."""
    index: dict[str, int] = {}
    # Only different words stay objects.
    found = [np.array([index.setdefault(w, len(index)) for w in _words(t)], dtype=np.int32) for t in texts]
    out: list[tuple[str, float, list]] = [(UND, 0.0, []) for _ in texts]
    if not index or not model.langs:
        return out
    unique, ids = list(index), np.concatenate(found)
    scores = _scored(unique, model, options)[ids]
    letters = np.array([len(w) for w in unique])[ids]
    sizes = np.array([len(f) for f in found])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    order = np.argsort(-sizes, kind="stable")
    labels = viterbi(scores, starts[order], sizes[order], options.penalty)
    for d in np.flatnonzero(sizes):
        part = slice(starts[d], starts[d] + sizes[d])
        mine = labels[part]
        share = np.bincount(mine, weights=letters[part], minlength=len(model.langs))
        top = int(share.argmax())
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(mine)) + 1, [len(mine)]))
        spans = [
            {"lang": model.langs[mine[a]], "first": int(a), "words": int(b - a)} for a, b in zip(cuts, cuts[1:], strict=False)
        ]
        out[d] = (model.langs[top], float(share[top] / share.sum()), spans)
    return out


_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))


def _labelled(
    batches: Iterator[pa.RecordBatch], model: LangModel, options: LangOptions, names: tuple[str, str, str]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, start, held = batch.column("text"), 0, 0
        sizes = [len(t) if (t := x.as_py()) else 0 for x in texts]
        for i, size in enumerate(sizes):
            held += size
            if held < _PIECE_CHARS and i + 1 < len(sizes):
                continue
            piece = batch.slice(start, i + 1 - start)
            lang, share, spans = zip(*label(piece.column("text").to_pylist(), model, options), strict=True)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(lang), pa.array(share), pa.array(spans, _SPANS)],
                names=[*piece.schema.names, *names],
            )
            start, held = i + 1, 0


def identify(docs: DataFrame, model: LangModel, options: LangOptions = LangOptions()) -> DataFrame:
    """doc_id, lang_pred, score, spans for each row of `docs`.

    A text that is NULL, empty or without a letter is `und` with score 0. So is every text
    if nothing could be learned. Rows repeating an id are labelled one by one. A tie goes to
    the language that sorts first. No other column is read.
    """
    kind = "key long, text string, lang_pred string, score double, spans array<struct<lang:string,first:long,words:long>>"
    names = ("lang_pred", "score", "spans")
    found = keyed(docs).mapInArrow(lambda it: _labelled(it, model, options, names), kind)
    return found.select(unkeyed("key", "doc_id"), *names)


def keep_identified(docs: DataFrame, model: LangModel, options: LangOptions = LangOptions()) -> DataFrame:
    """`docs` without those rejected: `und`, or no language holding `reject_below` of the letters."""
    names = ("_tidemark_lang", "_tidemark_score", "_tidemark_spans")
    span = T.StructType().add("lang", "string").add("first", "long").add("words", "long")
    kind = T.StructType(list(docs.schema.fields))
    for name, of in zip(names, ("string", "double", T.ArrayType(span)), strict=True):
        kind = kind.add(name, of)
    found = docs.mapInArrow(lambda it: _labelled(it, model, options, names), kind)
    kept = found.where((F.col(names[0]) != UND) & (F.col(names[1]) >= options.reject_below))
    return kept.drop(*names)
