"""Quality rules by distribution divergence.

Each document's character classes and common words are histogrammed and compared with the reference of its language
by Jensen-Shannon distance. A reference is the summed histogram of all documents of the language that pass the base
rules, so it covers the whole table. The common words of the languages in ``COMMON_WORDS`` are given; every other
language has its ``OWN_WORDS`` most frequent words, counted over the same documents. Short documents have noisy
histograms: below ``MIN_CHARS`` (character classes) or ``MIN_JUDGED_WORDS`` (common words) a distance is not judged.
For a language with fewer than ``MIN_REFERENCE`` reference words, or a null one, only the base rules hold: no document
is judged by the mixture of other languages. Letters beyond ASCII keep their case.

Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. Extra columns pass
``quality_verdicts`` by. ``drop_rejected`` decides row by row, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import arrays as A
from kinfold.llm.columns import plainly_named
from kinfold.sources.scratch import drop, materialize

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PCT = 20
MIN_CHARS = 200
MIN_JUDGED_WORDS = 100
MIN_REFERENCE = 200
OWN_WORDS = 20
#: Jensen-Shannon distances (square root of the divergence in bits, 0 to 1) above which a document is rejected.
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.3

# Frequent function words of some languages.
COMMON_WORDS = {
    "de": "der die das und in zu den von mit für auf ist im dem nicht ein eine als auch es",
    "en": "the of and to in a is that for it was on are as with be at this or an",
    "es": "de la que el en y a los se del las un por con no una su para es como",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au",
}
_VOCABULARY = sorted({word for words in COMMON_WORDS.values() for word in words.split()})

_SYMBOLS = b"#*$%&|<>"
_CLASSES = ["lower", "upper", "digit", "blank", "stop", "symbol", "other", "beyond"]


def _class_of(byte: int) -> int | None:
    char = chr(byte)
    if byte >= 0x80:
        return None if byte & 0xC0 == 0x80 else 7
    if char.islower():
        return 0
    if char.isupper():
        return 1
    if char.isdigit():
        return 2
    if byte == 0x20 or 0x09 <= byte <= 0x0D:
        return 3
    if char in ".,;:!?'\"()-":
        return 4
    return 5 if byte in _SYMBOLS else 6


# One row of byte counts times this matrix gives the class counts.
_CLASS_MATRIX = np.zeros((256, len(_CLASSES)), np.int64)
for _byte in range(256):
    if (_class := _class_of(_byte)) is not None:
        _CLASS_MATRIX[_byte, _class] = 1
_IS_SYMBOL = np.isin(np.arange(256), list(_SYMBOLS)).astype(np.int64)

_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_HISTOGRAMS = "class_counts array<long>, word_counts array<long>"


def _vocabulary_hashes() -> tuple[np.ndarray, np.ndarray]:
    data = "".join(_VOCABULARY).encode()
    ends = np.cumsum([len(word.encode()) for word in _VOCABULARY])
    starts = np.r_[0, ends[:-1]]
    hashes = A.hash_spans(np.frombuffer(data + bytes(A.PAD), np.uint8), starts, ends)
    order = np.argsort(hashes)
    return hashes[order], order


def _duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    repeated = 0
    for line in lines:
        if line.strip(" \t\n\v\f\r"):
            repeated += line in seen
            seen.add(line)
    return repeated


def _repeated_words(hashes: np.ndarray, words: A.Words) -> np.ndarray:
    """Words inside windows that occur again in the same document; equal 64-bit window hashes count as equal."""
    at = A.window_starts(words.first, WINDOW)
    windows = A.window_hashes(hashes, WINDOW)[at] if len(at) else np.zeros(0, np.uint64)
    owner = np.searchsorted(words.first, at, side="right") - 1
    keys = windows + A.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return A.sums(A.covered(len(hashes), at[again], WINDOW), words.first)


def _spelled(texts: A.Texts) -> tuple[A.Words, np.ndarray]:
    """Words and their hashes without ASCII case and surrounding marks."""
    plain = texts.map_bytes(A.LOWER)
    words = A.words_of(plain, A.ALNUM)
    return words, A.hash_spans(plain.data, words.starts, words.ends)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the documents that pass the base rules, summed by language within a slice."""
    for part, texts in A.text_slices(batches):
        words = A.words_of(texts, A.NOT_BLANK)
        repeated = _repeated_words(A.hash_spans(texts.data, words.starts, words.ends), words)
        good = (words.counts >= MIN_WORDS) & (repeated * 100 <= words.counts * MAX_REPEATED_PCT)
        spelled, hashes = _spelled(texts)
        langs = part.column("lang").to_pylist()
        names = sorted(set(langs))
        place = {lang: i for i, lang in enumerate(names)}
        owner = A.owners(spelled.first)
        lang_of = np.array([place[lang] for lang in langs], np.int64)[owner]
        lang_of, hashes = lang_of[good[owner]], hashes[good[owner]]
        order = np.lexsort((hashes, lang_of))
        lang_of, hashes = lang_of[order], hashes[order]
        new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (lang_of[1:] != lang_of[:-1])][: len(hashes)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[i] for i in lang_of[new]], pa.string()),
                pa.array(hashes[new].view(np.int64), pa.int64()),
                pa.array(np.diff(np.r_[new, len(hashes)]), pa.int64()),
            ],
            names=["lang", "word", "n"],
        )


def own_vocabularies(docs: DataFrame) -> dict[str, np.ndarray]:
    """Hashes of the most frequent words of each language that ``COMMON_WORDS`` does not know.

    ``OWN_WORDS`` hashes per language of at least ``MIN_REFERENCE`` words reach the driver.
    """
    others = docs.filter(F.col("lang").isNotNull() & ~F.col("lang").isin(*COMMON_WORDS)).select("lang", "text")
    counts = others.mapInArrow(_word_counts, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "language-words")
    large = counts.groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= MIN_REFERENCE).select("lang")
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    best = ranked.filter(F.col("rank") <= OWN_WORDS).join(large, "lang").groupBy("lang").agg(F.collect_list("word").alias("words"))
    return {row.lang: np.sort(np.array(row.words, np.int64).view(np.uint64)) for row in best.collect()}


def _common_words(spelled: A.Words, hashes: np.ndarray, langs: list[str | None], own: dict[str, np.ndarray]) -> np.ndarray:
    """Counts of the common words of each document's language, and of all other words in the last column."""
    vocabulary, places = _vocabulary_hashes()
    size, n = len(vocabulary), len(spelled.counts)
    owner = A.owners(spelled.first)
    common = np.zeros((n, size + 1), np.int64)
    for lang in {lang if lang in own else None for lang in langs}:
        words, at_place = (vocabulary, places) if lang is None else (own[lang], np.arange(len(own[lang])))
        mine = np.array([(other if other in own else None) == lang for other in langs], bool)[owner]
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        found = np.flatnonzero(mine & (words[at] == hashes))
        keys = owner[found] * (size + 1) + at_place[at[found]]
        common += np.bincount(keys, minlength=n * (size + 1)).reshape(n, size + 1)
    common[:, size] = spelled.counts - common.sum(axis=1)
    return common


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel(), pa.int64()))


def _histogram_rows(part: pa.RecordBatch, texts: A.Texts, columns: list[str], own: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(texts)
    bins = np.zeros((n, 256), np.int64)
    for i in range(n):
        bins[i] = np.bincount(texts.data[texts.bounds[i] : texts.bounds[i + 1]], minlength=256)
    words = A.words_of(texts, A.NOT_BLANK)
    hashes = A.hash_spans(texts.data, words.starts, words.ends)
    classes = bins @ _CLASS_MATRIX
    # Common words ignore case and surrounding marks.
    common = _common_words(*_spelled(texts), part.column("lang").to_pylist(), own)
    lines = [_duplicate_lines(text) if text else 0 for text in part.column("text").to_pylist()]
    counts = [
        words.counts,
        classes.sum(axis=1) - classes[:, 3],
        bins @ _IS_SYMBOL,
        lines,
        _repeated_words(hashes, words),
    ]
    return pa.RecordBatch.from_arrays(
        [
            *[part.column(c) for c in columns],
            *[pa.array(np.asarray(c), pa.int64()) for c in counts],
            _lists(classes),
            _lists(common),
        ],
        names=[*columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
               "class_counts", "word_counts"],
    )


def _histograms(
    batches: Iterator[pa.RecordBatch], columns: list[str], own: dict[str, np.ndarray]
) -> Iterator[pa.RecordBatch]:
    for part, texts in A.text_slices(batches):
        yield _histogram_rows(part, texts, columns, own)


def document_histograms(docs: DataFrame, columns: list[str], own: dict[str, np.ndarray]) -> DataFrame:
    """Base counts and histograms of every document, beside ``columns`` (which have lang and must not clash with them)."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, *(["text"] if "text" not in columns else [])).mapInArrow(
        lambda batches: _histograms(batches, columns, own), f"{schema}, {_COUNTS}, {_HISTOGRAMS}"
    )


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PCT)


def _summed(counts: str, size: int) -> list[F.Column]:
    return [F.sum(F.col(counts)[i]).alias(f"{counts}_{i}") for i in range(size)]


def language_references(histograms: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Summed class and word counts by language.

    One row per language reaches the driver; a language is a short code, and languages below ``MIN_REFERENCE``
    words are left out before.
    """
    n_classes, n_words = len(_CLASSES), len(_VOCABULARY) + 1
    sums = [*_summed("class_counts", n_classes), *_summed("word_counts", n_words)]
    summed = histograms.filter(~base_failed() & F.col("lang").isNotNull()).groupBy("lang").agg(*sums)
    n_reference = sum((F.col(f"word_counts_{i}") for i in range(n_words)), F.lit(0))
    out = {}
    for row in summed.filter(n_reference >= MIN_REFERENCE).collect():
        values = np.array(row[1:], np.int64)
        out[row[0]] = values[:n_classes], values[n_classes:]
    return out


def _distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts from the reference; 0 for a row of zeros."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = np.broadcast_to(reference / reference.sum(), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where(counts.sum(axis=1) > 0, np.sqrt(np.clip(terms.sum(axis=1) / 2, 0, 1)), 0.0)


def _judged(batch: pa.RecordBatch, references) -> tuple[np.ndarray, np.ndarray]:
    """Distances of each row, NaN where a guard leaves it unjudged."""
    n = batch.num_rows
    out = np.full((2, n), math.nan)
    if not n:
        return out[0], out[1]
    langs = batch.column("lang").to_pylist()
    counts = [batch.column(c).flatten().to_numpy().reshape(n, -1) for c in ("class_counts", "word_counts")]
    for lang in set(langs):
        reference = references.get(lang)
        if reference is None:
            continue
        rows = np.array([i for i, other in enumerate(langs) if other == lang])
        for k, least in enumerate((MIN_CHARS, MIN_JUDGED_WORDS)):
            mine = counts[k][rows]
            out[k][rows] = np.where(mine.sum(axis=1) >= least, _distance(mine, reference[k]), math.nan)
    return out[0], out[1]


def with_distances(histograms: DataFrame, references) -> DataFrame:
    """Adds class_distance, word_distance (null: not judged) and kept."""
    columns = [c for c in histograms.columns if c not in ("class_counts", "word_counts")]

    def judge(batches):
        for batch in batches:
            distances = _judged(batch, references)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], *[pa.array(d, pa.float64(), from_pandas=True) for d in distances]],
                names=[*columns, "class_distance", "word_distance"],
            )

    schema = ", ".join(f"`{c}` {histograms.schema[c].dataType.simpleString()}" for c in columns)
    judged = histograms.mapInArrow(judge, f"{schema}, class_distance double, word_distance double")
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (
        F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE
    )
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & near)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, both distances and kept, for every row of ``docs``."""
    histograms = materialize(document_histograms(docs, ["doc_id", "lang"], own_vocabularies(docs)), "histograms")
    return with_distances(histograms, language_references(histograms)).drop("lang")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Reads the texts twice, those of languages that
    ``COMMON_WORDS`` does not know once more, and joins no text."""
    own = own_vocabularies(docs)
    histograms = materialize(document_histograms(docs, ["lang"], own), "histograms")
    references = language_references(histograms)
    drop(histograms)
    rows = plainly_named(docs, "text", "lang")

    def keep(batches):
        for part, texts in A.text_slices(batches):
            counts = _histogram_rows(part, texts, ["lang"], own)
            n_words, repeated = (counts.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            good = (n_words >= MIN_WORDS) & (repeated * 100 <= n_words * MAX_REPEATED_PCT)
            for distances, most in zip(_judged(counts, references), (MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE), strict=True):
                good &= np.isnan(distances) | (distances <= most)
            yield part.filter(pa.array(good))
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(keep, rows.schema).toDF(*docs.columns)
