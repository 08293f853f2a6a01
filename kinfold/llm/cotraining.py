"""Quality classifier by co-training.

Two logistic classifiers see different views of a document: its text (shape features and the most telling words) and its
metadata (language, source, length, and host and path of the page of the same id). In each round either view labels all
unlabelled documents that it is sure of, and these join the training rows of the other view. Then each view's score
is calibrated on labelled rows that took no part in training, a combiner of the two calibrated log-odds is fitted on
the same rows, and all documents are scored.

Only labelled rows are sampled, by a hash of doc_id: at most ``MAX_LABELLED`` (a fifth of which calibrates). The words are
chosen from them. Of the unlabelled documents every confident one teaches: their features are written once as a narrow
table, and a fit reads it by sums of losses, gradients and curvatures, so the driver has matrices of a few hundred columns
(1,024 of metadata at most) and no rows. The rows of one pseudo-label weigh, taken together, at most what the labelled
rows of a class weigh, and both pseudo-labels the same, so neither their number nor a hot source drowns the labels.
Everything is deterministic but for the order of sums. The target is good text: quality 1 and not toxic.

Defined cases: a null text is empty; null metadata is a value of its own; a document with several labels counts with each.
Null labels are no labels. Without labelled rows of both classes every score is 0.5 and every document is kept. Rows
without a doc_id are scored by their text and metadata alone. Extra columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm import arrays as A
from kinfold.llm.url_reputation import split_url
from kinfold.sources.scratch import materialize

MAX_LABELLED = 8_000
N_WORDS = 192
MIN_WORD_DOCS = 8
ROUNDS = 3
CONFIDENT = 0.95
KEEP = 0.5
_META_BITS = 10
#: Rows of a curvature matrix per shuffled row.
_MATRIX_ROWS = 64
_HOLD_OUT = 5

_SHAPE = ["log_words", "log_bytes", "word_size", "upper", "digit", "symbol", "stop", "beyond", "distinct", "common", "lines"]
_bytes = np.arange(256)
_GROUPS = [
    (_bytes >= 65) & (_bytes <= 90),
    (_bytes >= 48) & (_bytes <= 57),
    np.isin(_bytes, list(b"#*$%&|<>")),
    np.isin(_bytes, list(b".,;:!?'\"()-")),
    _bytes >= 0x80,
]


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Logistic:
    """Ridge logistic regression by Newton steps on standardised features, both classes weighed alike."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    def loss(w: np.ndarray) -> float:
        margin = z @ w
        return float((weight * (np.logaddexp(0, margin) - y * margin)).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(np.clip(z @ w, -30, 30))
        gradient = z.T @ (weight * (p - y)) + penalty * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        if then >= now - 1e-9 * abs(now):
            break
        w, now = w - size * step, then
    return Logistic(mean, scale, w[:-1], float(w[-1]))


def _word_hashes(texts: A.Texts) -> tuple[np.ndarray, A.Words]:
    plain = texts.map_bytes(A.LOWER)
    words = A.words_of(plain, A.ALNUM)
    return A.hash_spans(plain.data, words.starts, words.ends), words


def _distinct_words(hashes: np.ndarray, words: A.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct words of each document."""
    owner = A.owners(words.first)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def text_features(texts: A.Texts, vocabulary: np.ndarray) -> np.ndarray:
    """Shape features, and which words of the sorted ``vocabulary`` a text has."""
    n = len(texts)
    hashes, words = _word_hashes(texts)
    distinct, owner = _distinct_words(hashes, words)
    size = np.maximum(np.diff(texts.bounds), 1)
    count = np.maximum(words.counts, 1)
    raw = texts.data[: texts.size]
    shares = [A.sums(group[raw], texts.bounds) / size for group in _GROUPS]
    sizes = A.sums(words.ends - words.starts, words.first) / count
    n_distinct = np.bincount(owner, minlength=n)
    out = np.zeros((n, len(_SHAPE) + len(vocabulary)))
    lines = A.sums(raw == 10, texts.bounds)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, distinct), len(vocabulary) - 1)
        hit = vocabulary[at] == distinct
        out[owner[hit], len(_SHAPE) + at[hit]] = 1
    common = out[:, len(_SHAPE) :].sum(axis=1) / np.maximum(n_distinct, 1)
    shape = [np.log1p(words.counts), np.log1p(size), sizes, *shares, n_distinct / count, common, lines / count]
    out[:, : len(_SHAPE)] = np.array(shape).T
    return out


def _bucket(name: str, value) -> int:
    return zlib.crc32(f"{name}={value}".encode()) & ((1 << _META_BITS) - 1)


def metadata_features(part: pa.RecordBatch) -> np.ndarray:
    """Hashed one-hot values of the metadata columns."""
    columns = [c for c in part.schema.names if c.startswith("meta_")]
    out = np.zeros((part.num_rows, 1 << _META_BITS), np.float32)
    for column in columns:
        values = part.column(column).to_pylist()
        places = {v: _bucket(column, v) for v in set(values)}
        out[np.arange(part.num_rows), [places[v] for v in values]] = 1
    return out


def own_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, text and the meta_ columns that a document has itself."""
    return docs.select(
        "doc_id",
        "text",
        F.col("lang").alias("meta_lang"),
        F.col("source").alias("meta_source"),
        F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(1)))).alias("meta_size"),
    )


def with_page_metadata(rows: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Adds meta_host and meta_path of the page (page_id, url) of the same id; of repeated pages the least url counts."""
    if pages is None:
        return rows
    host, path = split_url(F.col("url"))
    known = pages.filter("page_id IS NOT NULL").groupBy(F.col("page_id").alias("doc_id")).agg(F.min("url").alias("url"))
    known = known.select("doc_id", host.alias("meta_host"), F.regexp_extract(path, "^(/[^/]*)", 1).alias("meta_path"))
    return rows.join(known, "doc_id", "left")


def _hash_order() -> Column:
    return F.xxhash64("doc_id", F.lit(7))


def _marked(labels: DataFrame) -> DataFrame:
    good = F.when(F.col("quality").isNotNull(), (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return labels.select("doc_id", good.cast("int").alias("good")).filter("good IS NOT NULL AND doc_id IS NOT NULL")


def _sample(rows: DataFrame, marked: DataFrame, pages: DataFrame | None) -> DataFrame:
    """A bounded sample of labelled rows (with ``good``), in hash order."""
    known = materialize(marked.orderBy(_hash_order(), "doc_id", "good").limit(MAX_LABELLED), "labelled-sample")
    # The list of ids is bounded by the sample size, so it may be broadcast.
    labelled = with_page_metadata(rows.join(F.broadcast(known), "doc_id"), pages).orderBy(_hash_order(), "doc_id", "good")
    return materialize(labelled, "labelled")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in A.text_slices(batches):
        hashes, owner = _distinct_words(*_word_hashes(texts))
        good = np.array(part.column("good").to_pylist(), np.int64)[owner]
        words, inverse = np.unique(hashes, return_inverse=True)
        counts = [np.bincount(inverse, weights=w, minlength=len(words)).astype(np.int64) for w in (good, 1 - good)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words.view(np.int64), pa.int64()), *[pa.array(c, pa.int64()) for c in counts]],
            names=["word", "good", "bad"],
        )


def telling_words(labelled: DataFrame) -> np.ndarray:
    """Hashes of the ``N_WORDS`` words whose share of documents differs most between the classes."""
    totals = labelled.agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).first()
    counts = labelled.select("text", "good").mapInArrow(_word_counts, "word long, good long, bad long")
    counts = counts.groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("good") + 0.5) / (totals.good + 1.0)) - F.log((F.col("bad") + 0.5) / (totals.bad + 1.0))
    best = counts.filter(F.col("good") + F.col("bad") >= MIN_WORD_DOCS).orderBy(
        F.round(F.abs(odds) * F.log1p(F.col("good") + F.col("bad")), 9).desc(), "word"
    )
    words = [row.word for row in best.limit(N_WORDS).collect()]
    return np.sort(np.array(words, np.int64).view(np.uint64))


def _features_of(table: DataFrame, vocabulary: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A bounded sample's features, computed in tasks; (rows, text view, metadata view) reach the driver."""
    meta = [c for c in table.columns if c.startswith("meta_")]
    extra = [c for c in ("doc_id", "good") if c in table.columns]

    def features(batches):
        for part, texts in A.text_slices(batches):
            values = text_features(texts, vocabulary).astype(np.float32)
            buckets = [np.flatnonzero(row) for row in metadata_features(part)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in extra],
                    pa.array(list(values), pa.list_(pa.float32())),
                    pa.array(buckets, pa.list_(pa.int64())),
                ],
                names=[*extra, "x", "meta"],
            )

    kinds = {"doc_id": "doc_id long", "good": "good int"}
    schema = ", ".join([*[kinds[c] for c in extra], "x array<float>, meta array<long>"])
    got = table.select(*extra, "text", *meta).mapInArrow(features, schema).toArrow()
    order = np.lexsort((np.arange(got.num_rows), got.column("doc_id").to_numpy()))
    got = got.take(pa.array(order))
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(got.num_rows, len(_SHAPE) + len(vocabulary))
    m = np.zeros((got.num_rows, 1 << _META_BITS), np.float32)
    for i, buckets in enumerate(got.column("meta").to_pylist()):
        m[i, buckets] = 1
    return got, x, m


def narrow_features(rows: DataFrame, marked: DataFrame, pages: DataFrame | None, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, free (not labelled), shape, words (one bit each) and metadata buckets of every row, as a table."""
    meta = [c for c in rows.columns if c not in ("doc_id", "text")]

    def read(batches):
        for part, texts in A.text_slices(batches):
            values = text_features(texts, vocabulary)
            bits = np.packbits(values[:, len(_SHAPE) :] > 0, axis=1)
            shape = pa.array(list(values[:, : len(_SHAPE)].astype(np.float32)), pa.list_(pa.float32()))
            packed = pa.array([row.tobytes() for row in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", *meta)], shape, packed], names=["doc_id", *meta, "shape", "words"])

    def hashed(batches):
        for part in batches:
            buckets = pa.array([np.flatnonzero(row) for row in metadata_features(part)], pa.list_(pa.int64()))
            columns = ["doc_id", "free", "shape", "words"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], buckets], names=[*columns, "meta"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *meta))
    narrow = rows.mapInArrow(read, f"{kinds}, shape array<float>, words binary")
    known = marked.select("doc_id").distinct().withColumn("known", F.lit(True))
    narrow = narrow.join(known, "doc_id", "left").withColumn("free", F.col("known").isNull()).drop("known")
    schema = "doc_id long, free boolean, shape array<float>, words binary, meta array<long>"
    return materialize(with_page_metadata(narrow, pages).mapInArrow(hashed, schema), "narrow-features")


def _text_view(part: pa.RecordBatch, n_words: int) -> np.ndarray:
    """Text features of narrow rows, and a column of ones."""
    n = part.num_rows
    shape = part.column("shape").flatten().to_numpy(zero_copy_only=False).reshape(n, len(_SHAPE))
    raw = np.frombuffer(b"".join(part.column("words").to_pylist()), np.uint8).reshape(n, (n_words + 7) // 8)
    return np.c_[shape.astype(np.float64), np.unpackbits(raw, axis=1, count=n_words), np.ones(n)]


def _meta_view(part: pa.RecordBatch, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places) of the ones in the metadata view; the last place, after ``columns``, is one in every row."""
    lists = part.column("meta")
    place = np.full(1 << _META_BITS, -1)
    place[columns] = np.arange(len(columns))
    at = place[lists.flatten().to_numpy(zero_copy_only=False)]
    owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    owner, at = np.r_[owner[at >= 0], np.arange(part.num_rows)], np.r_[at[at >= 0], np.full(part.num_rows, len(columns))]
    order = np.argsort(owner, kind="stable")
    return owner[order], at[order]


@dataclass
class Views:
    """How narrow rows are seen; weights of a view have the bias as their last number."""

    n_words: int
    columns: np.ndarray

    def margins(self, part: pa.RecordBatch, weights) -> list[np.ndarray]:
        rows, places = _meta_view(part, self.columns)
        odds = [_text_view(part, self.n_words) @ weights[0], np.bincount(rows, weights[1][places], minlength=part.num_rows)]
        return [np.clip(z, -30, 30) for z in odds]


def _told(teacher_odds: np.ndarray) -> np.ndarray:
    """Pseudo-labels 0 and 1; -1 where the teacher is not sure."""
    p = sigmoid(teacher_odds)
    return np.where(p >= CONFIDENT, 1, np.where(1 - p >= CONFIDENT, 0, -1))


def told_counts(features: DataFrame, views: Views, weights) -> np.ndarray:
    """How many unlabelled rows are told 0 and 1, to the text view and to the metadata view."""

    def count(batches):
        for part in batches:
            told = [_told(z) for z in reversed(views.margins(part, weights))]
            yield pa.RecordBatch.from_pydict({f"n{k}{c}": pa.array([int((t == c).sum())], pa.int64()) for k, t in enumerate(told) for c in (0, 1)})

    names = ["n00", "n01", "n10", "n11"]
    counts = features.filter("free").mapInArrow(count, ", ".join(f"{n} long" for n in names))
    row = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).first()
    return np.array(row, np.float64).reshape(2, 2)


def _moments(margin, y, weight):
    """Loss, and the factors of a row in the gradient and the curvature."""
    p = sigmoid(np.clip(margin, -30, 30))
    return float((weight * (np.logaddexp(0, margin) - y * margin)).sum()), weight * (p - y), weight * p * (1 - p)


def told_sums(features: DataFrame, views: Views, teachers, told_weights: np.ndarray, weights) -> list[np.ndarray]:
    """For each view a matrix of the summed curvature, with the gradient and (in the first row) the loss as last columns."""
    sizes = [len(w) for w in weights]

    def add(batches):
        sums = [np.zeros((n, n + 2)) for n in sizes]
        for part in batches:
            told = [_told(z) for z in reversed(views.margins(part, teachers))]
            each = [np.where(t >= 0, w[np.maximum(t, 0)], 0.0) for t, w in zip(told, told_weights, strict=True)]
            x = _text_view(part, views.n_words)
            loss, first, second = _moments(x @ weights[0], told[0] == 1, each[0])
            sums[0] += np.c_[(x * second[:, None]).T @ x, x.T @ first, np.r_[loss, np.zeros(sizes[0] - 1)]]
            rows, places = _meta_view(part, views.columns)
            margin = np.bincount(rows, weights[1][places], minlength=part.num_rows)
            loss, first, second = _moments(margin, told[1] == 1, each[1])
            n, counts = sizes[1], np.bincount(rows, minlength=part.num_rows)
            # Each one of a row meets all ones of the row.
            left = np.repeat(np.arange(len(rows)), counts[rows])
            starts = np.cumsum(counts) - counts
            right = np.arange(len(left)) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows]) + starts[rows[left]]
            curve = np.bincount(places[left] * n + places[right], second[rows[left]], minlength=n * n).reshape(n, n)
            gradient = np.bincount(places, first[rows], minlength=n)
            sums[1] += np.c_[curve, gradient, np.r_[loss, np.zeros(n - 1)]]
        for k, matrix in enumerate(sums):
            for at in range(0, len(matrix), _MATRIX_ROWS):
                block = pa.array([matrix[at : at + _MATRIX_ROWS].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), block], names=["view", "at", "block"])

    def total(table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(b, np.float64) for b in table.column("block").to_pylist()]
        return pa.table({**{c: table.column(c).slice(0, 1) for c in ("view", "at")}, "block": pa.array([sum(blocks).tobytes()], pa.binary())})

    schema = "view int, at int, block binary"
    got = features.filter("free").mapInArrow(add, schema).groupBy("view", "at").applyInArrow(total, schema).collect()
    out = [np.zeros((n, n + 2)) for n in sizes]
    for row in got:
        block = np.frombuffer(row.block, np.float64).reshape(-1, sizes[row.view] + 2)
        out[row.view][row.at : row.at + len(block)] = block
    return out


def fit_views(own, penalties, start, told, rounds: int = 25) -> list[np.ndarray]:
    """Newton steps of both views at once; ``own`` has (x, y, weight) of their labelled rows, ``told`` the sums of the others."""

    def evaluate(weights):
        out = []
        for (x, y, weight), penalty, w, more in zip(own, penalties, weights, told(weights), strict=True):
            loss, first, second = _moments(x @ w, y, weight)
            curve = (x * second[:, None]).T @ x + np.diag(penalty) + more[:, :-2]
            out.append((loss + float((penalty * w * w).sum()) / 2 + more[0, -1], x.T @ first + penalty * w + more[:, -2], curve))
        return out

    weights = [w.copy() for w in start]
    now = evaluate(weights)
    sizes = [1.0, 1.0]
    for _ in range(rounds):
        if not any(sizes):
            break
        trial = [w - size * np.linalg.solve(curve, gradient) for w, size, (_, gradient, curve) in zip(weights, sizes, now, strict=True)]
        for k, then in enumerate(evaluate(trial)):
            gain = now[k][0] - then[0]
            if sizes[k] and gain >= 0:
                sizes[k] = 1.0 if gain > 1e-7 * abs(now[k][0]) else 0.0
                weights[k], now[k] = trial[k], then
            elif sizes[k]:
                sizes[k] = sizes[k] / 2 if sizes[k] > 1e-4 else 0.0
    return weights


@dataclass
class CoTrained:
    views: Views
    weights: list[np.ndarray]
    #: (slope, offset) that calibrates each view's log-odds.
    calibration: tuple[tuple[float, float], tuple[float, float]]
    combiner: Logistic

    def score(self, part: pa.RecordBatch) -> np.ndarray:
        """Three columns: calibrated text and metadata scores, and the combined score."""
        odds = self.views.margins(part, self.weights)
        calibrated = np.array([a * z + b for (a, b), z in zip(self.calibration, odds, strict=True)]).T
        return np.c_[sigmoid(calibrated), sigmoid(self.combiner.log_odds(calibrated))]


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    fit = fit_logistic(z[:, None], y)
    slope = float(fit.weights[0] / fit.scale[0])
    return slope, float(fit.bias - slope * fit.mean[0])


def _told_weights(counts: np.ndarray, n_labelled: int) -> np.ndarray:
    """Weight of one row of each pseudo-label: both weigh the same in all, and at most half the labelled rows."""
    most = [min([n_labelled / 2, *view[view > 0]]) for view in counts]
    return np.array(most)[:, None] / np.maximum(counts, 1)


def co_train(labelled: DataFrame, features_with) -> tuple[CoTrained, DataFrame] | None:
    """The model, and the narrow features ``features_with(vocabulary)`` of all rows.

    None if one of the classes is missing in the training or the calibration rows.
    """
    if labelled.isEmpty():
        return None
    vocabulary = telling_words(labelled)
    rows, x, m = _features_of(labelled, vocabulary)
    y = rows.column("good").to_numpy().astype(np.int64)
    held = np.arange(len(y)) % _HOLD_OUT == 0
    if any(len(set(y[side])) < 2 for side in (held, ~held)):
        return None
    features = features_with(vocabulary)
    # Buckets that all rows together have often enough are features.
    n_rows = features.count()
    buckets = features.select(F.explode("meta").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    buckets = sorted(buckets.filter(F.col("n") >= MIN_WORD_DOCS).collect())
    columns = np.array([row.bucket for row in buckets], np.int64)
    share = np.array([row.n for row in buckets], np.float64) / n_rows
    views = Views(len(vocabulary), columns)
    both = [np.c_[view, np.ones(len(y))] for view in (x, m[:, columns].astype(np.float64))]
    scales = [x[~held].std(axis=0), np.sqrt(share * (1 - share))]
    # Ridge on standardised features, the bias hardly.
    penalties = [np.r_[np.where(scale < 1e-9, 1, scale) ** 2, 1e-6] for scale in scales]
    good = y[~held]
    weight = np.where(good == 1, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    own = [(view[~held], good, weight) for view in both]
    nothing = [np.zeros((len(p), len(p) + 2)) for p in penalties]
    weights = fit_views(own, penalties, [np.zeros(len(p)) for p in penalties], lambda _: nothing)
    for _ in range(ROUNDS):
        teachers, counts = weights, told_counts(features, views, weights)
        if not counts.any():
            break
        each = _told_weights(counts, len(good))
        weights = fit_views(own, penalties, teachers, lambda w, t=teachers, e=each: told_sums(features, views, t, e, w))
    z = [np.clip(view[held] @ w, -30, 30) for view, w in zip(both, weights, strict=True)]
    calibration = tuple(_platt(v, y[held]) for v in z)
    calibrated = np.array([a * v + b for (a, b), v in zip(calibration, z, strict=True)]).T
    return CoTrained(views, weights, calibration, fit_logistic(calibrated, y[held])), features


_SCORES = "doc_id long, text_score double, metadata_score double, score double"


def quality_scores(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, text_score, metadata_score, score, kept for each row of ``docs``.

    Only narrow rows meet labels and pages; training and scoring read their table.
    """
    rows, marked = own_metadata(docs), _marked(labels)
    trained = co_train(_sample(rows, marked, pages), lambda vocabulary: narrow_features(rows, marked, pages, vocabulary))
    if trained is None:
        half = [F.lit(0.5).alias(c) for c in ("text_score", "metadata_score", "score")]
        return rows.select("doc_id", *half).withColumn("kept", F.col("score") >= KEEP)
    model, features = trained

    def score(batches):
        for part in batches:
            scores = model.score(part)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(scores[:, k], pa.float64()) for k in range(3)]],
                names=["doc_id", "text_score", "metadata_score", "score"],
            )

    return features.mapInArrow(score, _SCORES).withColumn("kept", F.col("score") >= KEEP)
