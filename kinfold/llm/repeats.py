"""Finding windows of text that occur again elsewhere, without a row per window.

A window is ``width`` neighbouring symbols (words or bytes). Its anchor is the leftmost of its ``k``-symbol grams with the
least hash, so equal windows have equal anchors at equal places. Neighbouring windows with one anchor form a run (a
super-k-mer). Steps, shared by the two operators that remove repeats:

1. ``repeated_anchors``: tasks collect the anchors of blocks of documents, drop what repeats inside the block (that is
   known to repeat), and send each anchor once as a 39-bit print to the bucket of its hash, marked by one more bit if it
   is known. A bucket finds prints
   of more than one document (or place) and returns them by document. A hot anchor costs one print per block.
2. ``occurrences``: the documents meet their returned prints; each run with such an anchor becomes a row
   (anchor, run, doc_id, tie, start, n). Prints that clash by chance only make a few rows too many.
3. ``run_classes``: equal runs are aggregated. Equal runs repeat as a whole. Runs that share an anchor but differ may share
   some windows: the operators compare these, one copy of each run.
4. ``covers``: the windows found, as bit masks over runs, go back to every occurrence and to the documents.

Grams, windows and runs are compared by 64-bit hashes. A run is told by the hash of its anchor and by that of its own
symbols, so only a clash among runs of one anchor could join what differs.

Rows are told by doc_id, which may be any number, and a 64-bit hash of their text and its length (``tie``), so rows of one
doc_id may differ or repeat. Rows without a doc_id neither lose anything nor make others lose it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import arrays as A
from kinfold.sources.scratch import materialize

BLOCK_ANCHORS = 1 << 20
BUCKET_BYTES = 48 << 20
_PRINT_SHIFT = np.uint64(25)
_ONE = np.uint64(1)
_PLACE_BITS = np.uint64(22)
_CHUNK = 1 << 18


@dataclass
class Symbols:
    """Symbols of some documents: gram and window hashes at each place, and the places at which documents begin."""

    first: np.ndarray
    grams: np.ndarray
    windows: np.ndarray


@dataclass(frozen=True)
class Kind:
    """What a window is made of. ``across_documents``: only repeats in another document count."""

    width: int
    k: int
    across_documents: bool
    symbols: Callable[[A.Texts], Symbols]


def word_symbols(width: int, k: int) -> Callable[[A.Texts], Symbols]:
    def symbols(texts: A.Texts) -> Symbols:
        words = A.words_of(texts, A.NOT_BLANK)
        hashes = A.hash_spans(texts.data, words.starts, words.ends)
        return Symbols(words.first, A.window_hashes(hashes, k), A.window_hashes(hashes, width))

    return symbols


def byte_symbols(width: int) -> Callable[[A.Texts], Symbols]:
    """Grams of 24 bytes: long enough that few of them recur by chance."""

    def symbols(texts: A.Texts) -> Symbols:
        n = texts.size
        eight = A.eights(texts.data)
        own = A.mix(eight[: n + A.PAD - 32])
        g = A.join_hash(A.join_hash(own[:-16], own[8:-8]), own[16:])
        m = n - width + 1
        windows = np.zeros(0, np.uint64)
        if m > 0:
            windows = A.join_hash(A.join_hash(g[:m], g[24 : 24 + m]), g[width - 24 : width - 24 + m])
        return Symbols(texts.bounds, g[: max(n - 23, 0)], windows)

    return symbols


@dataclass
class Runs:
    """Runs of windows with one anchor; starts and anchors are places among all symbols."""

    starts: np.ndarray
    counts: np.ndarray
    anchors: np.ndarray
    docs: np.ndarray


def runs_of(kind: Kind, symbols: Symbols) -> Runs:
    at = A.window_starts(symbols.first, kind.width)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return Runs(empty, empty, empty, empty)
    w = kind.width - kind.k + 1
    low = np.uint64((1 << int(_PLACE_BITS)) - 1)
    anchors = np.zeros(len(at), np.int64)
    n = len(symbols.grams)
    for start in range(0, n, _CHUNK):
        a, b = np.searchsorted(at, [start, start + _CHUNK])
        if a == b:
            continue
        grams = symbols.grams[start : start + _CHUNK + w - 1]
        keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        if span < w:
            keys = np.minimum(keys[: len(keys) - (w - span)], keys[w - span :])
        anchors[a:b] = (keys[at[a:b] - start] & low).astype(np.int64) + start
    cuts = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)])
    starts = at[cuts]
    docs = np.searchsorted(symbols.first, starts, side="right") - 1
    return Runs(starts, np.diff(np.r_[cuts, len(at)]), anchors[cuts], docs)


def run_hashes(symbols: Symbols, runs: Runs) -> np.ndarray:
    """A run has fewer windows than a window has symbols, so its first and last window hold all its symbols."""
    last = symbols.windows[runs.starts + runs.counts - 1]
    return A.mix(A.join_hash(symbols.windows[runs.starts], last) + runs.counts.astype(np.uint64))


def _block(anchors: np.ndarray, docs: np.ndarray, across: bool):
    """(known, sent): (anchor, doc) that repeat inside the block, and one (anchor, doc, whether known) for each anchor."""
    order = np.argsort(anchors, kind="stable")
    anchors, docs = anchors[order], docs[order]
    cuts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    counts = np.diff(np.r_[cuts, len(anchors)])
    again = np.maximum.reduceat(docs, cuts) != np.minimum.reduceat(docs, cuts) if across else counts > 1
    every = np.repeat(again, counts)
    return (anchors[every], docs[every]), (anchors[cuts], docs[cuts], again)


_PRINTS = "bucket int, known boolean, prints binary, docs binary"


def _print_rows(bucket: np.ndarray, known: bool, anchors: np.ndarray, docs: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
    """One row per bucket; prints and marks as five bytes each, documents in ascending order beside them."""
    order = np.lexsort((docs, bucket))
    prints = (anchors >> _PRINT_SHIFT) << _ONE | marks.astype(np.uint64)
    bucket, prints, docs = bucket[order], prints[order], docs[order]
    raw = prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(bucket)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cuts], pa.int32()),
            pa.array(np.full(len(cuts), known), pa.bool_()),
            pa.array([raw[a:b].tobytes() for a, b in zip(cuts, ends, strict=False)], pa.binary()),
            pa.array([docs[a:b].astype("<i8").tobytes() for a, b in zip(cuts, ends, strict=False)], pa.binary()),
        ],
        names=["bucket", "known", "prints", "docs"],
    )


def _sent(batches: Iterator[pa.RecordBatch], kind: Kind, n_buckets: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    blocks = 0

    def flush():
        nonlocal blocks
        anchors, docs = (np.concatenate(c) for c in zip(*held, strict=True))
        (known, known_docs), (once, once_docs, again) = _block(anchors, docs, kind.across_documents)
        # What is known needs no meeting and is dealt by document, so a hot anchor does not gather.
        spread = (A.mix(known_docs.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
        yield _print_rows(spread, True, known, known_docs, np.ones(len(known), bool))
        yield _print_rows((once % np.uint64(n_buckets)).astype(np.int32), False, once, once_docs, again)
        blocks += 1

    for part, texts in A.text_slices(batches):
        symbols = kind.symbols(texts)
        runs = runs_of(kind, symbols)
        if len(runs.starts):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((symbols.grams[runs.anchors], ids[runs.docs]))
        if sum(len(h[0]) for h in held) >= BLOCK_ANCHORS:
            yield from flush()
            held = []
    if held:
        yield from flush()


def _met(table: pa.Table, across: bool) -> pa.Table:
    """Prints of a bucket that more than one document (or place) has, each with its document."""

    def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(rows.column("prints").to_pylist()), np.uint8).reshape(-1, 5)
        prints = np.zeros((len(raw), 8), np.uint8)
        prints[:, :5] = raw
        docs = np.frombuffer(b"".join(rows.column("docs").to_pylist()), "<i8")
        packed = prints.view("<u8")[:, 0]
        return packed >> _ONE, docs, (packed & _ONE).astype(bool)

    flags = table.column("known").to_numpy().astype(bool)
    known, known_docs, _ = unpacked(table.filter(pa.array(flags)))
    prints, docs, marks = unpacked(table.filter(pa.array(~flags)))
    if len(prints):
        order = np.argsort(prints, kind="stable")
        prints, docs, marks = prints[order], docs[order], marks[order]
        cuts = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
        counts = np.diff(np.r_[cuts, len(prints)])
        low, high = np.minimum.reduceat(docs, cuts), np.maximum.reduceat(docs, cuts)
        again = ((low != high) if across else (counts > 1)) | np.logical_or.reduceat(marks, cuts)
        found = np.repeat(again, counts) & ~marks
        prints, docs = np.concatenate([known, prints[found]]), np.concatenate([known_docs, docs[found]])
    else:
        prints, docs = known, known_docs
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "print": pa.array(prints.astype(np.int64), pa.int64())})


def repeated_anchors(docs: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, prints): prints of the anchors in a document that occur elsewhere too.

    The number of buckets follows the size of the texts, so a bucket stays within a task's memory.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) // BUCKET_BYTES + 1)
    sent = docs.select("doc_id", "text").mapInArrow(lambda batches: _sent(batches, kind, n_buckets), _PRINTS)
    met = sent.groupBy("bucket").applyInArrow(
        lambda table: _met(table, kind.across_documents), "doc_id long, print long"
    )
    return met.groupBy("doc_id").agg(F.collect_list("print").alias("prints"))


_OCCURRENCES = "anchor long, run long, doc_id long, tie long, start long, n int"


def tie_of() -> F.Column:
    return F.xxhash64("text", F.octet_length("text"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", tie_of().alias("tie"))


def _occurring(batches, kind: Kind):
    for part, texts in A.text_slices(batches):
        symbols = kind.symbols(texts)
        runs = runs_of(kind, symbols)
        prints = (symbols.grams[runs.anchors] >> _PRINT_SHIFT).astype(np.int64)
        lists = part.column("prints")
        wanted = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        salt = A.mix(np.arange(1, part.num_rows + 1, dtype=np.uint64))
        keys = np.sort(wanted.astype(np.uint64) + salt[owner])
        own = prints.astype(np.uint64) + salt[runs.docs]
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        keep = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        runs = Runs(runs.starts[keep], runs.counts[keep], runs.anchors[keep], runs.docs[keep])
        run = run_hashes(symbols, runs)
        ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(symbols.grams[runs.anchors].view(np.int64), pa.int64()),
                pa.array(run.view(np.int64), pa.int64()),
                pa.array(ids[runs.docs], pa.int64()),
                part.column("tie").take(pa.array(runs.docs)),
                pa.array(runs.starts - symbols.first[runs.docs], pa.int64()),
                pa.array(runs.counts, pa.int32()),
            ],
            names=["anchor", "run", "doc_id", "tie", "start", "n"],
        )


def occurrences(docs: DataFrame, kind: Kind) -> DataFrame:
    """Rows of all runs whose anchor repeats, as a table."""
    docs = docs.filter("doc_id IS NOT NULL")
    flagged = keyed(docs).join(repeated_anchors(docs, kind).hint("merge"), "doc_id")
    return materialize(flagged.mapInArrow(lambda batches: _occurring(batches, kind), _OCCURRENCES), "runs")


RUN = ["anchor", "run"]


def run_classes(found: DataFrame) -> DataFrame:
    """(anchor, run, copies, doc_id, tie, start, n): each distinct run with its number and its first place."""
    first = F.min(F.struct("doc_id", "tie", "start", "n"))
    classes = found.groupBy(*RUN).agg(F.count("*").alias("copies"), first.alias("first"))
    return materialize(classes.select(*RUN, "copies", "first.*"), "run-classes")


def shared_anchors(classes: DataFrame) -> DataFrame:
    """The anchors that more than one class has, as a table."""
    shared = classes.groupBy("anchor").agg(F.count("*").alias("_n")).filter("_n > 1").select("anchor")
    return materialize(shared, "shared-anchors")


def at_places(docs: DataFrame, classes: DataFrame, spread, schema: str) -> DataFrame:
    """Reads the first place of each class: ``spread(batches)`` sees text and ``places``, a list of class rows."""
    places = classes.groupBy("doc_id", "tie").agg(F.collect_list(F.struct(*RUN, "copies", "start", "n")).alias("places"))
    return keyed(docs).join(places.hint("merge"), ["doc_id", "tie"]).mapInArrow(spread, schema)


def place_columns(part: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns of all places of a slice, and the row that each belongs to."""
    lists = part.column("places")
    flat = lists.flatten()
    owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    return {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}, owner


def full_mask(n: str = "n") -> F.Column:
    return F.expr(f"shiftleft(1L, {n}) - 1")


def covers(found: DataFrame, masks: DataFrame, mask: F.Column) -> DataFrame:
    """(doc_id, tie, runs): runs of a document (start, n, mask) with a removed window.

    ``masks`` has one row per class, so a run with many copies is a skewed side that Spark splits.
    """
    rows = found.join(masks, RUN).withColumn("mask", mask).filter("mask <> 0")
    return rows.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n", "mask")).alias("runs"))


def covered_places(part: pa.RecordBatch, first: np.ndarray, width: int) -> np.ndarray:
    """Which symbols of a slice the windows of its ``runs`` cover."""
    lists = part.column("runs")
    steps = np.zeros(int(first[-1]) + 1, np.int32)
    flat = lists.flatten()
    if len(flat):
        lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        owner = np.repeat(np.arange(part.num_rows), lengths)
        starts = flat.field("start").to_numpy(zero_copy_only=False) + first[owner]
        n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        masks = flat.field("mask").to_numpy(zero_copy_only=False)
        whole = masks == (1 << n) - 1
        np.add.at(steps, starts[whole], 1)
        np.add.at(steps, starts[whole] + n[whole] - 1 + width, -1)
        starts, masks = starts[~whole], masks[~whole]
        for bit in range(64):
            has = masks >> bit & 1 == 1
            if has.any():
                np.add.at(steps, starts[has] + bit, 1)
                np.add.at(steps, starts[has] + bit + width, -1)
    return np.cumsum(steps[:-1]) > 0
