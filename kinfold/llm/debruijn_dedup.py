"""Substring dedup over a compacted de Bruijn graph of words.

The graph's edges are windows of ``WIDTH`` words, its nodes the words that two windows in a row share. Only edges that can
repeat are made at all (see ``repeats``): windows whose anchor occurs twice. Windows in a row with one anchor are a path
without a branch already; such runs are counted as one row, and single edges are told apart only where runs with one
anchor differ. ``compact_paths`` then joins repeated runs that follow each other into paths, wherever
every copy of the first goes on to the second and every copy of the second comes from the first: neither branches, and no
text begins or ends between them, so all spans of a path have one length. Every span keeps its source coordinates (doc_id,
start, n_words). ``confirmed_spans`` reads the words there again and takes the spans of a path whose words another span of
it has too, by a 128-bit digest of all the words; where a path's words differ, its runs are read and compared one by one.
Single edges inside runs that differ are told by the 64-bit hashes of their anchor and of their words.

Each word that lies in a window whose words also start anywhere else, in the same or another document, is removed.

Defined cases: null, empty and blank texts have no words; fewer than ``WIDTH`` words never lose any. An exact copy of a
document of ``WIDTH`` words or more loses all words, as its source does. Rows without a doc_id lose nothing. An empty table gives an
empty result. Extra columns pass ``remove_repeats`` by; an untouched text stays byte for byte, a cut one keeps its words and the blanks
before them.
"""

from __future__ import annotations

import hashlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import arrays as A
from kinfold.llm import repeats
from kinfold.llm.columns import plainly_named
from kinfold.sources.scratch import drop, materialize

WIDTH, K = 35, 16
KIND = repeats.Kind(WIDTH, K, False, repeats.word_symbols(WIDTH, K))
RUN = repeats.RUN


def _edges(batches):
    """Window hashes of one copy of each run."""
    for part, texts in A.text_slices(batches):
        symbols = KIND.symbols(texts)
        columns, owner = repeats.place_columns(part)
        n = columns["n"].astype(np.int64)
        windows = symbols.windows[A.ramps(symbols.first[owner] + columns["start"], n)] if len(n) else np.zeros(0, np.uint64)
        ends = np.r_[0, np.cumsum(n)].astype(np.int32)
        edges = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(windows.view(np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(columns[c], pa.int64()) for c in (*RUN, "copies")], edges], names=[*RUN, "copies", "edges"]
        )


def edge_masks(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(anchor, run, edge_mask): bits of single edges that other runs with this anchor have too; and the tables behind it."""
    shared = repeats.shared_anchors(classes)
    rows = repeats.at_places(
        docs, classes.join(shared, "anchor", "left_semi"), _edges, "anchor long, run long, copies long, edges array<long>"
    )
    edges = materialize(rows.select(*RUN, "copies", F.posexplode("edges").alias("bit", "edge")), "edges")
    drop(shared)
    again = edges.groupBy("edge").agg(F.sum("copies").alias("_n")).filter("_n > 1").select("edge")
    again = materialize(again, "repeated-edges")
    masks = edges.join(again, "edge", "left_semi").groupBy(*RUN).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("edge_mask"))
    return masks, [edges, again]


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences, classes with ``mask``), both tables; the mask tells the repeated windows of a run."""
    found = repeats.occurrences(docs, KIND)
    classes = repeats.run_classes(found)
    whole = F.when(F.col("copies") > 1, repeats.full_mask()).otherwise(F.coalesce("edge_mask", F.lit(0)))
    masks, used = edge_masks(docs, classes)
    masked = classes.join(masks, RUN, "left").withColumn("mask", whole).filter("mask <> 0")
    masked = materialize(masked.select(*RUN, "copies", "mask"), "masked-runs")
    drop(classes, *used)
    return found, masked


def whole_runs(found: DataFrame, masked: DataFrame) -> DataFrame:
    """(doc_id, tie, start, n, node, copies): occurrences of the runs that repeat as a whole; a node is a run."""
    runs = found.join(masked.filter(F.col("copies") > 1).select(*RUN, "copies"), RUN)
    return runs.select("doc_id", "tie", "start", "n", F.struct(*RUN).alias("node"), "copies")


def compact_paths(found: DataFrame, masked: DataFrame) -> DataFrame:
    """(path, doc_id, tie, start, n_words, runs): spans of nonbranching repeated paths at their source coordinates.

    Runs follow each other if one ends where the other begins. A run goes on a path if all its copies follow one run and
    all copies of that run lead to it. The path has the name of its first run. Rows that repeat with their doc_id have
    paths of single runs.
    """
    whole = whole_runs(found, masked)
    order = Window.partitionBy("doc_id", "tie").orderBy("start")
    ahead = F.lead(F.struct("node", "copies", "start")).over(order)
    steps = whole.withColumn("_next", ahead).filter(F.col("_next.start") == F.col("start") + F.col("n"))
    steps = steps.groupBy("node", "copies", F.col("_next.node").alias("_to"), F.col("_next.copies").alias("_to_copies"))
    links = steps.agg(F.count("*").alias("_n")).filter("_n = copies AND _n = _to_copies")
    inner = materialize(links.select(F.col("_to").alias("node"), F.lit(0).alias("_begins")), "inner-runs")
    on_path = whole.join(inner, "node", "left").withColumn("_begins", F.coalesce("_begins", F.lit(1)))
    span = F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = on_path.withColumn("_span", span).groupBy("doc_id", "tie", "_span")
    return spans.agg(
        F.min_by("node", "start").alias("path"),
        F.min("start").alias("start"),
        (F.max(F.col("start") + F.col("n")) - F.min("start") + WIDTH - 1).alias("n_words"),
        F.count("*").alias("runs"),
    ).select("path", "doc_id", "tie", "start", "n_words", "runs")


def _read_spans(batches):
    """A digest of the words of each span, joined by one space."""
    for part, texts in A.text_slices(batches):
        words = A.words_of(texts, A.NOT_BLANK)
        lists = part.column("places")
        flat = lists.flatten()
        owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        starts, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n_words"))
        first = starts + words.first[owner]
        last = first + n - 1
        odd = (words.starts[1:] - words.ends[:-1] != 1) | (texts.data[words.ends[:-1]] != ord(" "))
        odd = np.r_[0, np.cumsum(odd)]
        digests = []
        for a, b, plain in zip(first.tolist(), last.tolist(), odd[first] == odd[last], strict=True):
            if plain:
                raw = texts.data[words.starts[a] : words.ends[b]].tobytes()
            else:
                raw = b" ".join(texts.data[words.starts[w] : words.ends[w]].tobytes() for w in range(a, b + 1))
            digests.append(hashlib.blake2b(raw, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [
                flat.field("path"),
                part.column("doc_id").take(pa.array(owner)),
                part.column("tie").take(pa.array(owner)),
                flat.field("start"),
                flat.field("n_words"),
                pa.array(digests, pa.binary()),
            ],
            names=["path", "doc_id", "tie", "start", "n_words", "digest"],
        )


_READ = "path struct<anchor: bigint, run: bigint>, doc_id long, tie long, start long, n_words long, digest binary"


def confirmed_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans with their ``digest``, the path and digest of those whose words no other span of the path has), both tables."""
    places = spans.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("path", "start", "n_words")).alias("places"))
    read = repeats.keyed(docs).join(places.hint("merge"), ["doc_id", "tie"]).mapInArrow(_read_spans, _READ)
    read = materialize(read, "read-spans")
    alone = read.groupBy("path", "digest").agg(F.count("*").alias("_n")).filter("_n = 1").select("path", "digest")
    return read, materialize(alone, "unlike-spans")


def _repeated_spans(docs: DataFrame, found: DataFrame, masked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, tie, start, n_words) of paths and, where a path's words differ, of their runs; and the tables behind them."""
    read, alone = confirmed_spans(docs, compact_paths(found, masked))
    used = [read, alone]
    parts = [read.join(alone, ["path", "digest"], "left_anti")]
    if not alone.isEmpty():
        whole = whole_runs(found, masked)
        unlike = read.join(alone, ["path", "digest"], "left_semi")
        unlike = unlike.select("doc_id", "tie", F.col("start").alias("_from"), (F.col("start") + F.col("n_words")).alias("_to"))
        nodes = whole.join(unlike, ["doc_id", "tie"]).filter("start >= _from AND start < _to").select("node").distinct()
        runs = whole.join(nodes, "node", "left_semi")
        runs = runs.select(F.col("node").alias("path"), "doc_id", "tie", "start", (F.col("n") + WIDTH - 1).cast("long").alias("n_words"))
        read, alone = confirmed_spans(docs, runs)
        used += [read, alone]
        parts.append(read.join(alone, ["path", "digest"], "left_anti"))
    spans = [part.select("doc_id", "tie", "start", "n_words") for part in parts]
    return reduce(DataFrame.unionByName, spans), used


def repeated_words(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, spans): the removed spans of a document as (start, n_words), from its paths and its single edges."""
    found, masked = repeated_runs(docs)
    paths, used = _repeated_spans(docs, found, masked)
    # A path of n words stands for its n - WIDTH + 1 windows.
    paths = paths.select("doc_id", "tie", F.struct("start", F.col("n_words").cast("int").alias("n")).alias("span"))
    single = found.join(masked.filter(F.col("copies") == 1), RUN).select(
        "doc_id", "tie", F.explode(F.expr("filter(sequence(0, n - 1), i -> (shiftright(mask, i) & 1) = 1)")).alias("i"), "start"
    )
    single = single.select(
        "doc_id", "tie", F.struct((F.col("start") + F.col("i")).alias("start"), F.lit(WIDTH).alias("n")).alias("span")
    )
    spans = paths.unionByName(single).groupBy("doc_id", "tie").agg(F.collect_list("span").alias("spans"))
    spans = materialize(spans, "removed-spans")
    drop(found, masked, *used)
    return spans


def _removed(part: pa.RecordBatch, words: A.Words) -> np.ndarray:
    lists = part.column("spans")
    flat = lists.flatten()
    if not len(flat):
        return np.zeros(len(words), bool)
    lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    owner = np.repeat(np.arange(part.num_rows), lengths)
    starts = flat.field("start").to_numpy(zero_copy_only=False) + words.first[owner]
    return A.covered(len(words), starts, flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64))


def _digests(batches):
    for part, texts in A.text_slices(batches):
        words = A.words_of(texts, A.NOT_BLANK)
        gone = _removed(part, words)
        shas = []
        for i in range(len(texts)):
            own = range(words.first[i], words.first[i + 1])
            if gone[words.first[i] : words.first[i + 1]].all():
                kept = b""
            else:
                kept = b" ".join(texts.data[words.starts[w] : words.ends[w]].tobytes() for w in own if not gone[w])
            shas.append(hashlib.sha256(kept).hexdigest())
        removed = A.sums(gone, words.first)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas)],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs``."""
    rows = repeats.keyed(docs).join(repeated_words(docs).hint("merge"), ["doc_id", "tie"], "left")
    return rows.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut(batches, columns: list[str]):
    for part, texts in A.text_slices(batches):
        words = A.words_of(texts, A.NOT_BLANK)
        gone = _removed(part, words)
        removed = A.sums(gone, words.first)
        old = part.column("text").to_pylist()
        new = []
        for i, text in enumerate(old):
            if not removed[i]:
                new.append(text)
                continue
            a, b = words.first[i], words.first[i + 1]
            # Each kept word with the blanks before it; the text's own end goes with its last word.
            begins = np.r_[texts.bounds[i], words.ends[a : b - 1]]
            stay = np.flatnonzero(~gone[a:b])
            pieces = [texts.data[begins[w] : words.ends[a + w]].tobytes() for w in stay]
            tail = texts.data[words.ends[b - 1] : texts.bounds[i + 1]].tobytes() if len(stay) and not gone[b - 1] else b""
            new.append((b"".join(pieces) + tail).decode())
        arrays = {"text": pa.array(new, pa.string())}
        yield pa.RecordBatch.from_arrays([arrays.get(c, part.column(c)) for c in columns], names=columns)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words cut out of ``text``; every row stays, a text may become empty."""
    rows = plainly_named(docs, "doc_id", "text")
    tied = rows.withColumn("tie", repeats.tie_of()).join(repeated_words(docs).hint("merge"), ["doc_id", "tie"], "left")
    return tied.mapInArrow(partial(_cut, columns=rows.columns), rows.schema).toDF(*docs.columns)
