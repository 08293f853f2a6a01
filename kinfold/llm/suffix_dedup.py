"""Substring dedup by a sparse suffix array.

A byte is removed if a ``WIDTH``-byte string that covers it also starts in a document with a smaller doc_id. A suffix array
of all bytes would be many times the text; here only suffixes that can matter are made (see ``repeats``): those of
windows whose anchor occurs in two documents, one copy of each distinct run of windows. These suffixes are
range-partitioned by sampled splitters on their leading tokens (the 24 bytes at the anchor, as three 64-bit numbers in
byte order), so equal windows fall into one range. Each bucket sorts its windows by multikey quicksort: eight bytes at
a time, going on only among ties. Equal windows stand side by side then, and the least doc_id among them decides. An anchor
with very many runs may straddle splitters, as ties are broken by the run; the first and the last anchor of each bucket
are therefore compared across boundaries, by an aggregation of their windows.

Runs that repeat as a whole are settled by their class alone: in documents above the least that has the run, all
windows are removed.

Defined cases: null texts are empty; fewer than ``WIDTH`` bytes never lose any. Rows of one doc_id do not remove each other; rows
without a doc_id lose nothing. An empty table gives an empty result. Cuts may fall inside a UTF-8 character: ``repeat_digests`` hashes the bytes;
``remove_repeats`` drops what is left of a cut character from the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import arrays as A
from kinfold.llm import repeats
from kinfold.sources.scratch import drop, materialize

WIDTH, K = 50, 24
KIND = repeats.Kind(WIDTH, K, True, repeats.byte_symbols(WIDTH))
RUN = repeats.RUN
FLUSH_BYTES = 4 << 20
_SIGN = np.uint64(1 << 63)
LEADS = ["lead_a", "lead_b", "lead_c"]
_SUFFIX = "lead_a long, lead_b long, lead_c long, anchor long, run long, doc_id long, n int, bytes binary"


def multikey_ties(keys: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, group): the suffixes that equal another one in their first ``width`` bytes, and a number per group.

    ``keys`` has eight bytes from each place on, as a number in byte order. Multikey quicksort on 64-bit symbols: each
    level sorts by the next symbol within the ties of the last, and drops what has no tie left.
    """
    members = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for at in [*range(0, width - 8, 8), width - 8]:
        symbol = keys[starts[members] + at]
        order = np.lexsort((symbol, group))
        members, group, symbol = members[order], group[order], symbol[order]
        new = np.r_[True, (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])][: len(members)]
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        members, group = members[tied], group[tied]
    return members, group


def _suffixes(batches):
    """One row per distinct run: its bytes, and the anchor's bytes as leading tokens."""
    for part, texts in A.text_slices(batches):
        symbols = KIND.symbols(texts)
        columns, owner = repeats.place_columns(part)
        starts = texts.bounds[owner] + columns["start"]
        n = columns["n"].astype(np.int64)
        # The anchor's place: where the run's gram hash is the anchor's.
        grams = symbols.grams.view(np.int64)
        at = starts.copy()
        left = np.flatnonzero(grams[at] != columns["anchor"]) if len(at) else at
        while len(left):
            at[left] += 1
            left = left[grams[at[left]] != columns["anchor"][left]]
        tokens = np.ascontiguousarray(A.eights(texts.data)).byteswap()
        leads = [(tokens[at + k] ^ _SIGN).view(np.int64) for k in (0, 8, 16)]
        ends = starts + n - 1 + WIDTH
        raw = [texts.data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        doc_ids = part.column("doc_id").to_numpy(zero_copy_only=False)[owner]
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.array(lead, pa.int64()) for lead in leads],
                *[pa.array(columns[c], pa.int64()) for c in RUN],
                pa.array(doc_ids, pa.int64()),
                pa.array(n, pa.int32()),
                pa.array(raw, pa.binary()),
            ],
            names=[*LEADS, *RUN, "doc_id", "n", "bytes"],
        )


_SORTED = "anchor long, run long, mask long, meeting int, edges binary"
_EDGE = np.dtype([("window", "<u8"), ("doc_id", "<i8"), ("anchor", "<i8"), ("run", "<i8"), ("bit", "<i8")])


def _bucket_rows(rows: pa.Table, mask: np.ndarray) -> pa.RecordBatch:
    columns = [*[rows.column(c).combine_chunks() for c in RUN], pa.array(mask, pa.int64())]
    nothing = [pa.nulls(rows.num_rows, kind) for kind in (pa.int32(), pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, *nothing], names=[*RUN, "mask", "meeting", "edges"])


def _edge_rows(edges: np.ndarray, n_meetings: int) -> pa.RecordBatch:
    """Windows of a bucket's outer anchors in one row per meeting; equal windows meet."""
    meeting = (edges["window"] % np.uint64(n_meetings)).astype(np.int32)
    order = np.argsort(meeting, kind="stable")
    meeting, edges = meeting[order], edges[order]
    cuts = np.flatnonzero(np.r_[True, meeting[1:] != meeting[:-1]]) if len(edges) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(edges)]
    nothing = [pa.nulls(len(cuts), pa.int64()) for _ in range(3)]
    packed = [edges[i:j].tobytes() for i, j in zip(cuts, ends, strict=False)]
    columns = [*nothing, pa.array(meeting[cuts], pa.int32()), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[*RUN, "mask", "meeting", "edges"])


def _windows(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, row, bit) of all windows in the rows' bytes."""
    raw = rows.column("bytes").to_pylist()
    data = np.frombuffer(b"".join(raw) + bytes(A.PAD), np.uint8)
    begins = np.cumsum([0, *map(len, raw)])[:-1].astype(np.int64)
    n = rows.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(raw)), n)
    starts = A.ramps(begins, n)
    return data, starts, row, starts - begins[row]


def _sorted_masks(rows: pa.Table, with_edges: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(mask, edges): bits of the windows that a smaller document among the rows has; and, if wanted, the windows of the
    least document among the rows, which a smaller document elsewhere may have."""
    data, starts, row, bit = _windows(rows)
    keys = np.ascontiguousarray(A.eights(data)).byteswap()
    members, group = multikey_ties(keys, starts, WIDTH)
    mask = np.zeros(rows.num_rows, np.int64)
    docs = rows.column("doc_id").to_numpy()
    settled = np.zeros(len(starts), bool)
    if len(members):
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        own = docs[row[members]]
        least = np.repeat(np.minimum.reduceat(own, cuts), np.diff(np.r_[cuts, len(group)]))
        later = members[own > least]
        np.bitwise_or.at(mask, row[later], np.int64(1) << bit[later])
        settled[later] = True
    if not with_edges:
        return mask, np.zeros(0, _EDGE)
    left = np.flatnonzero(~settled)
    edges = np.zeros(len(left), _EDGE)
    whole = A.Texts(data, np.array([0, len(data) - A.PAD], np.int64))
    edges["window"] = KIND.symbols(whole).windows[starts[left]]
    edges["bit"] = bit[left]
    for name, values in (("doc_id", docs), ("anchor", rows.column("anchor").to_numpy()), ("run", rows.column("run").to_numpy())):
        edges[name] = values[row[left]]
    return mask, edges


def _sort_bucket(batches: Iterator[pa.RecordBatch], n_meetings: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range. Whole anchors are sorted together; of the first and last, windows also go out as edges."""
    held: list[pa.RecordBatch] = []
    first: int | None = None

    def split(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, first
        anchors = table.column("anchor").to_numpy()
        first = anchors[0] if first is None else first
        tail = anchors == anchors[-1]
        edge = (anchors == first) | (tail if last else False)
        inner = ~edge if last else ~edge & ~tail
        for wanted, outer in ((edge, True), (inner, False)):
            if wanted.any():
                rows = table.filter(pa.array(wanted))
                mask, edges = _sorted_masks(rows, outer)
                yield _bucket_rows(rows, mask)
                if outer:
                    yield _edge_rows(edges, n_meetings)
        rest = ~edge & tail
        held = [] if last or not rest.any() else table.filter(pa.array(rest)).to_batches()

    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= FLUSH_BYTES:
            table = pa.Table.from_batches(held)
            anchors = table.column("anchor").to_numpy()
            if anchors[0] != anchors[-1] or anchors[0] == first:
                yield from split(table, False)
    if held and sum(b.num_rows for b in held):
        yield from split(pa.Table.from_batches(held), True)


def _meet(table: pa.Table) -> pa.Table:
    """Across boundaries: bits of the edges whose window a smaller document has in another bucket."""
    edges = np.frombuffer(b"".join(table.column("edges").to_pylist()), _EDGE)
    order = np.argsort(edges["window"], kind="stable")
    edges = edges[order]
    cuts = np.flatnonzero(np.r_[True, edges["window"][1:] != edges["window"][:-1]])
    least = np.repeat(np.minimum.reduceat(edges["doc_id"], cuts), np.diff(np.r_[cuts, len(edges)]))
    later = edges[edges["doc_id"] > least]
    columns = [later["anchor"], later["run"], np.int64(1) << later["bit"]]
    return pa.table({name: pa.array(np.ascontiguousarray(c), pa.int64()) for name, c in zip((*RUN, "mask"), columns, strict=True)})


def window_masks(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchor, run, mask): windows of the class's first document that a smaller document has; and the table behind it."""
    shared = repeats.shared_anchors(classes)
    suffixes = repeats.at_places(docs, classes.join(shared, "anchor", "left_semi"), _suffixes, _SUFFIX)
    ranged = suffixes.repartitionByRange(*LEADS, "run").sortWithinPartitions(*LEADS, "anchor")
    n_meetings = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = materialize(ranged.mapInArrow(lambda batches: _sort_bucket(batches, n_meetings), _SORTED), "suffix-buckets")
    drop(shared)
    inner = buckets.filter("edges IS NULL AND mask <> 0").select(*RUN, "mask")
    # Each bucket sends a window of its outer anchors once, so a meeting grows with buckets, not with copies.
    met = buckets.filter("edges IS NOT NULL").select("meeting", "edges").groupBy("meeting")
    outer = met.applyInArrow(_meet, "anchor long, run long, mask long")
    return inner.unionByName(outer).groupBy(*RUN).agg(F.bit_or("mask").alias("mask")), buckets


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, runs): the removed windows of each document."""
    found = repeats.occurrences(docs, KIND)
    classes = repeats.run_classes(found)
    masks, buckets = window_masks(docs, classes)
    settled = classes.join(masks.withColumnRenamed("mask", "own_mask"), RUN, "left").select(*RUN, F.col("doc_id").alias("least"), "own_mask", "copies")
    settled = materialize(settled.filter("copies > 1 OR own_mask <> 0"), "settled-runs")
    drop(classes, buckets)
    mask = F.when(F.col("doc_id") > F.col("least"), repeats.full_mask()).otherwise(F.coalesce("own_mask", F.lit(0)))
    removed = materialize(repeats.covers(found, settled, mask), "removed-runs")
    drop(found, settled)
    return removed


def _digests(batches):
    for part, texts in A.text_slices(batches):
        gone = repeats.covered_places(part, texts.bounds, WIDTH)
        removed = A.sums(gone, texts.bounds)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        starts = texts.bounds[:-1][texts.bounds[:-1] < texts.bounds[1:]]
        begins[starts] = gone[starts]
        shas = []
        for i in range(len(texts)):
            own = texts.data[texts.bounds[i] : texts.bounds[i + 1]]
            kept = own[~gone[texts.bounds[i] : texts.bounds[i + 1]]] if removed[i] else own
            shas.append(hashlib.sha256(kept.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                *[pa.array(c, pa.int64()) for c in (np.diff(texts.bounds), removed, A.sums(begins, texts.bounds))],
                pa.array(shas, pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``."""
    rows = repeats.keyed(docs).join(repeated_bytes(docs).hint("merge"), ["doc_id", "tie"], "left")
    return rows.mapInArrow(
        _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with repeated bytes cut out; a text without any stays as it is."""

    def cut(batches):
        for part, texts in A.text_slices(batches):
            gone = repeats.covered_places(part, texts.bounds, WIDTH)
            removed = A.sums(gone, texts.bounds)
            new = part.column("text").to_pylist()
            for i in np.flatnonzero(removed):
                a, b = texts.bounds[i], texts.bounds[i + 1]
                new[i] = texts.data[a:b][~gone[a:b]].tobytes().decode(errors="ignore")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(new, pa.string())], names=["doc_id", "text"])

    rows = repeats.keyed(docs).join(repeated_bytes(docs).hint("merge"), ["doc_id", "tie"], "left")
    return rows.mapInArrow(cut, "doc_id long, text string")
