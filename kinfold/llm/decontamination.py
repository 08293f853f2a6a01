"""Benchmark decontamination by a broadcast set of normalised n-grams.

The windows of all benchmark items form a sorted hash set. Each task scans the token windows of its documents against
the set, looks up a small bit table first, and confirms every hit by comparing the window's words with those of the
item, so no result rests on a hash. The set is broadcast in parts of at most ``PART_BYTES`` (its size is computed
before); a larger benchmark means more parts, each a scan of the documents, joined by document. A usual benchmark is
one part and one scan without a shuffle.

Defined cases: a null or wordless text has no windows (as document: 0 hits; as item: no window). An item of fewer
words than ``width`` is one window of its length. Repeated documents are judged alike; repeated item rows of one
item_id count once. Documents' extra columns are kept by ``remove_contaminated`` and ``remove_spans``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from kinfold.llm import arrays as A
from kinfold.llm.columns import plainly_named
from kinfold.sources.scratch import materialize

WIDTH = 10
PART_BYTES = 64 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {code: code + 32 for code in range(65, 91)}
_BIT_TABLE = 20


def normalised_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(gram, size, item_ids): the distinct windows of all items as joined words, with the items that have them."""

    def grams(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = normalised_words(text)
                size = min(width, len(words))
                if size:
                    rows += [(item, " ".join(words[i : i + size]), size) for i in range(len(words) - size + 1)]
            items, texts, sizes = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())],
                names=["item_id", "gram", "size"],
            )

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows = items.mapInArrow(grams, "item_id string, gram string, size int")
    return rows.groupBy("gram", "size").agg(F.collect_set("item_id").alias("item_ids"))


class GramSet:
    """One broadcast part: windows by size, sorted by hash."""

    def __init__(self, rows: list[tuple[str, int, list[str]]]):
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, list[bytes], list[list[str]]]] = {}
        by_size = defaultdict(list)
        for gram, size, items in rows:
            by_size[size].append((gram.encode(), items))
        for size, members in by_size.items():
            data = b" ".join(gram for gram, _ in members)
            ends = np.cumsum([len(gram) + 1 for gram, _ in members])
            bounds = np.r_[0, ends].astype(np.int64)
            bounds[-1] -= 1
            texts = A.Texts(np.frombuffer(data + bytes(A.PAD), np.uint8), bounds)
            words = A.words_of(texts, A.ALNUM)
            hashes = A.window_hashes(A.hash_spans(texts.data, words.starts, words.ends), size)[words.first[:-1]]
            order = np.argsort(hashes)
            table = np.zeros(1 << _BIT_TABLE, bool)
            table[hashes >> np.uint64(64 - _BIT_TABLE)] = True
            self.sizes[size] = hashes[order], table, [members[i][0] for i in order], [members[i][1] for i in order]

    def hits(self, texts: A.Texts, words: A.Words, hashes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, list[str]]]]:
        """Which words lie in a window of the set, and (document, items) of every confirmed hit."""
        starts, widths, found = [], [], []
        for size, (known, table, grams, items) in self.sizes.items():
            at = A.window_starts(words.first, size)
            if not len(at):
                continue
            windows = A.window_hashes(hashes, size)[at]
            maybe = table[windows >> np.uint64(64 - _BIT_TABLE)]
            at, windows = at[maybe], windows[maybe]
            place = np.searchsorted(known, windows)
            place[place == len(known)] = 0
            equal = known[place] == windows
            for start, k in zip(at[equal].tolist(), place[equal].tolist(), strict=True):
                gram = b" ".join(texts.data[words.starts[i] : words.ends[i]].tobytes() for i in range(start, start + size))
                while grams[k] != gram and k + 1 < len(known) and known[k + 1] == known[k]:
                    k += 1  # another window of the same hash
                if grams[k] == gram:
                    starts.append(start)
                    widths.append(size)
                    found.append((int(np.searchsorted(words.first, start, side="right")) - 1, items[k]))
        covered = A.covered(len(words), np.array(starts, np.int64), np.array(widths, np.int64))
        return covered, found


def _parts(windows: DataFrame) -> int:
    cost = F.octet_length("gram") + F.aggregate("item_ids", F.lit(0), lambda a, x: a + F.octet_length(x) + 16) + 96
    total = windows.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
    return max(1, -(-int(total) // PART_BYTES))


_HITS = "n_words long, hit_words array<long>, items array<string>"


def _hit_columns(part: pa.RecordBatch, words: A.Words, covered: np.ndarray, found) -> list[pa.Array]:
    """Positions of hit words and sorted hit items of each document, with those of earlier parts."""
    hit = np.flatnonzero(covered)
    cuts = np.searchsorted(hit, words.first)
    places = hit - np.repeat(words.first[:-1], np.diff(cuts))
    items: list[set[str]] = [set() for _ in range(part.num_rows)]
    for doc, ids in found:
        items[doc].update(ids)
    columns = [
        pa.array(words.counts, pa.int64()),
        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(places, pa.int64())),
        pa.array([sorted(ids) for ids in items], pa.list_(pa.string())),
    ]
    if "hit_words" in part.schema.names:
        for k, name in ((1, "hit_words"), (2, "items")):
            pairs = zip(columns[k].to_pylist(), part.column(name).to_pylist(), strict=True)
            columns[k] = pa.array([sorted({*new, *old}) for new, old in pairs], columns[k].type)
    return columns


def contamination(docs: DataFrame, benchmark: DataFrame, carried: list[str], width: int = WIDTH) -> DataFrame:
    """The ``carried`` columns of each row with n_words, hit_words (positions) and items (those with occurrences).

    ``carried`` may have text, but none of the new names.
    """
    context = docs.sparkSession.sparkContext
    windows = materialize(benchmark_windows(benchmark, width), "benchmark-windows")
    n_parts = _parts(windows)
    rows = docs.select(*dict.fromkeys([*carried, "text"]))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in rows.columns}
    for i in range(n_parts):
        # At most PART_BYTES: the driver collects and broadcasts one part of the benchmark, never of the documents.
        known = windows.filter(F.pmod(F.xxhash64("gram"), F.lit(n_parts)) == i).collect()
        shared = context.broadcast([(row.gram, row.size, list(row.item_ids)) for row in known])
        kept = carried if i == n_parts - 1 else list(kinds)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, kept=kept):
            grams = GramSet(shared.value)
            for part, texts in A.text_slices(batches):
                plain = texts.map_bytes(A.LOWER)
                words = A.words_of(plain, A.ALNUM)
                hashes = A.hash_spans(plain.data, words.starts, words.ends)
                hits = _hit_columns(part, words, *grams.hits(plain, words, hashes))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], *hits], names=[*kept, "n_words", "hit_words", "items"]
                )

        rows = rows.mapInArrow(scan, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", {_HITS}")
        if i < n_parts - 1:
            rows = materialize(rows, "decontamination-part")
    return rows


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    hits = contamination(docs, benchmark, ["doc_id"])
    return hits.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns."""
    rows = plainly_named(docs, "text")
    clean = contamination(rows, benchmark, rows.columns).filter(F.size("hit_words") == 0)
    return clean.select(*rows.columns).toDF(*docs.columns)


def _without(text: str | None, hit_words: list[int]) -> str | None:
    """Cuts each run of hit words with what stands between them; the rest of the text stays as it is."""
    if not hit_words:
        return text
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    hit = set(hit_words)
    out, at = [], 0
    for i, (start, end) in enumerate(places):
        if i in hit:
            if i - 1 not in hit:
                out.append(text[at:start])
            at = end
    return "".join([*out, text[at:]])


def _cut_hits(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``rows`` without their hit words, and whether there were any, as a table."""
    hits = contamination(rows, benchmark, rows.columns)
    names = rows.columns

    def cut(batches):
        for batch in batches:
            found = batch.column("hit_words").to_pylist()
            texts = [_without(t, hit) for t, hit in zip(batch.column("text").to_pylist(), found, strict=True)]
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(hit) for hit in found], pa.bool_())], names=[*names, "_hit"])

    schema = StructType([*rows.schema, StructField("_hit", BooleanType())])
    return materialize(hits.mapInArrow(cut, schema), "spans-removed")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with hit words cut out of ``text``; other texts and columns stay. Words around a cut become
    neighbours, so rounds follow until no document has a hit (each round only shortens texts)."""
    rows = plainly_named(docs, "text")
    out, cut = [], _cut_hits(rows, benchmark)
    while not cut.filter("_hit").isEmpty():
        # Only documents that lost something can have new neighbours.
        out.append(cut.filter("NOT _hit").drop("_hit"))
        cut = _cut_hits(cut.filter("_hit").drop("_hit"), benchmark)
    out.append(cut.drop("_hit"))
    return reduce(DataFrame.unionByName, out).toDF(*docs.columns)
