"""Ranked lexical search by branch and bound over FP-trees of documents.

Only terms that some item has matter. One pass over the texts turns each document into its restricted term vector: the
items' terms that it has, with their counts. A second pass over these vectors counts documents by term; terms are
then ordered by falling frequency. The third builds one FP-tree per block of vectors in each task: a vector is a path of its terms
in that order, so documents share what their most frequent terms have in common, and a path without a branch is one
node. A node knows, for all documents below, the largest count of each term and the least length measure ``m``.
These bound an item's score from above, as scores rise with counts and fall with ``m``. The tree is searched depth first for all items at
once: an item goes on into a node only while the bound can still reach its ten best so far in the task. At a leaf the bound is the
score. A task's ten best per item then meet, so what is shuffled follows items and tasks, not documents.

The items go to the tasks in parts of at most ``ITEM_BYTES`` of text, one search over all documents each.

Scores: ``w`` = floor(1000 ln((2N+2)/(2df+1))), ``m`` = 10 + (90 n N) div L, and an item's score sums
w ((10^9 tf) div (1000 tf + 8 m)) over its distinct terms. N, L, n and df count all documents and terms of the table.

Defined cases: null, empty and unspoken texts (no term) have no vector and are in no result, be it a document or an item.
Each row is a document of its own, though ids or texts repeat; equal scores go by doc_id, a null one last. Items with equal ids are ranked
each by themselves, so ranks of such an id repeat. Empty tables give no rows. Texts are read whole. Other columns are
neither read nor returned. Words of up to eight bytes are told apart by their bytes, longer ones by a 64-bit hash and then their bytes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import arrays as A
from kinfold.sources.scratch import materialize

BEST = 10
ITEM_BYTES = 1 << 18
#: Documents of a tree, and a bound of its entries: nodes times terms.
TREE_DOCS = 1024
TREE_ENTRIES = 1 << 23

_MARKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"


class Vocabulary:
    """Numbers of words, found by hash and confirmed by bytes."""

    def __init__(self, terms: list[str]):
        raw = [term.encode() for term in terms]
        ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
        starts = ends - np.array([len(r) for r in raw], np.int64)
        self.data = np.frombuffer(b"".join(raw) + bytes(A.PAD), np.uint8)
        hashes = A.hash_spans(self.data, starts, ends)
        self.order = np.argsort(hashes)
        self.hashes, self.starts, self.sizes = hashes[self.order], starts[self.order], (ends - starts)[self.order]

    def numbers(self, texts: A.Texts, words: A.Words) -> np.ndarray:
        """The number of each word, -1 for words that are not in the vocabulary."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.hashes) or not len(words):
            return out
        hashes = A.hash_spans(texts.data, words.starts, words.ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        sizes = words.ends - words.starts
        found = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == sizes))
        mine, theirs = A.eights(texts.data), A.eights(self.data)
        doubt, place = found[sizes[found] > 8], 0
        while len(doubt):
            # Eight bytes at a time; the last eight end with the word.
            shift = np.minimum(place, sizes[doubt] - 8)
            wrong = doubt[mine[words.starts[doubt] + shift] != theirs[self.starts[at[doubt]] + shift]]
            found = np.setdiff1d(found, wrong, assume_unique=True)
            place += 8
            doubt = doubt[(sizes[doubt] > place) & ~np.isin(doubt, wrong, assume_unique=True)]
        out[found] = self.order[at[found]]
        return out


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each item that has any."""
    plain = F.translate("text", _UPPER, _LOWER)
    terms = F.array_distinct(F.filter(F.split(plain, _MARKS, -1), lambda t: t != ""))
    return items.select("item_id", terms.alias("terms")).filter("size(terms) > 0")


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, size: int) -> Iterator[pa.RecordBatch]:
    for part, texts in A.text_slices(batches):
        plain = texts.map_bytes(A.LOWER)
        words = A.words_of(plain, A.ALNUM)
        numbers = vocabulary.numbers(plain, words)
        known = np.flatnonzero(numbers >= 0)
        keys, counts = np.unique(A.owners(words.first)[known] * size + numbers[known], return_counts=True)
        rows = np.flatnonzero(words.counts)
        first = np.searchsorted(keys, np.r_[rows * size, len(texts) * size])
        ends = pa.array(first, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").take(pa.array(rows, pa.int64())),
                pa.array(words.counts[rows], pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array((keys % size).astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
            ],
            names=["doc_id", "n", "terms", "counts"],
        )


def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Documents by term; under ``size`` all documents and under ``size + 1`` their terms."""
    df = np.zeros(size + 2, np.int64)
    for batch in batches:
        df[:size] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        df[size] += batch.num_rows
        df[size + 1] += int(batch.column("n").to_numpy().sum())
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], names=["term", "n"])


@dataclass
class Node:
    """Documents with equal first terms. ``counts`` are the largest ones below for each of ``terms``; a leaf has ids."""

    terms: np.ndarray
    counts: np.ndarray
    m: int
    ids: list = field(default_factory=list)
    below: list[Node] = field(default_factory=list)


def _joined(below: list[Node], dense: np.ndarray) -> Node:
    terms = np.unique(np.concatenate([node.terms for node in below]))
    for node in below:
        dense[node.terms] = np.maximum(dense[node.terms], node.counts)
    counts = dense[terms]
    dense[terms] = 0
    return Node(terms, counts, min(node.m for node in below), below=below)


def tree(leaves: list[Node], dense: np.ndarray) -> Node:
    """The FP-tree of vectors whose terms are in order of frequency; paths without a branch are one node.

    Sorted vectors that stand side by side share the longest paths, so open branches are a stack by depth.
    """
    leaves = sorted(leaves, key=lambda leaf: leaf.terms.astype(">u4").tobytes())
    open_: list[tuple[int, list[Node]]] = []

    def close(last: Node, depth: int) -> Node:
        while open_ and open_[-1][0] > depth:
            _, below = open_.pop()
            last = _joined([*below, last], dense)
        return last

    for leaf, after in zip(leaves, leaves[1:], strict=False):
        n = min(len(leaf.terms), len(after.terms))
        apart = np.flatnonzero(leaf.terms[:n] != after.terms[:n])
        depth = int(apart[0]) if len(apart) else n
        last = close(leaf, depth)
        if open_ and open_[-1][0] == depth:
            open_[-1][1].append(last)
        else:
            open_.append((depth, [last]))
    return close(leaves[-1], -1)


class Search:
    """The ``best`` documents of each item so far, among those of the trees that were searched."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, best: int):
        self.sizes = np.array([len(terms) for terms in items], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.terms = np.concatenate(items) if items else np.zeros(0, np.int64)
        self.weights, self.best = weights, best
        self.dense = np.zeros(len(weights) + 1, np.int64)
        self.found: list[list[tuple[int, float, int | None]]] = [[] for _ in items]
        #: The least score that still counts.
        self.floor = np.ones(len(items), np.int64)

    def bounds(self, node: Node, items: np.ndarray) -> np.ndarray:
        self.dense[node.terms] = self.weights[node.terms] * (1_000_000_000 * node.counts // (1000 * node.counts + 8 * node.m))
        sizes = self.sizes[items]
        gathered = self.dense[self.terms if len(items) == len(self.sizes) else self.terms[A.ramps(self.starts[items], sizes)]]
        self.dense[node.terms] = 0
        return np.add.reduceat(gathered, np.cumsum(sizes) - sizes)

    def _take(self, item: int, score: int, ids: list) -> None:
        found = self.found[item]
        for doc_id in ids:
            # The worst comes first: least score, then largest id, a null one above all.
            entry = (score, -math.inf if doc_id is None else -doc_id, doc_id)
            if len(found) < self.best:
                heapq.heappush(found, entry)
            elif entry[:2] > found[0][:2]:
                heapq.heapreplace(found, entry)
            else:
                break
        if len(found) == self.best:
            self.floor[item] = found[0][0]

    def visit(self, root: Node) -> int:
        """Searches a tree; returns the number of nodes it looked at."""
        seen, waiting = 0, [(root, np.arange(len(self.sizes)))]
        while waiting:
            node, items = waiting.pop()
            bounds = self.bounds(node, items)
            seen += 1
            live = bounds >= self.floor[items]
            if not live.any():
                continue
            if node.ids:
                for item, score in zip(items[live].tolist(), bounds[live].tolist(), strict=True):
                    self._take(item, score, node.ids)
            else:
                waiting += [(below, items[live]) for below in reversed(node.below)]
        return seen


def _leaves(batches: Iterator[pa.RecordBatch], rank: np.ndarray, n_docs: int, n_terms: int) -> Iterator[list[Node]]:
    """Leaves of one tree after another; documents alike in terms, counts and measure are one leaf."""
    limit = max(1, min(TREE_DOCS, TREE_ENTRIES // max(len(rank), 1)))
    held: dict[tuple, Node] = {}
    for batch in batches:
        ids, lengths = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
        lists, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy()
        sizes = lists.value_lengths().to_numpy()
        terms = rank[lists.flatten().to_numpy()]
        ends = np.cumsum(sizes)
        order = np.lexsort((terms, np.repeat(np.arange(len(sizes)), sizes)))
        terms, counts = terms[order], counts[order].astype(np.int64)
        for doc_id, n, a, b in zip(ids, lengths, (ends - sizes).tolist(), ends.tolist(), strict=True):
            if a == b:
                continue
            leaf = Node(terms[a:b], counts[a:b], 10 + 90 * n * n_docs // n_terms)
            held.setdefault((leaf.terms.tobytes(), leaf.counts.tobytes(), leaf.m), leaf).ids.append(doc_id)
            if len(held) >= limit:
                yield list(held.values())
                held = {}
    if held:
        yield list(held.values())


def _searched(batches, items: list[np.ndarray], weights: np.ndarray, rank: np.ndarray, n_docs: int, n_terms: int, best: int):
    search = Search(items, weights, best)
    for leaves in _leaves(batches, rank, n_docs, n_terms):
        for leaf in leaves:
            leaf.ids.sort(key=lambda i: math.inf if i is None else i)
        search.visit(tree(leaves, search.dense))
    rows = [(item, doc_id, score) for item, found in enumerate(search.found) for score, _, doc_id in found]
    columns = list(zip(*rows, strict=True)) or [()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_part(docs: DataFrame, rows: list, best: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) for some items, given as rows of ``item_terms``."""
    spark = docs.sparkSession
    terms = sorted({term for row in rows for term in row.terms})
    number, size = {term: i for i, term in enumerate(terms)}, len(terms)
    vocabulary = Vocabulary(terms)
    vectors = materialize(docs.mapInArrow(lambda batches: _vectors(batches, vocabulary, size), _VECTORS), "term-vectors")
    counted = vectors.mapInArrow(lambda batches: _frequencies(batches, size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = dict(counted.collect())
    n_docs, n_terms = df.pop(size, 0), df.pop(size + 1, 0)
    if not n_docs:
        return None
    order = sorted(range(size), key=lambda t: (-df.get(t, 0), terms[t]))
    rank = np.zeros(size, np.int64)
    rank[order] = np.arange(size)
    weights = np.array([_weight(n_docs, df.get(t, 0)) for t in order], np.int64)
    items = [np.array([rank[number[term]] for term in row.terms], np.int64) for row in rows]
    found = vectors.mapInArrow(
        lambda batches: _searched(batches, items, weights, rank, n_docs, n_terms, best), "item long, doc_id long, score long"
    )
    ids = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(rows)], "item long, item_id long")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= best)
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of each item with a score above 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = materialize(item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), "text")), "item-terms")
    size = F.coalesce(F.sum(F.aggregate("terms", F.lit(0), lambda n, t: n + F.octet_length(t))), F.lit(0))
    parts = int(wanted.agg(size).first()[0]) // ITEM_BYTES + 1
    out = []
    for i in range(parts):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(parts)) == i).collect()
        found = _search_part(docs, rows, best) if rows else None
        if found is not None:
            out.append(found if parts == 1 else materialize(found, "search-part"))
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = out[0]
    for other in out[1:]:
        result = result.unionByName(other)
    return result
