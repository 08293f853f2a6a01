"""Near-copies by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: the first (a bijective mixer) scatters a shingle to a place of a universe
of ``UNIVERSE`` places, the second (a permutation table) is read there, once for each circular shift. The shifted
values of one shingle stand side by side in the table, so a signature is a minimum over short slices of it.

1. Each document's distinct shingles, their 128-bit multiset hash and its band keys; one scan, one narrow table.
   Documents of equal sets form a class, represented by the lowest doc_id; only representatives go on.
2. Representatives that share a band key form a bucket. Each bucket has a centre: the member whose buckets are the
   largest in sum, which in a group of edited copies is their common source. Pairs (member, centre) are verified on
   the full sets. That is one pair per member and centre, never all pairs of a bucket.
3. Members that do not link to their centre may still link to another member of its buckets. All members of such a centre
   are compared through their differences from the centre, in blocks of bounded size, inside tasks; only links that
   connect something new leave a task. So all pairs that share a band key are judged; only linked-through-the-centre
   pairs are skipped, as they are in one component already.
4. Connected components of the links, and back to all documents.

The threshold is a parameter, and the bands belong to it: with 25 bands of 5 rows, a pair at 0.85 misses all bands with a
chance of 4e-7, and with 40 bands a pair at 0.8 with a chance of 1.3e-7. Shingles are compared by 64-bit hashes.

Defined cases: null, empty and blank texts have an empty set, link with nothing and are kept. Fewer than five words are
one shingle. Rows of one doc_id are one document: it links by any of its rows, and they are kept or dropped together.
Rows without a doc_id link with nothing and are kept, without
a component. An empty table gives an empty result. Extra columns pass ``drop_near_copies`` by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import arrays as A
from kinfold.llm.columns import plainly_named
from kinfold.operators.components import connected_components
from kinfold.sources.scratch import materialize

SHINGLE = 5
BANDS, ROWS = 25, 5
UNIVERSE_BITS = 20
#: The contract of op4, which ``BANDS`` is sized for. Other callers give their own percentage and bands.
MIN_PERCENT = 85
SEED = 20240
#: Members per block where a centre's members are compared among themselves: bounds a task, not a result.
BLOCK = 1024
_GATHER = 8192

_tables: dict[int, np.ndarray] = {}


def _slices_of_table(width: int) -> np.ndarray:
    """Row p holds the second permutation at p under the first ``width`` circular shifts."""
    if width not in _tables:
        table = np.random.default_rng(SEED).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        _tables[width] = np.concatenate([table, table[: width - 1]])
    return np.lib.stride_tricks.sliding_window_view(_tables[width], width)


def shingle_sets(texts: A.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of text ``i`` are ``hashes[first[i]:first[i + 1]]``."""
    plain = texts.map_bytes(A.LOWER)
    words = A.words_of(plain, A.NOT_BLANK)
    word_hashes = A.hash_spans(plain.data, words.starts, words.ends)
    found, owner = [], []
    at = A.window_starts(words.first, SHINGLE)
    if len(at):
        found.append(A.window_hashes(word_hashes, SHINGLE)[at])
        owner.append(np.searchsorted(words.first, at, side="right") - 1)
    for size in range(1, SHINGLE):
        short = np.flatnonzero(words.counts == size)
        if len(short):
            whole = A.window_hashes(word_hashes, size)[words.first[short]]
            found.append(A.mix(whole + np.uint64(size)))
            owner.append(short)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    hashes, docs = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    distinct = np.ones(len(hashes), bool)
    distinct[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[distinct], docs[distinct]
    return hashes, np.searchsorted(docs, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One row of coordinates per text; a text without shingles has the largest values."""
    width = bands * ROWS
    rows = _slices_of_table(width)
    places = (A.mix(hashes ^ np.uint64(SEED)) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    out = np.full((len(first) - 1, width), np.iinfo(np.uint32).max, np.uint32)
    owner = A.owners(first)
    for start in range(0, len(places), _GATHER):
        part, docs = places[start : start + _GATHER], owner[start : start + _GATHER]
        cuts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        least = np.minimum.reduceat(rows[part], cuts, axis=0)
        out[docs[cuts]] = np.minimum(out[docs[cuts]], least)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    bands = signature.shape[1] // ROWS
    coordinates = signature.astype(np.uint64).reshape(len(signature), bands, ROWS)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for k in range(ROWS):
        keys = A.join_hash(keys, A.mix(coordinates[:, :, k] + np.uint64(1)))
    return keys


def _signed(batches, bands: int):
    for part, texts in A.text_slices(batches):
        hashes, first = shingle_sets(texts)
        keys = band_keys(signatures(hashes, first, bands))
        sizes = np.diff(first)
        sums = []
        for salt in (np.uint64(1), np.uint64(0x5851F42D4C957F2D)):
            total = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(A.mix(hashes * np.uint64(3) + salt), out=total[1:])
            sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
        width = np.where(sizes > 0, bands, 0)
        ends = np.r_[0, np.cumsum(width)].astype(np.int32)
        flat = keys[sizes > 0].reshape(-1).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array(sizes, pa.int64()),
                *[pa.array(s, pa.int64()) for s in sums],
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
            ],
            names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
        )


def _sets(batches):
    for part, texts in A.text_slices(batches):
        hashes, first = shingle_sets(texts)
        flat = pa.array(hashes.view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32), pa.int32()), flat)],
            names=["doc_id", "shingles"],
        )


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(np.r_[0, column.value_lengths().to_numpy(zero_copy_only=False)])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _enough(both, size_a, size_b, percent: int):
    return 100 * both >= percent * (size_a + size_b - both)


def _against_centres(batches, percent: int):
    """Verifies (doc, centre) and gives the symmetric difference of their sets."""
    for batch in batches:
        sets, centres = _lists(batch.column("shingles")), _lists(batch.column("centre_shingles"))
        linked, differences = [], []
        for mine, theirs in zip(sets, centres, strict=True):
            apart = np.setxor1d(mine, theirs, assume_unique=True)
            both = (len(mine) + len(theirs) - len(apart)) // 2
            linked.append(_enough(both, len(mine), len(theirs), percent))
            differences.append(apart.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"),
                batch.column("centre"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(linked, pa.bool_()),
                pa.array(differences, pa.list_(pa.int64())),
            ],
            names=["doc", "centre", "size", "linked", "apart"],
        )


def block_links(
    docs: np.ndarray, sizes: np.ndarray, linked: np.ndarray, apart: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Links among members of one centre, without pairs that both link to it; a spanning forest of them.

    |a ^ b| follows from the differences to the centre: |da| + |db| - 2 |da & db|.
    """
    n = len(docs)
    tokens = np.concatenate(apart)
    owner = np.repeat(np.arange(n), [len(a) for a in apart])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    cuts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1], True]) if len(tokens) else np.zeros(1, np.int64)
    shared = np.zeros((n, n), np.int32)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            shared[np.ix_(owner[a:b], owner[a:b])] += 1
    lengths = np.array([len(a) for a in apart], np.int64)
    unlike = lengths[:, None] + lengths[None, :] - 2 * shared
    total = sizes[:, None] + sizes[None, :]
    found = _enough((total - unlike) // 2, total, 0, percent) & ~(linked[:, None] & linked[None, :])
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for a, b in zip(*np.nonzero(np.triu(found, 1)), strict=True):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            links.append((int(docs[a]), int(docs[b])))
    return links


def _within_block(table: pa.Table, percent: int) -> pa.Table:
    table = table.combine_chunks()
    # Who is held against all is among all as well.
    _, once = np.unique(table.column("doc").to_numpy(), return_index=True)
    table = table.take(pa.array(once)).combine_chunks()
    apart = [a for chunk in table.column("apart").chunks for a in _lists(chunk)]
    docs, sizes, linked = (table.column(c).to_numpy() for c in ("doc", "size", "linked"))
    links = block_links(docs, sizes, linked.astype(bool), apart, percent)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _links_in_blocks(verified: DataFrame, percent: int) -> DataFrame:
    """Links among the members of centres that have a member which does not link to them.

    Members that link to a centre are linked with each other by it, so only the others are held against all. A member goes
    out once per block of those others, and each of those once per block of members.
    """
    open_centres = (
        verified.groupBy("centre")
        .agg(F.count("*").alias("members"), F.count_if(~F.col("linked")).alias("outside"))
        .filter("outside > 0 AND members > 1")
        .select("centre", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("members", "outside")])
    )
    rows = verified.join(open_centres, "centre")
    own = {c: F.pmod(F.xxhash64("doc"), F.col(c)).cast("int") for c in ("members", "outside")}
    every = {c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("members", "outside")}
    row = ["centre", "doc", "size", "linked", "apart"]
    all_members = rows.select(*row, every["outside"].alias("low"), own["members"].alias("high"))
    outsiders = rows.filter("NOT linked").select(*row, own["outside"].alias("low"), every["members"].alias("high"))
    paired = all_members.unionByName(outsiders)
    return paired.groupBy("centre", "low", "high").applyInArrow(
        lambda table: _within_block(table, percent), "a long, b long"
    )


def near_copies(docs: DataFrame, percent: int = MIN_PERCENT, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``; a pair of at least ``percent`` similarity links."""
    texts = docs.select("doc_id", "text")
    signed = materialize(
        texts.mapInArrow(
            lambda batches: _signed(batches, bands), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
        ),
        "signed",
    )
    key = ["set_a", "set_b", "n_shingles"]
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("class"))
    members = materialize(signed.select("doc_id", *key).join(classes, key, "left").drop("set_a", "set_b"), "classes")
    own = signed.filter("n_shingles > 0").join(classes.select("class").distinct(), F.col("doc_id") == F.col("class"), "left_semi")
    banded = own.select("doc_id", F.explode("bands").alias("band")).distinct()
    crowded = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = materialize(banded.join(crowded, "band"), "buckets")
    weight = buckets.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    weighed = buckets.join(weight, "doc_id")
    centres = weighed.groupBy("band").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("centre"))
    pairs = materialize(
        buckets.join(centres, "band").filter("doc_id <> centre").select(F.col("doc_id").alias("doc"), "centre").distinct(),
        "pairs",
    )
    wanted = pairs.select(F.col("doc").alias("doc_id")).union(pairs.select("centre")).distinct()
    sets = materialize(
        texts.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles array<long>"), "shingles"
    )
    both = pairs.join(sets.select(F.col("doc_id").alias("centre"), F.col("shingles").alias("centre_shingles")), "centre")
    both = both.join(sets.select(F.col("doc_id").alias("doc"), "shingles"), "doc")
    verified = materialize(
        both.mapInArrow(
            lambda batches: _against_centres(batches, percent),
            "doc long, centre long, size long, linked boolean, apart array<long>",
        ),
        "verified",
    )
    star = verified.filter("linked").select(F.col("doc").alias("a"), F.col("centre").alias("b"))
    links = materialize(star.union(_links_in_blocks(verified, percent)).distinct(), "near-links")
    roots = connected_components(links).select(F.col("node").alias("class"), "root")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "class", "doc_id"))
    return (
        members.join(roots, "class", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_copies(docs: DataFrame, percent: int = MIN_PERCENT, bands: int = BANDS) -> DataFrame:
    """The rows of ``docs`` whose document is the lowest of its component."""
    gone = near_copies(docs, percent, bands).filter(~F.col("kept")).select("doc_id")
    rows = plainly_named(docs, "doc_id")
    return rows.join(gone.hint("merge"), "doc_id", "left_anti").select(*rows.columns).toDF(*docs.columns)
