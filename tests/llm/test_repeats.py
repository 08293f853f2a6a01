"""Both repeat removers against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import arrays, debruijn_dedup, repeats, suffix_dedup

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed: int, n: int = 90) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "the", "of"]

    def words(count):
        return [rng.choice(vocabulary) for _ in range(count)]

    passages = [words(rng.choice([8, 20, 34, 35, 36, 50, 120])) for _ in range(10)]
    docs: list[tuple[int | None, str | None]] = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += words(rng.randint(0, 50)) + (rng.choice(passages) if rng.random() < 0.6 else [])
        if i % 17 == 0:
            text = ["a"] * rng.randint(30, 90)
        if i % 19 == 0:
            text = ["a", "b"] * rng.randint(30, 60)
        docs.append((i * 3 + 1, " ".join(text)))
    docs += [(1000 + i, docs[5][1]) for i in range(3)] + [(2, docs[7][1]), (900, None), (901, ""), (902, " \n")]
    docs += [(910, f"{docs[9][1]} tail"), (911, "  \n " + (docs[11][1] or "").replace(" ", "\n"))]
    docs += [(7, docs[3][1]), (7, docs[3][1]), (None, docs[4][1]), (13, f"x {docs[8][1]}")]
    rng.shuffle(docs)
    return docs


def brute_words(docs, width=debruijn_dedup.WIDTH):
    texts = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(
        tuple(w[j : j + width]) for (i, _), w in zip(docs, texts, strict=True) if i is not None for j in range(len(w) - width + 1)
    )
    out = []
    for (doc, _), w in zip(docs, texts, strict=True):
        gone = set()
        for j in range(len(w) - width + 1) if doc is not None else ():
            if seen[tuple(w[j : j + width])] > 1:
                gone.update(range(j, j + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(docs, width=suffix_dedup.WIDTH):
    least: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for j in range(len(b) - width + 1) if i is not None else ():
            least[b[j : j + width]] = min(i, least.get(b[j : j + width], i))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1) if i is not None else ():
            if least[b[j : j + width]] < i:
                gone[j : j + width] = b"\x01" * width
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs():
    return corpus(5)


def test_words(spark, docs):
    got = debruijn_dedup.repeat_digests(frame(spark, docs)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert ordered(got.collect()) == ordered(brute_words(docs))


def test_bytes(spark, docs):
    got = suffix_dedup.repeat_digests(frame(spark, docs))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert ordered(got.select(*columns).collect()) == ordered(brute_bytes(docs))


@pytest.mark.parametrize("shift", [-600, -10_000, 1 << 40])
def test_ids_of_any_sign(spark, docs, shift):
    moved = [(None if i is None else i + shift, t) for i, t in docs]
    words = debruijn_dedup.repeat_digests(frame(spark, moved)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert ordered(words.collect()) == ordered(brute_words(moved))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert ordered(suffix_dedup.repeat_digests(frame(spark, moved)).select(*columns).collect()) == ordered(brute_bytes(moved))


def test_marks_are_no_ids():
    """What a block knows to repeat is told by a bit, whatever the least document's id; its print stays the same."""
    anchors = np.array([9, 9, 5], np.uint64) << np.uint64(32)
    (known, known_docs), sent = repeats._block(anchors, np.array([-1, -7, -1]), True)
    assert known.tolist() == [9 << 32] * 2 and sorted(known_docs.tolist()) == [-7, -1]
    rows = repeats._print_rows(np.zeros(2, np.int32), False, *sent)
    other = repeats._print_rows(np.zeros(2, np.int32), False, sent[0], np.array([-2, -3]), np.zeros(2, bool))
    met = repeats._met(pa.Table.from_batches([rows, other]), True).to_pydict()
    assert sorted(zip(met["doc_id"], met["print"], strict=True)) == [(-3, 9 << 7), (-2, 5 << 7), (-1, 5 << 7)]


def test_small_blocks_and_buckets(spark, docs, monkeypatch):
    """Known-in-block prints, flushes and boundary anchors are used here."""
    rows = frame(spark, docs)
    parts = [pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in docs if i is not None])]
    monkeypatch.setattr(repeats, "BLOCK_ANCHORS", 40)
    sent = list(repeats._sent(iter(parts), suffix_dedup.KIND, 3))
    assert any(any(b.column("known").to_pylist()) for b in sent)
    assert rows.count() == len(docs)


def test_sorted_buckets_of_any_cut(spark, monkeypatch):
    """One bucket, many flushes: the masks do not depend on where a flush falls."""
    rng = random.Random(3)
    data = [bytes(rng.choice(b"ab") for _ in range(70)) for _ in range(60)]
    data += data[:20]
    starts = np.array([i * 80 for i in range(len(data))])
    flat = np.frombuffer(b"".join(d.ljust(80, b"-") for d in data) + bytes(64), np.uint8)
    keys = np.ascontiguousarray(arrays.eights(flat)).byteswap()
    members, group = suffix_dedup.multikey_ties(keys, starts, 50)
    got = sorted(sorted(members[group == g].tolist()) for g in np.unique(group))
    same = {}
    for i, d in enumerate(data):
        same.setdefault(d[:50], []).append(i)
    assert got == sorted(v for v in same.values() if len(v) > 1)


def test_paths(spark):
    """A passage shared by three documents is one path; where two passages branch, paths end."""
    words = [f"p{i}" for i in range(200)]
    docs = [(i, " ".join([f"x{i}_{k}" for k in range(40)] + words + [f"y{i}_{k}" for k in range(40)])) for i in range(3)]
    found, masked = debruijn_dedup.repeated_runs(spark.createDataFrame(docs, SCHEMA))
    paths = debruijn_dedup.compact_paths(found, masked).collect()
    assert len({p.path for p in paths}) == 1 and len(paths) == 3
    assert all(p.start >= 40 and p.start + p.n_words <= 240 and p.n_words > 150 for p in paths)


def test_paths_end_where_texts_branch_or_end(spark):
    """All spans of a path have one length, and its words; a passage twice in a row is two spans."""
    words = [f"p{i}" for i in range(300)]
    docs = [(1, words), (2, ["a"] + words + ["b"]), (3, words[:150]), (4, words + words), (5, words[100:] + ["c"])]
    docs = [(i, " ".join(w)) for i, w in docs]
    found, masked = debruijn_dedup.repeated_runs(spark.createDataFrame(docs, SCHEMA))
    paths = debruijn_dedup.compact_paths(found, masked).collect()
    texts = dict(docs)
    said = {}
    for p in paths:
        said.setdefault(p.path, []).append(tuple(texts[p.doc_id].split()[p.start : p.start + p.n_words]))
    assert all(len(set(spans)) == 1 and len(spans) > 1 for spans in said.values())
    assert max(p.runs for p in paths) > 1 and sum(p.doc_id == 4 for p in paths) > sum(p.doc_id == 1 for p in paths)


def test_spans_are_held_against_their_sources(spark):
    """Spans that hashes call equal count only if their words are: a lone one is told, blanks make no difference."""
    words = [f"w{i}" for i in range(60)]
    other = words[:30] + ["X"] + words[31:]
    docs = [(1, " ".join(words)), (2, "\t".join(["z", *words])), (3, " ".join(other)), (4, " ".join(other))]
    rows = repeats.keyed(spark.createDataFrame(docs, SCHEMA)).select("doc_id", "tie")
    spans = rows.selectExpr(
        "named_struct('anchor', 7L, 'run', IF(doc_id = 4, 9L, 8L)) AS path", "doc_id", "tie", "IF(doc_id = 2, 1L, 0L) AS start", "60L AS n_words"
    )
    read, alone = debruijn_dedup.confirmed_spans(spark.createDataFrame(docs, SCHEMA), spans)
    kept = read.join(alone, ["path", "digest"], "left_anti").collect()
    assert read.count() == 4 and sorted(r.doc_id for r in kept) == [1, 2]


def test_unlike_paths_fall_back_to_their_runs(spark, monkeypatch):
    """If a path's words differ somewhere, the runs that do agree are still found."""
    words = [f"p{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words))], SCHEMA)
    found, masked = debruijn_dedup.repeated_runs(docs)
    told = debruijn_dedup.confirmed_spans
    calls = []

    def doubting(docs, spans):
        read, alone = told(docs, spans)
        calls.append(read.count())
        return (read, read.select("path", "digest").distinct()) if len(calls) == 1 else (read, alone)

    monkeypatch.setattr(debruijn_dedup, "confirmed_spans", doubting)
    spans, _ = debruijn_dedup._repeated_spans(docs, found, masked)
    covered = {(r.doc_id, w) for r in spans.collect() for w in range(r.start, r.start + r.n_words)}
    assert covered == {(d, w) for d in (1, 2) for w in range(200)} and calls[1] > calls[0] == 2


def test_cut_texts(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"one  two\n{passage}\tend\n", "de"), (2, f"{passage} é", None), (3, "alone ", "x"), (4, None, "y")]
    out = debruijn_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, prints string"))
    assert out.columns == ["doc_id", "text", "prints"]
    got = {r.doc_id: (r.text, r.prints) for r in out.collect()}
    assert got == {1: ("one  two\tend\n", "de"), 2: (" é", None), 3: ("alone ", "x"), 4: (None, "y")}
    names = ["doc_id", "text", "_", "a.b", "tie", "spans", "c0"]
    clash = spark.createDataFrame([(*r, 1, None, r[2], 5) for r in rows], "doc_id long, text string, x string, y int, z int, w string, v int")
    clash = debruijn_dedup.remove_repeats(clash.toDF(*names))
    assert clash.columns == names and {r[0]: (r[1], r[2]) for r in clash.collect()} == got and {r[3] for r in clash.collect()} == {1}
    cut = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()}
    assert cut[1] == rows[0][1] and cut[3] == "alone " and cut[2].endswith("é") and len(cut[2]) < 12


@pytest.mark.parametrize("operator", [debruijn_dedup, suffix_dedup])
def test_empty(spark, operator):
    empty = spark.createDataFrame([], SCHEMA)
    assert operator.repeat_digests(empty).collect() == []
    assert operator.remove_repeats(empty).collect() == []


def test_long_text(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    docs = [(1, text), (2, f"{text} z"), (3, "é" * 100_000)]
    got = debruijn_dedup.repeat_digests(spark.createDataFrame(docs, SCHEMA))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == [(1, 60_000, 60_000), (2, 60_001, 60_000), (3, 1, 0)]
    sizes = {r.doc_id: r.n_removed for r in suffix_dedup.repeat_digests(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert sizes == {1: 0, 2: len(text), 3: 0}
