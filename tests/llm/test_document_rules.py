"""Quality rules, decontamination, tokenizing, packing and block files."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import arrays, decontamination, id_blocks, packing, quality_rules, token_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = [
    (1, "The cat and the dog. " * 3, "en"),
    (2, "one two three four five six seven eight nine ten\n\n one\none\none", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \t\n\x0b\x0c\r ", "xx"),
    (6, "a b c d e a b c d e a b c d e x", "de"),
    (6, "a b c d e a b c d e a b c d e x", "de"),
    (7, "é ü #$% <a>|& \x1c \u2003 word", "fr"),
    (8, "x" * 100_000, "en"),
    (9, " ".join(f"w{i % 9973}" for i in range(60_000)), "en"),
    (None, "some text without an id", "en"),
]
BYTE_BPE, WORD_BPE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def base(text):
    words = WORD.findall(text or "")
    windows: dict = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 10 or 100 * len(repeated) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(repeated), failed


def frame(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_base_counts(spark):
    got = quality_rules.quality_verdicts(frame(spark)).collect()
    ours = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr)
    assert ours == sorted(((i, *base(t)) for i, t, _ in DOCS), key=repr)
    assert all(not r.kept for r in got if r.base_failed)


def test_divergence_rejects_and_guards(spark):
    rng = random.Random(1)
    common = "the of and to in a is that for it was on are as with be".split()

    def prose(n):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice("house tree river stone water light".split()) + str(rng.random())[2:3] for _ in range(n))

    rows = [(i, prose(300), "en") for i in range(60)]
    rows += [(100, " ".join(f"{w}$$$###" for w in prose(300).split()), "en"), (101, " ".join(f"QZ{i}" for i in range(300)), "en")]
    rows += [(102, "QZX $$$ ### QQQ 12 77 ZZ Q9 %%% 11 K", "en"), (103, prose(200), None), (104, prose(200), "zz")]
    docs = frame(spark, rows).withColumn("class_counts", F.lit("mine")).withColumn("kept", F.lit("also"))
    out = quality_rules.drop_rejected(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept == {*range(60), 102, 103, 104}


def test_every_language_has_its_own_reference(spark):
    """A language without given common words is judged by its own documents; one without a reference is not judged."""
    rng = random.Random(3)

    def prose(frequent, others, n):
        return " ".join(rng.choice(frequent.split()) if rng.random() < 0.4 else rng.choice(others.split()) + rng.choice("abcdefgh") for _ in range(n))

    english = "the of and to in a is that for it was on are as with be", "house tree river stone water light"
    russian = "и в не на я что тот быть с а весь это как она по но", "дом дерево река камень вода свет"
    italian = "di e il la che in un a per non una sono si da con come", "casa albero fiume pietra acqua luce"
    rows = [(i, prose(*english, 300), "en") for i in range(60)]
    rows += [(100 + i, prose(*russian, 300), "ru") for i in range(20)] + [(200 + i, prose(*italian, 300), "it") for i in range(20)]
    rows += [(300, prose(*english, 300), "ru"), (301, " ".join(f"QZ{i}" for i in range(300)), "it"), (302, prose(*russian, 150), "uk"), (303, prose(*russian, 300), None)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(docs).collect()}
    kept = {i for i, r in got.items() if r.kept}
    assert kept == {*range(60), *range(100, 120), *range(200, 220), 302, 303}
    assert got[100].word_distance is not None and got[302].word_distance is None and got[303].class_distance is None
    assert {r.doc_id for r in quality_rules.drop_rejected(docs).collect()} == kept


def brute_contamination(docs, items, width=10):
    grams = {}
    for item, text in items:
        words = decontamination.normalised_words(text)
        size = min(width, len(words))
        for i in range(len(words) - size + 1) if size else ():
            grams.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words, hit, found = decontamination.normalised_words(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(words) - size + 1):
                if (gram := tuple(words[i : i + size])) in grams:
                    hit.update(range(i, i + size))
                    found |= grams[gram]
        out.append((doc, len(words), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_bytes", [1 << 20, 600])
def test_decontamination(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(decontamination, "PART_BYTES", part_bytes)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 10, 14])))) for i in range(12)]
    items += [(50, None), (51, "É-ok Ünter"), (52, "1 2 3 4 5 6 7 8 9 10 11"), (52, "1 2 3 4 5 6 7 8 9 10 11")]
    docs = [(i, " ".join(rng.choice([rng.choice(words), items[rng.randrange(12)][1].upper()]) for _ in range(20))) for i in range(30)]
    docs += [(90, None), (91, ""), (92, "x 1,2.3 4 5 6 7 8 9 10 y"), (92, "x 1,2.3 4 5 6 7 8 9 10 y"), (None, "É-ok Ünter")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("mine"))
    got = decontamination.contamination(rows, bench, ["doc_id"]).collect()
    assert sorted(((r.doc_id, r.n_words, list(r.hit_words), list(r["items"])) for r in got), key=repr) == brute_contamination(docs, items)
    clean = {d for d, _, hit, _ in brute_contamination(docs, items) if not hit}
    left = decontamination.drop_contaminated(rows, bench)
    assert left.columns == rows.columns and {r.doc_id for r in left.collect()} == clean
    cut = decontamination.remove_spans(rows, bench)
    texts = [(r.doc_id, r.text) for r in cut.collect()]
    assert len(texts) == len(docs) and not any(hit for _, _, hit, _ in brute_contamination(texts, items))


def test_no_benchmark_and_no_documents(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = decontamination.contamination_report(docs, bench).first()
    assert (row.n_hit, row.contaminated, row.n_items) == (0, False, 0)
    assert decontamination.contamination_report(docs.limit(0), bench).collect() == []
    assert quality_rules.quality_verdicts(frame(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\t\x1c\u2003xyzß漢", max_size=40), max_size=8))
def test_words_and_windows(texts):
    flat = arrays.texts_of(pa.array(texts, pa.string()))
    words = arrays.words_of(flat, arrays.NOT_BLANK)
    expected = [WORD.findall(t) for t in texts]
    assert [flat.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)] == sum(expected, [])
    assert words.counts.tolist() == [len(w) for w in expected]
    hashes = arrays.hash_spans(flat.data, words.starts, words.ends)
    for width in (1, 3, 5):
        at = arrays.window_starts(words.first, width)
        got = arrays.window_hashes(hashes, width)[at] if len(at) else []
        keys = [tuple(w[i : i + width]) for w in expected for i in range(len(w) - width + 1)]
        assert len(set(zip(keys, map(int, got), strict=True))) == len(set(keys)) == len(set(map(int, got)))


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_encoder_equals_library(path):
    rng = random.Random(4)
    alphabet = [*"aabcdelmrstv  \n\t'''.,!12é²ñÉ \x85\x1c\x1d ÄßİȺ–漢<|", "  ", "'s", "'ll", "I'd", "\u0301", "<|endoftext|>", "\x00"]
    encoder, library = token_ids.Encoder(path), Tokenizer.from_file(path)
    for trial in range(25):
        letters = alphabet if trial % 3 else [c for c in alphabet if max(map(ord, c)) < 0x250 and c not in "İȺ<" and len(c) < 5]
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(80)]
        ids, first = encoder.encode(arrays.texts_of(pa.array(texts)))
        for i, expected in enumerate(library.encode_batch(texts, add_special_tokens=False)):
            assert ids[first[i] : first[i + 1]].tolist() == expected.ids, texts[i]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50), max_size=400), st.integers(1, 5))
def test_blocks_round_trip(values, n_docs):
    ids = np.array(values, np.uint32)
    counts = np.diff(np.r_[0, np.sort(np.random.default_rng(1).integers(0, len(ids) + 1, n_docs - 1)), len(ids)]).astype(np.int64)
    docs = np.arange(n_docs) * 7
    back = id_blocks.unpack_ids(id_blocks.pack_ids(docs, counts, ids))
    assert [b.tolist() for b in back] == [docs.tolist(), counts.tolist(), ids.tolist()]


def test_blocks_are_narrow():
    rng = np.random.default_rng(2)
    ids = rng.integers(1000, 1016, 128 * 100).astype(np.uint32)
    ids[::64] = 50_000
    payload = id_blocks.pack_ids(np.array([1]), np.array([len(ids)]), ids)
    assert len(payload) < 100 * (6 + 64 + 2 * 5 + 8) + 100


def encoded(path, text, end):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_block_files(spark):
    docs = frame(spark).repartition(4)
    got = sorted(map(tuple, id_blocks.id_digests(id_blocks.write_ids(docs, BYTE_BPE)).collect()), key=lambda r: r[1])
    start, expected = 0, []
    for doc, text, _ in sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = encoded(BYTE_BPE, text, 0)
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    assert id_blocks.id_digests(id_blocks.write_ids(docs.limit(0), BYTE_BPE)).collect() == []


def check_packing(rows, expected):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(expected)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            ids = expected[doc]
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(expected[doc])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at < 4096 and at & (at - 1) == 0


def test_packing(spark, monkeypatch):
    rows = [d for i, d in enumerate(DOCS) if d[0] != 6 or i == 5]
    got = packing.pack(frame(spark, rows).repartition(3), WORD_BPE, with_ids=True).collect()
    check_packing(got, {d: encoded(WORD_BPE, t, 2) for d, t, _ in rows})
    assert all(len(r.ids) == r.length for r in got)
    assert packing.pack(frame(spark, []), WORD_BPE).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 4), min_size=1, max_size=6), st.integers(1, 100))
def test_fill_is_closest(counts, capacity):
    reach = {0}
    for length, n in counts.items():
        reach = {r + k * length for r in reach for k in range(n + 1)}
    chosen = packing.fill(sorted(counts, reverse=True), counts, capacity)
    assert all(n <= counts[length] for length, n in chosen.items())
    assert sum(length * n for length, n in chosen.items()) == max(r for r in reach if r <= capacity)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_packer_has_no_padding(sizes):
    packer = packing.Packer(64)
    sequences = [s for i, n in enumerate(sizes) for s in packer.add(i, n)] + list(packer.windows()) + list(packer.rest())
    lengths = [sum(p[2] for p in s) for s in sequences]
    assert sum(lengths) == sum(sizes) and all(n == 64 or n & (n - 1) == 0 for n in lengths)
    places = sorted((doc, start + k) for s in sequences for doc, start, n in s for k in range(n))
    assert places == [(i, k) for i, n in enumerate(sizes) for k in range(n)]
