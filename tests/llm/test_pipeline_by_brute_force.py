"""Rows, texts and ids of the corpus pipeline against plain Python, stage by stage."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kinfold.llm import arrays, debruijn_dedup, quality_rules, queries
from tests.llm.test_document_rules import base, brute_contamination

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPELLED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {code: code + 32 for code in range(65, 91)}


def kind_of(char):
    if ord(char) > 0x7F:
        return "beyond"
    if char.isalpha():
        return "lower" if char.islower() else "upper"
    if char.isdigit():
        return "digit"
    if char in " \t\n\v\f\r":
        return "blank"
    return "stop" if char in ".,;:!?'\"()-" else "symbol" if char in "#*$%&|<>" else "other"


def distance(counts, reference):
    n, m = sum(counts.values()), sum(reference.values())
    if not n:
        return 0.0
    total = 0.0
    for key in {*counts, *reference}:
        p, q = counts[key] / n, reference[key] / m
        total += sum(x * math.log2(2 * x / (p + q)) for x in (p, q) if x)
    return math.sqrt(min(max(total / 2, 0), 1))


def judged(rows):
    """doc_id -> (class distance, word distance, kept) for rows of known languages."""
    vocabulary = {w for words in quality_rules.COMMON_WORDS.values() for w in words.split()}
    classes = [Counter(map(kind_of, t or "")) for _, t, _ in rows]
    common = [Counter(w if w in vocabulary else "" for w in SPELLED.findall((t or "").translate(LOWER))) for _, t, _ in rows]
    failed = [base(t)[-1] for _, t, _ in rows]
    references = defaultdict(lambda: (Counter(), Counter()))
    for (_, _, lang), bad, *counts in zip(rows, failed, classes, common, strict=True):
        if not bad:
            for reference, own in zip(references[lang], counts, strict=True):
                reference.update(own)
    out = []
    for (doc_id, _, lang), bad, *counts in zip(rows, failed, classes, common, strict=True):
        distances = [
            distance(own, reference) if sum(own.values()) >= least and sum(references[lang][1].values()) >= quality_rules.MIN_REFERENCE else None
            for own, reference, least in zip(counts, references[lang], (quality_rules.MIN_CHARS, quality_rules.MIN_JUDGED_WORDS), strict=True)
        ]
        near = [d is None or d <= most for d, most in zip(distances, (quality_rules.MAX_CLASS_DISTANCE, quality_rules.MAX_WORD_DISTANCE), strict=True)]
        out.append((doc_id, *distances, not bad and all(near)))
    return out


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def one_of_each(rows, percent=80):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return [row for i, row in enumerate(rows) if find(i) == i]


def without_repeats(rows, width=debruijn_dedup.WIDTH):
    words = [list(WORD.finditer(t or "")) for _, t, _ in rows]
    seen = Counter(tuple(m[0] for m in w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, text, lang), w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - width + 1) if seen[tuple(m[0] for m in w[i : i + width])] > 1 for k in range(i, i + width)}
        if gone:
            ends = [0, *(m.end() for m in w)]
            tail = text[ends[-1] :] if len(w) - 1 not in gone else ""
            text = "".join(text[ends[k] : m.end()] for k, m in enumerate(w) if k not in gone) + tail
        out.append((doc_id, text, lang))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text, r.lang) for r in queries.table(spark, SF, "documents").collect()]


def test_distances_and_verdicts(spark, rows):
    got = quality_rules.quality_verdicts(queries.table(spark, SF, "documents")).collect()
    ours, theirs = ({r[0]: r[1:] for r in x} for x in (((r.doc_id, r.class_distance, r.word_distance, r.kept) for r in got), judged(rows)))
    assert ours.keys() == theirs.keys()
    for doc_id, want in theirs.items():
        assert [d is None for d in ours[doc_id]] == [d is None for d in want] and ours[doc_id][2] == want[2], doc_id
        assert all(abs(a - b) < 1e-9 for a, b in zip(ours[doc_id], want, strict=True) if a is not None), doc_id


@pytest.mark.parametrize("slice_bytes", [arrays.SLICE_BYTES, 3000])
def test_pipeline(spark, rows, monkeypatch, slice_bytes):
    """Also with slices of a few documents, as large tables have."""
    monkeypatch.setattr(arrays.slices, "__defaults__", (slice_bytes,))
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    keeps = {doc_id: kept for doc_id, *_, kept in judged(rows)}
    want = without_repeats(one_of_each([r for r in rows if keeps[r[0]]]))
    hit = {doc_id for doc_id, _, words, _ in brute_contamination([r[:2] for r in want], items) if words}
    want = {doc_id: text for doc_id, text, _ in want if doc_id not in hit}
    docs = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert {r.doc_id: r.text for r in docs.collect()} == want
    ids = defaultdict(dict)
    for r in corpus_pipeline.run(spark, SF).collect():
        ids[r.doc_id][r.start] = r.ids
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    assert {i: [x for _, part in sorted(parts.items()) for x in part] for i, parts in ids.items()} == {
        i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in want.items()
    }


def test_clashing_names(spark):
    """Whatever else a table has passes by."""
    docs = queries.table(spark, SF, "documents")
    names = [*docs.columns, "_row", "a.b", "n_words", "kept", "ids"]
    wide = docs.selectExpr("*", "doc_id", "lang", "n_chars", "true", "text").toDF(*names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, wide = stage(spark, docs, SF), stage(spark, wide, SF)
        assert wide.columns == names, name
    plain = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted((r[0], r[1]) for r in wide.collect()) == plain
