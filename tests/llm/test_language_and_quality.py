"""Language profiles and line quality against plain versions of themselves."""

import itertools
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from codemap_spark.llm import language_id, quality


def plain_vector(text):
    """Bundle of bound, permuted letter vectors, one trigram after another."""
    out, letters = np.zeros(language_id.DIMENSIONS), [ord(c) if c.isalpha() else 0 for c in f"\n{text}\n"]
    vector = lambda code: language_id.letter_vector(code).astype(float)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        if b and (a or c):
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out / max(np.linalg.norm(out), 1e-12)


def test_vectors_like_the_plain_ones(monkeypatch):
    texts = ["", "a", "ab cd, ef", "Straße 12 öffnen", "日本語の文章 です", "x", "the quick brown fox jumps over the lazy dog"] * 2
    for grams in (4096, 3):
        monkeypatch.setattr(language_id, "GRAMS", grams)
        found, has = language_id.document_vectors(texts)
        assert has.tolist() == [any(c.isalpha() for c in t) for t in texts]
        assert np.allclose(found, [plain_vector(t) for t in texts], atol=1e-5)


def test_rich_alphabet_in_bounded_memory():
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 500_000)))
    tracemalloc.start()
    language_id.document_vectors([text])
    assert tracemalloc.get_traced_memory()[1] < 250 << 20
    tracemalloc.stop()


def test_rare_languages_are_learnt(spark):
    rows = [(i, "the cat sat on the mat and then the dog came in", "en") for i in range(400)] + [(1000 + i, "der hund lag auf dem sofa und schlief", "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, _ = language_id.fit(docs, max_rows=20)
    assert langs == ["de", "en"]


def enumerated(model, text):
    """Score of a small text by summing over all labellings of its lines."""
    bins, length, document = quality.line_bins(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    weight = model["weight"][quality.feature_index(bins, document)].sum(1)
    total, good = 0.0, np.zeros(len(bins))
    for y in itertools.product((0, 1), repeat=len(bins)):
        p = math.exp(sum(w for w, k in zip(weight, y, strict=True) if k) + sum(model["transition"][a, b] for a, b in itertools.pairwise(y)))
        total += p
        good += p * np.array(y)
    return float((good / total * length).sum() / length.sum())


def test_scores_like_enumeration(spark):
    rng = np.random.default_rng(2)
    model = {"prior": 0.4, "weight": rng.standard_normal(quality.FEATURES) * 0.3, "transition": rng.standard_normal((2, 2))}
    texts = ["One line of words.", "Two lines.\nBUY NOW!!! 50% $$$", "a\n\n\nb c d\n  \ne e e e e\nF F\n!!", "", None, "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r["__score"], r["__predicted"]) for r in quality.score(docs, model).collect()}
    for i, t in enumerate(texts):
        want = enumerated(model, t) if t and t.strip() else 0.4
        assert found[i] == (pytest.approx(want, abs=1e-9), int(want >= 0.7))


def test_long_texts_are_learnt_from_throughout():
    runs = quality.chosen_runs(100_000, 7, 400)
    assert len(runs) == 8 and all(b - a == 50 for a, b in runs) and max(a for a, _ in runs) > 50_000 and runs == sorted(runs)
    assert quality.chosen_runs(399, 7, 400) == [(0, 399)] and quality.chosen_runs(0, 7, 400) == [(0, 0)]


def test_rare_labels_are_learnt(spark):
    rows = [(i, "A plain sentence of words.\nAnother one follows it.") for i in range(600)] + [(1000 + i, "$$$ !!! 999\n$$$ @@@ 777") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, max_rows=40, max_lines=200)
    assert model["weight"] is not None
    scores = {r.doc_id: r["__score"] for r in quality.score(docs, model).collect()}
    assert min(scores[i] for i in range(600)) > 0.7 > max(scores[1000 + i] for i in range(4))


def test_a_long_text_in_bounded_memory():
    text = pa.array(["word and more words, 12 of them.\n" * 60_000])
    tracemalloc.start()
    quality.line_bins(*quality.binary_buffer(text))
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
