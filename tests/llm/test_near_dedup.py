"""Near duplicates against brute force under true TF-IDF weights."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest

from codemap_spark.llm import near_dedup


def truth(texts, similarity=0.8):
    """(class of every text, pairs by similarity) of texts compared all with all."""
    counts = []
    for t in texts:
        w = (t or "").lower().split()
        counts.append(collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter())
    df = collections.Counter(s for c in counts for s in c)
    idf = {s: math.log1p(len(texts) / n) for s, n in df.items()}
    holders = collections.defaultdict(set)
    for i, c in enumerate(counts):
        for s in c:
            holders[s].add(i)
    parent, pairs = list(range(len(texts))), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, c in enumerate(counts):
        for j in {j for s in c for j in holders[s] if j > i}:
            both = c.keys() | counts[j].keys()
            pairs[i, j] = sum(min(c[s], counts[j][s]) * idf[s] for s in both) / sum(max(c[s], counts[j][s]) * idf[s] for s in both)
            if pairs[i, j] >= similarity:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))], pairs


def corpus(seed):
    """Copies with changed words, around a passage that 40 % of the texts share."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = list(rng.choice(words, 60))
    texts = [None, "", "one two", "ONE two", "one\t two"]
    for g in range(16):
        base = list(rng.choice(words, 120))
        if g % 2:
            base[30:30] = passage
        for _ in range(9):
            copy = list(base)
            for k in rng.integers(0, len(copy), rng.integers(0, 8)):
                copy[k] = str(rng.choice(words))
            texts.append(" ".join(copy))
    return texts


def test_links_like_brute_force(spark):
    texts = corpus(3)
    want, pairs = truth(texts)
    flat = [tuple((t or "").lower().split()) for t in texts]
    found = near_dedup.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    classes = {r.doc_id: r.component_id for r in found}
    assert classes == dict(enumerate(want))
    size = collections.Counter(want)
    assert all(r.group_size == size[r.component_id] and r.kept == (r.doc_id == r.component_id) for r in found)
    # the weights matter: by plain shares of shingles other pairs would link
    plain = sum(0.8 <= len(set(zip(*[flat[i][k:] for k in range(5)])) & set(zip(*[flat[j][k:] for k in range(5)]))) / len(set(zip(*[flat[i][k:] for k in range(5)])) | set(zip(*[flat[j][k:] for k in range(5)]))) for i, j in pairs if len(flat[i]) > 4 and len(flat[j]) > 4)
    assert plain != sum(s >= 0.8 for s in pairs.values())


def test_frequencies_and_blocks(spark, monkeypatch):
    """Frequencies come back exactly, over many blocks, ranges and tasks."""
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000)
    texts = [t or "" for t in corpus(5)] * 2
    source = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    dealt = near_dedup._deal(source, 7)
    rows = near_dedup._signed(dealt, near_dedup._frequencies(dealt, 11), len(texts)).collect()
    distinct = {near_dedup._digest(t) for t in texts} - {None}
    assert len(rows) == len(distinct) == len({r.node for r in rows}) and {bytes(r.digest) for r in rows} == distinct
    df = collections.Counter()
    for t in texts:
        terms = near_dedup.Terms(*near_dedup.binary_buffer(pa.array([t.encode()])))
        df.update(terms.hashes.tolist())
    for r in rows:
        terms = near_dedup.Terms(*near_dedup.binary_buffer(pa.array([r.text.encode()])))
        assert near_dedup._large(r.frequencies, len(terms.hashes)).tolist() == [df[h] for h in terms.hashes.tolist()]


def test_sampling_estimates_weighted_similarity():
    """Single samples agree about as often as the weighted similarity says."""
    rng = np.random.default_rng(8)
    n, pairs = 400, 60
    agree, expected = [], []
    for _ in range(pairs):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        w = rng.uniform(0.5, 12, n)
        keep = rng.random(n) < 0.9
        w2 = np.where(rng.random(n) < 0.1, w * 1.5, w)[keep]
        one = near_dedup.signatures(h, np.zeros(n, np.int64), w, 12.5, 1)
        two = near_dedup.signatures(h[keep], np.zeros(keep.sum(), np.int64), w2, 12.5, 1)
        agree.append((one == two).mean())
        full = np.zeros(n)
        full[keep] = w2
        expected.append((np.minimum(w, full).sum() / np.maximum(w, full).sum()) ** near_dedup.ROWS)
    assert abs(np.mean(agree) - np.mean(expected)) < 0.06


def test_edges(spark):
    texts = [(1, None), (None, "a b c d e f"), (None, "A b c d e f"), (7, "a b  c d e f"), (7, "other words in this one here"), (7, "other words in this one here"), (None, None), (None, "only one of its kind here")]
    df = spark.createDataFrame([(*r, 1, "x") for r in texts], "doc_id long, text string, node int, digest string")
    rows = near_dedup.near_duplicate_groups(df).collect()
    assert len(rows) == len(texts)
    by = collections.Counter((r.doc_id, r.component_id, r.group_size, r.kept) for r in rows)
    assert by == {(1, 1, 1, True): 1, (None, 7, 3, False): 2, (7, 7, 3, True): 1, (7, 7, 2, True): 1, (7, 7, 2, False): 1, (None, None, 1, True): 2}
    assert near_dedup.near_duplicate_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_recall_at_the_threshold(spark, seed):
    """Of the pairs at 0.8 to 0.85 nearly all share a band."""
    rng = np.random.default_rng(seed)
    shared = hit = 0
    for _ in range(150):
        h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        w = rng.uniform(4, 12, 300)
        keep = np.sort(rng.permutation(300)[:246])
        similarity = w[keep].sum() / w.sum()
        if not 0.8 <= similarity < 0.85:
            continue
        one, two = (near_dedup.signatures(x, np.zeros(len(x), np.int64), y, 12.5, 1) for x, y in ((h, w), (h[keep], w[keep])))
        shared += 1
        hit += bool((one == two).any())
    assert shared > 50 and hit / shared >= 0.99


def test_a_group_of_copies_keeps_its_links(spark):
    """Copies with six words of 200 changed link at 0.7 however many there are;
    from 0.5 on, as in the queries, so do copies with one in twenty changed."""
    rng = np.random.default_rng(4)
    filler = [" ".join(f"f{i}x{k}" for k in range(6)) for i in range(8000)]
    base = [f"b{k}" for k in range(200)]

    def group(name, size, edits):
        words = [f"{name}{w}" for w in base]
        out = [" ".join(words)]
        for c in range(size):
            copy = list(words)
            for k in 5 + 190 // edits * np.arange(edits) + rng.integers(0, 4):
                copy[k] = f"new{name}{c}k{k}"
            out.append(" ".join(copy))
        return out

    texts = group("a", 1, 6) + group("c", 20, 6) + group("d", 20, 10) + filler
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    classes = {r.doc_id: r.component_id for r in near_dedup.near_duplicate_groups(rows, similarity=0.7).collect()}
    assert all(classes[k] == 0 for k in range(2)) and all(classes[k] == 2 for k in range(2, 23))
    assert all(classes[k] == k for k in range(23, len(texts)))
    edited = {r.doc_id: r.component_id for r in near_dedup.near_duplicate_groups(rows, similarity=near_dedup.EDITED).collect()}
    assert all(edited[k] == 23 for k in range(23, 44)) and all(edited[k] == k for k in range(44, len(texts)))


def test_long_documents_without_a_common_shingle_share_no_sample():
    """The pool has 65,536 entries: two of 20,000 shingles have many in common."""
    rng = np.random.default_rng(4)
    w = np.full(20_000, 5.0)
    shared = 0
    for _ in range(12):
        a, b = (near_dedup.signatures(np.sort(rng.integers(0, 1 << 63, len(w), dtype=np.uint64)), np.zeros(len(w), np.int64), w, 5.0, 1) for _ in range(2))
        shared += int((a == b).sum())
    assert shared == 0
