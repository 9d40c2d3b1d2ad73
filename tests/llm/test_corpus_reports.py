"""Filter audit, line dedup and collocations against plain versions, and their
defined results at the edges."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import parity
import pytest

from codemap_spark.llm import collocations, common, filter_audit, line_dedup, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, part string, word string, n int, document string, keep string"


def frame(spark, rows):
    """Documents of (id, text, lang), with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, g, "s", 1, 7, "p", "w", 3, "d", "k") for i, t, g in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_line_dedup", "op13_phrase_collocations"])
def test_same_rows_as_sql(spark, name):
    assert parity.difference(spark, parity.connection(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF) == ""


WORDS = ["a", "A", "Bb", "x#y", "é", "日本", "dup", "dup", "$", "end.", "|"]


def texts(rng, n):
    out = [None, "", " \t\n\x0b\x0c\r", "x" * 300_000, "word " * 40_000, "W " * 250, " ", "a\x1fb c"]
    for _ in range(n):
        out.append("".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "\t", ", "]) for _ in range(rng.choice([3, 190, 230]))))
    return out + rng.choices(out, k=n)


# ---------------------------------------------------------------- filter audit


def audited(rows, labels):
    """The audit, document by document and order by order."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    judged = []
    for i, t, g in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        judged.append((g or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = collections.defaultdict(lambda: [0] * 7)
    shapley = collections.Counter()
    for part, fails, *_ in judged:
        for order in itertools.permutations("ABCDE"):
            hit = next((f for f in order if f in fails), None)
            shapley[part, hit] += hit is not None
    for part, fails, is_good, is_toxic in judged:
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out[part, "".join(order), step]
                bad = f in fails
                for k, x in enumerate((not gone and not bad, not gone and bad, gone and bad, fails == {f}, not gone and bad and is_good, not gone and bad and is_toxic)):
                    row[k] += x
                row[6] = shapley[part, f]
                gone = gone or bad
    return {(*k, *v) for k, v in out.items()}


def test_audit_like_the_plain_one(spark):
    rng = random.Random(1)
    rows = [(k if k % 17 else None, t, rng.choice(["en", "fr", None, ""])) for k, t in enumerate(texts(rng, 60))]
    rows += rows[:9] + [(3, "another text of a known id", "en")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {tuple(r) for r in filter_audit.audit(frame(spark, rows), marks).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}
    assert found == audited(rows, labels) and len(found) == 3 * 600
    assert filter_audit.audit(frame(spark, []), marks).count() == 0
    assert filter_audit.audit(frame(spark, rows[:3]), marks.limit(0)).where("good_lost > 0").count() == 0


def test_distinct_words_with_equal_hashes(monkeypatch):
    """Where hashes collide the bytes decide."""
    data = np.frombuffer(b"aa bb aa cc bb aa", np.uint8)
    start, end, document = np.array([0, 3, 6, 9, 12, 15]), np.array([2, 5, 8, 11, 14, 17]), np.array([0, 0, 0, 1, 1, 1])
    monkeypatch.setattr(filter_audit, "substring_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    assert filter_audit.distinct_words(data, start, end, document, 2).tolist() == [2, 3]


# ------------------------------------------------------------------ line dedup


def thinned(rows, least):
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})

    held = collections.defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add((i, t or ""))
    common_keys = {k for k, d in held.items() if k and len(d) >= least}
    out = collections.Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in common_keys]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_lines_like_the_plain_ones(spark):
    rng = random.Random(2)
    common_lines = [" Shared line", "SHARED LINE\t", "é\x0b", "É", " ", "one", ""]
    rows = [(k if k % 9 else None, "\n".join(rng.choice(common_lines + [f"own {k}", "x"]) for _ in range(rng.choice([1, 3, 70, 200]))), "en") for k in range(40)]
    rows += rows[:6] + [(50, None, "en"), (51, "", "en"), (52, "\n\n", "en"), (53, "y\n" * 20_000 + "one", "en"), (1, "one", "en"), (54, "one", "fr")]
    found = line_dedup.drop_common_lines(frame(spark, rows), min_documents=5)
    assert collections.Counter(tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()) == thinned(rows, 5)
    assert line_dedup.drop_common_lines(frame(spark, [])).count() == 0
    assert all(r.n_dropped == 0 and r.keep is None for r in line_dedup.drop_common_lines(frame(spark, rows[:4])).collect())


def test_bitmaps_say_which_lines_stay(spark):
    rows = [(k, "\n".join([f"only {k}-{j}" for j in range(150)] + ["all of them"] + [f"late {k}"]), "en") for k in range(3)]
    for r in line_dedup.keep_bitmaps(frame(spark, rows), min_documents=3).collect():
        assert r.n_dropped == 1 and [(w.word, w.bits & (1 << 64) - 1) for w in r.keep] == [(2, (1 << 64) - 1 - (1 << 150 - 128))]


def test_no_python_in_line_dedup(spark):
    plan = line_dedup.drop_common_lines(frame(spark, [(1, "a", "en")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


# ---------------------------------------------------------------- collocations


def collocated(rows, longest=3, least=10, inside=50, top=2000):
    counts, totals = collections.Counter(), collections.Counter()
    for _, t, g in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[g or "und" if g is None else g] += len(words)
            for k in range(1, longest + 1):
                for a in range(len(words) - k + 1):
                    counts[g or "und" if g is None else g, tuple(words[a : a + k])] += 1
    candidates = {p: n for p, n in counts.items() if len(p[1]) >= 2 and n >= least}
    longer = collections.defaultdict(int)
    for (g, words), n in candidates.items():
        for k in range(2, len(words)):
            for a in range(len(words) - k + 1):
                longer[g, words[a : a + k]] = max(longer[g, words[a : a + k]], n)
    out = collections.defaultdict(list)
    for (g, words), n in candidates.items():
        if (g, words) in longer and 100 * longer[g, words] >= inside * n:
            continue
        cuts = [(10**6 * n * n // (counts[g, words[:k]] * counts[g, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[g].append((-score, -n, " ".join(words).encode(), counts[g, words[:k]], counts[g, words[k:]]))
    return {(g, i, p.decode(), -n, le, r, totals[g], -s) for g, found in out.items() for i, (s, n, p, le, r) in enumerate(sorted(found)[:top], 1)}


PICKS = ["alpha", "Beta", "gamma", "d'Été", "日本", "x", "#", "alpha beta", "New York City", "new york"]


def spoken(rng, n):
    rows = [(k, " ".join(rng.choice(PICKS) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.choice([0, 5, 60]))), rng.choice(["en", "fr", None])) for k in range(n)]
    return rows + rows[:5] + [(None, None, "en"), (n, "", "de"), (n + 1, ". . .", "it"), (n + 2, "far apart " * 30_000, "la"), (n + 3, "aa " * 40, "qq"), (n + 4, "end", "en"), (n + 5, "alpha beta", "und")]


@pytest.mark.parametrize("block, longest", [(6 << 20, 3), (1, 4)])
def test_collocations_like_the_plain_ones(spark, monkeypatch, block, longest):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    rows = spoken(random.Random(3), 60)
    found = collocations.collocations(frame(spark, rows), max_words=longest, min_count=4, top=40)
    assert {tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == collocated(rows, longest, 4, top=40)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, "en"), (2, "one two", "en")])).count() == 0


def test_positions_keep_pieces_apart():
    import pyarrow as pa

    data, offsets = common.binary_buffer(pa.array(["a b,c", "", "d e", None, "f;;g \n"]))
    start, end, position = collocations.words_with_positions(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end, strict=True)] == list("abcdefg")
    assert (np.diff(position) == 1).tolist() == [True, False, False, True, False, False]
