"""The pipeline's stages, one after another, against plain versions of each."""

import collections
import re

import numpy as np
import public_tokenizers
import pytest
from test_language_and_quality import enumerated
from test_near_dedup import truth
from test_operators import base_spans, check_pieces

import corpus_pipeline
from codemap_spark.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good and junk texts, exact and near copies, secrets, null and repeated ids."""
    rng = np.random.default_rng(11)
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "rd", "st", "ll", "ng")]

    def prose(n):
        text = " ".join(rng.choice(words, n))
        return ". ".join(s.capitalize() for s in re.findall(r"(?:\S+ ?){1,9}", text)).replace(" .", ".") + "."

    rows, label = [], {}
    for i in range(60):
        rows.append((i, f"{prose(60)}\n{prose(50)}"))
        label[i] = 1
    for i in range(60, 100):
        rows.append((i, "\n".join("$$$ " + " ".join(map(str, rng.integers(0, 99999, 6))) + " !!! @@@" for _ in range(4))))
        label[i] = 0
    texts = dict(rows)
    rows += [(200, texts[3].upper()), (201, texts[3]), (None, texts[3]), (None, texts[4] + " More."), (None, texts[4] + " More."), (202, texts[5]), (202, texts[5])]
    rows += [(210 + k, texts[6 + k].replace(texts[6 + k].split()[20], "changed", 1)) for k in range(5)]
    rows += [(220, f"{texts[20]} password: hunter22 {texts[21]}"), (221, None), (222, ""), (None, None)]
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in label.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), str(folder)


def rows_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, corpus):
    docs, folder = corpus
    columns = docs.columns
    # quality: what the enumerated field scores at least 0.7
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = collections.Counter()
    for (i, t), n in rows_of(docs).items():
        score = enumerated(model, t) if t and t.strip() else model["prior"]
        if score >= 0.7:
            want[i, t] += n
    good = corpus_pipeline.keep_quality(spark, docs, folder)
    assert good.columns == columns and rows_of(good) == want and all(want[i, t] for (i, t) in rows_of(docs) if i is not None and i < 60) and not any(want[i, t] for (i, t) in want if i is not None and 60 <= i < 100)
    good = spark.createDataFrame(good.collect(), good.schema)
    # exact dedup: of equal texts the largest id, null ids smallest, one row
    best = {}
    for i, t in rows_of(good):
        key = (t or "").lower()
        if key not in best or (-1 if i is None else i) > (-1 if best[key][0] is None else best[key][0]):
            best[key] = (i, t)
    exact = corpus_pipeline.keep_exact(spark, good, folder)
    found = rows_of(exact)
    assert exact.columns == columns and set(found.values()) == {1} and {(i, (t or "").lower()) for i, t in found} == {(i, k) for k, (i, _) in best.items()}
    exact = spark.createDataFrame(exact.collect(), exact.schema)
    # near dedup: one document of each class
    ordered = sorted(rows_of(exact), key=lambda x: (x[0] is None, x[0] or 0))
    classes, _ = truth([t for _, t in ordered])
    near = corpus_pipeline.keep_near(spark, exact, folder)
    assert near.columns == columns and rows_of(near) == collections.Counter(ordered[c] for c in set(classes))
    assert near.count() < exact.count()
    near = spark.createDataFrame(near.collect(), near.schema)
    # secrets: base spans replaced, here no other kinds stand
    clean = corpus_pipeline.redact_secrets(spark, near, folder)
    cut = collections.Counter()
    for (i, t), n in rows_of(near).items():
        out = t
        for kind, a, b in reversed([s.split(":") for s in base_spans(t or "")]):
            out = out[: int(a)] + "[SECRET]" + out[int(b) :]
        cut[i, out] += n
    assert clean.columns == columns and rows_of(clean) == cut and any("[SECRET]" in (t or "") for _, t in cut)
    assert all(r.n_chars == len(r.text) for r in clean.collect() if r.text is not None)
    clean = spark.createDataFrame(clean.where("doc_id IS NOT NULL").collect(), clean.schema)
    # packing: each document's tokens once, in full sequences
    check_pieces(corpus_pipeline.pack_sequences(spark, clean, folder).collect(), [(r.doc_id, r.text) for r in clean.collect()])


def test_run_and_empty_table(spark, corpus, tmp_path):
    docs, folder = corpus
    rows = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(rows.columns)
    assert len({r.sequence_id for r in rows.collect()}) > 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "secret scan", "packing"] and public_tokenizers.path("byte_bpe_50k.json")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
