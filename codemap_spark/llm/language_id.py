"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a trigram's vector binds
(multiplies) its letters' vectors, permuted by position; a document's vector
bundles (adds) those of its trigrams.  A language's prototype bundles the unit
vectors of its learning documents.  A document is compared with the prototypes
by cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import held_out, prepare, slices

DIMENSIONS = 1024
SEED = 77


#: Trigram vectors that are held at once.
GRAMS = 4096


@lru_cache(maxsize=16_384)
def letter_vector(code: int) -> np.ndarray:
    """Letter vector of a code point; 0 is the word boundary."""
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1


def document_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, has a letter) of texts; zeros where no letter is.

    The vectors of GRAMS distinct trigrams at a time are held, whatever the
    texts' alphabets."""
    n = len(texts)
    joined = "\n".join(["", *texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    present = np.unique(codes) if len(codes) and codes.max() > 1 << 17 else np.flatnonzero(np.bincount(codes))
    letters = np.array([int(c) for c in present if chr(c).isalpha()], np.int64)
    table = np.zeros(int(present.max()) + 1, np.int32)
    table[letters] = np.arange(1, len(letters) + 1)
    symbol, k = table[codes], len(letters) + 1
    lengths = np.fromiter(map(len, texts), np.int64, n)
    begin = np.cumsum(lengths + 1) - lengths
    document = np.zeros(len(codes), np.int32)
    document[begin[1:] - 1] = 1
    document = np.cumsum(document, dtype=np.int32)
    a, b, c = symbol[:-2], symbol[1:-1], symbol[2:]
    on = np.flatnonzero((b > 0) & ((a > 0) | (c > 0)))
    has = np.zeros(n, bool)
    has[document[np.flatnonzero(symbol)]] = True
    out = np.zeros((n, DIMENSIONS), np.float32)
    if not len(on):
        return out, has
    gram, where = (a[on].astype(np.int64) * k + b[on]) * k + c[on], document[on + 1]
    if k**3 <= 1 << 24:
        seen = np.flatnonzero(np.bincount(gram, minlength=1))
        place = np.zeros(int(seen[-1]) + 1, np.int32)
        place[seen] = np.arange(len(seen))
        at = place[gram]
    else:
        seen, at = np.unique(gram, return_inverse=True)
    step = (1 << 22) // GRAMS
    if len(seen) > GRAMS:
        order = np.argsort(at // GRAMS, kind="stable")  # documents stay in order within a block
        at, where = at[order], where[order]
    cuts = np.searchsorted(at // GRAMS, np.arange(-(-len(seen) // GRAMS) + 1))
    known = np.append(0, letters)
    for g in range(len(cuts) - 1):
        part = seen[g * GRAMS : (g + 1) * GRAMS]
        used, spot = np.unique(np.stack([part // (k * k), part // k % k, part % k]), return_inverse=True)
        vectors = np.stack([letter_vector(int(x)) for x in known[used]])
        spot = spot.reshape(3, -1)
        grams = np.roll(vectors, 2, 1)[spot[0]]
        grams *= np.roll(vectors, 1, 1)[spot[1]]
        grams *= vectors[spot[2]]
        grams = grams.astype(np.float32)
        own_at, own = at[cuts[g] : cuts[g + 1]] - g * GRAMS, where[cuts[g] : cuts[g + 1]]
        bounds = np.searchsorted(own, np.arange(0, n + step, step))
        for i, first in enumerate(range(0, n, step)):
            if bounds[i] < bounds[i + 1]:
                m, rows = min(step, n - first), slice(bounds[i], bounds[i + 1])
                counts = np.bincount((own[rows] - first).astype(np.int64) * len(part) + own_at[rows], minlength=m * len(part)).reshape(m, len(part))
                out[first : first + m] += counts.astype(np.float32) @ grams
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out, has


def _vectors(batch) -> tuple[np.ndarray, np.ndarray]:
    lowered = pc.utf8_lower(pc.fill_null(batch.column("text"), ""))
    return document_vectors(lowered.to_pylist())


def fit(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_rows: int = 16_384) -> tuple[list[str], np.ndarray]:
    """(languages in order, unit prototypes) from labelled rows: of each
    language at most about its even share of ``max_rows``, chosen by a hash of
    the id, and all rows of a rarer one; what comes to the driver is one row
    per language, and one per language and dimension."""
    prepare(docs.sparkSession)
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    shares = {lang: int(max_rows / len(counts) / n * (1 << 30)) for lang, n in counts.items() if n * len(counts) > max_rows}
    if shares:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang")), F.lit(1 << 30))
        known = known.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) < share)

    def bundle(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            vectors, has = _vectors(batch)
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            for lang in set(langs[has]):
                part = vectors[(langs == lang) & has].astype(np.float64).sum(0)
                total[lang] = total[lang] + part if lang in total else part
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS), pa.int32()), pa.array(vector)], names=["lang", "dim", "value"])

    # a row per language and dimension reaches the driver; sums are rounded so that their order doesn't show
    rows = known.mapInArrow(bundle, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r.lang for r in rows})
    prototypes = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        prototypes[langs.index(r.lang), r.dim] = round(r.value, 6)
    return langs, prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, one row per input row.

    The score is the cosine with the nearest prototype, at least 0; ties go to
    the first language in order.  Null, empty and letterless texts, or no
    prototypes at all, give ``und`` and 0.  Other columns aren't read.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    # as doubles over a mean of all prototypes, what languages share falls away
    centre = prototypes.mean(0) if len(langs) > 1 else np.zeros(DIMENSIONS)
    directions = prototypes - centre
    directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-12)
    names = np.asarray([*langs, "und"], object)

    def run(batches):
        for batch in slices(batches, "text"):
            vectors, has = _vectors(batch)
            cosine = vectors.astype(np.float64)
            cosine -= centre * has[:, None]
            cosine /= np.maximum(np.linalg.norm(cosine, axis=1, keepdims=True), 1e-12)
            cosine = cosine @ directions.T
            best = cosine.argmax(1) if langs else np.zeros(len(has), np.int64)
            score = np.where(has & bool(langs), np.clip(cosine[np.arange(len(has)), best], 0, 1) if langs else 0.0, 0.0)
            best = np.where(has & bool(langs), best, len(langs))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Learn from the rows that aren't held out, predict all: id, held_out,
    lang_pred, score.  An empty table gives an empty one."""
    langs, prototypes = fit(docs.where(~held_out(id_col)), label_col, text_col, id_col)
    return predict(docs, langs, prototypes, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
