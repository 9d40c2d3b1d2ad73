"""Document quality from a linear-chain conditional random field over lines.

Each line has measures (shares of capitals, digits and symbols, word lengths,
distinct words, repeats of its line, ...), cut into bins; the bins of the line
and of its neighbours are its features.  The chain's two states are good and
bad.  Forward-backward gives every line's marginal probability of good, and a
document's score is their mean, weighted by line length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binary_buffer, codes_of, held_out, prepare, slices, splitmix
from .textarrays import LETTER, OTHER, byte_classes, substring_hashes, words_of

#: Bin bounds of every measure.
MEASURES: dict[str, tuple[float, ...]] = {
    "capitals": (0.001, 0.02, 0.05, 0.1, 0.3, 0.6, 0.9),
    "digits": (0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "symbols": (0.005, 0.02, 0.05, 0.1, 0.15, 0.25, 0.4),
    "word_length": (2, 3, 4, 5, 6, 8, 12),
    "size": (8, 20, 40, 80, 160, 400, 1000),
    "distinct": (0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 0.97),
    "next_same": (0.001, 0.02, 0.05, 0.1, 0.3, 0.6, 0.9),
    "symbol_ends": (0.02, 0.08, 0.15, 0.25, 0.4, 0.6, 0.85),
    "double_symbols": (0.001, 0.02, 0.05, 0.1, 0.3, 0.6, 0.9),
    "lone_symbols": (0.001, 0.02, 0.05, 0.1, 0.2, 0.3, 0.45),
    "repeated_line": (0.5,),
    "sentence_end": (0.5,),
}
BINS = 8
FEATURES = len(MEASURES) * BINS * 3 + 1  # own, previous, next; and one for no neighbour
#: Lines that follow one another and are learnt from together, in a long text.
RUN_LINES = 50


def line_bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of every line with a word, byte length of it, document of it)."""
    start, end, document = words_of(data, offsets)
    if not len(start):
        return np.zeros((0, len(MEASURES)), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    newline = np.append(0, np.cumsum(data == 0x0A))
    # a line is a run of words with the same document and count of newlines before them
    key = newline[start]
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(new)
    line = np.cumsum(new) - 1
    n = len(first)
    begin, stop = start[first], end[np.append(first[1:], len(start)) - 1]
    cls = byte_classes(data)

    def total(mask) -> np.ndarray:
        c = np.append(0, np.cumsum(mask))
        return c[stop] - c[begin]

    upper = (data >= 0x41) & (data <= 0x5A)
    accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
    upper[accent] = True
    chars = np.maximum(1, total((data & 0xC0) != 0x80))
    letters = total((cls == LETTER) & ((data & 0xC0) != 0x80))
    words = np.bincount(line, minlength=n)
    hashes = substring_hashes(data, start, end)
    with np.errstate(over="ignore"):
        codes, uniques = codes_of(splitmix(hashes ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    first_of = np.zeros(len(uniques), np.int64)
    first_of[codes] = line
    same_next = np.zeros(len(start), bool)
    same_next[:-1] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    last, before = end - 1, np.maximum(start, end - 2)
    ends_symbol = cls[last] == OTHER
    double = ends_symbol & (cls[before] == OTHER) & (end - start > 2)
    lone = ends_symbol & (end - start == 1)
    line_hash = np.add.reduceat(splitmix(hashes + np.uint64(1)), first)
    _, place, copies = np.unique(splitmix(line_hash ^ document[first].astype(np.uint64)), return_inverse=True, return_counts=True)
    values = {
        "capitals": total(upper) / np.maximum(1, letters),
        "digits": total((data >= 0x30) & (data <= 0x39)) / chars,
        "symbols": total((cls == OTHER)) / chars,
        "word_length": (letters + 0.0) / words,
        "size": stop - begin,
        "distinct": np.bincount(first_of, minlength=n) / words,
        "next_same": np.bincount(line, same_next, n) / words,
        "symbol_ends": np.bincount(line, ends_symbol, n) / words,
        "double_symbols": np.bincount(line, double, n) / words,
        "lone_symbols": np.bincount(line, lone, n) / words,
        "repeated_line": copies[place] > 1,
        "sentence_end": np.isin(data[stop - 1], np.frombuffer(b".!?", np.uint8)),
    }
    bins = np.stack([np.searchsorted(MEASURES[m], v, "right") for m, v in values.items()], 1).astype(np.uint8)
    return bins, stop - begin, document[first]


def feature_index(bins: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Indices of each line's features: its own bins and its neighbours'."""
    n, m = bins.shape
    own = bins + np.arange(m) * BINS
    out = np.full((n, 3 * m), FEATURES - 1, np.int32)
    out[:, :m] = own
    if n > 1:
        same = document[1:] == document[:-1]
        out[1:, m : 2 * m][same] = own[:-1][same] + m * BINS
        out[:-1, 2 * m :][same] = own[1:][same] + 2 * m * BINS
    return out


def chain_marginals(score: np.ndarray, size: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains of two states at once.

    ``score``: log-potential of good over bad per line; ``size``: lines of each
    chain, in order; ``transition``: 2 x 2 log-potentials.  Returns each line's
    marginal of good, expected transitions summed over chains, and the sum of
    the chains' log partition functions.
    """
    order = np.argsort(-size, kind="stable")
    first = np.append(0, np.cumsum(size))[:-1][order]
    long = size[order]
    longest = int(long[0]) if len(long) else 0
    alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    active = np.searchsorted(-long, -np.arange(1, longest + 1), "right")  # chains with over t lines
    for t in range(longest):
        at = first[: active[t]] + t
        if t:
            back = alpha[at - 1]
            alpha[at, 0] = np.logaddexp(back[:, 0] + transition[0, 0], back[:, 1] + transition[1, 0])
            alpha[at, 1] = np.logaddexp(back[:, 0] + transition[0, 1], back[:, 1] + transition[1, 1])
        alpha[at, 1] += score[at]
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        ahead = beta[at + 1]
        good = ahead[:, 1] + score[at + 1]
        beta[at, 0] = np.logaddexp(transition[0, 0] + ahead[:, 0], transition[0, 1] + good)
        beta[at, 1] = np.logaddexp(transition[1, 0] + ahead[:, 0], transition[1, 1] + good)
    total = alpha + beta
    z = np.logaddexp(total[:, 0], total[:, 1])
    pairs = np.zeros((2, 2))
    follow = np.ones(len(score), bool)
    follow[first] = False
    at = np.flatnonzero(follow)
    for i in range(2):
        for j in range(2):
            pairs[i, j] = np.exp(alpha[at - 1, i] + transition[i, j] + beta[at, j] + (score[at] if j else 0) - z[at]).sum()
    return np.exp(total[:, 1] - z), pairs, float(z[first].sum())


def fit_field(index: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int = 120, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by Adam on the mean log-likelihood per line;
    every line of a document carries its label."""
    target = np.repeat(label, size).astype(float)
    starts = np.append(0, np.cumsum(size))[:-1]
    follow = np.ones(len(target), bool)
    follow[starts] = False
    at = np.flatnonzero(follow)
    seen = np.zeros((2, 2))
    np.add.at(seen, (target[at - 1].astype(int), target[at].astype(int)), 1)
    theta = np.zeros(FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n = len(target)
    for step in range(1, rounds + 1):
        weight, transition = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        good, pairs, _ = chain_marginals(weight[index].sum(1), size, transition)
        grad = np.bincount(index.ravel(), np.repeat(good - target, index.shape[1]), FEATURES)
        grad = np.append(grad, (pairs - seen).ravel()) / n + penalty * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta -= 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[:FEATURES], theta[FEATURES:].reshape(2, 2)


def chosen_runs(lines: int, id_: int, most: int, run: int = RUN_LINES) -> list[tuple[int, int]]:
    """Bounds of the runs of a text's lines to learn from: all of them, or the
    ``most // run`` runs of least hash of (id, place), wherever they stand."""
    if lines <= most:
        return [(0, lines)]
    starts = np.arange(0, lines, run)
    order = np.argsort(splitmix(splitmix(np.array([id_], np.int64).view(np.uint64)) ^ starts.astype(np.uint64)), kind="stable")
    return [(int(a), min(int(a) + run, lines)) for a in sorted(starts[order[: max(1, most // run)]].tolist())]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4_096, max_lines: int = 120_000, text_lines: int = 400
) -> dict:
    """Fit on a bounded sample of the labelled documents that aren't held out.

    Of each label at most about ``max_rows`` / 2 documents, chosen by a hash of
    the id (all of a rarer label), and ``max_lines`` / 2 lines; of one text at
    most ``text_lines`` lines, in runs of RUN_LINES from anywhere in it, each a
    chain of its own.  The lines' bins, not the texts, come to the driver.

    Repeated labels of an id count by their minimum; labels other than 0 and 1
    or null are left out.  Without both labels the score is their prior.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
    known = known.where(~held_out(id_col))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, int(min(1.0, max_rows / 2 / n) * (1 << 20))).otherwise(share)
    known = known.where(F.pmod(F.xxhash64(F.lit(9), id_col), F.lit(1 << 20)) < share)
    # at most about max_rows ids: small enough to send to every task
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(known), id_col).select(F.col(id_col).cast("bigint").alias("id"), "label", "text")

    def measure(batches):
        for batch in slices(batches, "text"):
            bins, _, document = line_bins(*binary_buffer(batch.column("text")))
            cut = np.searchsorted(document, np.arange(batch.num_rows + 1)).tolist()
            rows = []
            for id_, label, a, b in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), cut[:-1], cut[1:], strict=True):
                rows += [(id_, label, c, bins[a + c : a + d].tobytes()) for c, d in chosen_runs(b - a, id_, text_lines)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["id", "label", "at", "bins"])

    rows = chosen.mapInArrow(measure, "id bigint, label int, at int, bins binary").collect()
    rows = sorted(rows, key=lambda r: (splitmix(np.array([r.id], np.int64).view(np.uint64))[0], r.id, r.at, r.bins))
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    held, size, label, lines = [], [], [], {0: 0, 1: 0}
    for r in rows:
        bins = np.frombuffer(r.bins, np.uint8).reshape(-1, len(MEASURES))
        # whole runs in order of the ids' hashes until a label has its lines, so long texts fare like others
        if len(bins) and lines[r.label] < max_lines // 2:
            held.append(bins)
            size.append(len(bins))
            label.append(r.label)
            lines[r.label] += len(bins)
    if len(set(label)) < 2:
        return {"prior": prior, "weight": None, "transition": None}
    size_of = np.asarray(size)
    index = feature_index(np.concatenate(held), np.repeat(np.arange(len(size_of)), size_of))
    weight, transition = fit_field(index, size_of, np.asarray(label))
    return {"prior": prior, "weight": weight, "transition": transition}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score, predicted, and the kept columns: one row per input row.

    A text without a word (null and empty ones too) scores the prior share of
    good labels.  Only the text enters the score; an empty table gives an empty
    one; there is no shuffle.
    """
    prepare(docs.sparkSession)
    names = list(dict.fromkeys([id_col, *keep]))
    fields = [docs.schema[c] for c in names]

    def run(batches):
        for batch in slices(batches, "__text"):
            data, offsets = binary_buffer(batch.column("__text"))
            bins, length, document = line_bins(data, offsets)
            out = np.full(batch.num_rows, model["prior"])
            if len(bins) and model["weight"] is not None:
                size = np.bincount(document, minlength=batch.num_rows)
                good, _, _ = chain_marginals(model["weight"][feature_index(bins, document)].sum(1), size[size > 0], model["transition"])
                weight = np.bincount(document, length, batch.num_rows)
                out = np.where(size > 0, np.bincount(document, good * length, batch.num_rows) / np.maximum(weight, 1), out)
            out = np.clip(out, 0, 1)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.float64()), pa.array((out >= threshold).astype(np.int32))], names=[*names, "__score", "__predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, f"{schema}, __score double, __predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learn from labelled rows that aren't held out, score all: id, held_out,
    score, predicted."""
    scored = score(docs, fit(docs, labels, id_col), id_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))
