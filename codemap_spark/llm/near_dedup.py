"""Near-duplicate documents by improved consistent weighted sampling.

A document's elements are its shingles of five words, weighted by term
frequency times inverse document frequency, ln(1 + documents / df), where a df
under a thousandth of the documents counts as that: a text's copies would
otherwise lower the weights of what they share, and a group's links with it.
Consistent weighted samples (Ioffe 2010) agree with a probability equal to the
weighted Jaccard similarity; bands of them give candidates, which are verified
by exact weighted Jaccard similarity under the same weights.

Document frequencies are exact and count every row.  Texts are dealt into
blocks by a digest of their words, equal ones as one with a count; a block
sends the distinct hashes of its shingles, with how many of its rows hold them,
to the owners of hash ranges, and gets every shingle's document frequency back.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import binary_buffer, by_bytes, codes_of, discard, join_counted, materialise, prepare, release, slices, splitmix, trim
from .components import components
from .textarrays import substring_hashes, words_of

WORDS, SIMILARITY = 5, 0.8
#: Similarity from which the queries take a text for an edited copy: an edit in
#: twenty words leaves two copies of one text with half of their shingles.
EDITED = 0.5
BANDS, ROWS = 24, 3
#: Share of the documents up to which all shingles weigh alike.
RARE = 0.001
POOL_BITS = 16
#: Bytes of text of a block, shingles of an owner's range, and bytes that a
#: task holds before it sends texts on.
BLOCK_BYTES, RANGE_SHINGLES, HELD_BYTES = 3 << 20, 1 << 20, 8 << 20
#: Most members of a hub's group that are compared with it in one task.
STAR_ROWS = 256


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every shingle, in order, of lower-cased words
    between ASCII white space; under five words the whole text is one."""
    lower = data + (((data >= 0x41) & (data <= 0x5A)) * np.uint8(32))
    start, end, document = words_of(lower, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = splitmix(substring_hashes(lower, start, end))
    odd = [np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1) for k in range(WORDS)]
    n, m = len(word), max(0, len(word) - WORDS + 1)
    with np.errstate(over="ignore"):
        full = np.zeros(m, np.uint64)
        for k in range(WORDS):
            full += word[k : k + m] * odd[k]
        on = document[:m] == document[WORDS - 1 :] if m else np.zeros(0, bool)
        first = np.flatnonzero(np.append(True, document[1:] != document[:-1]))
        count = np.diff(np.append(first, n))
        short = np.flatnonzero(count < WORDS)
        whole = np.zeros(len(short), np.uint64)
        for k in range(WORDS - 1):
            at = np.minimum(first[short] + k, n - 1)
            whole += np.where(count[short] > k, word[at] * odd[k], np.uint64(0))
    hashes = np.concatenate([splitmix(full[on]), splitmix(whole + np.uint64(7))])
    of = np.concatenate([document[:m][on], document[first[short]]])
    order = np.argsort(of, kind="stable") if len(short) else slice(None)
    return hashes[order], of[order]


class Terms:
    """Distinct shingles of documents, in order of document and hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        hashes, document = shingles(data, offsets)
        order = np.argsort(hashes)
        document = document[order]
        narrow = document.astype(np.uint16) if len(offsets) <= 1 << 16 else document
        again = np.argsort(narrow, kind="stable")  # of few bits: a radix sort
        hashes, document = hashes[order[again]], document[again]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])
        first = np.flatnonzero(new)
        self.hashes, self.document = hashes[first], document[first]
        self.tf = np.diff(np.append(first, len(hashes)))
        self.bounds = np.searchsorted(self.document, np.arange(len(offsets)))


def _small(values: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them; empty if all are 1."""
    most = int(values.max()) if len(values) else 1
    if most == 1 and (not len(values) or values.min() == 1):
        return b""
    return values.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * np.dtype(t).itemsize)).tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``_small``."""
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if raw else np.ones(n, np.int64)


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the byte planes of their gaps, for the shuffle's compression."""
    gaps = np.diff(hashes, prepend=np.uint64(0))
    return gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def idf(frequency: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p(documents / np.maximum(frequency, RARE * documents))


@lru_cache(maxsize=2)
def _variates(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Odd multipliers, and r, ln c, beta of every sample and pool entry; made
    row by row, so that no wider copy of a table is ever held."""
    rng = np.random.default_rng(2010)
    odd = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    size = 1 << POOL_BITS
    r, c, beta = (np.empty((samples, size), np.float32) for _ in range(3))
    for j in range(samples):
        r[j], c[j], beta[j] = rng.gamma(2, 1, size), np.log(rng.gamma(2, 1, size)), rng.random(size)
    return odd, r, c, beta


@lru_cache(maxsize=1)
def _base_levels(samples: int, base: float) -> np.ndarray:
    """ln a of every sample and pool entry for the weight ``base``."""
    _, r, c, beta = _variates(samples)
    out = np.empty_like(c)
    for j in range(samples):
        t = np.floor(np.float32(math.log(base)) / r[j] + beta[j])
        out[j] = c[j] - r[j] * (t - beta[j] + 1)
    return out


def signatures(hashes: np.ndarray, document: np.ndarray, weight: np.ndarray, base: float, documents: int) -> np.ndarray:
    """(documents, BANDS) band keys of weighted shingles, ordered by document.

    A sample is the hash and step of the element that minimises
    ln a = ln c - r (t - beta + 1), t = floor(ln S / r + beta), the first by hash
    of equal ones.  Elements share a pool of variates, so its entry isn't enough:
    long documents without a common shingle have many entries in common.  Those
    with the weight ``base``, that of a rare shingle found once in its document,
    take a from a table.
    """
    samples = BANDS * ROWS
    odd, r, c, beta = _variates(samples)
    levels = _base_levels(samples, base)
    first = np.flatnonzero(np.append(True, document[1:] != document[:-1]))
    size = np.diff(np.append(first, len(hashes)))
    log_weight = np.log(weight).astype(np.float32)
    other = np.flatnonzero(weight != base)
    other_weight = log_weight[other]
    keys = np.zeros((documents, BANDS), np.uint64)
    sample_keys = np.zeros((samples, len(first)), np.uint64)

    def level(j, entry, log_s):
        width = r[j][entry]
        t = np.floor(log_s / width + beta[j][entry])
        return c[j][entry] - width * (t - beta[j][entry] + 1), t

    with np.errstate(over="ignore"):
        for j in range(samples):
            entry = ((hashes * odd[j]) >> np.uint64(64 - POOL_BITS)).astype(np.uint16)
            a = levels[j][entry]
            if len(other):
                a[other] = level(j, entry[other], other_weight)[0]
            least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), size))
            best = least[np.searchsorted(least, first)]  # the first of each document's least
            _, t = level(j, entry[best], log_weight[best])
            sample_keys[j] = splitmix(splitmix(hashes[best] + np.uint64(j)) ^ t.astype(np.int64).view(np.uint64))
        for b in range(BANDS):
            key = np.full(len(first), b + 1, np.uint64)
            for j in range(b * ROWS, (b + 1) * ROWS):
                key = splitmix(key ^ sample_keys[j])
            keys[document[first], b] = key
    return keys


def _weighted(texts: pa.Array, frequencies: list[bytes], documents: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes in order, term frequencies, idf) of every document's shingles."""
    out, at = [], 0
    for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
        terms = Terms(*binary_buffer(part.column("text")))
        count = np.empty(len(terms.hashes))
        for k, (a, b) in enumerate(zip(terms.bounds[:-1].tolist(), terms.bounds[1:].tolist(), strict=True)):
            count[a:b] = _large(frequencies[at + k], b - a)
        weight = idf(count, documents)
        out += [(terms.hashes[a:b], terms.tf[a:b], weight[a:b]) for a, b in zip(terms.bounds[:-1], terms.bounds[1:], strict=True)]
        at += part.num_rows
    return out


def similarity_of(left: tuple, right: tuple) -> float:
    """Weighted Jaccard similarity of two documents of ``_weighted``."""
    (h, m, w), (g, n, v) = left, right
    if not len(h) or not len(g):
        return 0.0
    at = np.minimum(np.searchsorted(g, h), len(g) - 1)
    on = np.flatnonzero(g[at] == h)
    common = float((np.minimum(m[on], n[at[on]]) * w[on]).sum())
    return common / max(float(m @ w + n @ v) - common, 1e-300)


def _elements(weighted: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, weights) of documents of ``_weighted``, the k-th occurrence of a
    shingle as an element of its own, so that minimum and maximum are set
    operations."""
    out = []
    for hashes, tf, weight in weighted:
        more = np.flatnonzero(tf > 1)
        if len(more):
            nth = np.concatenate([np.arange(1, k) for k in tf[more].tolist()])
            again = np.repeat(more, tf[more] - 1)
            hashes = np.concatenate([hashes, splitmix(hashes[again] ^ splitmix(nth.astype(np.uint64)))])
            weight = np.concatenate([weight, weight[again]])
        out.append((hashes, weight))
    return out


def _pair_matrix(elements: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of left with right documents; a document
    is (element codes, weights), each element once."""
    codes, _ = codes_of(np.concatenate([e[0] for e in elements]))
    size = np.fromiter((len(e[0]) for e in elements), np.int64, len(elements))
    of = np.repeat(np.arange(len(elements)), size)
    weight = np.concatenate([e[1] for e in elements])
    total = np.bincount(of, weight, len(elements))
    shared = np.bincount(codes)[codes] > 1  # the others can't be common to two
    codes, of, weight = codes[shared], of[shared], weight[shared]
    order = np.argsort(codes, kind="stable")
    codes, of, weight = codes[order], of[order], weight[order]
    codes = np.cumsum(np.append(0, codes[1:] != codes[:-1])) if len(codes) else codes
    common = np.zeros((len(left), len(right)))
    place_left, place_right = np.full(len(elements), -1), np.full(len(elements), -1)
    place_left[left], place_right[right] = np.arange(len(left)), np.arange(len(right))
    step, begin = 4096, 0
    while begin < len(codes):
        base = codes[begin]
        end = int(np.searchsorted(codes, base + step))
        c, o, w = codes[begin:end] - base, of[begin:end], weight[begin:end]
        x, y = np.zeros((len(left), step)), np.zeros((len(right), step))
        on = place_left[o] >= 0
        x[place_left[o[on]], c[on]] = w[on]
        on = place_right[o] >= 0
        y[place_right[o[on]], c[on]] = 1
        common += x @ y.T
        begin = end
    return common / np.maximum(total[left][:, None] + total[right][None, :] - common, 1e-300)


def _digest(text: str | bytes | None) -> bytes | None:
    """Digest of the words of a text, lower-cased; none without a word."""
    raw = text.encode() if isinstance(text, str) else text
    return hashlib.sha256(b" ".join(words)).digest() if raw and (words := raw.lower().split()) else None


def _block(digest: bytes, blocks: int) -> int:
    return int.from_bytes(digest[:6], "big") * blocks >> 48


def _deal(source: DataFrame, blocks: int) -> DataFrame:
    """Distinct texts, by block: block, digests, copies, sizes and the texts
    themselves, compressed.  Copies that meet in a task go out as one."""
    schema = "block int, digests binary, copies binary, sizes binary, texts binary"

    def run(batches):
        codec = pa.Codec("zstd", 1)
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            rows = []
            order = sorted(held)
            begin = 0
            while begin < len(order):
                block, end = _block(order[begin], blocks), begin
                while end < len(order) and _block(order[end], blocks) == block:
                    end += 1
                part = [held[d] for d in order[begin:end]]
                texts = b"".join(x[0] for x in part)
                sizes = np.array([len(x[0]) for x in part], "<i8")
                rows.append((block, b"".join(order[begin:end]), np.array([x[1] for x in part], "<i8").tobytes(), sizes.tobytes(), codec.compress(texts, asbytes=True)))
                begin = end
            for part in by_bytes(rows, lambda r: len(r[1]) + len(r[4])):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], names=["block", "digests", "copies", "sizes", "texts"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                digest = _digest(raw)
                if digest is None:
                    continue
                found = held.get(digest)
                if found:
                    found[1] += 1
                else:
                    held[digest] = [raw, 1]
                    size += len(raw) + 200
                    if size > HELD_BYTES:
                        yield from flush()
                        held, size = {}, 0
        yield from flush()

    return source.select("text").mapInArrow(run, schema)


def _opened(table: pa.Table) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """(digests, copies, texts) of a block, each text once, by digest."""
    codec = pa.Codec("zstd")
    held: dict[bytes, list] = {}
    for digests, copies, sizes, texts in zip(*(table.column(c).to_pylist() for c in ("digests", "copies", "sizes", "texts")), strict=True):
        size = np.frombuffer(sizes, "<i8")
        raw = codec.decompress(texts, int(size.sum()), asbytes=True)
        at = np.append(0, np.cumsum(size)).tolist()
        for k, n in enumerate(np.frombuffer(copies, "<i8").tolist()):
            digest = digests[32 * k : 32 * k + 32]
            if digest in held:
                held[digest][0] += n
                # texts that differ in case or white space only: one of them, whatever the order
                held[digest][1] = min(held[digest][1], raw[at[k] : at[k + 1]])
            else:
                held[digest] = [n, raw[at[k] : at[k + 1]]]
    order = sorted(held)
    return order, np.array([held[d][0] for d in order], np.int64), [held[d][1] for d in order]


def _census(texts: list[bytes]) -> tuple[list[tuple[int, int, Terms]], np.ndarray, np.ndarray, np.ndarray]:
    """A block's runs of texts (first, after the last, terms); its distinct
    hashes in order; the order of all its hashes by hash; and which of those
    are the first of their kind."""
    runs, at = [], 0
    for part in slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])], "text"):
        runs.append((at, at + part.num_rows, Terms(*binary_buffer(part.column("text")))))
        at += part.num_rows
    hashes = np.concatenate([t.hashes for _, _, t in runs])
    order = np.argsort(hashes)
    hashes = hashes[order]
    new = np.append(True, hashes[1:] != hashes[:-1])
    return runs, hashes[new], order, new


def _frequencies(dealt: DataFrame, ranges: int) -> DataFrame:
    """(block, range, frequencies): document frequencies over the corpus of
    each block's distinct shingles, in order of range and hash."""

    def bounds(hashes):
        """Where the ranges begin in sorted hashes."""
        least = [min((k << 64) // ranges + 1, (1 << 64) - 1) if k else 0 for k in range(ranges)]
        return np.append(np.searchsorted(hashes, np.array(least, np.uint64)), len(hashes))

    def send(table: pa.Table) -> pa.Table:
        _, copies, texts = _opened(table)
        runs, hashes, order, new = _census(texts)
        rows = np.concatenate([copies[a:b][terms.document] for a, b, terms in runs])
        rows = np.add.reduceat(rows[order], np.flatnonzero(new))
        at = bounds(hashes).tolist()
        used = [k for k in range(ranges) if at[k] < at[k + 1]]
        return pa.table(
            {
                "range": pa.array(used, pa.int32()),
                "block": pa.array([table.column("block")[0].as_py()] * len(used), pa.int32()),
                "hashes": pa.array([_packed(hashes[at[k] : at[k + 1]]) for k in used], pa.binary()),
                "copies": pa.array([_small(rows[at[k] : at[k + 1]]) for k in used], pa.binary()),
            }
        )

    def count(batches):
        rows, own = [], None

        def settle():
            hashes = [_unpacked(r[1]) for r in rows]
            size = np.array(list(map(len, hashes)))
            copies = np.concatenate([_large(r[2], n) for r, n in zip(rows, size.tolist(), strict=True)])
            hashes = np.concatenate(hashes)
            order = np.argsort(hashes)
            new = np.append(True, np.diff(hashes[order]) != 0)
            total = np.add.reduceat(copies[order], np.flatnonzero(new))
            out = np.empty(len(hashes), np.int64)
            out[order] = total[np.cumsum(new) - 1]
            at = np.append(0, np.cumsum(size)).tolist()
            blobs = [_small(out[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([own] * len(rows), pa.int32()), pa.array(size, pa.int64()), pa.array(blobs, pa.binary())], names=["block", "range", "n", "frequencies"]
            )

        for batch in batches:
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("range", "block", "hashes", "copies")), strict=True):
                if part != own:
                    if rows:
                        yield settle()
                    own, rows = part, []
                rows.append(row)
        if rows:
            yield settle()

    sent = dealt.groupBy("block").applyInArrow(send, "range int, block int, hashes binary, copies binary")
    return sent.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "block").mapInArrow(count, "block int, range int, n bigint, frequencies binary")


def _signed(dealt: DataFrame, frequencies: DataFrame, documents: int) -> DataFrame:
    """(node, digest, text, frequencies, bands) of every distinct text; the
    frequencies are those of its distinct shingles, in order of hash."""
    base = float(idf(np.ones(1), documents)[0])
    schema = "node bigint, digest binary, text string, frequencies binary, bands array<bigint>"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.column("block")[0].as_py()
        digests, _, texts = _opened(left)
        runs, _, order, new = _census(texts)
        right = right.sort_by("range")
        found = np.concatenate([_large(raw, n) for raw, n in zip(right.column("frequencies").to_pylist(), right.column("n").to_pylist(), strict=True)])
        counts = np.empty(len(order), np.int64)
        counts[order] = found[np.cumsum(new) - 1]
        blobs, bands, at = [], [], 0
        for a, b, terms in runs:
            count = counts[at : at + len(terms.hashes)]
            at += len(count)
            blobs += [_small(count[i:j]) for i, j in zip(terms.bounds[:-1], terms.bounds[1:], strict=True)]
            bands.append(signatures(terms.hashes, terms.document, terms.tf * idf(count, documents), base, b - a))
        bands = np.concatenate(bands)
        n = len(texts)
        del runs, order, new, found, counts
        trim()
        return pa.table(
            {
                "node": pa.array((block << 32) + np.arange(n), pa.int64()),
                "digest": pa.array(digests, pa.binary()),
                "text": pa.array([t.decode() for t in texts], pa.string()),
                "frequencies": pa.array(blobs, pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64), pa.int64())),
            }
        )

    return dealt.groupBy("block").cogroup(frequencies.groupBy("block")).applyInArrow(run, schema)


#: Members of a tile; a larger bucket is compared tile by tile.
TILE = 192


def _linked_members(members: DataFrame, texts: DataFrame, similarity: float, documents: int) -> DataFrame:
    """(a, b): a spanning forest of the links between members of a bucket that
    are in different components.  ``members`` has band, n, node, component,
    ``texts`` node, text, frequencies.

    A bucket of n members is n / TILE tiles by a hash of the node, and every two
    tiles meet in one group, so no task holds more than two tiles.  Texts, not
    pairs, are dealt out.
    """
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "node"), tiles).cast("int")
    placed = members.select("band", "node", "component", own.alias("tile"), tiles.alias("tiles")).join(texts.hint("merge"), "node")
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "component", "text", "frequencies"
    )

    def meet(batches):
        group, rows, small, out = None, [], [], []
        waiting = [0]  # characters of the pairs of the small groups

        def forest(rows, pairs):
            """Pairs that join components not yet joined."""
            parent = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for p, q in pairs:
                a, b = root(rows[p][2]), root(rows[q][2])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((rows[p][1], rows[q][1]))

        def close():
            if len(rows) < 2:
                return
            if len(rows) <= 6:
                small.append(list(rows))
                waiting[0] += len(rows) * sum(len(r[3]) for r in rows)
                if waiting[0] > 1 << 20:
                    close_small()
                return
            tile = np.array([r[0] for r in rows])
            left, right = (np.flatnonzero(tile == k) for k in (group[1], group[2]))
            if not len(left) or not len(right):
                return
            found = _pair_matrix(_elements(_weighted(pa.array([r[3] for r in rows]), [r[4] for r in rows], documents)), left, right) >= similarity
            component = np.array([r[2] for r in rows], np.int64)
            found &= component[left][:, None] != component[right][None, :]
            p, q = np.nonzero(found)
            forest(rows, zip(left[p].tolist(), right[q].tolist(), strict=True))

        def close_small():
            pairs = [(g, p, q) for g, rows in enumerate(small) for p in range(len(rows)) for q in range(p) if rows[p][2] != rows[q][2]]
            if pairs:
                of = {}  # every text's elements once
                for g, p, q in pairs:
                    of.setdefault((g, p), len(of))
                    of.setdefault((g, q), len(of))
                weighted = _weighted(pa.array([small[g][p][3] for g, p in of]), [small[g][p][4] for g, p in of], documents)
                for g, p, q in pairs:
                    if similarity_of(weighted[of[g, p]], weighted[of[g, q]]) >= similarity:
                        forest(small[g], [(p, q)])
            small.clear()
            waiting[0] = 0

        for batch in slices(batches, "text"):
            columns = [batch.column(c).to_pylist() for c in ("band", "i", "j", "tile", "node", "component", "text", "frequencies")]
            for band, i, j, *row in zip(*columns, strict=True):
                if (band, i, j) != group:
                    close()
                    group, rows = (band, i, j), []
                rows.append(row)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out.clear()
        close()
        close_small()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(meet, "a bigint, b bigint")


def _first(id_col: Column, row: Column) -> Column:
    """Order of rows: null ids last, then by id, then by row number."""
    return F.struct(id_col.isNull().alias("none"), id_col.alias("id"), row.alias("row"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, component_id, group_size, kept, text_md5: one row per input row.

    Documents link if their weighted Jaccard similarity is at least
    ``similarity``; the class is the smallest id reachable, and one row of
    that id is kept.  Texts without a word (null, empty) link with nothing.
    Rows that repeat an id are documents of their own, and so are rows with a
    null id, whose class is null only if all its ids are: one row of each class
    is kept, whatever the ids.  An empty table gives an empty one; other
    columns aren't read.  ``text_md5`` is the digest of the text as it is (null
    as empty), so that a kept row is found by id and digest.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.md5(text.cast("binary")).alias("text_md5"))

    def survey(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_md5"), pa.array(map(_digest, texts), pa.binary()), pa.array(map(len, texts), pa.int64())], names=["id", "text_md5", "digest", "size"]
            )

    surveyed = source.mapInArrow(survey, "id bigint, text_md5 string, digest binary, size bigint")
    keys = materialise(surveyed.withColumn("row", F.monotonically_increasing_id()), "near-keys")
    documents = keys.count()
    classes = keys.where("digest is not null").groupBy("digest").agg(F.min(_first(F.col("id"), F.col("row"))).alias("first"), F.count("*").alias("copies"), F.max("size").alias("size"))
    classes = materialise(classes, "near-classes", small=True)
    size = classes.agg(F.sum("size")).first()[0] or 0
    # a shingle begins at a word, and words have some six characters
    dealt = _deal(source, max(1, round(size / BLOCK_BYTES)))
    nodes = materialise(_signed(dealt, _frequencies(dealt, max(1, round(size / 6 / RANGE_SHINGLES))), documents), "near-nodes")
    release(spark)
    texts = nodes.select("node", "text", "frequencies")

    members = nodes.select("node", F.explode("bands").alias("band"))
    # the smallest node of a bucket is its hub: one candidate pair per member, not all pairs
    hubs = materialise(members.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "near-hubs", small=True)
    starred = materialise(join_counted(members, hubs, "band", "n", nodes.count() * BANDS).where("node <> hub"), "near-stars", small=True)

    def of_candidates(ids: DataFrame, most: int) -> DataFrame:
        """The texts of some nodes, of which there are at most ``most``; sent
        to the texts if they are few."""
        return texts.join(F.broadcast(ids.distinct()) if most <= 1_000_000 else ids, "node", "left_semi")

    def verify(pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of pairs a, b, n from both whole texts; n bounds
        the pairs of one b, whose text goes to a task per STAR_ROWS of them."""
        salts = F.ceil(F.col("n") / STAR_ROWS).cast("int")
        dealt = pairs.select("a", "b", F.pmod(F.xxhash64(F.lit(5), "a"), salts).cast("int").alias("salt"))
        copies = pairs.groupBy("b").agg(F.max("n").alias("n")).select("b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        found = of_candidates(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), 2 * pairs.count())
        left = dealt.join(found.select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.col("frequencies").alias("frequencies_a")).hint("merge"), "a")
        # renamed alike, so that both joins read one shuffle of the texts
        right = copies.join(found.select(F.col("node").alias("b"), F.col("text").alias("text_b"), F.col("frequencies").alias("frequencies_b")).hint("merge"), "b")
        both = left.join(right.hint("shuffle_hash"), ["b", "salt"]).select("a", "b", "text_a", "text_b", "frequencies_a", "frequencies_b")

        def run(batches):
            for large in slices(batches, "text_b", 1 << 20):
                for batch in slices([large], "text_a", 1 << 20):
                    b = batch.column("b").to_numpy()
                    # a hub's text comes with each of its pairs, side by side
                    new = np.append(True, b[1:] != b[:-1])
                    own = pa.array(np.flatnonzero(new))
                    hubs = _weighted(batch.column("text_b").take(own), batch.column("frequencies_b").take(own).to_pylist(), documents)
                    left = _weighted(batch.column("text_a"), batch.column("frequencies_a").to_pylist(), documents)
                    found = [similarity_of(x, hubs[k]) for x, k in zip(left, (np.cumsum(new) - 1).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "similarity"])

        return materialise(both.mapInArrow(run, "a bigint, b bigint, similarity double"), "near-verified")

    pairs = materialise(starred.groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.max("n").alias("n")), "near-pairs", small=True)
    stars = verify(pairs)
    release(spark)
    edges = stars.where(F.col("similarity") >= similarity).select("a", "b")
    labels = components(edges)
    # Members that their hub doesn't reach may link with others of the bucket.
    # The hub is done: it was compared with every member.  1 - similarity is a
    # metric, so of a pair in different components one is outside the hub's,
    # and the other's distance from the hub is at most 1 - similarity less.
    slack = 1 - similarity + 1e-9
    far = stars.select(F.col("a").alias("node"), F.col("b").alias("hub"), (1 - F.col("similarity")).alias("far"))
    named = starred.join(far, ["node", "hub"]).join(labels.withColumnRenamed("id", "node"), "node", "left").select("band", "node", "far", F.coalesce("component", "node").alias("component"))
    named = materialise(named, "near-named", small=True)
    count = named.count()
    discard(starred)
    centres = hubs.join(labels.select(F.col("id").alias("hub"), F.col("component").alias("of_hub")), "hub", "left").select("band", "n", F.coalesce("of_hub", "hub").alias("hub_component"))
    around = materialise(join_counted(named, centres, "band", "n", count), "near-around", small=True)
    nearest = around.where("component <> hub_component").groupBy("band").agg(F.min("far").alias("nearest"), F.max("n").alias("all"))
    placed = join_counted(around.drop("n"), nearest, "band", "all", count).where(F.col("far") >= F.col("nearest") - slack).select("band", "node", "component")
    placed = materialise(placed, "near-placed", small=True)
    discard(around)
    member_set = [F.sum(F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(1 << 40))).alias(f"set{k}") for k in range(3)]
    sets = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), *member_set).where("low <> high")
    # the same members often meet in several bands: once is enough
    mixed = materialise(sets.groupBy("n", "set0", "set1", "set2").agg(F.min("band").alias("band")).select("band", "n"), "near-mixed", small=True)
    if not mixed.isEmpty():
        unsettled = materialise(join_counted(placed, mixed, "band", "n", placed.count()), "near-unsettled", small=True)
        added = materialise(_linked_members(unsettled, of_candidates(unsettled.select("node"), unsettled.count()), similarity, documents), "near-crossed")
        if not added.isEmpty():
            labels = components(edges.union(added))
    grouped = nodes.select("node", "digest").join(labels.withColumnRenamed("id", "node"), "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    grouped = materialise(grouped.join(classes, "digest"), "near-grouped", small=True)
    sizes = grouped.groupBy("component").agg(F.min("first").alias("kept"), F.sum("copies").alias("group_size"), F.count("*").alias("n"))
    by_class = join_counted(grouped, sizes, "component", "n", grouped.count()).select("digest", "copies", "kept", "group_size")
    by_class = materialise(by_class, "near-by-class", small=True)
    discard(nodes)
    rows = join_counted(keys, by_class, "digest", "copies", documents)
    linked = rows.select("id", F.col("kept.id").alias("component_id"), "group_size", (F.col("row") == F.col("kept.row")).alias("kept"), "text_md5")
    alone = keys.where("digest is null").select("id", F.col("id").alias("component_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_md5")
    return linked.unionByName(alone).withColumnRenamed("id", id_col)
