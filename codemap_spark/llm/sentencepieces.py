"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Pieces and scores come from a public model.  A segment (blanks and the run
after them) starts as characters; an agenda holds the merges of neighbours by
score; the n-th merge that comes up is skipped when a keyed hash of (seed,
document id, place of the segment in the document, n) falls below the dropout
rate.  So every occurrence of a word is dealt by itself, and reproducibly.  A
segmentation depends on the segment and on which merges were skipped, so these
two are the cache's key.  Characters without a piece become byte pieces.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binary_buffer, prepare, slices, splitmix
from .textarrays import distinct, join_ranges

SPACE = "▁"
MASK = (1 << 64) - 1
MAX_CACHED = 700_000
STEP = 0x9E3779B97F4A7C15
#: Slots of the first table that finds pairs.
SLOT_BITS = 20
#: Characters of a segment that lists are quicker for than arrays.
FEW = 1_000
#: Symbol of a place whose character is part of a symbol before it.
GONE = -2
#: Up to this many characters at most 63 merges come up: one for each pair at
#: first, and two for each merge made.
SHORT = 22


def _mix(x: int) -> int:
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & MASK
    x = (x ^ (x >> 29)) * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ (x >> 32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """``_mix`` over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


class Pieces:
    """A BPE model's pieces; segments are cached by (segment, skipped merges)."""

    def __init__(self, path: str, dropout: float, seed: int) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.unknown = model.unk_id()
        self.byte_ids, self.score, self.piece_bytes = [0] * 256, {}, [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.piece_bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece] = (-model.get_score(i), i)
                self.piece_bytes[i] = piece.replace(SPACE, " ").encode()
        self.limit, self.seed = int(dropout * (1 << 32)), _mix(seed & MASK)
        # blanks only lead a piece, so segments that start at blanks are independent
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has a blank after its first character")
        self.width = np.fromiter(map(len, self.piece_bytes), np.int64, n)
        self.pool = np.frombuffer(b"".join(self.piece_bytes), np.uint8)
        self.at = np.append(0, np.cumsum(self.width))[:-1]
        self.cache: dict[tuple[bytes, int], bytes] = {}

    def segment(self, raw: bytes, key: int = 0) -> array:
        """ids of one segment; blanks are plain spaces here.  Symbols, links and
        agenda are flat arrays, as a segment can be a whole text; one of few characters goes by lists."""
        text = raw.decode()
        if len(text) <= FEW:
            return array("i", self._short_segment(text, key))
        if not hasattr(self, "pair_key"):
            self._tables()
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        sym = np.concatenate([self._symbols(codes[k : k + (1 << 18)]) for k in range(0, max(1, len(codes)), 1 << 18)])
        size, limit, pair = len(sym), self.limit, self.pair
        key, turn = _mix(self.seed ^ key), -1
        # of every pair that makes a piece, its rank above its place: numbers in the order of the agenda.
        # Those of the start are sorted once; a heap holds what merges add
        parts = []
        for k in range(0, size - 1, 1 << 18):
            at, rank = self._ranked(sym[k : min(k + (1 << 18), size - 1)].astype(np.int64), sym[k + 1 : k + (1 << 18) + 1].astype(np.int64))
            parts.append((rank << 40) | (at + k))
        first = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        del parts
        sym = array("i", sym.tobytes())
        before, after = array("i", range(-1, size - 1)), array("i", range(1, size + 1))
        agenda, place, done, taken, ahead = [], (1 << 40) - 1, 0, 0, []
        while True:
            if taken == len(ahead) and done < len(first):
                ahead, taken = first[done : done + 4096].tolist(), 0
                done += len(ahead)
            if taken < len(ahead) and (not agenda or ahead[taken] < agenda[0]):
                top = ahead[taken]
                taken += 1
            elif agenda:
                top = heapq.heappop(agenda)
            else:
                break
            i = top & place
            j = after[i]
            if sym[i] == GONE or j >= size:
                continue
            found = pair(sym[i], sym[j])
            if found is None or found[0] != top >> 40:
                continue
            turn += 1
            if limit and _mix((key + turn * STEP) & MASK) >> 32 < limit:
                continue
            sym[i], sym[j] = found[1], GONE
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                found = pair(sym[i], sym[k])
                if found:
                    heapq.heappush(agenda, found[0] << 40 | i)
            k = before[i]
            if k >= 0:
                found = pair(sym[k], sym[i])
                if found:
                    heapq.heappush(agenda, found[0] << 40 | k)
        out, i = array("i"), 0
        while i < size:
            if 0 <= sym[i] < len(self.width):
                out.append(sym[i])
            else:  # characters without a piece, and blanks on their own, go by their bytes
                out.extend(self.byte_ids[x] for x in (SPACE if codes[i] == 32 else chr(codes[i])).encode())
            i = after[i]
        return out

    def _short_segment(self, text: str, key: int) -> list[int]:
        """``segment`` by lists, which cost more memory and less time.  Pieces
        of one score are merged from left to right, as in ranks."""
        # a literal blank mark would decode as a space: it goes by its bytes
        part = [SPACE if c == " " else "\x00mark" if c == SPACE else c for c in text]
        score, limit = self.score, self.limit
        key, turn = _mix(self.seed ^ key), -1
        size = len(part)
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        agenda = []
        for i in range(size - 1):
            found = score.get(part[i] + part[i + 1])
            if found:
                agenda.append((found[0], i, found[1], i + 1, len(part[i]) + len(part[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, i, piece, j, width = heapq.heappop(agenda)
            if part[i] is None or after[i] != j or len(part[i]) + len(part[j]) != width:
                continue
            turn += 1
            if limit and _mix((key + turn * STEP) & MASK) >> 32 < limit:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                k = after[i]
                found = score.get(part[i] + part[k])
                if found:
                    heapq.heappush(agenda, (found[0], i, found[1], k, len(part[i]) + len(part[k])))
            if before[i] >= 0:
                k = before[i]
                found = score.get(part[k] + part[i])
                if found:
                    heapq.heappush(agenda, (found[0], k, found[1], i, len(part[k]) + len(part[i])))
        out = []
        for p in part:
            if p is None:
                continue
            found = score.get(p)
            if found:
                out.append(found[1])
            else:
                out += [self.byte_ids[b] for b in (SPACE if p == "\x00mark" else p).encode()]
        return out

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 of those that no piece has."""
        place = np.minimum(np.searchsorted(self.char_code, codes), len(self.char_code) - 1)
        return np.where(self.char_code[place] == codes, self.char_symbol[place], -1).astype(np.int32)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, ranks) of the pairs that make a piece."""
        k = np.where((left >= 0) & (right >= 0), left * self.symbols + right, -1)
        i = np.minimum(np.searchsorted(self.pair_key, k), len(self.pair_key) - 1)
        at = np.flatnonzero(self.pair_key[i] == k)
        return at, self.pair_rank[i[at]]

    def pair(self, left: int, right: int) -> tuple[int, int] | None:
        """(rank, piece) of two symbols, if they make one."""
        return self.pairs.get(left * self.symbols + right) if left >= 0 and right >= 0 else None

    def _tables(self) -> None:
        """Pairs of symbols that make a piece, sorted by key, and known characters."""
        chars = sorted({c for p in self.score for c in p} | {SPACE})
        symbol = {p: i for p, (_, i) in self.score.items()}
        extra = len(self.width)
        for c in chars:
            if c not in symbol:
                symbol[c] = extra
                extra += 1
        self.symbols = extra
        # pieces of one score have one rank: of these the leftmost merge comes first
        rank = {x: r for r, x in enumerate(sorted({x for x, _ in self.score.values()}))}
        rank_of = {p: rank[x] for p, (x, _) in self.score.items()}
        pairs = {}
        for p in self.score:
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * extra + right] = (rank_of[p], symbol[p])
        self.pairs = pairs
        self.pair_key = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_key.tolist()], np.int64)
        self.pair_piece = np.array([pairs[k][1] for k in self.pair_key.tolist()], np.int64)
        self.padded_key = np.append(self.pair_key, -2)
        self.padded_rank, self.padded_piece = np.append(self.pair_rank, 1 << 40), np.append(self.pair_piece, 0)
        self.tables = self._spread(self.pair_key)
        # blanks come as plain spaces here, and a literal blank mark is unknown
        known = [c for c in chars if c not in (SPACE, " ")] + [" "]
        self.char_code = np.array(sorted(map(ord, known)), np.int64)
        self.char_symbol = np.array([symbol[SPACE if c == 32 else chr(c)] for c in self.char_code.tolist()], np.int64)

    def _spread(self, keys: np.ndarray) -> list[tuple[np.ndarray, np.uint64, np.uint64]]:
        """Tables of places in ``keys`` by hash; a key whose slot in one table
        is another's is in the next, of an eighth of the slots."""
        tables, left, bits = [], np.arange(len(keys)), SLOT_BITS
        while len(left):
            odd = splitmix(np.array([len(tables)], np.uint64))[0] | np.uint64(1)
            table = np.full(1 << bits, len(keys), np.int32)
            with np.errstate(over="ignore"):
                slot = (keys[left].astype(np.uint64) * odd) >> np.uint64(64 - bits)
            table[slot] = left
            tables.append((table, odd, np.uint64(64 - bits)))
            left, bits = left[table[slot] != left], max(12, bits - 3)
        return tables

    def _places(self, k: np.ndarray) -> np.ndarray:
        """Places of pair keys, the number of pairs for those that make no piece."""
        at, out = None, None
        u = k.view(np.uint64)
        with np.errstate(over="ignore"):
            for table, odd, shift in self.tables:
                if at is None:
                    out = table[(u * odd) >> shift]
                    at = np.flatnonzero(self.padded_key[out] != k)
                    continue
                found = table[(u[at] * odd) >> shift]
                fine = self.padded_key[found] == k[at]
                out[at[fine]] = found[fine]
                at = at[~fine]
        out[at] = len(self.pair_key)
        return out

    def _skipped(self, key: np.ndarray, turn: int) -> np.ndarray:
        """Whether the merge that comes up at a turn is skipped, by mixed key."""
        return _mixed(key + np.uint64(turn * STEP & MASK)) >> np.uint64(32) < np.uint64(self.limit)

    def segments(self, raws: list[bytes], keys: np.ndarray) -> list[bytes]:
        """Packed ids of many segments: the agendas of all of them advance
        together, one merge of each at a time.  Same ids as ``segment``."""
        if not hasattr(self, "pair_key"):
            self._tables()
        kind = "<u2" if len(self.width) <= 1 << 16 else "<u4"
        texts = [r.decode() for r in raws]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        sym = self._symbols(codes).astype(np.int64)
        # a line end or control character goes by its byte, which merges with nothing
        alone = np.flatnonzero((sym < 0) & (codes < 128))
        sym[alone] = np.asarray(self.byte_ids)[codes[alone]]
        word = np.repeat(np.arange(len(texts)), size)
        hard = size > 200
        hard[word[sym < 0]] = True
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(hard).tolist():
            out[i] = np.asarray(self.segment(raws[i], int(keys[i])), kind).tobytes()
        on = ~hard[word]
        sym, word = sym[on], word[on]
        key, turn = _mixed(np.uint64(self.seed) ^ keys.astype(np.uint64)), -1
        none = np.int64(1) << 40

        def ranked(left, right, same):
            """(rank, piece) of pairs; none across segments or without a piece."""
            i = self._places(np.where(same, left * self.symbols + right, -1))
            return self.padded_rank[i], self.padded_piece[i]

        rank, piece = np.full(len(sym), none), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], piece[:-1] = ranked(sym[:-1], sym[1:], word[:-1] == word[1:])
        while len(sym):
            new = np.ones(len(sym), bool)
            new[1:] = word[1:] != word[:-1]
            first = np.flatnonzero(new)
            local = np.arange(len(sym)) - np.repeat(first, np.diff(np.append(first, len(sym))))
            best = np.minimum.reduceat((rank << 12) | local, first)
            open_ = (best >> 12) < none
            if not open_.all():
                bounds = np.append(first, len(sym))
                small = sym.astype(kind).tobytes()
                width = np.dtype(kind).itemsize
                for k in np.flatnonzero(~open_).tolist():
                    out[word[first[k]]] = small[bounds[k] * width : bounds[k + 1] * width]
                keep = np.repeat(open_, np.diff(bounds))
                moved = np.cumsum(keep) - 1
                first, best = moved[first[open_]], best[open_]
                sym, word, rank, piece = sym[keep], word[keep], rank[keep], piece[keep]
                if not len(sym):
                    break
            i = first + (best & 4095)
            turn += 1
            if self.limit:
                skip = self._skipped(key[word[i]], turn)
                rank[i[skip]] = none
                i = i[~skip]
                if not len(i):
                    continue
            sym[i] = piece[i]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            i = i - np.arange(len(i))
            sym, word, rank, piece = sym[keep], word[keep], rank[keep], piece[keep]
            for at in (i, i[i > 0] - 1):
                at = at[(at + 1 < len(sym))]
                rank[at], piece[at] = ranked(sym[at], sym[at + 1], word[at] == word[at + 1])
            if i[-1] == len(sym) - 1:
                rank[-1] = none
        return out

    def _packed(self, raws: list[bytes], skips: list[int], key: np.ndarray, cached: list[bool]) -> list[bytes]:
        names = list(zip(raws, skips, strict=True))
        found = list(map(self.cache.get, names))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            if len(self.cache) + len(missing) > MAX_CACHED:
                # plain segmentations are wanted most
                self.cache = {k: v for k, v in self.cache.items() if not k[1]}
                if len(self.cache) > MAX_CACHED // 2:
                    self.cache = {}
            for i, x in zip(missing, self.segments([raws[i] for i in missing], key[missing]), strict=True):
                found[i] = x
                if cached[i]:
                    self.cache[names[i]] = x
        return found

    def _skips(self, key: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A bit per turn of each short segment, 0 where no merge of the plain
        segmentation is skipped; the mixed key itself for the others."""
        out = np.zeros(len(key), np.uint64)
        if not self.limit:
            return out
        key = _mixed(np.uint64(self.seed) ^ key)
        out[size > SHORT] = key[size > SHORT]
        at = np.flatnonzero(size <= SHORT)
        most = size[at] - 1  # turns: one for each merge made, and one for each skipped
        for turn in range(3 * (SHORT - 1)):
            on = most > turn
            at, most = at[on], most[on]
            if not len(at):
                break
            skip = self._skipped(key[at], turn)
            out[at] |= skip.astype(np.uint64) << np.uint64(turn)
            most += skip
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, own_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all documents of a UTF-8 buffer.  A document that
        isn't empty gets the leading blank that the model adds."""
        size = np.diff(offsets)
        full = size > 0
        # room for the leading blank of each full document
        shift = np.cumsum(full)
        spaced = np.full(len(data) + int(full.sum()), 0x20, np.uint8)
        own = offsets[:-1] + shift - full
        spaced[join_ranges(own + full, size)] = data
        edges = np.append(own, len(spaced))
        if not len(spaced):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        blank = spaced == 0x20
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[edges[:-1][full]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(spaced))
        document = np.searchsorted(edges, begin, "right") - 1
        codes, first = distinct(spaced, begin, end)
        size = np.add.reduceat((spaced & 0xC0) != 0x80, begin, dtype=np.int64)
        nth = np.arange(len(begin)) - np.searchsorted(begin, edges)[document]
        key = splitmix(own_ids.view(np.uint64))[document] + nth.astype(np.uint64) * np.uint64(STEP | 2)
        skips = self._skips(key, size)
        # an occurrence of each wanted pair of a segment and its skipped merges
        head = np.full(len(first), -1)
        plain, varied = np.flatnonzero(skips == 0), np.flatnonzero(skips)
        head[codes[plain]] = plain
        used = head >= 0
        place = (np.cumsum(used) - 1)[codes]
        varied = varied[np.lexsort((skips[varied], codes[varied]))]
        new = np.ones(len(varied), bool)
        new[1:] = (codes[varied[1:]] != codes[varied[:-1]]) | (skips[varied[1:]] != skips[varied[:-1]])
        place[varied] = int(used.sum()) + np.cumsum(new) - 1
        at = np.append(head[used], varied[new])
        raw = spaced.tobytes()
        cached = (size[at] <= SHORT) if self.limit else np.ones(len(at), bool)
        packed = self._packed([raw[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)], skips[at].tolist(), key[at], cached.tolist())
        kind = "<u2" if len(self.width) <= 1 << 16 else "<u4"
        width = np.fromiter(map(len, packed), np.int64, len(packed)) // np.dtype(kind).itemsize
        pool, from_ = np.frombuffer(b"".join(packed), kind), np.append(0, np.cumsum(width))[:-1]
        length = width[place]
        ids = pool[join_ranges(from_[place], length)].astype(np.int64)
        return ids, np.append(0, np.cumsum(length))[np.searchsorted(begin, edges)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, offsets) of all documents, without the added blank."""
        width = self.width[ids]
        data = self.pool[join_ranges(self.at[ids], width)]
        edges = np.append(0, np.cumsum(width))[offsets]
        full = np.diff(edges) > 0
        keep = np.ones(len(data), bool)
        keep[edges[:-1][full]] = False
        return data[keep], edges - np.append(0, np.cumsum(full))


@lru_cache(maxsize=4)
def pieces(path: str, dropout: float, seed: int) -> Pieces:
    return Pieces(path, dropout, seed)


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>: one row per input row, whole texts.

    Null text counts as empty and has no ids; repeated rows have equal ids; a
    null id counts as 0 for the dropout; an empty table gives an empty one;
    other columns aren't read.  No shuffle.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = pieces(model_path, dropout, seed)
        for batch in slices(batches, "text"):
            own = batch.column("id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            ids, offsets = model.encode(*binary_buffer(batch.column("text")), own)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the texts of encoded rows; null or empty ids give an empty text."""
    prepare(encoded.sparkSession)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        model = pieces(model_path, 0.0, 0)
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            offsets = np.append(0, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))
            data, edges = model.decode(np.fromiter((i for x in lists for i in x), np.int64, int(offsets[-1])), offsets)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_crc32, text_crc32 (of the decoded text), lossless: the
    encoding of every row, decoded again and compared with its whole text."""
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = pieces(model_path, dropout, seed)
        for batch in slices(batches, "text"):
            own = batch.column("id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            data, edges = binary_buffer(batch.column("text"))
            ids, offsets = model.encode(data, edges, own)
            back, ends = model.decode(ids, offsets)
            raw, new, packed = data.tobytes(), back.tobytes(), ids.astype("<u4").tobytes()
            rows = list(zip(edges[:-1].tolist(), edges[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.int64()),
                    pa.array([zlib.crc32(new[c:d]) for _, _, c, d in rows], pa.int64()),
                    pa.array([raw[a:b] == new[c:d] for a, b, c, d in rows], pa.bool_()),
                ],
                names=["id", "n_tokens", "ids_crc32", "text_crc32", "lossless"],
            )

    schema = f"id {id_type}, n_tokens bigint, ids_crc32 bigint, text_crc32 bigint, lossless boolean"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
