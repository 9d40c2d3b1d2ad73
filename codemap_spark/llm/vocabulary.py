"""Fast, exact use of public tokenizers: texts are cut into the pre-tokens
that the tokenizer treats independently, and the library encodes each distinct
pre-token once per worker.  Texts with characters whose classes Python's ``re``
judges differently go to the library whole."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import binary_buffer
from .textarrays import byte_level_bounds, distinct, hard_documents, join_ranges, word_level_bounds

#: Characters below U+0250 whose letter or digit class differs between
#: Python's ``re`` and Unicode properties, and separators that only ``re``
#: counts as white space.
ODD = re.compile("[ɐ-\U0010ffff²³¹¼½¾\x1c-\x1f\x85]")
#: Pre-token patterns as published for the two tokenizer families, with
#: letters and digits spelled for ``re``.
BYTE_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
MAX_CACHED = 600_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes:
    printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(itself)]
    return {chr(b): b for b in itself} | {chr(0x100 + i): b for i, b in enumerate(others)}


def merge_engine(spec: dict):
    """(encode pre-token bytes, id of rank) from a BPE vocabulary, or None if
    it needs more than merges by rank.  Runs in tiktoken's compiled core; an
    end-of-word suffix becomes one byte that UTF-8 never has, merged first."""
    import tiktoken

    model, alphabet = spec["model"], byte_alphabet()
    suffix = model.get("end_of_word_suffix") or ""
    if model.get("type") not in (None, "BPE") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
        return None
    vocab, ranks, ids = model["vocab"], {}, []

    def add(token: str) -> None:
        end = suffix and token.endswith(suffix)
        stem = token[: -len(suffix)] if end else token
        data = bytes(alphabet[c] for c in stem) + (b"\xff" if end else b"")
        if data in ranks:
            raise ValueError(token)
        ranks[data] = len(ids)
        ids.append(vocab[token])

    try:
        for char in alphabet:
            add(char)
        if suffix:
            ranks[b"\xff"] = ranks.get(b"\xff", len(ids))
            for char, byte in alphabet.items():
                if byte != 0xFF:
                    add(char + suffix)
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            add(left + right)
    except (KeyError, ValueError):
        return None
    core = tiktoken.Encoding("merges", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    return core._core_bpe.encode_single_piece, ids, b"\xff" if suffix else b""


class _Cache(dict):
    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= MAX_CACHED:
            self.clear()
        self[word] = value = self.make(word)
        return value


class Encoder:
    """ids as little-endian unsigned 32-bit bytes, or counts, of whole texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        kind, normalizer = json.dumps(spec.get("pre_tokenizer")), json.dumps(spec.get("normalizer"))
        plain = [t for t in spec.get("added_tokens", []) if t.get("normalized") or t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
        self.pattern, self.lower = None, False
        if not plain and spec.get("normalizer") is None and '"use_regex": true' in kind and '"add_prefix_space": false' in kind:
            self.pattern = BYTE_LEVEL
        elif not plain and "Lowercase" in normalizer and "[\\\\p{N}]|" in kind and '"invert": true' in kind:
            self.pattern, self.lower = WORD_LEVEL, True
        engine = merge_engine(spec) if self.pattern is not None else None
        if engine:
            piece, real, end = engine
            self.ids = _Cache(lambda word: struct.pack(f"<{len(x := piece(word.encode() + end))}I", *[real[i] for i in x]))
            self.counts = _Cache(lambda word: len(piece(word.encode() + end)))
        else:
            self.ids = _Cache(self._pack)
            self.counts = _Cache(lambda word: len(self._encode(word)))

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pack(self, word: str) -> bytes:
        ids = self._encode(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, text: str) -> list[str] | None:
        if self.pattern is None or ODD.search(text) or any(s in text for s in self.special):
            return None
        return self.pattern.findall(text.lower() if self.lower else text)

    def packed(self, text: str) -> bytes:
        words = self._words(text)
        return self._pack(text) if words is None else b"".join(map(self.ids.__getitem__, words))

    def count(self, text: str) -> int:
        words = self._words(text)
        return len(self._encode(text)) if words is None else sum(map(self.counts.__getitem__, words))

    def _pieces(self, texts: pa.Array):
        """(hard documents, pre-token codes, first pre-token of each document,
        distinct pre-tokens) of a string array without nulls."""
        lowered = pc.utf8_lower(texts) if self.lower else texts
        data, offsets = binary_buffer(lowered)
        # lowering keeps what makes a document hard, but for its marks
        hard = hard_documents(*binary_buffer(texts)) if self.pattern is not None else np.ones(len(texts), bool)
        size = np.where(hard, 0, np.diff(offsets))
        if hard.any():
            data, offsets = data[join_ranges(offsets[:-1], size)], np.append(0, np.cumsum(size))
        if not len(data):
            return hard, np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), []
        start, end = (word_level_bounds if self.lower else byte_level_bounds)(data, offsets)
        codes, first = distinct(data, start, end)
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        return hard, codes, np.searchsorted(start, offsets), words

    def count_batch(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text of a string array without nulls."""
        hard, codes, begin, words = self._pieces(texts)
        each = np.fromiter(map(self.counts.__getitem__, words), np.int64, len(words))
        total = np.append(0, np.cumsum(each[codes]))
        out = total[begin[1:]] - total[begin[:-1]]
        for i in np.flatnonzero(hard):
            out[i] = self.count(texts[int(i)].as_py())
        return out

    def ids_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text) of a string array without nulls."""
        hard, codes, begin, words = self._pieces(texts)
        packed = list(map(self.ids.__getitem__, words))
        width = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        pool, at = np.frombuffer(b"".join(packed), "<u4"), np.append(0, np.cumsum(width))[:-1]
        length = width[codes]
        ids = pool[join_ranges(at[codes], length)] if len(codes) else pool
        offsets = np.append(0, np.cumsum(length))[begin]
        if hard.any():
            parts, sizes = [], np.diff(offsets)
            for i in range(len(texts)):
                if hard[i]:
                    own = np.frombuffer(self.packed(texts[i].as_py()), "<u4")
                    sizes[i] = len(own)
                    parts.append(own)
                else:
                    parts.append(ids[offsets[i] : offsets[i + 1]])
            ids, offsets = np.concatenate(parts), np.append(0, np.cumsum(sizes))
        return ids, offsets


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def version(path: str) -> str:
    """Digest of the vocabulary file: another file is another tokenizer."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
