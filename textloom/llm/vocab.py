"""Piece counts and piece ids of texts, computed once per distinct pre-token.

The tokenizer here (a BPE file of the `tokenizers` library) never lets a piece
cross white space, and neither its normaliser nor its special strings look
across it. So a text's pieces are those of its blank-separated pre-tokens, one
after another, and each distinct pre-token of a step needs one call only.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from textloom.llm import blocks

#: Where the vocabulary file is found by default.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How the vocabulary's file normalises and cuts texts. The pre-tokens
#: here stand on them, so that a file with others is refused.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@lru_cache(maxsize=2)
def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    own = json.loads(t.to_str())
    if own["normalizer"] != _NORMALIZER or own["pre_tokenizer"] != _PRE_TOKENIZER or any(a["normalized"] or a["lstrip"] or a["rstrip"] for a in own["added_tokens"]):
        raise ValueError(f"{path} cuts texts in another way than pre-tokens are cut here")
    t.no_truncation()
    t.no_padding()
    return t


#: Words that need no Unicode tables: printable ASCII and Latin-1 letters, without
#: the characters that contractions and special strings begin with.
_PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]*")
#: The vocabulary's pre-tokens of such words, in lower case.
_PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Byte-level BPE writes a byte as a printable character: itself, or one from 256 on.
_SHOWN = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
_SHOWN |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Words, and pre-tokens, that a worker remembers from step to step.
REMEMBERED = 150_000


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """Ids of blank-separated words, packed as 32-bit integers. Plain words are
    split into the vocabulary's own pre-tokens, each given to the model once;
    others go through the library's whole pipeline."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(_SHOWN.__getitem__, piece.encode()))
        ids = _packed([t.id for t in self.model.tokenize(shown)])
        if len(self.pieces) < REMEMBERED:
            self.pieces[piece] = ids
        return ids

    def word(self, word: bytes) -> bytes:
        text, known = word.decode(), self.pieces
        if _PLAIN.fullmatch(text):
            ids = b"".join([known.get(p) or self.piece(p) for p in _PIECE.findall(text.lower())])
        else:
            ids = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.words) < REMEMBERED:
            self.words[word] = ids
        return ids

    def all(self, words: list[bytes]) -> list[bytes]:
        known = self.words
        return [known.get(w) or self.word(w) for w in words]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(distinct: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words one after another, and their offsets."""
    packed = encoder(path).all(distinct.to_pylist())
    sizes = np.zeros(len(packed) + 1, np.int64)
    sizes[1:] = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    return np.frombuffer(b"".join(packed), np.uint32), np.cumsum(sizes)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of runs of the given starts and sizes, one run after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


#: Printable ASCII without the characters of _PLAIN's gap.
_ASCII = blocks._table(b for b in range(0x21, 0x7F) if b not in b"'<")
#: Kinds of a plain word's bytes: letters (also those of two bytes), digits, others.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 0
_KIND[0x30:0x3A] = 1


def pre_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of each pre-token, the distinct pre-tokens, and offsets by text. Plain
    words are split into the vocabulary's own pre-tokens, in lower case: runs of
    letters, single digits, runs of other characters. Another word is one."""
    w = blocks.words(texts)
    data = blocks.LOWER[w.data]
    lead = np.zeros(len(data), bool)
    lead[1:] = data[:-1] == 0xC3
    letter = lead & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
    before = np.zeros(len(data), bool)
    before[:-1] = letter[1:]
    odd = np.zeros(len(data) + 1, np.int64)
    np.cumsum(w.inside & ~(_ASCII[data] | letter | (data == 0xC3) & before), out=odd[1:])
    plain = odd[w.stops] == odd[w.starts]
    upper = letter & (data < 0x9F)
    inside = w.inside
    ours = np.repeat(plain, w.stops - w.starts)  # by byte inside a word
    found = np.where(ours, np.where(upper, data + 0x20, data)[inside], w.data[inside])
    kind = _KIND[found]
    sizes = w.stops - w.starts
    first = np.zeros(len(found), bool)
    first[np.cumsum(sizes) - sizes] = True
    starts = np.flatnonzero(first | ours & np.append(False, (kind[1:] != kind[:-1]) | (kind[1:] == 1))[: len(found)])
    codes, distinct = blocks.coded(blocks.binary(found, np.append(starts, len(found))))
    edges = np.concatenate([[0], np.cumsum(sizes)])[w.ends]
    return codes, distinct, np.searchsorted(starts, edges)


def pieces_of(tokens: list[bytes], path: str) -> np.ndarray:
    """Number of pieces of each pre-token."""
    t, shown = load(path), _SHOWN
    out = []
    for token in tokens:
        text = token.decode()
        if _PLAIN.fullmatch(text):
            out.append(len(t.model.tokenize("".join(map(shown.__getitem__, token)))))
        else:
            out.append(len(t.encode(text, add_special_tokens=False)))
    return np.array(out, np.int64)


def piece_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and offsets by text."""
    w = blocks.words(texts)
    codes, distinct = w.codes
    ids, ends = encoded(distinct, path)
    sizes = np.diff(ends)[codes]
    return ids[gather(ends[:-1][codes], sizes)], np.concatenate([[0], np.cumsum(sizes)])[w.ends]
