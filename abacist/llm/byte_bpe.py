"""Whole texts to ids of a byte-level BPE vocabulary, through the tokenizers library.

Merges never cross the pieces that the pre-tokenizer cuts, so a text may be cut at piece boundaries, each
different chunk encoded once by the library, and the ids joined. Made-up or rare words then cost one
library call per worker, repeated words one dictionary look-up. Texts with the string of one of the file's added
tokens go to the library whole, which gives the token's own id, as it does by default. Ids are held as little-endian unsigned
32-bit bytes, the form in which they are written and summed.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Chunks kept per Python worker. The dictionary is emptied when it is full, which changes no result.
CACHE_CHUNKS = 450_000
#: Longer chunks are encoded each time instead of being kept.
CACHE_CHARS = 48

#: Texts in which every engine's letters and digits are the same: ASCII and the accented Latin letters.
_PLAIN = re.compile("[\n\x20-\x7eÀ-ÖØ-öø-ɏ]*")
#: The pre-tokenizer's own rule, for such texts.
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\\s+(?!\\S)|\\s+"
)
#: For all others: a space between characters that aren't white space starts a piece.
_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")

#: The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 and up.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class ByteBpe:
    """Encoder for one tokenizer file: the library's ids with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # ``known`` holds every result already

    def _learn_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        merge = self.model.tokenize
        return {
            p: array("I", [t.id for t in merge(p.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
            for p in pieces
        }

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that may be several pieces."""
        if not chunks:
            return {}
        encoded = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        ends = (np.cumsum(np.bincount(encoded.word_ids, minlength=len(chunks))) * 4).tolist()
        ids = np.array(encoded.ids, dtype="<u4").tobytes()
        return {c: ids[a:b] for c, a, b in zip(chunks, [0, *ends[:-1]], ends)}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
        whole = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        given, texts = texts, ["" if i in whole else t for i, t in enumerate(texts)]
        plain = [bool(_PLAIN.fullmatch(t)) for t in texts]
        cut = [_PIECE.findall(t) if p else _BEFORE_WORD.split(t) for t, p in zip(texts, plain)]
        new = self._learn_pieces(set().union(*[c for c, p in zip(cut, plain) if p]).difference(known))
        known.update(new)
        if not all(plain):
            more = self._learn(list(set().union(*[c for c, p in zip(cut, plain) if not p]).difference(known, ("",))))
            known.update(more)
            new |= more
        known[""] = b""
        out = [b"".join([known[c] for c in chunks]) for chunks in cut]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(given[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        for c in new:
            if len(c) > CACHE_CHARS:
                del known[c]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


#: Texts that are encoded together: so many, or fewer if they are long.
TOGETHER, TOGETHER_CHARS = 64, 1_000_000


def grouped(texts: list[str]) -> list[tuple[int, int]]:
    """Ranges of neighbouring texts to encode together."""
    out, start, chars = [], 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if i + 1 - start >= TOGETHER or chars >= TOGETHER_CHARS:
            out.append((start, i + 1))
            start, chars = i + 1, 0
    return out + ([(start, len(texts))] if start < len(texts) else [])


_encoders: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """The encoder of this worker, made at its first use."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]
