"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

``encode_pieces`` keeps an agenda (a heap) of the adjacent symbol pairs of a text, ordered by the score of
the piece they would make and then from left to right, and merges until no pair makes a piece. What is left
outside the vocabulary falls back to bytes.

No piece joins a word's last character with the mark of the next word's start, and no piece holds a
control character; both are read from the vocabulary, not assumed. So a text is cut there, and the
agenda runs once for each different segment of a worker. In every Arrow batch the segments that are new are
also encoded by the sentencepiece library; where the two differ, the library's ids are taken and counted in
``n_differing``, so the result is always the library's.

Nulls count as empty texts; an empty text has the begin and end ids only. Equal rows give equal rows; the
input's other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from abacist.llm.workspace import slices, tidied

#: Segments kept per Python worker; the dictionary is emptied when it is full, which changes no result.
CACHE_SEGMENTS = 1_500_000
CACHE_CHARS = 48
MARK = "▁"

SCHEMA = (
    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string, n_differing long"
)


class PieceBpe:
    """A merge-type vocabulary, its agenda, and the library's processor to check against."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.vocab_size())
        special = {i for i in every if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.id_of = {sp.id_to_piece(i): i for i in every if i not in special}
        self.rank = {
            p: r for r, (_, p) in enumerate(sorted((-sp.get_score(i), p) for p, i in self.id_of.items() if len(p) > 1))
        }
        scores = {sp.get_score(self.id_of[p]) for p in self.rank}
        if len(scores) != len(self.rank):  # equal scores are merged from left to right
            order = {s: r for r, s in enumerate(sorted(scores, reverse=True))}
            self.rank = {p: order[sp.get_score(self.id_of[p])] for p in self.rank}
        self.byte_id = {i: sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)}
        longer = "".join(self.rank)
        self.cuts_words = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank)
        alone = "".join(re.escape(c) for c in map(chr, range(32)) if c not in longer)
        self.checkable = self.cuts_words and "\n" not in longer
        self.segments = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}

    def agenda(self, segment: str) -> list[str]:
        """The segment's symbols once no adjacent pair makes a piece."""
        symbols: list[str] = list(segment)
        n, rank = len(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [(r, i, 2) for i in range(n - 1) if (r := rank(symbols[i] + symbols[i + 1])) is not None]
        heapify(pairs)
        while pairs:
            _, left, size = heappop(pairs)
            right = after[left]
            if right >= n or not symbols[left] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            merged = symbols[left] + symbols[right]
            symbols[left], symbols[right] = merged, ""
            after[left] = end = after[right]
            if end < n:
                before[end] = left
                if (r := rank(joined := merged + symbols[end])) is not None:
                    heappush(pairs, (r, left, len(joined)))
            if (start := before[left]) >= 0 and (r := rank(joined := symbols[start] + merged)) is not None:
                heappush(pairs, (r, start, len(joined)))
        return [s for s in symbols if s]

    def encode_pieces(self, segment: str) -> bytes:
        ids: list[int] = []
        for s in self.agenda(segment):
            if (i := self.id_of.get(s)) is not None:
                ids.append(i)
            else:
                ids.extend(map(self.byte_id.__getitem__, s.encode()))
        return array("I", ids).tobytes()

    def checked(self, new: list[str]) -> tuple[dict[str, bytes], int]:
        """Ids of the segments, by the agenda and then by the library; how many differ."""
        own = {s: self.encode_pieces(s) for s in new}
        if not self.checkable:
            return own, 0
        differing = 0
        lead = self.library.encode("\n")
        for s, ids in zip(new, self.library.encode(["\n" + s.replace(MARK, " ") for s in new], num_threads=1)):
            if own[s] != (theirs := array("I", ids[len(lead):]).tobytes()):
                own[s] = theirs
                differing += 1
        return own, differing

    def encode_all(self, texts: list[str]) -> tuple[list[bytes], int]:
        """Ids of whole texts with begin and end ids, and how many new segments the library encoded otherwise."""
        sp, known = self.library, self.known
        if len(known) > CACHE_SEGMENTS:
            known.clear()
        normal = [sp.normalize(t) if t else "" for t in texts]
        cut = [self.segments.findall(t) for t in normal] if self.cuts_words else [[t] if t else [] for t in normal]
        new, differing = self.checked(list(set().union(*cut).difference(known)))
        known.update(new)
        begin, end = (array("I", [i]).tobytes() for i in (sp.bos_id(), sp.eos_id()))
        out = [b"".join([begin, *[known[s] for s in c], end]) for c in cut]
        for s in new:
            if len(s) > CACHE_CHARS:
                del known[s]
        if not self.checkable:
            theirs = [array("I", x).tobytes() for x in sp.encode(texts, add_bos=True, add_eos=True, num_threads=1)]
            differing, out = differing + sum(a != b for a, b in zip(out, theirs)), theirs
        return out, differing

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, dtype="<u4").tolist())


_processors: dict[str, PieceBpe] = {}


def processor(path: str) -> PieceBpe:
    if path not in _processors:
        _processors[path] = PieceBpe(path)
    return _processors[path]


def encode_decode(docs: DataFrame, model: str, digests_only: bool = False) -> DataFrame:
    """``doc_id`` and ``text`` to ids (little-endian unsigned 32-bit), the text decoded from them, and digests.

    With ``digests_only`` the ids and decoded texts stay in the worker and those two columns are null.
    ``n_differing`` counts, on the first row of each group of texts, segments that only the library got right.
    """
    from abacist.llm.byte_bpe import grouped

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
         ("ids", pa.binary()), ("decoded", pa.string()), ("n_differing", pa.int64())]
    )

    def batch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = processor(model)
        for batch in slices(batches, 2048):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows: list[tuple] = []
            ids_of = batch.column("doc_id").to_pylist()
            for a, b in grouped(texts):
                encoded, differing = bpe.encode_all(texts[a:b])
                for k, ids in enumerate(encoded):
                    decoded = bpe.decode(ids)
                    shown = (None, None) if digests_only else (ids, decoded)
                    rows.append((ids_of[a + k], len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                 hashlib.sha256(decoded.encode()).hexdigest(), *shown, 0 if k else differing))
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lambda x: tidied(batch_rows(x)), SCHEMA)
