"""Sum-of-squares packing of documents into training sequences of a fixed length.

``pieces`` encodes each document and cuts only those that are longer than a sequence: full pieces, behind a
first piece that takes the remainder. ``pack`` fills sequences: full pieces alone, every other piece where
the sum, over the residual gaps, of the squared number of open sequences with that gap becomes smallest.
A step costs one pass over the gaps (at most the sequence length), whatever the number of sequences.

Pieces are dealt by a hash of their row numbers, so equal rows go to all groups alike and a group holds about ``GROUP_PIECES``.
Each group is packed on its own, longest first. Sequences that a group leaves with a gap of over ``SPARE`` tokens are taken
apart and their pieces packed again, in fewer groups, until one group's worth is left or a round leaves over
``STALLED`` of its pieces to the next. A task holds the numbers of one group at a time, no texts.

Nulls count as empty texts: a piece with the end id only. Equal rows each get pieces of their own, in whichever group; null
document ids are ordinary values. An empty table gives no pieces. Other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.llm.superminhash import _keyed_runs
from abacist.llm.workspace import slices, stored, tidied

#: Pieces packed in one group; a group is one task's work.
GROUP_PIECES = 16_384
#: A sequence with at most this share of its length free isn't taken apart again.
SPARE = 1 / 128
#: A round that leaves more than this share of its pieces to the next is the last.
STALLED = 0.9
#: Numbers of sequences: bits of a sequence in its group and of a group in its round.
SEQUENCE_BITS, GROUP_BITS = 20, 35

PIECES = "doc_id long, doc_key long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, with_ids: bool = False) -> DataFrame:
    """A row per piece. ``ids`` (little-endian unsigned 32-bit) only ``with_ids``, else null."""
    schema = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from abacist.llm.byte_bpe import encoder, grouped

        bpe, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, 4096):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            of, rows = batch.column("doc_id").to_pylist(), []
            for a, b in grouped(texts):
                for k, ids in enumerate(bpe.encode_all(texts[a:b]), a):
                    ids += end
                    n, key = len(ids) // 4, zlib.crc32(ids)
                    edges = [0, *range(n % length or min(n, length), n + 1, length)]
                    for i, (p, q) in enumerate(zip(edges, edges[1:])):
                        part = ids[4 * p : 4 * q]
                        rows.append((of[k], key, i, p, q - p, zlib.crc32(part), part if with_ids else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lambda x: tidied(cut(x)), PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the given order, and the gap of each sequence.

    Putting a piece of ``s`` tokens into a sequence with gap ``g`` changes the sum of squares by
    ``2 * (open[g - s] - open[g] + 1)``; a new sequence counts as gap ``capacity``. A sequence whose gap is too small for
    any piece isn't open and counts as nothing. Ties go to the smallest gap.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    least = max(1, int(lengths.min())) if len(lengths) else 1
    for i, s in enumerate(lengths.tolist()):
        change = 2 * (count[: capacity + 1 - s] - count[s:] + 1)
        change[:least] = (1 - 2 * count[s:])[:least]  # filled up
        change[-1] = 2 * count[capacity - s] + 1 if capacity - s >= least else 0
        possible = count[s:] > 0
        possible[-1] = True
        gap = s + int(np.argmin(np.where(possible, change, np.iinfo(np.int64).max)))
        if gap == capacity:
            b = len(gaps)
            gaps.append(capacity)
        else:
            b = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = left = gap - s
        if left >= least:
            stacks[left].append(b)
            count[left] += 1
    return bins, offsets, np.array(gaps, dtype=np.int64)


def _packed(rows: DataFrame, groups: int, capacity: int, round_no: int) -> DataFrame:
    """``rows`` with ``sequence_id``, ``offset`` and ``gap`` of the sequence."""
    # the rows are read from a stored table, so a task that runs again gives them the same numbers
    mixed = F.xxhash64(F.lit(round_no), F.monotonically_increasing_id())
    schema = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()),
                        ("offset", pa.int64()), ("gap", pa.int64())])

    def pack_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _keyed_runs(batches, ["group"]):
            bins, offsets, gaps = sum_of_squares(part.column("length").to_numpy(), capacity)
            if len(gaps) >> SEQUENCE_BITS:
                raise ValueError("a group of more sequences than numbers")
            ids = (((round_no << GROUP_BITS) + part.column("group")[0].as_py()) << SEQUENCE_BITS) + bins
            columns = [part.column(f.name).combine_chunks() for f in list(schema)[:6]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids), pa.array(offsets), pa.array(gaps[bins])], schema=schema)

    dealt = rows.select("doc_id", "doc_key", "piece", "start", "length", "ids_crc32", F.pmod(mixed, F.lit(groups)).alias("group"))
    ordered = dealt.repartition(groups, "group").sortWithinPartitions(
        "group", F.desc("length"), "doc_id", "doc_key", "piece", "start", "ids_crc32"
    )
    fields = "doc_id long, doc_key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, gap long"
    return ordered.mapInArrow(pack_groups, fields)


def pack(rows: DataFrame, capacity: int) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; offsets leave no gap from 0 on.

    ``rows`` is read more than once and must be stored.
    """
    fixed: Column = F.col("gap") <= int(capacity * SPARE)
    done: list[DataFrame] = []
    left = rows.count()
    for round_no in itertools.count():
        n, groups = left, max(1, -(-left // GROUP_PIECES))
        out = stored(_packed(rows, groups, capacity, round_no), f"packed-{round_no}")
        left = out.where(~fixed).count()
        if groups == 1 or left > STALLED * n:
            done.append(out)
            break
        done.append(out.where(fixed))
        rows = stored(out.where(~fixed).drop("sequence_id", "offset", "gap"), f"unpacked-{round_no}")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.drop("gap", "doc_key")


def sequences(packed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """The sequences' ids: a row per ``sequence_id`` with its pieces' ids joined (at most one capacity)."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = with_ids.select(*keys, "ids").dropDuplicates(keys)
    joined = packed.alias("p").join(ids.alias("i"), [F.col(f"p.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys])
    part = F.struct(F.col("p.offset"), F.col("p.doc_id"), F.col("i.ids"))
    return joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("pieces")).select(
        "sequence_id",
        F.transform("pieces", lambda x: x["doc_id"]).alias("doc_ids"),
        F.aggregate("pieces", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
