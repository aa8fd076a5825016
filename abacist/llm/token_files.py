"""Token ids in flat unsigned files with 64-bit document offsets.

Format: for each part three files of little-endian integers. ``ids``: the ids of its documents one after
another, unsigned 16-bit where the vocabulary allows it, else unsigned 32-bit. ``offsets``: one 64-bit
number more than there are documents; document ``i`` has the ids from ``offsets[i]`` up to
``offsets[i + 1]``. ``docs``: 64-bit document ids. Parts are in ascending order of document ids and hold about ``PART_BYTES``
of text. A manifest row per part gives its files and how many of its documents, the first ones, have no id; a part's base, the number
of ids before it, is a prefix sum over the manifest. A reader maps local files and reads others range by range.

Each attempt of a task writes files of its own name and the manifest names only those of the attempt that
succeeded, so lost executors leave no mixed or doubled parts.

Nulls count as empty texts; an empty text has the end id only. A null document id is stored as 0 and comes first.
Rows with equal document ids are all written, in the order of a hash of their texts, over as many parts as their bytes need.
An empty table gives no parts. Other columns of the input are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.llm.workspace import fresh_path, slices, stored, tidied

MANIFEST = "part int, n_docs long, n_null long, n_tokens long, width int, ids string, offsets string, docs string"
#: Bytes of text for a part, and documents read at once.
PART_BYTES, READ_DOCS = 256 << 20, 1_024


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode ``text`` and write the files; returns the manifest with each part's ``base``.

    ``folder`` is a URI that pyarrow's file systems can write (file, hdfs, s3, gs); by default a new one in
    the shared folder. There are ``spark.sql.shuffle.partitions`` parts, or more where ``PART_BYTES`` asks for them.
    """
    spark = docs.sparkSession
    folder = (folder or fresh_path(spark, "token-files")).rstrip("/")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from abacist.llm.byte_bpe import encoder, grouped

        bpe, files = encoder(tokenizer), None
        width = 2 if max(bpe.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], dtype="<u4").tobytes()
        total, count, n_null = 0, 0, 0
        for batch in slices(batches, 4096):
            if not batch.num_rows:
                continue
            if files is None:
                store, path = pyarrow.fs.FileSystem.from_uri(folder)
                store.create_dir(path, recursive=True)
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                names = [f"{name}.{kind}" for kind in ("ids", "offsets", "docs")]
                files = [store.open_output_stream(f"{path}/{n}", compression=None) for n in names]
                files[1].write(np.zeros(1, dtype="<i8").tobytes())
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in grouped(texts):
                encoded = [x + end for x in bpe.encode_all(texts[a:b])]
                flat = np.frombuffer(b"".join(encoded), dtype="<u4")
                files[0].write(flat.astype(f"<u{width}").tobytes())
                ends = total + np.cumsum([len(x) // 4 for x in encoded])
                files[1].write(ends.astype("<i8").tobytes())
                total, count = int(ends[-1]), count + len(encoded)
            n_null += batch.column("doc_id").null_count
            ids = batch.column("doc_id").fill_null(0)
            files[2].write(ids.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        if files:
            for f in files:
                f.close()
            row = {"part": TaskContext.get().partitionId(), "n_docs": count, "n_null": n_null, "n_tokens": total, "width": width}
            row |= dict(zip(("ids", "offsets", "docs"), (f"{folder}/{n}" for n in names)))
            schema = pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()),
                                ("ids", pa.string()), ("offsets", pa.string()), ("docs", pa.string())])
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    # the hash and the row number let a range end within rows of one id, or equal rows
    rows = docs.select(docs["doc_id"].cast("long"), docs["text"], F.xxhash64(docs["text"]).alias("h"), F.monotonically_increasing_id().alias("n"))
    ordered = rows.repartitionByRange(parts, "doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n").select("doc_id", "text")
    manifest = stored(ordered.mapInArrow(lambda x: tidied(write_part(x)), MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def opened(uri: str) -> Callable[[int, int], bytes]:
    """Bytes of one file from one place to another: memory-mapped where it is local, read from the store otherwise."""
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    if not store.get_file_info(path).size:
        return lambda start, end: b""
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        mapped = np.memmap(path, dtype="u1", mode="r")
        return lambda start, end: mapped[start:end].tobytes()
    file = store.open_input_file(path)
    return lambda start, end: file.read_at(end - start, start)


def read(manifest: DataFrame) -> DataFrame:
    """A row per document from the files: ``start``, ``n_tokens`` and the unsigned CRC-32 of its ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                ids, offsets, docs = (opened(part[kind]) for kind in ("ids", "offsets", "docs"))
                width = part["width"]
                for a in range(0, part["n_docs"], READ_DOCS):
                    b = min(a + READ_DOCS, part["n_docs"])
                    at = np.frombuffer(offsets(8 * a, 8 * b + 8), dtype="<i8")
                    of = np.frombuffer(docs(8 * a, 8 * b), dtype="<i8")
                    sums = [zlib.crc32(np.frombuffer(ids(width * i, width * j), dtype=f"<u{width}").astype("<u4").tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                    columns = [pa.array(of, mask=np.arange(a, b) < part["n_null"]), pa.array(part["base"] + at[:-1]), pa.array(np.diff(at))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, type=pa.int64())], schema=schema)

    spread = manifest.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part")
    return spread.mapInArrow(read_parts, "doc_id long, start long, n_tokens long, ids_crc32 long")
