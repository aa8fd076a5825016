"""Nearest neighbours by inner product: p-stable hashing with multiple probes, and exact reranking.

Vectors get one more component that makes all norms one norm (queries get 0), so that the order by inner product
becomes the order by distance. That norm covers ``LIFTED`` of a sample; the few vectors of larger norm have a bucket of
their own that every query visits, so that outliers don't move queries away from the other data. A table hashes a vector
with ``HASHES`` functions ``floor((a x + b) / w)``, ``a`` normal (2-stable).

A query visits the perturbed buckets of each table in the order of estimated success: the sum of the squared distances to
the sides of the bucket that its projection must cross. How many it visits is measured for each query: as many as find the
share ``TARGET`` of its nearest vectors in a bounded sample; the full table is denser, so its neighbours are nearer and
easier to find. Queries that no number of visits serves, whose last neighbour ties with others (the smaller id wins, which no
hash can tell), or that found fewer entries than a result needs, are compared exactly with all rows, in blocks.

Every distinct vector is indexed in every table and stored once, in a block of about ``BLOCK`` vectors that holds whole buckets of
the first table where they fit. Hash keys and block numbers find the blocks that a query meets; its candidates in a block are merged over
tables and scored once. Where a query's buckets hold over ``DENSE`` of the sample, every query goes to every block without that look-up.
Copies of a vector are one entry with their smallest ids, as many as a result can hold, so a vector that a
third of all rows share costs no more than any other; its group is cut down before it is shuffled.

Vectors that are null, zero, of another length than most of the sample's, or hold a null or non-finite component
take no part. Rows with null ids take no part. Repeated rows with equal ids and vectors count once. Ties go to the smaller
id, however many there are. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abacist.llm.superminhash import _keyed_runs
from abacist.llm.workspace import slices, stored

TABLES, HASHES, SEED = 2, 4, 20
#: Width of a bucket, in deviations of the projections over the sample; the most steps from a query's own bucket in a function.
WIDTH, STEPS = 1.0, 4
#: Rows of the sample, queries of it, the recall to reach on it, and the share of its norms that the lift covers.
SAMPLE, SAMPLE_QUERIES, TARGET, LIFTED = 8_192, 256, 0.95, 0.995
#: Vectors in a block (at most, but for chance) and the least number of blocks; queries compared with a block at once.
BLOCK, BLOCKS, QUERY_BLOCK = 32_768, 12, 256
#: Share of the sample in a query's buckets from which looking up blocks doesn't pay.
DENSE = 0.1
#: Key of the vectors that the lift doesn't cover.
OUTLYING = -1
PAIRS, HELD = 65_536, 1_000_000

#: All perturbations: steps of each function.
_MOVES = np.array(list(itertools.product(range(-STEPS, STEPS + 1), repeat=HASHES)))
_PLACE = (2 * STEPS + 1) ** np.arange(HASHES - 1, -1, -1)


class Hashing:
    """The hash functions of all tables, fitted to a sample's norms and projections."""

    def __init__(self, sample: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.norm = float(np.quantile(np.sqrt(np.einsum("ij,ij->i", sample, sample)), LIFTED)) * (1 + 1e-6)
        self.normals = rng.standard_normal((TABLES * HASHES, sample.shape[1] + 1))
        spread = (self.lifted(sample, False) @ self.normals.T).std(axis=0) if len(sample) > 1 else np.ones(TABLES * HASHES)
        self.width = np.maximum(WIDTH * spread, 1e-9)
        self.shift = rng.random(TABLES * HASHES)
        self.sample = sample
        self.sample_buckets = np.floor(self.places(sample, False)).astype(np.int64)
        self.sample_outlying = self.index_keys(sample)[:, 0] == OUTLYING

    def lifted(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Vectors with the component that makes their norms equal; for queries of that norm, 0."""
        squares = np.einsum("ij,ij->i", vectors, vectors)
        if query:
            scale = self.norm / np.sqrt(squares)
            return np.column_stack([vectors * scale[:, None], np.zeros(len(vectors))])
        return np.column_stack([vectors, np.sqrt(np.maximum(self.norm**2 - squares, 0))])

    def places(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Projections in units of the bucket width, (rows, tables, hashes)."""
        return (self.lifted(vectors, query) @ self.normals.T / self.width + self.shift).reshape(-1, TABLES, HASHES)

    @staticmethod
    def keys(buckets: np.ndarray) -> np.ndarray:
        """One number per (table, bucket) of an array (rows, tables, ..., hashes)."""
        key = np.zeros(buckets.shape[:-1], dtype=np.int64)
        key += np.arange(TABLES).reshape((TABLES,) + (1,) * (buckets.ndim - 3))
        for i in range(HASHES):
            key = key * 1024 + np.clip(buckets[..., i] + 512, 0, 1023)
        return key

    def index_keys(self, vectors: np.ndarray) -> np.ndarray:
        """The key of each vector in each table."""
        keys = self.keys(np.floor(self.places(vectors, False)).astype(np.int64))
        keys[np.einsum("ij,ij->i", vectors, vectors) > self.norm**2] = OUTLYING
        return keys

    def agenda(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the perturbations in estimated success order, (rows, tables, perturbations), and the place of each in that order."""
        inside = (places - np.floor(places))[..., None]
        step = np.arange(-STEPS, STEPS + 1)
        # reaching a step crosses this distance
        cost = np.where(step > 0, step - inside, np.where(step < 0, inside - 1 - step, 0)) ** 2
        total = np.zeros(places.shape[:2] + (2 * STEPS + 1,) * HASHES)
        for i in range(HASHES):
            total += cost[:, :, i].reshape(places.shape[:2] + (1,) * i + (-1,) + (1,) * (HASHES - 1 - i))
        order = total.reshape(*places.shape[:2], -1).argsort(axis=-1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[-1]), order.shape), axis=-1)
        return order, rank

    def needed(self, places: np.ndarray, rank: np.ndarray, which: np.ndarray) -> np.ndarray:
        """How many visits a table each query needs to find these vectors of the sample, (rows, vectors); more than there are: never."""
        moves = self.sample_buckets[which] - np.floor(places).astype(np.int64)[:, None]
        reached = (np.abs(moves) <= STEPS).all(axis=-1)
        at = np.where(reached, ((moves + STEPS) * _PLACE).sum(axis=-1), 0).transpose(0, 2, 1)
        visits = np.where(reached, np.take_along_axis(rank, at, axis=2).transpose(0, 2, 1) + 1, len(_MOVES) + 1).min(axis=-1)
        return np.where(self.sample_outlying[which], 0, visits)

    def visits(self, queries: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per query the keys of the buckets that it visits, whether they reach ``TARGET``, and the share of the sample in them."""
        places = self.places(queries, True)
        order, rank = self.agenda(places)
        probes = np.ones(len(queries), dtype=np.int64)
        near, tied = self.nearest(queries, k)
        if near.shape[1]:
            found = np.sort(self.needed(places, rank, near), axis=1)
            probes = np.maximum(found[:, int(np.ceil(TARGET * near.shape[1])) - 1], 1)
        sure = (probes <= len(_MOVES)) & ~tied
        own = self.index_keys(queries)  # where the query's own copies are
        base = np.floor(places).astype(np.int64)
        keys = []
        for q in range(len(queries)):
            moves = _MOVES[order[q, :, : probes[q] if sure[q] else 1]]
            keys.append(np.unique(np.concatenate([self.keys(base[q : q + 1, :, None] + moves[None])[0].ravel(), own[q], [OUTLYING]])))
        share = np.mean(self.needed(places, rank, np.broadcast_to(np.arange(0, len(self.sample), 8), (len(queries), -(-len(self.sample) // 8)))) <= probes[:, None], axis=1)
        return keys, sure, share

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the numbers of its ``k`` best vectors of the sample, other than itself, and whether others tie with the last."""
        score = queries @ self.sample.T
        score[(queries[:, None, :1] == self.sample[None, :, :1])[..., 0] & (np.abs(score - np.einsum("ij,ij->i", queries, queries)[:, None]) < 1e-9)] = -np.inf
        m = max(0, min(k, len(self.sample) - 1))
        if not m:
            return np.zeros((len(queries), 0), dtype=np.int64), np.zeros(len(queries), dtype=bool)
        best = np.argpartition(-score, m - 1, axis=1)[:, :m]
        last = np.take_along_axis(score, best, axis=1).min(axis=1, keepdims=True)
        return best, (score >= last - 1e-9 * np.abs(last)).sum(axis=1) > m


def usable(vector: Column) -> Column:
    """Vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _best(query: np.ndarray, rep: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best different entries of each query, ties to the smaller."""
    order = np.lexsort((rep, -score, query))
    query, rep, score = query[order], rep[order], score[order]
    new = np.r_[True, (query[1:] != query[:-1]) | (rep[1:] != rep[:-1])] if len(query) else np.zeros(0, dtype=bool)
    query, rep, score = query[new], rep[new], score[new]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=int)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    return query[rank < k], rep[rank < k], score[rank < k]


def _top(asks: np.ndarray, q: np.ndarray, reps: np.ndarray, w: np.ndarray, mask: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of the vectors ``w`` for each of the queries ``q``, by exact scores; all that may tie with the last are compared."""
    score = q @ w.T
    if mask is not None:
        score[~mask] = -np.inf
    m = min(k, len(w))
    least = np.partition(score, len(w) - m, axis=1)[:, len(w) - m]
    room = 1e-9 * np.sqrt(np.einsum("ij,ij->i", q, q) * np.einsum("ij,ij->i", w, w).max())
    i, j = np.nonzero((score >= (least - room)[:, None]) & (score > -np.inf))
    exact = np.zeros(len(i))
    for a in range(0, len(i), PAIRS):
        exact[a : a + PAIRS] = _exact(q[i[a : a + PAIRS]], w[j[a : a + PAIRS]])
    return _best(asks[i], reps[j], exact, k)


def _candidates(tables: list[tuple[np.ndarray, np.ndarray]], asked: list[np.ndarray]) -> np.ndarray:
    """Which vectors are in a visited bucket of any table, (queries, vectors). ``tables``: the keys there, and which of them each vector has."""
    mask = np.zeros((len(asked), len(tables[0][1])), dtype=bool)
    who, what = np.repeat(np.arange(len(asked)), [len(a) for a in asked]), np.concatenate(asked)
    for there, of in tables:
        at = np.minimum(np.searchsorted(there, what), len(there) - 1)
        hit = there[at] == what
        visited = np.zeros((len(asked), len(there)), dtype=bool)
        visited[who[hit], at[hit]] = True
        mask |= visited[:, of]
    return mask


def _keyed_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Each block's vectors (0), then its queries (1) in bounded tables; blocks without vectors are left out."""
    block, asking = None, False
    for run in _keyed_runs(_bounded(batches), ["block", "asks", "piece"]):
        number = run.column("block")[0].as_py()
        if run.column("asks")[0].as_py() == 0:
            block, asking = number, True
            yield 0, run
        elif asking and number == block:
            yield 1, run


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with a column ``piece``: 0 for vectors, which stay together, and a new number for each batch of queries."""
    for number, batch in enumerate(slices(batches, 4 * QUERY_BLOCK), 1):
        piece = np.where(batch.column("asks").to_numpy() == 0, 0, number)
        yield batch.append_column("piece", pa.array(piece))


def search(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` rows nearest to each query row, other than itself.

    ``rows``: ``vec_id, embedding``; queries are the rows with ``is_query`` (of ``vec_id``).
    """
    spark = rows.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vector = F.col("embedding").cast("array<double>")
    taking = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))

    # copies: an entry (its smallest id) and at most k + 1 ids per vector and kind; each task keeps so many before the shuffle
    near = Window.partitionBy("v").orderBy("vec_id")
    ranked = taking.distinct().withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k + 1)
    entries = ranked.groupBy("v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = stored(entries.select("rep", "v", "ids"), "vectors")
    sample = entries.select("v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow().column("v")
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = np.array([len(v) for v in sample.to_pylist()])
    dimension = int(np.bincount(lengths).argmax())
    entries = entries.where(F.size("v") == dimension)
    hashing = Hashing(np.array([v for v in sample.to_pylist() if len(v) == dimension], dtype=np.float64))
    total = entries.count()
    blocks = max(BLOCKS, -(-total // BLOCK))
    tested = hashing.sample[:SAMPLE_QUERIES]
    dense = float(np.mean([hashing.visits(tested[a : a + 32], k)[2].mean() for a in range(0, len(tested), 32)])) > DENSE
    shared = spark.sparkContext.broadcast(hashing)  # at most SAMPLE vectors

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            if batch.num_rows:
                keys = shared.value.index_keys(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(list(keys), pa.list_(pa.int64()))], names=["rep", "keys"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            if batch.num_rows:
                keys, sure, _ = shared.value.visits(_matrix(batch.column("v")), k)
                columns = [batch.column("rep"), batch.column("v"), pa.array(keys, pa.list_(pa.int64())), pa.array(sure)]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "v", "keys", "sure"])

    indexed = stored(entries.select("rep", "v").mapInArrow(index, "rep long, keys array<long>"), "index")
    home = F.col("keys")[0].alias("home")
    sizes = stored(indexed.groupBy(home).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")), "bucket-sizes")
    part = F.pmod(F.xxhash64("rep"), "parts")
    block = F.pmod(F.xxhash64("home", part), F.lit(blocks)).cast("int")
    located = stored(indexed.withColumn("home", home).join(sizes, "home").select("rep", "keys", block.alias("block")), "located")

    asked = taking.where(is_query).select("vec_id", "v").distinct()
    # each distinct query vector is searched once
    question = asked.groupBy("v").agg(F.min("vec_id").alias("rep")).where(F.size("v") == dimension)
    probing = question.select("rep", "v").repartition(spread, "rep").mapInArrow(probe, "rep long, v array<double>, keys array<long>, sure boolean")
    probing = stored(probing, "probes")

    ours = located.join(entries.select("rep", "v"), "rep").select("block", F.lit(0).alias("asks"), "rep", "v", "keys")
    sure = probing.where("sure")
    if dense:
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        theirs = sure.select(every.alias("block"), F.lit(1).alias("asks"), "rep", "v", "keys")
    else:
        # (key, block) and (key, query) are pairs of numbers
        where = located.select(F.explode("keys").alias("key"), "block").distinct()
        met = sure.select("rep", F.explode("keys").alias("key")).join(where, "key").groupBy("rep", "block").agg(F.collect_set("key").alias("keys"))
        theirs = met.join(sure.select("rep", "v"), "rep").select("block", F.lit(1).alias("asks"), "rep", "v", "keys")
    found_schema = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for number, run in _keyed_parts(batches):
            if number == 0:  # a block's vectors come before the queries that visit it
                reps, w = run.column("rep").to_numpy(), _matrix(run.column("v").combine_chunks())
                tables = [np.unique(c, return_inverse=True) for c in run.column("keys").combine_chunks().flatten().to_numpy().reshape(len(reps), -1).T]
                continue
            asks, q = run.column("rep").to_numpy(), _matrix(run.column("v").combine_chunks())
            asked_keys = run.column("keys").combine_chunks()
            starts, flat = asked_keys.offsets.to_numpy(), asked_keys.values.to_numpy()
            for a in range(0, len(asks), QUERY_BLOCK):
                b = min(a + QUERY_BLOCK, len(asks))
                mask = _candidates(tables, [flat[starts[i] : starts[i + 1]] for i in range(a, b)])
                some = np.flatnonzero(mask.any(axis=0))
                if len(some):
                    held.append(_top(asks[a:b], q[a:b], reps[some], w[some], mask[:, some], k + 1))
            if sum(len(x[0]) for x in held) > HELD:
                held = [_best(*map(np.concatenate, zip(*held)), k + 1)]
                if len(held[0][0]) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], schema=found_schema)
                    held = []
        if held:
            best = _best(*map(np.concatenate, zip(*held)), k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], schema=found_schema)

    dealt = ours.unionByName(theirs).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(rerank, "query long, rep long, score double").distinct()
    first = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = lambda rows: rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")
    best = stored(top(found), "visited")
    counted = best.groupBy(F.col("query").alias("rep")).agg(F.count(F.lit(1)).alias("n"))
    enough = F.col("sure") & (F.coalesce("n", F.lit(0)) >= min(k + 1, total))
    missed = stored(probing.select("rep", "v", "sure").join(counted, "rep", "left").where(~enough).select("rep", "v"), "missed")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, run in _keyed_parts(batches):
            run_reps, run_v = run.column("rep").to_numpy(), _matrix(run.column("v").combine_chunks())
            if number == 0:
                reps, w = run_reps, run_v
                continue
            for a in range(0, len(run_reps), QUERY_BLOCK):
                best = _top(run_reps[a : a + QUERY_BLOCK], run_v[a : a + QUERY_BLOCK], reps, w, None, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], schema=found_schema)

    if missed.isEmpty():
        whole = best
    else:
        # every vector is in one block, and every missed query goes to each block
        held = entries.select(F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "rep", "v")
        asking = missed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "rep", "v")
        grid = held.unionByName(asking).repartition(blocks, "block").sortWithinPartitions("block", "asks")
        exact = top(grid.mapInArrow(compare, "query long, rep long, score double"))
        whole = best.join(missed.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(exact)
    # entries to ids; queries' copies each drop themselves
    copies = whole.join(entries.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = copies.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    answers = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("near"))
    named = asked.join(question.select("v", F.col("rep").alias("query")), "v").select("vec_id", "query")
    per_query = named.join(answers, "query").select(F.col("vec_id").alias("query_id"), "near")
    others = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    rows_out = per_query.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return rows_out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
