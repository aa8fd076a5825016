"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification and union-find.

A text's set are the hashes of its distinct word shingles. SuperMinHash gives every element a permutation of
the signature's places and, for its ``j``-th place, the value ``j`` plus a random fraction; a place keeps its
least value. The permutations make the places negatively correlated, which lowers the variance. Places are
filled layer by layer (``j`` = 0, 1, ...) for all elements at once, and stop early: once every place has a value
of the layers so far, no later layer can lower it.

1. Texts with equal sets become one representative; only representatives go on.
2. Signatures are banded; representatives that share a band and agree in enough places of the signature
   (six deviations below the threshold) are linked loosely. Members of one band's bucket are compared inside
   a task, in blocks, and only a spanning forest of the loose links leaves it.
3. Loose links are united. Each loose family is verified on whole texts' sets through an inverted index, and again only
   a spanning forest of the true links leaves a task, so no row per pair exists and no link between different texts of a family
   is lost. A family beyond one block is verified block by block first, each block with the family's smallest member; then the texts
   outside the family's largest component so far, in blocks, with all the others. Near copies of one text so cost a
   family no more than its size, and only texts that are apart are sent to several tasks.
4. True links are united and the components are carried to all texts.

Uniting links (``components``) alternates large-star and small-star steps on narrow rows, so nothing is
gathered in one task or on the driver.

Nulls and texts without words have an empty set and stay alone. Rows with equal ids: their sets are linked to
one component of that id. Null ids: the row keeps ``component_id`` null and ``kept`` true and takes no part.
An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.workspace import as_bytes, discard, slices, stored, tidied

#: Places of a signature, and places of a band: all bands miss a pair of similarity 0.8 with a chance of 7e-6.
PLACES, BAND = 150, 5
#: Deviations of the estimate below the threshold at which pairs are still verified.
DEVIATIONS = 6
#: Members of a bucket compared with each other; larger buckets are linked as a whole, which verification undoes.
BUCKET_BLOCK = 512
#: Texts and set elements of a block of a family; a task verifies two blocks together. So few pairs are compared one by one.
FAMILY_BLOCK, FAMILY_ELEMENTS, FEW = 1024, 2_000_000, 32
CACHE_WORDS = 200_000

_U = np.uint64
_GOLDEN, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


class Shingler:
    """Sorted distinct 64-bit hashes of word shingles; words' hashes are kept per worker."""

    def __init__(self, words: int):
        import xxhash

        self.words, self.digest, self.known = words, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Words are runs without ASCII white space, A-Z lower-cased. Fewer words than a shingle: one shingle of all."""
        cut = text.lower().split() if text else []
        if not cut:
            return np.zeros(0, dtype=_U)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            one = np.fromiter(map(known.__getitem__, cut), dtype=_U, count=len(cut))
        except KeyError:
            digest = self.digest
            known.update((w, digest(w)) for w in set(cut).difference(known))
            one = np.fromiter(map(known.__getitem__, cut), dtype=_U, count=len(cut))
        k = min(self.words, len(cut))
        out = np.full(len(cut) - k + 1, _U(k), dtype=_U)
        for i in range(k):
            out = mixed(out * _GOLDEN + one[i : len(cut) - k + 1 + i])
        return np.unique(out)


def superminhash(elements: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The signature of a set of 64-bit hashes: for each place the layer (high 32 bits) and fraction (low 32 bits)."""
    n = len(elements)
    signature = np.full(places, np.iinfo(np.uint64).max, dtype=_U)
    if not n:
        return signature
    order: np.ndarray | None = None
    rows = np.arange(n)
    for layer in range(places):
        state = mixed(elements + _U(int(_GOLDEN) * (2 * layer + 1) % (1 << 64)))
        swap = layer + ((state >> _U(32)) * _U(places - layer) >> _U(32)).astype(np.int64)
        if layer == 0 and n >= 16 * places:
            place = swap  # most likely the only layer; the permutations are made only if not
            first = swap
        else:
            if order is None:
                order = np.broadcast_to(np.arange(places, dtype=np.int16), (n, places)).copy()
                if layer == 1:
                    order[rows, first], order[:, 0] = 0, first
            place = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[:, layer]
            order[:, layer] = place
        value = (_U(layer) << _U(32)) | (state & _U(0xFFFFFFFF))
        np.minimum.at(signature, place, value)
        if (signature != np.iinfo(np.uint64).max).all():
            break
    return signature


SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"


def signed(docs: DataFrame, words: int) -> DataFrame:
    """Per document the size and digest of its set, the hashes of its bands and a byte per place. Empty sets: nulls."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                        ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        salt = np.arange(PLACES // BAND, dtype=_U) * _GOLDEN
        for batch in slices(batches, 2048):
            sizes, keys, bands, sketches = [], [], [], []
            for text in as_bytes(batch.column("text")):
                found = shingles(text)
                sizes.append(len(found))
                if not len(found):
                    keys.append(None), bands.append(None), sketches.append(None)
                    continue
                signature = superminhash(found)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                band = salt.copy()
                for column in signature.reshape(-1, BAND).T:
                    band = mixed(band * _GOLDEN + column)
                bands.append(band.view(np.int64))
                sketches.append(mixed(signature).astype(np.uint8).tobytes())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                       pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lambda x: tidied(sign(x)), SIGNED)


class Forest:
    """Union-find over 0 .. n - 1; the roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def unite(self, i: int, j: int) -> bool:
        i, j = sorted((self.root(i), self.root(j)))
        self.up[j] = i
        return i != j


def _spanning(sketches: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Spanning forest of the members that agree in at least ``least`` places."""
    n = len(sketches)
    if n == 2:
        return [(0, 1)] if int((sketches[0] == sketches[1]).sum()) >= least else []
    left, out = np.arange(n), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            near = (sketches[left] == sketches[i]).sum(axis=1) >= least
            out += [(i, int(j)) for j in left[near]]
            front += left[near].tolist()
            left = left[~near]
    return out


def _keyed_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows with equal ``names`` from batches sorted by them: tables of whole runs, all of a batch's small runs apart."""
    held: list[pa.Table] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        codes = [table.column(n).to_numpy() for n in names]
        change = np.zeros(len(codes[0]), dtype=bool)
        for c in codes:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), len(change)]
        for a, b in zip(edges, edges[1:]):
            this = tuple(c[a] for c in codes)
            if held and this != key:
                yield pa.concat_tables(held)
                held = []
            key = this
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGE)


def loose_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of representatives ``rep`` that share a band and whose sketches agree enough."""
    j = percent / 100
    least = int(PLACES * (j - DEVIATIONS * (j * (1 - j) / PLACES) ** 0.5))
    spread = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded = sets.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first")).where("n > 1")
    members = stored(banded.join(stored(buckets, "buckets"), "key"), "bucket-members")
    whole = members.where((F.col("n") > BUCKET_BLOCK) & (F.col("rep") != F.col("first"))).select(F.col("first").alias("a"), F.col("rep").alias("b"))
    small = members.where(F.col("n") <= BUCKET_BLOCK).select("rep", "key").join(sets.select("rep", "sketch"), "rep")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for run in _keyed_runs(batches, ["key"]):
            reps = run.column("rep").to_numpy()
            sketches = np.frombuffer(b"".join(run.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(reps), PLACES)
            for i, k in _spanning(sketches, least):
                a.append(int(reps[i])), b.append(int(reps[k]))
            if len(a) > 50_000:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)

    dealt = small.repartition(spread, "key").sortWithinPartitions("key")
    return whole.unionByName(dealt.mapInArrow(lambda x: tidied(link(x)), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) of every linked node: large-star and small-star until nothing changes."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, "links")
    while True:
        # large star: each node's larger neighbours move to its smallest neighbour or itself
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours move to the smallest of them
        down = large.where("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        if after.count() == pairs.count() and after.join(pairs, ["u", "v"], "left_anti").isEmpty():
            discard(after)
            break
        discard(pairs)
        pairs = after
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _true_links(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose intersection is at least ``percent`` of the union.

    Through an inverted index over the shingles that several sets have. Sets with equal ``known`` labels are united already;
    a set is compared only with those that aren't united with it yet.
    """
    sizes = np.array([len(s) for s in sets])
    part = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(flat, kind="stable")
    ordered = flat[by]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    lengths = np.diff(np.r_[starts, len(ordered)])
    several = lengths > 1
    held = np.repeat(several, lengths)
    post = owner[by][held]  # for each shingle of several sets, the sets that have it, ascending
    lengths = lengths[several]
    ends = np.cumsum(lengths)
    shingle = np.repeat(np.arange(len(lengths)), lengths)
    mine = np.argsort(post, kind="stable")
    edge = np.searchsorted(post[mine], np.arange(len(sets) + 1))
    out = []
    for i in range(len(sets)):
        apart = (part != part[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        apart[: i + 1] = False
        others = np.flatnonzero(apart)
        own = shingle[mine[edge[i] : edge[i + 1]]]
        if not len(own) or not len(others):
            continue
        if len(others) <= FEW:
            common = np.array([len(np.intersect1d(sets[i], sets[k], assume_unique=True)) for k in others])
        else:
            counts = np.zeros(len(sets), dtype=np.int64)
            for some in np.array_split(own, max(1, int(lengths[own].sum() // 4_000_000) + 1)):
                n = lengths[some]
                at = np.repeat(ends[some] - n - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                counts += np.bincount(post[at], minlength=len(sets))
            common = counts[others]
        for k in others[100 * common >= percent * (sizes[others] + sizes[i] - common)].tolist():
            if part[k] != part[i]:
                part[part == part[k]] = part[i]
                out.append((i, k))
    return out


def _verified(tasks: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """True links inside each task. ``tasks``: ``rep, task, label``, equal labels being united; ``docs``: ``rep, text``."""
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for run in _keyed_runs(batches, ["task"]):
            if run.num_rows < 2:
                continue
            reps = run.column("rep").to_numpy()
            sets = [shingles(t) for chunk in run.column("text").chunks for t in as_bytes(chunk)]
            links = _true_links(sets, percent, run.column("label").to_numpy())
            if links:
                yield _edges([int(reps[i]) for i, _ in links], [int(reps[k]) for _, k in links])

    # stored, so that its size decides whether it or the texts are moved
    ordered = stored(tasks, "family-tasks").join(docs, "rep").repartition(spread, "task").sortWithinPartitions("task", "rep")
    return ordered.mapInArrow(lambda x: tidied(verify(x)), "a long, b long")


def verified_links(docs: DataFrame, families: DataFrame, words: int, percent: int) -> DataFrame:
    """True links inside each family. ``families``: ``node, component, n_shingles``; ``docs``: ``rep, text``."""
    blocks_of = lambda n, elements: F.greatest(F.ceil(n / FAMILY_BLOCK), F.ceil(elements / FAMILY_ELEMENTS)).cast("int")
    sizes = [F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("elements")]
    counted = families.groupBy("component").agg(*sizes).select("component", blocks_of(F.col("n"), F.col("elements")).alias("blocks"))
    sized = stored(families.join(counted, "component"), "sized-families")
    block = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    # whole texts are moved once; both steps read those of families only
    texts = stored(docs.join(families.select(F.col("node").alias("rep")), "rep"), "family-texts")
    # a family's smallest member goes to all of its blocks
    own = F.when(F.col("node") == F.col("component"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    first = sized.select(F.col("node").alias("rep"), "component", "blocks", F.explode(own).alias("block"))
    first = first.select("rep", F.xxhash64("component", "block").alias("task"), F.col("rep").alias("label"))
    inside = stored(_verified(first, texts, words, percent), "block-links")

    large = sized.where("blocks > 1")
    if large.isEmpty():
        return inside
    united = components(inside.join(large.select(F.col("node").alias("a")), "a"))
    labelled = stored(large.join(united.withColumnRenamed("component", "label"), "node", "left").select(
        F.col("node").alias("rep"), "component", "n_shingles", "blocks", F.coalesce("label", "node").alias("label")), "labelled-families")
    groups = labelled.groupBy("component", "label").agg(*sizes)
    most = groups.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = groups.join(most, "component").where("label <> main").groupBy("component").agg(F.sum("n").alias("n"), F.sum("elements").alias("elements"))
    apart = most.join(rest, "component").select("component", "main", blocks_of(F.col("n"), F.col("elements")).alias("rest_blocks"))
    dealt = labelled.join(apart, "component")
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("label") == F.col("main"), F.col("blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    main, other = F.lit("main"), F.lit("rest")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, a, b: F.struct(kind.alias("kind"), a.alias("a"), b.alias("b"))
    # a block apart meets each main block and each block apart, itself among them
    of_main = F.transform(every("rest_blocks"), lambda a: cell(main, a, block))
    of_rest = F.concat(
        F.transform(every("blocks"), lambda b: cell(main, block, b)), F.transform(every("rest_blocks"), lambda b: cell(other, F.least(block, b), F.greatest(block, b)))
    )
    cells = dealt.select("rep", "component", "label", F.explode(F.when(F.col("label") == F.col("main"), of_main).otherwise(of_rest)).alias("cell"))
    second = cells.select("rep", F.xxhash64("component", "cell.kind", "cell.a", "cell.b").alias("task"), "label")
    return inside.unionByName(_verified(second, texts, words, percent))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Documents whose sets meet in at least ``percent`` of their union are linked; ``component_id`` is the smallest
    id that links reach, and a document is kept if that is its own.
    """
    sets = stored(signed(docs, words), "signed")
    known = sets.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    distinct = stored(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "distinct-sets")
    bearer = distinct.withColumn("doc_id", F.col("rep"))
    reps = known.join(bearer, ["set_key", "doc_id"]).select("rep", "set_key", "n_shingles", "bands", "sketch")
    reps = stored(reps.dropDuplicates(["set_key", "rep"]), "representatives")
    member = stored(sets.select("doc_id", "n_shingles", "set_key").join(distinct, "set_key", "left").drop("set_key"), "membership")
    loose = components(loose_links(reps, percent))
    sizes = reps.groupBy(F.col("rep").alias("node")).agg(F.sum("n_shingles").alias("n_shingles"))
    families = stored(loose.join(sizes, "node"), "families")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    links = verified_links(texts, families, words, percent)
    # an id with several sets links their representatives
    several = member.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    same = member.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    united = stored(components(links.unionByName(same)), "components").withColumnRenamed("node", "rep")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    found = member.join(united, "rep", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
