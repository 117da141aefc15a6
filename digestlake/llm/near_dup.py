"""MinHash near-duplicates with odd sketches.

A document's set holds its distinct word shingles. Documents with equal sets form one class at once; only one of
each class goes on. Its MinHash samples are cut into bands, whose keys bring candidates together, and folded
into a parity bitmap, the odd sketch: the population count of the XOR of two sketches estimates how many samples
differ, most precisely where few do. Candidates that the estimate does not rule out are confirmed on their full sets.

Candidates are never all pairs of a bucket. A first round holds each member of a bucket against two pivots, of which one is
the most central. Components of the confirmed links follow. A second round goes through the buckets whose members are still
in several components, and there holds members of the smaller components against all members of others, by sketches and in
blocks of bounded size. So large groups of near copies cost a few pairs a member, and no link between components is lost.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from digestlake.llm.components import components, united
from digestlake.llm.decontaminate import _texts
from digestlake.llm.tables import id_and_text, slices
from digestlake.llm.words import SHINGLE_BYTES, Words, chain, mix
from digestlake.session import discard, stash

#: 40 bands of 5 samples: a pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 40 = 1e-7.
BANDS, ROWS = 40, 5
#: Samples in all; the sketch folds every one of them.
SAMPLES = 512
#: Bits of an odd sketch.
SKETCH_BITS = 2048
#: Members of a bucket that one task holds against as many others in the second round.
BLOCK = 1024
FACTORS = (mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
SHIFTS = (mix(np.arange(1001, SAMPLES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle names of each text; of a text with fewer words, the name of the whole sequence."""
    for some in slices(texts, len):
        words = Words(some, SHINGLE_BYTES)
        runs = chain(words.name, size, size)
        for k in range(len(some)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            else:
                yield chain(words.name[a:b], b - a, 1000 + b - a) if b > a else np.empty(0, np.uint64)


def samples(names: np.ndarray) -> np.ndarray:
    """MinHash: the least value of every hash function over the set."""
    least = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    short = (names >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(names), 512):
        values = short[a : a + 512, None] * FACTORS
        values += SHIFTS
        least = np.minimum(least, values.min(axis=0))
    return least


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """Parity bitmaps, one row of 64-bit words for each row of samples: every (function, value) flips a bit."""
    n = len(least)
    at = (mix(least.astype(np.uint64) << np.uint64(16) | np.arange(SAMPLES, dtype=np.uint64)) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    flips = np.bincount((at + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8), axis=1).view(np.uint64)


def estimate(differing_bits: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the population count of the XOR of two odd sketches."""
    share = np.minimum(2 * differing_bits / SKETCH_BITS, 0.999)
    return 1 + SKETCH_BITS / 2 * np.log(1 - share) / (2 * SAMPLES)


def most_bits(similarity: float) -> int:
    """Bits that may differ for a candidate: five standard deviations beyond what the similarity gives, so that the sketch
    turns away fewer than one in a million of the pairs that are linked."""
    differ = 2 * SAMPLES * (1 - similarity)
    slope = np.exp(-2 * differ / SKETCH_BITS)
    mean = SKETCH_BITS / 2 * (1 - slope)
    sampling = 2 * np.sqrt(SAMPLES * similarity * (1 - similarity)) * slope
    colliding = np.sqrt(differ**2 / SKETCH_BITS)
    return int(np.ceil(mean + 5 * np.hypot(sampling, colliding)))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node and proof (the two halves of a digest of the whole set), bands (keys), sketch for every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(_texts(b), size))
            least = np.array([samples(s) for s in sets], np.uint32).reshape(len(sets), SAMPLES)
            keys = chain_rows(least[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, ROWS)).reshape(-1, BANDS)
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            columns = [pa.array([len(s) for s in sets], pa.int64()), *halves(sets), pa.array(list(keys), pa.list_(pa.int64())), pa.array(list(odd_sketches(least).view(np.int64)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_shingles", "node", "proof", "bands", "sketch"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, node long, proof long, bands array<long>, sketch array<long>")


def chain_rows(rows: np.ndarray) -> np.ndarray:
    made = np.full(len(rows), 0x77, np.uint64)
    for k in range(rows.shape[1]):
        made = mix(made * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return made


def set_digest(names: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of all members of a set, given in order: sets of equal digests are equal."""
    return tuple(np.frombuffer(hashlib.blake2b(names.tobytes(), digest_size=16).digest(), "<i8").tolist())


def halves(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    digests = [set_digest(s) for s in sets]
    return pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64())


def alike(n_a, n_b, percent: int):
    """What the sizes of two sets must hold for a link."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def shared_bands(nodes: DataFrame) -> DataFrame:
    """key, node, n, turn: buckets of two members or more.

    turn orders a node's claim to be a pivot: how many others all its buckets hold. Where copies stem from one text, that text or
    one near it shares most buckets with the others, and comes first in all of them.
    """
    bands = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    met = stash(bands.join(shared, "key"), "bands")
    central = met.groupBy("node").agg(F.sum("held").alias("central"))
    turns = stash(met.join(central, "node").select("key", "node", "n", F.struct("central", F.xxhash64("node").alias("hash")).alias("turn")), "turns")
    discard(met)
    return turns


def pivot_pairs(bands: DataFrame, percent: int) -> DataFrame:
    """a, b: members of buckets with two pivots of theirs: the most central one, and the one of the least hash."""
    who = F.struct("node", "n")
    pivots = bands.groupBy("key").agg(F.max_by(who, "turn").alias("one"), F.min_by(who, "turn.hash").alias("other"))
    pivots = pivots.select("key", F.explode(F.array_distinct(F.array("one", "other"))).alias("p"))
    met = bands.join(pivots, "key").where((F.col("p.node") != F.col("node")) & alike(F.col("p.n"), F.col("n"), percent))
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def screened(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The pairs whose odd sketches do not rule a link out."""
    sketch = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    bits = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return pairs.join(sketch("a"), "a").join(sketch("b"), "b").where(bits <= most).select("a", "b")


def cells(bands: DataFrame) -> DataFrame:
    """key, i, j, side, node, n, component, sketch: members of buckets that hold several components, dealt into cells.

    bands: key, node, n, turn, sketch, component. The component of a bucket's pivot is its main one. Its other members, the rest,
    meet each other and those of the main one, in blocks; members of the main component do not meet. Cell (i, -1 - j)
    holds rest block i and main block j, cell (i, j) with i <= j rest blocks i and j. Side 0 meets side 1, and itself in (i, i).
    """
    mixed = bands.groupBy("key").agg(F.max_by("component", "turn").alias("main"), F.min("component").alias("least"), F.max("component").alias("largest")).where("least < largest").select("key", "main")
    sides = bands.join(mixed, "key").withColumn("rest", F.col("component") != F.col("main")).select("key", "node", "rest")
    sizes = sides.groupBy("key").agg(F.count_if("rest").alias("r"), F.count_if(~F.col("rest")).alias("m"))
    blocks = sizes.select("key", F.ceil(F.col("r") / BLOCK).cast("int").alias("nr"), F.ceil(F.col("m") / BLOCK).cast("int").alias("nm"))
    own = lambda n: F.pmod(F.xxhash64("node", "key"), n).cast("int")
    upto = lambda n, make: F.transform(F.sequence(F.lit(0), n - 1), make)
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    of_rest = F.concat(
        upto(F.col("nm"), lambda j: cell(own(F.col("nr")), -1 - j, 0)),
        upto(F.col("nr"), lambda j: F.when(j >= own(F.col("nr")), cell(own(F.col("nr")), j, 0)).otherwise(cell(j, own(F.col("nr")), 1))),
    )
    of_main = upto(F.col("nr"), lambda i: cell(i, -1 - own(F.col("nm")), 1))
    dealt = bands.join(blocks, "key").join(mixed, "key").withColumn("cell", F.explode(F.when(F.col("component") != F.col("main"), of_rest).otherwise(of_main)))
    return dealt.select("key", "cell.i", "cell.j", "cell.side", "node", "n", "component", "sketch")


CELL = ("key", "i", "j")


def on_cells(rows: DataFrame, make, schema: str) -> DataFrame:
    """make over record batches that hold whole cells, sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in (b for b in batches if b.num_rows):
            cut = edges_of(b, CELL)[-2]
            if cut or (held and any(held[-1].column(c)[-1] != b.column(c)[0] for c in CELL)):
                whole = [x for x in (*held, b.slice(0, cut)) if x.num_rows]
                if whole:
                    yield from make(pa.Table.from_batches(whole).combine_chunks())
                held = []
            held.append(b.slice(cut))
        if held:
            yield from make(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, schema)


def edges_of(rows, columns: tuple) -> list[int]:
    """Where runs of equal values begin, and the end."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in columns:
        x = rows.column(c).to_numpy() if isinstance(rows, pa.Table) else rows.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return [*np.flatnonzero(new).tolist(), rows.num_rows]


def meetings(table: pa.Table, percent: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each cell: a row, and the rows that it may be linked with by component, size and sketch."""
    x = {c: table.column(c).to_numpy() for c in ("i", "j", "side", "n", "component")}
    sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
    edges = edges_of(table, CELL)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        rows = np.arange(lo, hi)
        one = rows[x["side"][lo:hi] == 0]
        alone = x["i"][lo] == x["j"][lo]
        other = one if alone else rows[x["side"][lo:hi] == 1]
        for a in one.tolist():
            b = other[other > a] if alone else other
            n, m = x["n"][a], x["n"][b]
            b = b[(x["component"][b] != x["component"][a]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)]
            if len(b):
                b = b[np.bitwise_count(sketch[b] ^ sketch[a]).sum(axis=1) <= most]
                if len(b):
                    yield a, b


def cross_links(bands: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, most: int) -> DataFrame:
    """doc_ids a, b of links between components.

    Members that may have a link in a cell are picked out by sketches, each once a cell; only for these are full sets
    fetched, and held against each other within the cell. What leaves a cell are links alone, and of those only the ones
    that join what the cell's earlier ones have not.
    """
    schema = "key long, i int, j int, side int, node long, n long, component long, sketch array<long>"

    def pick(table: pa.Table) -> Iterator[pa.RecordBatch]:
        picked = np.zeros(table.num_rows, bool)
        for a, b in meetings(table, percent, most):
            picked[a] = picked[b] = True
        yield from table.filter(pa.array(picked)).combine_chunks().to_batches()

    def verify(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names, ids = table.column("names").combine_chunks(), table.column("doc_id").to_pylist()
        at, flat = names.offsets.to_numpy(), names.values.to_numpy()
        own = lambda k: flat[at[k] : at[k + 1]]
        parent: dict[int, int] = {}

        def root(k: int) -> int:
            while parent.setdefault(k, k) != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        found = []
        component = table.column("component").to_pylist()
        for a, bs in meetings(table, percent, most):
            for b in bs.tolist():
                if root(component[a]) != root(component[b]):
                    both = len(np.intersect1d(own(a), own(b), assume_unique=True))
                    if both * 100 >= (len(own(a)) + len(own(b)) - both) * percent:
                        parent[root(component[a])] = root(component[b])
                        found.append((ids[a], ids[b]))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    picked = stash(on_cells(cells(bands), pick, schema), "cells")
    if picked.isEmpty():
        return picked.select(F.col("node").alias("a"), F.col("node").alias("b"))
    sets = full_sets(picked.select("node").distinct(), nodes, docs, size)
    links = stash(on_cells(picked.join(sets, "node"), verify, "a long, b long"), "links")
    discard(picked)
    return links


def full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """doc_id, node, names: the sorted shingle names of the wanted nodes, from their texts."""
    ids = wanted.join(nodes.select("node", "proof", "doc_id"), "node")
    texts = docs.join(ids, "doc_id").dropDuplicates(["doc_id", "node", "proof", "text"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, node, proof = list(shingle_sets(_texts(b), size)), b.column("node").to_pylist(), b.column("proof").to_pylist()
            right = pa.array([set_digest(s) == (n, p) for s, n, p in zip(sets, node, proof, strict=True)], pa.bool_())
            whole = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "node", "names"])
            yield whole.filter(right)

    return texts.mapInArrow(full, "doc_id long, node long, names array<long>")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_ids a, b of the pairs that are linked by their full sets."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, size)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("doc_id").alias(f"id_{c}"), F.col("names").alias(f"names_{c}"))
    both = F.size(F.array_intersect("names_a", "names_b"))
    linked = both * 100 >= (F.size("names_a") + F.size("names_b") - both) * percent
    return pairs.join(side("a"), "a").join(side("b"), "b").where(linked).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Linked are documents with 100 * |intersection| >= percent * |union| of their shingle sets; rows of one doc_id are one
    document. component_id is the least doc_id reachable by links, kept whether it is the document's own. Null and
    empty texts, and texts without words, have no shingles and are linked with nothing. Rows without a doc_id
    are in no link and are kept. An empty table gives no rows. Documents of equal sets are linked by a digest of the whole set,
    all others by their whole sets. A very long text is held whole by one task, at some 40 bytes a word.
    """
    docs = id_and_text(docs)
    signed = stash(signatures(docs, size), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "n_shingles", "bands", "sketch"))
    nodes = stash(full.groupBy("node", "proof").agg(first.alias("x")).select("node", "proof", "x.doc_id", F.col("x.n_shingles").alias("n"), "x.bands", "x.sketch"), "nodes")
    same = full.select("doc_id", "node", "proof").join(nodes.select("node", "proof", F.col("doc_id").alias("rep")), ["node", "proof"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    texts, most = docs.where("doc_id is not null"), most_bits(percent / 100)
    turns = shared_bands(nodes)
    pairs = stash(screened(pivot_pairs(turns, percent), nodes, most), "pairs")
    links = stash(confirmed(pairs, nodes, texts, size, percent), "links")
    labels = components(links.unionByName(same))
    placed = nodes.select("node", "doc_id", "sketch").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    bands = turns.join(placed.select("node", "sketch", "component"), "node")
    more = cross_links(bands, nodes, texts, size, percent, most)
    if not more.isEmpty():
        labels = united(labels, more)
    discard(turns, pairs, links)
    every = signed.select("doc_id", "n_shingles").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return every.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, whatever the case of its letters."""
    there = {c.lower() for c in docs.columns}
    while name.lower() in there:
        name += "_"
    return name


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of the document with the least doc_id in each component, one row of each such
    document: of rows that repeat its doc_id the one with the least text, null before others, and of those with equal texts the one
    whose columns, written as JSON, have the least digest. Rows without a doc_id stay. Further columns may have any name and type.
    """
    found = near_duplicates(docs, size, percent)
    own, turn = unused(docs, "own_id"), unused(docs, "turn")
    gone = found.where("not kept").select(F.col("doc_id").alias(own)).distinct()
    with_id = docs.withColumn(own, F.col("doc_id").cast("long"))
    left = with_id.join(gone, own, "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        rest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256)
        order = Window.partitionBy(own).orderBy(F.col("text").cast("string").asc_nulls_first(), rest)
        one = left.where(F.col(own).isNotNull()).withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).drop(turn)
        left = left.where(F.col(own).isNull()).unionByName(one)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
