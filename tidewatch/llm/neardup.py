"""Near-duplicates by MinHash with odd sketches.

MinHash samples of a document's shingle set are banded to find candidates. A
second, larger family of samples of the candidates (the least hash in each of
8,192 ranges) is folded into a parity bitmap; the population count of two
bitmaps' XOR estimates how many samples differ, most precisely for very similar
sets. What passes is compared on the full sets. Links become classes by exchanging smallest
neighbours."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Memo, by_slices, free_name, written
from tidewatch.operators.ranking import once

#: 30 bands of 5 samples miss a pair of similarity 0.8 with probability 7e-6.
BANDS, ROWS = 30, 5
SAMPLES = BANDS * ROWS
RANGE_BITS = 13
RANGES = SKETCH_BITS = 1 << RANGE_BITS
#: Standard deviations that a sketch may be off before a pair is not compared further.
SIGMAS = 5.5

_RNG = np.random.default_rng(9)
_MUL = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Shingler:
    """Sets of distinct word shingles as sorted 64-bit hashes. Words are runs of
    anything but ASCII blanks, A-Z lower-cased; with fewer words than the
    width the whole sequence is the one shingle."""

    def __init__(self, width: int):
        self.width, self.hashes = width, Memo(xxhash.xxh3_64_intdigest, 100_000)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        width = min(self.width, len(words))
        h = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        n = len(words) - width + 1
        code = np.full(n, width, dtype=np.uint64)
        for i in range(width):
            code = (code ^ h[i:n + i]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(32)
        return np.unique(code)


_SHINGLERS: dict[int, Shingler] = {}


def shingler_of(width: int) -> Shingler:
    """One per Python worker, so its word cache lasts."""
    if width not in _SHINGLERS:
        _SHINGLERS[width] = Shingler(width)
    return _SHINGLERS[width]


def node_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minhash(shingles: np.ndarray) -> np.ndarray:
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 512):
        best = np.minimum(best, (shingles[i:i + 512, None] * _MUL + _ADD).min(0))
    return best


def bands_of(samples: np.ndarray) -> np.ndarray:
    code = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    for column in samples.reshape(BANDS, ROWS).T:
        code = (code ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(31)
    return code.view(np.int64)


def odd_sketch(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of samples, and for each bit the parity of how many fall on it.
    ``shingles`` are sorted, so the first of each range is its least."""
    place = shingles >> np.uint64(64 - RANGE_BITS)
    samples = shingles[np.concatenate(([True], place[1:] != place[:-1]))]
    bits = np.bincount(((samples * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return len(samples), np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketch_limit(a: Column, b: Column, na: Column, nb: Column, percent: int) -> Column:
    """Most differing bits of sketches of ``a`` and ``b`` samples if the sets, of
    ``na`` and ``nb`` shingles, have this similarity; the lower of two bounds.

    The first always holds: there are at most (na + nb) (1 - p) / (1 + p)
    differing shingles, each shingle that is no sample changes that by one at
    most, and bits only cancel. It is sharp for sets well below the number of
    ranges. The second is for large sets and exceeded less than once in a
    million times: the expected number plus standard deviations, as by chance
    vary how many samples differ and how many of those meet on a bit."""
    m, p = float(SKETCH_BITS), percent / 100
    sure = (na + nb) * ((1 - p) / (1 + p)) + (na - a) + (nb - b)
    union = (na + nb) / (1 + p)
    places = RANGES * (1 - F.exp(-union / RANGES))
    differing = F.greatest(F.lit(0.0), a + b - 2 * p * places)
    stay, x = F.exp(-2 * differing / m), 4 * differing / m
    chance = 12 * p * (1 - p) * places * (1 - places / union) + 4  # 12, not 4: measured, as a lost sample changes its neighbour too
    spread = F.pow(stay, 2) * chance + m / 4 * (1 - F.exp(-x) * (1 + x))
    return F.least(sure + 1e-6, m / 2 * (1 - stay) + SIGMAS * F.sqrt(spread) + 2)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node and bands of every document."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingler, n, nodes, bands = shingler_of(width), [], [], []
        for text in batch.column("text").to_pylist():
            s = shingler(text)
            n.append(len(s))
            nodes.append(node_of(s) if len(s) else None)
            bands.append(bands_of(minhash(s)) if len(s) else None)
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, longs)],
                                          names=["doc_id", "text_key", "n_shingles", "node", "bands"])

    return narrow.mapInArrow(by_slices(run), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text_key long, n_shingles long, node binary, bands array<long>")


def sets(docs: DataFrame, width: int) -> DataFrame:
    """node, its shingles and their odd sketch."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingler = shingler_of(width)
        found = [s for s in map(shingler, batch.column("text").to_pylist()) if len(s)]
        samples, sketches = zip(*map(odd_sketch, found)) if found else ((), ())
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array([node_of(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], longs), pa.array(samples, pa.int32()), pa.array(sketches, longs)],
            names=["node", "shingles", "samples", "sketch"])

    return docs.select("text").mapInArrow(by_slices(run), "node binary, shingles array<long>, samples int, sketch array<long>")


def alike(x: str, y: str, percent: int) -> Column:
    """Sizes and odd sketches of the frames ``x`` and ``y`` allow the similarity."""
    of = lambda frame, c: F.col(f"{frame}.{c}")
    differing = F.aggregate(F.zip_with(of(x, "sketch"), of(y, "sketch"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, c: acc + c)
    sizes = F.least(of(x, "n"), of(y, "n")) * 100 >= F.greatest(of(x, "n"), of(y, "n")) * percent
    return sizes & (differing <= sketch_limit(of(x, "samples"), of(y, "samples"), of(x, "n"), of(y, "n"), percent))


def measured(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """(a, b, common, total): shared and all shingles of each pair's full sets. A
    pair first takes the set of its second node along, then meets the first's,
    so a node with very many partners is one row on one side of a join that
    Spark can split."""
    b = full.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    a = full.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    common = F.size(F.array_intersect("sa", "sb"))
    met = once(pairs.join(b, "b").join(a, "a"), "common", common)
    return met.select("a", "b", "common", (F.size("sa") + F.size("sb") - F.col("common")).alias("total"))


def tangled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are not yet stars around their v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of an edge.

    In turns every node links its larger neighbours, then its smaller ones, to
    its smallest; the graph becomes stars in few rounds whatever the size of a
    group. Each round is written to the shared folder."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while tangled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.*").filter("u <> v").distinct(), "small-star")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept, one row per document.

    Documents with equal sets are one node. Within a band's bucket all nodes
    are compared with the smallest one; buckets whose nodes are then still in
    several classes compare the rest across classes only. So a large group of
    copies costs one comparison per node, and no link between different classes
    is left out. ``component_id`` is the smallest doc_id of the class, ``kept``
    marks the rows with that id. Documents without words are classes of their
    own (a null doc_id there gives a null class, kept); null doc_ids elsewhere
    count for the links but not for the smallest. Rows with equal doc_id are
    rows of their own; repeated rows share a class and are kept or not alike."""
    linked = F.col("common") * 100 >= F.col("total") * percent
    sig = written(signatures(docs, width), "signatures")
    nodes = written(sig.filter("node is not null").groupBy("node").agg(
        F.min("text_key").alias("text_key"), F.min("bands").alias("bands")), "nodes")
    member = nodes.select("node", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    member = written(member.join(shared, "band"), "buckets")  # only buckets of two nodes or more
    wanted = written(nodes.join(member.select("node").distinct(), "node", "left_semi"), "candidates")
    # candidates grow with the documents, so their keys are never broadcast: the same plan at every size
    keys = wanted.select("text_key").distinct().hint("merge")
    full = docs.select("text").join(keys, F.xxhash64("text") == F.col("text_key"), "left_semi")
    full = written(sets(full, width).groupBy("node").agg(F.min("shingles").alias("shingles"), F.min("samples").alias("samples"), F.min("sketch").alias("sketch")), "sets")
    facts, bands = full.select("node", F.size("shingles").alias("n"), "samples", "sketch"), wanted.select("node", "bands")

    stars = member.filter("node <> first").select("first", "node").distinct()
    stars = stars.join(facts.alias("y"), "node").join(facts.withColumnRenamed("node", "_first").alias("x"), F.col("first") == F.col("_first"))
    stars = stars.filter(alike("x", "y", percent)).select(F.col("first").alias("a"), F.col("y.node").alias("b"))
    stars = written(measured(stars, full), "stars")
    roots = written(components(stars.filter(linked)), "roots")

    placed = member.filter("size > 2 and node <> first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).filter("_l <> _h").select("band")
    apart = stars.select(F.col("a").alias("first"), F.col("b").alias("node"), (1 - F.col("common") / F.col("total")).alias("apart"))
    rest = placed.join(mixed, "band", "left_semi").join(apart, ["first", "node"], "left").join(facts, "node").join(bands, "node")
    rest = written(rest.select("band", "bands", "node", "root", "apart", "n", "samples", "sketch"), "mixed-buckets")
    # one less similarity is a metric: two nodes whose distances from the first differ by more than the limit are no link
    near = F.coalesce(F.abs(F.col("x.apart") - F.col("y.apart")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    # each pair is looked at in the first of the bands it shares; whatever that bucket says holds for the others
    here = F.element_at("x.bands", F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True).cast("int")) == F.col("x.band")
    across = rest.alias("x").join(rest.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.root") < F.col("y.root")) & near & here & alike("x", "y", percent))
    across = across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = written(measured(across, full).filter(linked), "cross-links")
    if not more.isEmpty():
        star = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = written(components(star.unionByName(more.select("a", "b"))), "all-roots")

    named = sig.select("doc_id", "text_key", "n_shingles", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    empty = named.filter("root is null").withColumn("component_id", F.col("doc_id"))
    out = named.filter("root is not null").join(least, "root").unionByName(empty)
    return out.select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that :func:`classes` keeps, one for each doc_id and text;
    columns of ``docs``. All rows of a class without any doc_id stay."""
    a, b = free_name(docs, "_id"), free_name(docs, "_key")
    found = classes(docs, width, percent).filter("not kept").select(F.col("doc_id").alias(a), F.col("text_key").alias(b)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b)), "left_anti")
