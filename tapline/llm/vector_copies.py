"""Near copies among labelled flow vectors: p-stable hashing of Euclidean distance, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import if_small
from ..session import stage
from .near_copies import components
from .vectors import finite_vector, matrices

BLOCK = 32  # vectors of a bucket up to which all their pairs are compared
TILE = 1_024  # vectors of a dense group compared at once with as many others
WIDTH = 8.0  # cells of a projection, in distances of the least similar pair that links
APART = 1.2  # distance of unrelated unit vectors that the number of projections is made for
MISSED = 5e-4  # share of pairs at the very threshold that may share no bucket
SEED = 20_240_229


@dataclass(frozen=True)
class Hashing:
    """Tables of ``width`` quantised Gaussian projections each; cells have size ``cell``."""

    tables: int
    width: int
    cell: float

    @staticmethod
    def same_cell(distance: float, cell: float) -> float:
        """Chance that two points at a distance share a cell of one random projection (2-stable)."""
        x = cell / distance
        return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))

    @classmethod
    def for_vectors(cls, count: int, least: float) -> Hashing:
        """Projections by the number of vectors, so that unrelated ones meet about twice in all tables; as many
        tables as leave MISSED of the pairs at the threshold apart."""
        distance = max(math.sqrt(max(0.0, 2 - 2 * least)), 1e-3)
        cell = WIDTH * distance
        near, far = cls.same_cell(distance, cell), cls.same_cell(max(APART, 2 * distance), cell)
        width = max(4, math.ceil(math.log(20 * max(1, count)) / -math.log(far)))
        return cls(max(1, math.ceil(math.log(MISSED) / math.log1p(-(near**width)))), width, cell)

    def buckets(self, unit: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Buckets (vectors x tables) as 64-bit numbers, equal for equal cells in a table; ``apart`` keeps labels apart."""
        size = unit.shape[1]
        rng = np.random.default_rng([SEED, size])
        directions = rng.normal(size=(size, self.tables * self.width))
        cells = np.floor(unit @ directions / self.cell + rng.random(self.tables * self.width)).astype(np.int64).view(np.uint64)
        odd = rng.integers(0, 1 << 64, (self.tables, self.width), np.uint64) | np.uint64(1)
        mixed = (cells.reshape(len(unit), self.tables, self.width) * odd).sum(axis=2, dtype=np.uint64)
        salt = rng.integers(0, 1 << 64, self.tables, np.uint64)
        mixed = (mixed ^ apart[:, None]) * np.uint64(0x9E3779B97F4A7C15) + salt
        return mixed ^ (mixed >> np.uint64(29))


def unit_rows(entries: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    scaled = entries / np.abs(entries).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def bucket_rows(nodes: DataFrame, hashing: Hashing) -> DataFrame:
    """(bucket, a, b): a node of a bucket, b null; of a bucket with over BLOCK nodes in one batch, its first node
    twice. The others of such buckets are (null, node, first node).

    So a bucket has few rows to shuffle from each batch, however many nodes it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for at, entries in matrices(batch, 2):
                for part in np.array_split(np.arange(len(at)), max(1, len(at) * hashing.tables * hashing.width // 4_000_000)):
                    made = hashing.buckets(unit_rows(entries[part]), label[at[part]])
                    bucket, owner = made.ravel().view(np.int64), np.repeat(node[at[part]], hashing.tables)
                    order = np.lexsort((owner, bucket))
                    bucket, owner = bucket[order], owner[order]
                    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                    sizes = np.diff([*starts, len(bucket)])
                    large = np.repeat(sizes > BLOCK, sizes)
                    first = np.repeat(owner[starts], sizes)
                    star = large & (owner != first)
                    columns = [pa.array(bucket, mask=star), pa.array(owner), pa.array(first, mask=~large)]
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "a", "b"])

    return nodes.select("node", "label_hash", "v").mapInArrow(run, "bucket long, a long, b long")


def met_in_buckets(sorted_rows: DataFrame) -> DataFrame:
    """(a, b, dense): the pairs of each bucket of up to BLOCK nodes; a node and the first node of each larger one.

    Reads rows sorted by bucket and node; holds one batch and at most BLOCK rows before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, first = None, [], None

        def all_pairs():
            for i, a in enumerate(held):
                for b in held[i + 1 :]:
                    out.append((a, b, False))

        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            for own, a, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if own != bucket:
                    all_pairs()
                    bucket, held, first = own, [], None
                if first is None and b is None and len(held) < BLOCK:
                    held.append(a)
                    continue
                if first is None:
                    first = held[0] if held else a
                    out.extend((first, x, True) for x in held[1:])
                    held = []
                if a != first:
                    out.append((first, a, True))
            yield rows_of(out)
        out = []
        all_pairs()
        yield rows_of(out)

    def rows_of(out: list[tuple[int, int, bool]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(3)], names=["a", "b", "dense"])

    return sorted_rows.mapInArrow(run, "a long, b long, dense boolean")


def linked_pairs(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Rows of ``pairs`` (a, b) whose cosine is at least ``least``, with the copies of both."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"), F.col("copies").alias(f"copies_{x}"), F.col("v").alias(f"v{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.col("la").eqNullSafe(F.col("lb")) & (F.size("va") == F.size("vb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for (at, left), (_, right) in zip(matrices(batch, 4), matrices(batch, 5), strict=True):
                good[at] = np.einsum("ij,ij->i", unit_rows(left), unit_rows(right)) >= least
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column(k) for k in range(4)], names=["a", "b", "copies_a", "copies_b"])

    return both.select("a", "b", "copies_a", "copies_b", "va", "vb").mapInArrow(run, "a long, b long, copies_a long, copies_b long")


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a square matrix of links, the least row it reaches by them."""
    roots = np.arange(len(linked))
    while True:
        lower = np.where(linked, roots[None, :], len(linked)).min(axis=1, initial=len(linked))
        lower = np.minimum(roots, lower)
        lower = lower[lower]
        if (lower == roots).all():
            return roots
        roots = lower


def dense_links(members: DataFrame, least: float) -> DataFrame:
    """(node, root, links) from all pairs within each group ``head`` of ``members`` (head, node, copies, v): the node
    of least number that a pair of tiles connects it with, and the copies it links with.

    A group is dealt into tiles by hash, and every two of its tiles meet once, in a row of their own.
    """
    sizes = if_small(stage(members.groupBy("head").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))))
    dealt = members.join(sizes, "head").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    packed = dealt.groupBy("head", "tiles", "tile").agg(F.collect_list(F.struct("node", "copies", "v")).alias("rows"))
    left = packed.select("head", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"), F.col("rows").alias("left"))
    right = packed.select("head", F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"), F.col("rows").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py() == batch.column(1)[row].as_py()
                sides = []
                for k in (2,) if same else (2, 3):
                    flat = batch.column(k).slice(row, 1).flatten()
                    entries = pa.RecordBatch.from_arrays([flat.field(2)], names=["v"])
                    sides.append((flat.field(0).to_numpy(), flat.field(1).to_numpy(), unit_rows(matrices(entries, 0)[0][1])))
                node, copies, unit = (np.concatenate(x) for x in zip(*sides))
                linked = unit @ unit.T >= least
                if not same:
                    counted = linked.copy()
                    cut = len(sides[0][0])
                    counted[:cut, :cut] = counted[cut:, cut:] = False
                else:
                    np.fill_diagonal(linked, False)
                    counted = linked
                columns = [pa.array(node), pa.array(node[local_roots(linked)]), pa.array(counted @ copies)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "links"])

    met = left.hint("merge").join(right, ["head", "i", "j"]).select("i", "j", "left", F.when(F.col("i") != F.col("j"), F.col("right")).alias("right"))
    return met.mapInArrow(run, "node long, root long, links long")


def near_flows(flows: DataFrame, id_col: str = "flow_id", vector_col: str = "features", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """Links between flows of the same label whose feature vectors have a cosine of at least ``least``.

    Returns a row for each flow: ``flow_id``, ``n_links`` (other flows linked directly), ``component_id`` (the least
    ``flow_id`` reachable by links, itself included; null ids are passed over, a group of null ids only has null) and
    ``kept`` (whether these two are equal). A null label, or a vector that is null, empty, zero or holds null or a
    non-finite entry, links with nothing, and so do vectors of different length. Repeated rows are flows of
    their own. Other columns are not read.

    Equal vectors of a label are one node. Unit vectors are hashed by tables of quantised Gaussian projections
    (``Hashing``); the pairs of buckets with up to BLOCK nodes are candidates. Nodes of larger buckets that overlap
    form a dense group, within which all pairs are compared as tiles of matrices, so no pair of a dense group is a row.
    Every link is an exact cosine in double precision. A pair at the very threshold outside dense groups
    is missed with a chance of MISSED, nearer ones hardly ever.
    """
    vector, label = F.col(f"`{vector_col}`"), F.col(f"`{label_col}`")
    usable = label.isNotNull() & finite_vector(vector) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))
    key = F.when(usable, F.struct(label.alias("label"), F.xxhash64(vector).alias("h"), F.xxhash64(F.lit(1), F.reverse(vector)).alias("g"), F.size(vector).alias("size")))
    rows = stage(flows.select(F.col(f"`{id_col}`").alias("id"), key.alias("key"), F.when(usable, vector).alias("v")))
    grouped = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = stage(grouped.select(F.monotonically_increasing_id().alias("node"), "key", F.col("key.label").alias("label"), F.xxhash64("key.label", "key.size").alias("label_hash"), "first", "copies", "v"))
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    dealt = stage(bucket_rows(nodes, Hashing.for_vectors(most, least)))
    stars = dealt.filter("bucket IS NULL").select(F.col("b").alias("a"), F.col("a").alias("b"))
    met = stage(met_in_buckets(dealt.filter("bucket IS NOT NULL").repartition("bucket").sortWithinPartitions("bucket", "a")).filter("a != b").distinct())
    dense = stage(components(met.filter("dense").select("a", "b").union(stars)))
    heads = stage(dense.union(dense.select(F.col("root").alias("node"), "root").distinct()))
    head = lambda x: heads.select(F.col("node").alias(x), F.col("root").alias(f"head_{x}"))
    loose = met.filter("NOT dense").join(head("a"), "a", "left").join(head("b"), "b", "left")
    loose = loose.filter(F.coalesce(F.col("head_a") != F.col("head_b"), F.lit(True))).select("a", "b")
    links = stage(linked_pairs(loose, nodes, least))
    # A group of one label and length only: a bucket may by chance hold others.
    members = heads.join(nodes, "node").select(F.struct("root", "key.label", "key.size").alias("head"), "node", "copies", "v")
    tiles = stage(dense_links(members, least))
    across = links.select("a", "b").union(tiles.filter("node != root").select("root", "node"))
    found = components(across)
    counts = links.select(F.col("a").alias("node"), F.col("copies_b").alias("links")).union(links.select("b", "copies_a")).union(tiles.select("node", "links"))
    counts = counts.groupBy("node").agg(F.sum("links").alias("links"))
    held = nodes.select("node", "key", "first", "copies").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_ids = held.groupBy("root").agg(F.min("first").alias("component"))
    answer = held.join(least_ids, "root").join(counts, "node", "left").select("key", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = rows.select("id", "key").join(answer, "key", "left")
    component: Column = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
