"""Exact Jaccard join of raw records on word n-grams, by prefixes under several global orders."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .rows import id_and_text, id_type, text_slices

BLOCK = 64  # sets of a token up to which all their pairs are candidates
COMMON_BITS = 22  # at most 2**22 shingles count as common
LEAST_COMMON = 32
SIGNATURE = 1024  # bits at least
FILTER_BITS = 24
SALTS = 16
SLICE = 1_500_000  # bytes of text whose words a task holds at once
HELD = 2_000_000  # shingles counted at once
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Shared:
    """Broadcast tables of one call, dropped together once all that reads them is written."""

    def __init__(self, rows: DataFrame):
        self.context, self.held = rows.sparkSession.sparkContext, []

    def __call__(self, value):
        self.held.append(self.context.broadcast(value))
        return self.held[-1]

    def drop(self) -> None:
        while self.held:
            self.held.pop().destroy()


@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words; sets link from ``percent`` of Jaccard similarity."""

    width: int
    percent: int

    def prefix(self, n: np.ndarray | int) -> np.ndarray | int:
        """Tokens of a set of n of which a linked set must have one, whatever the order."""
        return n - -(-self.percent * n // 100) + 1

    def linked(self, shared: int, a: int, b: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer words, one hash of all."""
    cut = [t.encode().lower().split() for t in texts]
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in cut for w in ws), np.uint64, sum(map(len, cut)))
    sizes = [len(ws) for ws in cut]
    n = len(words) - width + 1

    def fold(parts: Iterator[np.ndarray], value: np.ndarray) -> np.ndarray:
        for part in parts:
            value = (value ^ part) * _ODD[0]
            value = value ^ (value >> np.uint64(31))
        return value

    rolled = fold((words[k : k + n] for k in range(width)), np.full(max(0, n), width, np.uint64)) if n > 0 else words[:0]
    out, at = [], 0
    for size in sizes:
        if size >= width:
            out.append(np.unique(rolled[at : at + size - width + 1]))
        elif size:
            out.append(fold((words[i : i + 1] for i in range(at, at + size)), np.full(1, size, np.uint64)))
        else:
            out.append(words[:0])
        at += size
    return out


def body_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def set_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens by bit; two sets differ in at least as many tokens as these in bits.

    A power of two of bits, at least two for each token. The two halves of one, XORed, are the next smaller.
    """
    size = max(SIGNATURE, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else SIGNATURE
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def differing_bits(a: Column, b: Column) -> Column:
    """Bits in which two signatures differ; of sizes one power apart, the larger one is folded."""

    def fold(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        halves = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), halves).otherwise(x)

    differ = F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(differ, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)).cast("int"))


def describe_sets(rows: DataFrame, rule: Rule) -> DataFrame:
    """One row for each record (id, n, set, body, signature) and rows (token, seen) of shingles seen again.

    A task counts the shingles of its distinct sets in batches and passes on those counted twice and more.
    """
    kind = id_type(rows, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "set", "body", "signature", "token", "seen"]
        known, held, total = set(), [], 0

        def counts() -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate(held), return_counts=True)
            token, seen = token[seen > 1], seen[seen > 1]
            nulls = [pa.nulls(len(token), t) for t in (kinds[0], pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(token.view(np.int64)), pa.array(seen.astype(np.int32))], names=names)

        kinds = [pa.null()]
        for part, texts in text_slices(batches, chars=SLICE):
            kinds[0] = part.column(0).type
            sets = shingle_sets(texts, rule.width)
            marks = [set_of(s) for s in sets]
            columns = [
                part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(marks, pa.int64()), pa.array(map(body_of, texts), pa.int64()),
                pa.array([signature(s) for s in sets], pa.list_(pa.int64())), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            for mark, tokens in zip(marks, sets, strict=True):
                if mark not in known:
                    known.add(mark)
                    held.append(tokens)
                    total += len(tokens)
            if total > HELD:
                yield counts()
                held, total = [], 0
        if held:
            yield counts()

    return rows.mapInArrow(run, f"id {kind}, n int, set long, body long, signature array<long>, token long, seen int")


def common_tokens(described: DataFrame) -> np.ndarray:
    """The shingles counted most, least first; at most 2**COMMON_BITS, as the counts add up to no more."""
    total = described.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COMMON, total >> COMMON_BITS)
    found = described.filter("seen IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") > least)
    found = found.toPandas().sort_values(["seen", "token"])
    return found["token"].to_numpy(dtype=np.int64).view(np.uint64)


def first_order(tokens: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Places of tokens in the first order: by hash, common ones (sorted, with their ranks by count) last."""
    order = (tokens * _ODD[1]) >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        is_common = common[at] == tokens
        order[is_common] = np.uint64(1 << 63) + ranks[at[is_common]]
    return order


def postings(rows: DataFrame, rule: Rule, common: np.ndarray, share: Shared) -> DataFrame:
    """Prefix tokens (token, set, n) of every set; if common ones are among them, a negative token of its own."""
    ranks = np.argsort(common)
    shared = share((common[ranks], ranks.astype(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set()
        for _, texts in text_slices(batches, chars=SLICE):
            tokens, marks, sizes = [], [], []
            for s in shingle_sets(texts, rule.width):
                mark = set_of(s)
                if not len(s) or mark in known:
                    continue
                known.add(mark)
                order = first_order(s, *shared.value)
                p = rule.prefix(len(s))
                chosen = np.partition(order, p - 1)[:p]
                plain = chosen[chosen < np.uint64(1 << 63)]
                tokens.append(plain.view(np.int64))
                marks.append((mark, len(plain)))
                sizes.append(len(s))
                if len(plain) < p:
                    tokens.append(np.full(1, mark | -(1 << 63), np.int64))
                    marks.append((mark, 1))
                    sizes.append(len(s))
            if tokens:
                each = [k for _, k in marks]
                token = np.concatenate(tokens)
                columns = [pa.array(token), pa.array(np.repeat([m for m, _ in marks], each)), pa.array(np.repeat(np.array(sizes, np.int32), each))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "set", "n"])

    return rows.mapInArrow(run, "token long, set long, n int")


def blocks(sorted_postings: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b, na, nb) of sets that share a token of up to BLOCK sets; (a, null) for sets of larger ones
    and those with a negative token.

    Reads rows sorted by token and set; holds one batch and at most BLOCK rows before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty((0, 3), np.int64)
        held, open_token = none, None

        def members(rows: np.ndarray) -> pa.RecordBatch:
            gone = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), gone, pa.array(rows[:, 2]), gone], names=["a", "b", "na", "nb"])

        def finished(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            sizes = np.diff([*starts, len(rows)])
            large = sizes > BLOCK
            if large.any():
                yield members(rows[np.repeat(large, sizes)])
            for size in np.unique(sizes[(sizes > 1) & ~large]).tolist():
                left, right = np.triu_indices(size, 1)
                first = starts[sizes == size][:, None]
                for lot in np.array_split(first, max(1, len(first) * len(left) // 500_000)):
                    a, b = rows[(lot + left).ravel()], rows[(lot + right).ravel()]
                    near = 100 * np.minimum(a[:, 2], b[:, 2]) >= rule.percent * np.maximum(a[:, 2], b[:, 2])
                    a, b = a[near], b[near]
                    yield pa.RecordBatch.from_arrays([pa.array(a[:, 1]), pa.array(b[:, 1]), pa.array(a[:, 2]), pa.array(b[:, 2])], names=["a", "b", "na", "nb"])

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            apart = int(np.searchsorted(rows[:, 0], 0))
            if apart:
                yield members(rows[:apart])
                rows = rows[apart:]
                if not len(rows):
                    continue
            if open_token is not None:
                same = int(np.searchsorted(rows[:, 0], open_token, side="right"))
                if same:
                    yield members(rows[:same])
                rows = rows[same:]
                if not len(rows):
                    continue
                open_token = None
            rows = np.concatenate([held, rows])
            rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])] if len(rows) else rows
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0])) if len(rows) else 0
            yield from finished(rows[:last])
            held = rows[last:]
            if len(held) > BLOCK:
                yield members(held)
                open_token, held = held[0, 0], none
        yield from finished(held)

    return sorted_postings.mapInArrow(run, "a long, b long, na long, nb long")


def body_bits(bodies: DataFrame) -> np.ndarray:
    """Bit table of fixed size over the record hashes in column ``body``; what it lets through is a superset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.unique(np.concatenate([np.empty(0, np.uint64), *[b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS) for b in batches]]))
        if len(at):
            byte, first = np.unique(at >> np.uint64(3), return_index=True)
            seen = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
            seen[byte] = np.bitwise_or.reduceat(np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8), first)
            yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], names=["bits"])

    found = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for row in bodies.select("body").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        found |= np.frombuffer(row.bits, np.uint8)
    return found


def sets_of_bodies(rows: DataFrame, rule: Rule, bits: np.ndarray, share: Shared) -> DataFrame:
    """Tokens (set, n, tokens as 64-bit binary) of the records that pass the bit table."""
    shared = share(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = set(), shared.value
        for _, texts in text_slices(batches, chars=SLICE):
            at = np.array([body_of(t) for t in texts], np.int64).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            pick = np.flatnonzero(table[(at >> np.uint64(3)).astype(np.int64)] & (np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8)))
            found = [s for s in shingle_sets([texts[i] for i in pick], rule.width) if len(s)]
            marks = [set_of(s) for s in found]
            new = [i for i, m in enumerate(marks) if m not in known and not known.add(m)]
            columns = [pa.array([marks[i] for i in new], pa.int64()), pa.array([len(found[i]) for i in new], pa.int32()), pa.array([found[i].tobytes() for i in new], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["set", "n", "tokens"])

    return rows.mapInArrow(run, "set long, n int, tokens binary")


def hot_blocks(sets: DataFrame, rule: Rule) -> DataFrame:
    """Prefix tokens (token, set, n, place) under the order by exact count within these sets.

    A token of one set comes before every other, so a set with many tokens of its own needs none of the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens), pa.array(np.full(len(tokens), batch.column(0)[i].as_py())), pa.array(np.full(len(tokens), len(tokens), np.int32))], names=["token", "set", "n"]
                )

    each = sets.mapInArrow(run, "token long, set long, n int")
    counts = each.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    placed = each.join(counts, "token").repartition("set").dropDuplicates(["set", "token"])
    window = Window.partitionBy("set")
    place = F.col("n") - F.count("*").over(window) + F.row_number().over(window.orderBy("held", "token")) - 1
    prefix = F.col("n") - F.ceil(rule.percent * F.col("n") / 100) + 1
    return placed.withColumn("place", place.cast("long")).filter(F.col("place") < prefix).select("token", "set", F.col("n").cast("long").alias("n"), "place")


def may_link(rule: Rule, na: Column, nb: Column, left_a: Column, left_b: Column) -> Column:
    """Whether enough tokens are left, from the shared one on, in both sets."""
    sizes = 100 * F.least(na, nb) >= rule.percent * F.greatest(na, nb)
    return sizes & ((100 + rule.percent) * F.least(left_a, left_b) >= rule.percent * (na + nb))


def verify(rows: DataFrame, rule: Rule, pairs: DataFrame, nodes: DataFrame, share: Shared) -> DataFrame:
    """The pairs (a, b) that link. Parities come first; then, with the tokens at hand, the sets must share a
    token of their prefixes under each further order; last they are intersected."""
    side = lambda x: nodes.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"), F.col("body").alias(f"body_{x}"))
    bits = differing_bits(F.col("sa"), F.col("sb"))
    close = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    close = stage(close.filter((100 + rule.percent) * bits <= (100 - rule.percent) * (F.col("na") + F.col("nb"))).select("a", "b", "body_a", "body_b"))
    bodies = close.select(F.col("body_a").alias("body")).union(close.select("body_b"))
    sets = stage(sets_of_bodies(rows, rule, body_bits(bodies), share).dropDuplicates(["set"]))
    joined = close.select("a", "b").hint("merge").join(sets.select(F.col("set").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("set").alias("b"), F.col("tokens").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                good = True
                for odd in _ODD[2:]:
                    p, q = rule.prefix(len(a)), rule.prefix(len(b))
                    good = good and len(np.intersect1d(np.partition(a * odd, p - 1)[:p], np.partition(b * odd, q - 1)[:q], assume_unique=True)) > 0
                if good and rule.linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)):
                    keep.append(i)
            kept = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable by links (a, b), by alternating large and small stars."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.u", "e.v").filter("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_copies(events: DataFrame, width: int = 5, percent: int = 80, id_col: str = "event_id", text_col: str = "raw") -> DataFrame:
    """Groups of events whose raw records are copies or near copies.

    A-Z are lowered; words are what stands between ASCII white space. A record's set holds its distinct
    shingles of ``width`` words, or its whole word sequence as one if it has fewer. Two records link when
    100 * intersection >= ``percent`` * union; sets without a shingle link with nothing. Returns
    ``event_id``, ``n_shingles`` and ``component_id``, the least ``event_id`` reachable by links (null ids
    are passed over; a group of null ids only has null); one row for each input row, repeated rows included.
    Shingles are 64-bit hashes. Other columns are not read.

    Linked sets share a token of their prefixes under any order of tokens, so candidates must do so under
    several. The first order, by hash with the most counted shingles last, deals prefixes into blocks; a
    block of up to BLOCK sets gives its pairs. Sets of larger blocks, or whose prefix reaches a common
    shingle, are dealt again by an order of their exact counts, with the place of the shared token as a
    further bound; a large block there first pairs all with its most central set, and later only sets
    that are still apart. Every test only drops pairs that cannot link; none caps partners. Equal sets are
    one node throughout, so copies cost nothing. Hash tables that are broadcast have fixed sizes, and what
    several steps read is staged.
    """
    rule = Rule(width, percent)
    rows = id_and_text(events, id_col, text_col)
    share = Shared(rows)
    described = stage(describe_sets(rows, rule))
    records = described.filter("seen IS NULL").select("id", "n", "set", "body", "signature")
    nodes = stage(records.filter("n > 0").groupBy("set").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("body").alias("body"), F.first("signature").alias("signature")))
    posted = postings(rows, rule, common_tokens(described), share)
    paired = stage(blocks(posted.repartition("token").sortWithinPartitions("token", "set"), rule))
    hot = paired.filter("b IS NULL").select(F.col("a").alias("set")).distinct()
    again = stage(sets_of_bodies(rows, rule, body_bits(nodes.join(hot, "set")), share))
    places = stage(hot_blocks(again, rule))
    sizes = places.groupBy("token").agg(F.count("*").alias("held"), F.min(F.struct("place", "set", "n")).alias("pivot")).filter("held > 1")
    large = sizes.filter(F.col("held") > BLOCK)
    few = places.hint("merge").join(sizes.filter(F.col("held") <= BLOCK).select("token"), "token").select("token", F.struct("set", "n", "place").alias("x"))
    lists = few.groupBy("token").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    cross = lists.select(F.explode(F.flatten(F.transform("xs", lambda x, i: F.transform(F.slice("xs", i + 2, F.size("xs")), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("e"))
    near = may_link(rule, F.col("e.x.n"), F.col("e.y.n"), F.col("e.x.n") - F.col("e.x.place"), F.col("e.y.n") - F.col("e.y.place"))
    small = cross.filter(near).select(F.col("e.x.set").alias("a"), F.col("e.y.set").alias("b"))
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    crowd = stage(places.withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int")).hint("merge").join(salted, ["token", "salt"]))
    near = may_link(rule, F.col("n"), F.col("pivot.n"), F.col("n") - F.col("place"), F.col("pivot.n") - F.col("pivot.place"))
    stars = crowd.filter(near & (F.col("set") != F.col("pivot.set"))).select(F.least("set", "pivot.set").alias("a"), F.greatest("set", "pivot.set").alias("b"))
    pairs = stage(paired.filter("b IS NOT NULL").select("a", "b").union(small).distinct())
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(stars).distinct()
    links = stage(verify(rows, rule, first, nodes, share))
    labels = stage(components(links))
    label = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    apart = F.coalesce("ra", "a") != F.coalesce("rb", "b")
    rest = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").filter(apart).select("a", "b")
    named = stage(crowd.select("token", "salt", "set", "n", "place").join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set")))
    mixed = named.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("token")
    mixed = named.join(mixed, "token")
    right = mixed.drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    x, y = mixed.hint("merge").alias("x"), right.alias("y")  # never broadcast: both grow with the data
    near = may_link(rule, F.col("x.n"), F.col("y.n"), F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.set") < F.col("y.set")) & (F.col("x.root") != F.col("y.root")) & near
    rest = rest.union(x.join(y, met).select(F.col("x.set").alias("a"), F.col("y.set").alias("b"))).distinct()
    found = components(links.union(verify(rows, rule, rest, nodes, share)))
    share.drop()
    member = nodes.select("set", "first").join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    heads = member.groupBy("root").agg(F.min("first").alias("component"))
    owner = member.join(heads, "root").select("set", "component")
    return (
        records.select("id", "n", "set")
        .join(owner, "set", "left")
        .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
    )
