"""Look-alike labels of looked-up names: a pair dictionary of numbered trie nodes."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

RANGE_LABELS = 4_000  # labels of a range of the sorted trie, about
MOST_RANGES = 2_048
CUT_LETTERS = 32
SKIPPED, JOINED = 1, 0  # kinds of node pairs: around one code point, or around none


def looked_up_labels(dns: DataFrame, query_col: str = "query") -> DataFrame:
    """Labels (``label``) of the queried names of DNS events, A-Z lowered; null and empty ones give none."""
    lower = F.translate(F.col(f"`{query_col}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return dns.select(F.explode(F.split(lower, r"\.")).alias("label")).filter("label != ''")


def cut_labels(labels: DataFrame, count: int) -> list[str]:
    """At most MOST_RANGES - 1 strings that cut the sorted labels into ranges of about equal size.

    They are taken from sixteen labels for each range, chosen by hash; they set how work is dealt, no result.
    """
    ranges = min(MOST_RANGES, max(1, count // RANGE_LABELS))
    if ranges == 1:
        return []
    chosen = labels.orderBy(F.xxhash64("label"), "label").limit(16 * ranges).select(F.substring("label", 1, CUT_LETTERS).alias("label"))
    sample = sorted(r.label for r in chosen.collect())
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)} - {""})


def number_nodes(labels: DataFrame, cuts: list[str], columns: str) -> DataFrame:
    """The trie of the column ``label``, with a whole number for every node, equal for equal prefixes.

    Adds ``place`` (a number that rises in code-point order), ``nodes`` (the node of each prefix, from none to all
    code points) and ``fresh`` (whether a code point differs from the one before it). Labels are dealt by range
    and walked in order, so a task holds one path of the trie. A prefix can occur in two ranges only if it is a proper
    prefix of a cut; these few have numbers that all tasks know, from zero down.
    """
    known = {p: -i for i, p in enumerate(sorted({"", *(c[:k] for c in cuts for k in range(1, len(c)))}))}
    kept = [c.split(" ")[0] for c in columns.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pa.array([bisect_right(cuts, w) for w in batch.column("label").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), parts], names=[*kept, "part"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, path, place, made = None, "", [known[""]], 0, 0
        for batch in batches:
            places, nodes, fresh = [], [], []
            for label, own in zip(batch.column("label").to_pylist(), batch.column("part").to_pylist()):
                if own != part:
                    part, last, path, place, made = own, "", [known[""]], 0, 0
                base, size, depth = (own + 1) << 40, len(label), 0
                for a, b in zip(last, label):
                    if a != b:
                        break
                    depth += 1
                del path[depth + 1 :]
                while depth < min(size, CUT_LETTERS) and (number := known.get(label[: depth + 1])) is not None:
                    path.append(number)
                    depth += 1
                path.extend(range(base + made, base + made + size - depth))
                made += size - depth
                places.append(base + place)
                nodes.append(np.array(path, np.int64))
                points = np.frombuffer(label.encode("utf-32-le"), np.uint32)
                fresh.append(np.concatenate([[True], points[1:] != points[:-1]])[:size])
                last, place = label, place + 1
            columns = [pa.array(places, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), pa.array(fresh, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *columns], names=[*kept, "place", "nodes", "fresh"])

    dealt = labels.select(*kept).mapInArrow(deal, f"{columns}, part int").repartition("part").sortWithinPartitions("part", "label")
    return dealt.mapInArrow(walk, f"{columns}, place long, nodes array<long>, fresh array<boolean>")


def node_pairs(numbered: DataFrame) -> DataFrame:
    """(place, n, front, back, kind, fresh): each label's prefix and suffix nodes around every skipped code point,
    and around every point between two code points."""
    size = F.size("nodes") - 1

    def pair(i: Column, kind: int) -> Column:
        back = F.element_at("back_nodes", size - i + 1 - kind)
        fresh = F.element_at("fresh", i + 1) if kind == SKIPPED else F.lit(True)
        return F.struct(F.element_at("nodes", i + 1).alias("front"), back.alias("back"), F.lit(kind).cast("byte").alias("kind"), fresh.alias("fresh"))

    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: pair(i, SKIPPED))
    joins = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, JOINED))
    return numbered.select("place", "n", F.explode(F.concat(skips, joins)).alias("pair")).select("place", "n", "pair.*")


def near_labels(pairs: DataFrame) -> DataFrame:
    """(place, n_near, best): for labels with near ones their number, and the most frequent as (-n, place).

    Labels whose pairs around a skipped code point are equal differ by one replaced code point; a label's pair around
    a skip that equals another's around a joint has one code point more. A pair has one label with a joint there, and
    at most one label for each skipped code point, so a group never outgrows the alphabet. Of equal code points
    in a row only the first counts as skipped, so each insertion shows once.
    """
    same = Window.partitionBy("front", "back")
    order = same.orderBy(F.col("kind").desc(), F.col("n").desc(), "place")
    skip, label = F.col("kind") == SKIPPED, F.struct((-F.col("n")).alias("less"), "place")
    seen = pairs.select(
        "place", "kind", "fresh", "n",
        F.count_if(skip).over(same).alias("skips"),
        F.min(F.when(~skip, label)).over(same).alias("joint"),
        F.count_if(skip & F.col("fresh")).over(same).alias("longer"),
        F.min(F.when(skip & F.col("fresh"), label)).over(same).alias("best_longer"),
        F.row_number().over(order).alias("rank"),
        F.first(label).over(order).alias("first"),
        F.lead(label).over(order).alias("second"),
        F.lead("kind").over(order).alias("second_kind"),
    )
    replaced = F.when(F.col("rank") > 1, F.col("first")).when(F.col("second_kind") == SKIPPED, F.col("second"))
    shorter = F.when(F.col("fresh"), F.col("joint"))
    found = seen.select(
        "place",
        F.when(skip, F.col("skips") - 1 + shorter.isNotNull().cast("long")).otherwise(F.col("longer")).alias("near"),
        F.when(skip, F.least(replaced, shorter)).otherwise(F.col("best_longer")).alias("best"),
    )
    return found.filter("near > 0").groupBy("place").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(place, root) of labels with a form, by doubling: a form is ``ratio`` times as frequent, so chains are short."""
    steps = math.floor(math.log(max(1, most), ratio)) if ratio > 1 else most
    ends = forms.select("place", F.col("form_place").alias("root"))
    while steps > 1:
        on = ends.select(F.col("place").alias("root"), F.col("root").alias("further"))
        ends = stage(ends.join(on, "root", "left").select("place", F.coalesce("further", "root").alias("root")))
        steps = -(-steps // 2)
    return ends


def label_variants(labels: DataFrame, label_col: str = "label", least_length: int = 7, least_seen: int = 2, ratio: int = 10) -> DataFrame:
    """Spelling variants among the labels of looked-up names, such as typing errors and look-alike domains.

    ``labels`` has a row for each time a label was seen (``looked_up_labels`` makes them from DNS events). Labels are
    its distinct values of at least ``least_length`` code points, seen at least ``least_seen`` times (n) in all; null is none.
    Two are near if they differ by exactly one inserted, deleted or replaced code point. Returns for each label
    ``label``, ``n``, ``n_near`` (number of near labels), ``form`` (the near label of largest n, of ties the first in code-point
    order, if its n >= ``ratio`` * n, else null), ``form_n`` and ``root`` (following forms to the last; the label itself
    if it has none). Labels of any length are taken whole; no label or none frequent enough gives no row. A ``ratio``
    below 2 is refused, as forms could then go round. Other columns are not read.

    Forward and reversed tries of the labels get numbered nodes (``number_nodes``); near labels meet in equal pairs of prefix
    and suffix node (``near_labels``), so neighbours are exact and no pair of labels that is not near is formed.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    seen = labels.select(F.col(f"`{label_col}`").cast("string").alias("label")).filter(F.length("label") >= max(1, least_length))
    counted = stage(seen.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= least_seen))
    count, most = counted.agg(F.count("*"), F.max("n")).first()
    forward = stage(number_nodes(counted, cut_labels(counted, count), "label string, n long"))
    turned = forward.select(F.reverse("label").alias("label"), F.col("place").alias("owner"))
    backward = number_nodes(turned, cut_labels(turned.select("label"), count), "label string, owner long")
    both = forward.select("place", "n", "nodes", "fresh").join(backward.select(F.col("owner").alias("place"), F.col("nodes").alias("back_nodes")), "place")
    near = stage(near_labels(node_pairs(both)))
    named = forward.select("place", "label", "n").join(near, "place", "left").withColumn("form_n", -F.col("best.less"))
    has_form = F.col("form_n") >= ratio * F.col("n")
    named = stage(named.select("place", "label", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("form_n")).alias("form_n"), F.when(has_form, F.col("best.place")).alias("form_place")))
    roots = last_forms(named.filter("form_place IS NOT NULL"), most or 0, ratio)
    name = lambda x: forward.select(F.col("place").alias(f"{x}_place"), F.col("label").alias(x))
    ended = named.join(roots.withColumnRenamed("root", "root_place"), "place", "left").join(name("form"), "form_place", "left").join(name("root"), "root_place", "left")
    return ended.select("label", "form", F.coalesce("root", "label").alias("root"), "n", "n_near", "form_n")
