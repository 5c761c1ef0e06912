"""Ordered operations that survive hot keys.

A plain ``Window.partitionBy(key)`` sorts every row of a key in one task, so a key that holds a
third of the data would stall the job. Here the order of each key is cut into chunks of bounded
size, every chunk is a window partition of its own, and what a chunk must know about the rows
before it (a few tail rows, or one running value) is carried over from small per-chunk summaries.

Contract: ``seq`` is an integral column whose values are distinct within a key. Time-ordered
operators get there by aggregating equal timestamps first, in microseconds.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import stage

CHUNK_ROWS = int(os.environ.get("TAPLINE_CHUNK_ROWS", 1_000_000))
SAMPLES = 64
BROADCAST_ROWS = 1_000_000
CHUNK = "_chunk"
HALO = "_halo"


def _same(left: DataFrame, right: DataFrame, names: Sequence[str], null_safe: bool) -> Column:
    pairs = [(left[n], right[f"_r_{n}"]) for n in names]
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) if null_safe else x == y for x, y in pairs])


def join_on(
    left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left", null_safe: bool = True
) -> DataFrame:
    """Equi-join that keeps the left names.

    A null-safe join matches null keys but hashes other expressions than a grouping on the same
    keys, so it costs a shuffle more; key columns that are never null should say so.
    """
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns]
    )
    joined = left.join(renamed, _same(left, renamed, names, null_safe), how)
    return joined.drop(*[f"_r_{n}" for n in names]) if how not in ("left_semi", "left_anti") else joined


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a staged frame whose row count was checked; larger ones are shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def hot_keys(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame | None:
    """Keys with more than ``rows`` rows, or None when there is none. One map-side combined count."""
    hot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total")).filter(F.col("_total") > rows)
    staged = stage(hot)
    return None if staged.isEmpty() else staged.select(*by)


def assign_chunks(df: DataFrame, by: Sequence[str], seq: str, rows: int = CHUNK_ROWS) -> DataFrame | None:
    """Add ``_chunk``: consecutive ranges of ``seq`` per key with about ``rows`` rows each.

    Keys with more than ``rows`` rows are sampled by a hash of ``seq``, SAMPLES rows for each chunk to come,
    and the sample is cut into equal shares; so the number of chunks follows the number of rows, however
    sparse the sequence is, and only the sample of a key is ever sorted in one task. ``seq`` may be of any
    numeric type. Other keys are one chunk. Returns None when no key is that large, so ordinary data is
    planned as an ordinary window. Null keys are a key like any other.

    The cuts of a key form an array; a row finds its place in steps of the array's square root.
    """
    by = list(by)
    hot = hot_keys(df, by, rows)
    if hot is None:
        return None
    step = max(1, rows // SAMPLES)
    of_hot = join_on(df.select(*by, seq), if_small(hot), by, "left_semi") if by else df.select(seq)
    sample = of_hot.filter(F.pmod(F.xxhash64(seq), F.lit(step)) == 0)
    placed = sample.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(seq)))
    cuts = placed.filter(F.col("_i") % max(1, rows // step) == 0).groupBy(*by)
    cuts = cuts.agg(F.sort_array(F.collect_list(seq)).alias("_cuts"))
    cuts = cuts.withColumn("_width", F.ceil(F.sqrt(F.size("_cuts"))).cast("int"))
    cuts = stage(cuts.withColumn("_coarse", F.filter("_cuts", lambda _, i: i % F.col("_width") == 0)))
    if by:
        joined = join_on(df, if_small(cuts), by)
    else:
        one = cuts.select(F.struct("_cuts", "_width", "_coarse").alias("_c"))
        joined = df.withColumn("_c", one.scalar()).select("*", "_c._cuts", "_c._width", "_c._coarse").drop("_c")
    reached = lambda values: F.size(F.filter(values, lambda c: c <= F.col(seq)))
    steps = F.greatest(reached(F.col("_coarse")), F.lit(0))  # -1 for keys without cuts
    joined = joined.withColumn("_steps", steps)
    start = (F.col("_steps") - 1) * F.col("_width")
    chunk = F.when(F.col("_steps") > 0, start + reached(F.slice("_cuts", start + 1, F.col("_width")))).otherwise(0)
    return joined.withColumn(CHUNK, chunk.cast("long")).drop("_cuts", "_width", "_coarse", "_steps")


def running_by_value(
    df: DataFrame, by: Sequence[str], value: str, values: dict[str, tuple[str, Column, bool]], rows: int = CHUNK_ROWS
) -> DataFrame:
    """Running totals along a numeric column of any kind, for a staged frame of distinct values."""
    return running(df, by, value, values, rows=rows)


def with_halo(chunked: DataFrame, by: Sequence[str], seq: str, n: int) -> DataFrame:
    """Copy into each chunk the ``n`` rows of the key that precede it, marked ``_halo``.

    A window over (key, chunk) then sees the true neighbours, and dropping the copies afterwards
    leaves one result per input row. A chunk has at least one row, so the ``n`` rows before it lie
    within the tails of the ``n`` chunks before it. The tail filter is a group limit that Spark
    applies before the shuffle.
    """
    columns = [c for c in chunked.columns if c != CHUNK]
    from_end = Window.partitionBy(*by, CHUNK).orderBy(F.col(seq).desc())
    row = F.struct(F.col(seq).alias("_order_key"), *[F.col(c) for c in columns])
    tails = (
        chunked.withColumn("_from_end", F.row_number().over(from_end))
        .filter(F.col("_from_end") <= n)
        .groupBy(*by, CHUNK)
        .agg(F.sort_array(F.collect_list(row)).alias("_tail"))
    )
    earlier = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(-n, -1)
    previous = F.flatten(F.collect_list("_tail").over(earlier))
    kept = F.slice(F.col("_prev"), F.greatest(F.size("_prev") - n + 1, F.lit(1)), n)
    halo = (
        tails.select(CHUNK, previous.alias("_prev"))
        .filter(F.size("_prev") > 0)
        .select(CHUNK, F.explode(kept).alias("_row"))
        .select(*[F.col(f"_row.{c}").alias(c) for c in columns], CHUNK, F.lit(True).alias(HALO))
    )
    return chunked.withColumn(HALO, F.lit(False)).unionByName(halo)


def over_previous(
    df: DataFrame,
    by: Sequence[str],
    seq: str,
    n: int,
    columns: dict[str, Callable[[WindowSpec], Column]],
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add columns computed over a frame that reaches at most ``n`` rows back.

    ``columns`` maps a name to a function of the ordered window.
    """
    by = list(by)
    add = lambda frame, window: frame.select("*", *[make(window).alias(c) for c, make in columns.items()])
    chunked = assign_chunks(df, by, seq, rows)
    if chunked is None:
        return add(df, Window.partitionBy(*by).orderBy(seq))
    framed = with_halo(chunked, by, seq, n)
    return add(framed, Window.partitionBy(*by, CHUNK).orderBy(seq)).filter(~F.col(HALO)).drop(HALO, CHUNK)


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    by: Sequence[str],
    seq: str,
    values: dict[str, tuple[str, Column, bool]],
    descending: bool = False,
    rows: int = CHUNK_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Running sum, max or min along each key.

    ``values`` maps a new name to (kind, expression, inclusive). Exclusive sums start at 0,
    exclusive extremes at null. ``largest`` is the row count of the largest key where the caller
    knows it; the rows are then not counted again to find out that none is hot.
    """
    by = list(by)
    frame = None if largest is not None and largest <= rows else assign_chunks(df, by, seq, rows)
    direction = (lambda c: F.col(c).desc()) if descending else F.col

    def along(window: WindowSpec, name: str) -> Column:
        kind, expr, inclusive = values[name]
        out = _COMBINE[kind](expr).over(window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        return F.coalesce(out, F.lit(0)) if kind == "sum" else out

    if frame is None:
        window = Window.partitionBy(*by).orderBy(direction(seq))
        return df.select("*", *[along(window, name).alias(name) for name in values])
    partial = frame.groupBy(*by, CHUNK).agg(
        *[_COMBINE[kind](expr).alias(f"_p_{name}") for name, (kind, expr, _) in values.items()]
    )
    earlier = Window.partitionBy(*by).orderBy(direction(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = partial.select(
        *by,
        CHUNK,
        *[_COMBINE[kind](f"_p_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _, _) in values.items()],
    )
    joined = join_on(frame, carried, [*by, CHUNK])
    local = Window.partitionBy(*by, CHUNK).orderBy(direction(seq))
    out = []
    for name, (kind, _, _) in values.items():
        carry, inside = F.col(f"_c_{name}"), along(local, name)
        if kind == "sum":
            out.append((F.coalesce(carry, F.lit(0)) + inside).alias(name))
        else:
            out.append((F.greatest if kind == "max" else F.least)(carry, inside).alias(name))
    kept = [c for c in df.columns if c != CHUNK]
    return joined.select(*kept, *out)


def row_numbers(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Number the rows of each key from 1 by integral columns of which the last is unique.

    Works from the leading column down: rows are counted per distinct prefix and the counts summed
    along it, so no task ever sorts more than a chunk.
    """
    by = list(by)
    total = None
    offsets = df = stage(df)
    for depth, column in enumerate(order):
        prefix = [*by, *order[:depth]]
        before = f"_before{depth}"
        if depth == len(order) - 1:
            offsets = running(stage(offsets), prefix, column, {before: ("sum", F.lit(1), False)}, rows=rows)
        else:
            counts = df.groupBy(*prefix, column).agg(F.count(F.lit(1)).alias("_n"))
            summed = running(counts, prefix, column, {before: ("sum", F.col("_n"), False)}, rows=rows)
            offsets = join_on(offsets, summed.select(*prefix, column, before), [*prefix, column], null_safe=False)
        total = F.col(before) if total is None else total + F.col(before)
    drop = [f"_before{d}" for d in range(len(order))]
    return offsets.withColumn(name, (total + 1).cast("long")).drop(*drop)


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, fractions: dict[str, float],
    rows: int = CHUNK_ROWS, basics: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact linear-interpolated percentiles without holding a group in one task.

    Equal values are counted first; ranks come from counts summed over value chunks, and each
    percentile reads the two values around its position. ``basics`` are further aggregates over the counted
    values (``_x``, each ``_n`` times; nulls have ``_n`` 0), so the input is evaluated once.
    """
    by = list(by)
    known = df if basics else df.filter(F.col(value).isNotNull())
    counts = stage(known.groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count(value).alias("_n")))
    ranked = running_by_value(counts, by, "_x", {"_below": ("sum", F.col("_n"), False)}, rows)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    joined = join_on(ranked, totals, by) if by else ranked.withColumn("_total", totals.scalar())
    out = []
    for name, fraction in fractions.items():
        position = (F.col("_total") - 1) * F.lit(float(fraction))
        low = F.floor(position)
        high = F.least(low + 1, F.col("_total") - 1)
        holds = lambda index: (F.col("_below") <= index) & (index < F.col("_below") + F.col("_n"))
        out += [
            F.max(F.when(holds(low), F.col("_x"))).alias(f"_lo_{name}"),
            F.max(F.when(holds(high), F.col("_x"))).alias(f"_hi_{name}"),
            F.max(position - low).alias(f"_w_{name}"),
        ]
    out += [c.alias(name) for name, c in (basics or {}).items()]
    picked = joined.groupBy(*by).agg(*out)
    lerp = lambda n: F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")
    return picked.select(*by, *(basics or {}), *[lerp(n).alias(n) for n in fractions])
