"""Quality rules over raw records, with the frequency of their lines across each sensor's records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

# White space between words, and the characters that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SALTS = 16


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def lines_of(text: Column) -> Column:
    """The lines of a text that hold a word, each with its place among all lines."""
    placed = F.transform(F.split(text, "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("place")))
    return F.filter(placed, lambda x: F.length(without(x["line"], SPACES)) > 0)


def remaining(text: Column, removed_lines: Column) -> Column:
    """The text without the lines at these places; null places remove nothing."""
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed_lines)
    cut = bound(F.split(text, "\n"), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))
    return F.when(F.size(removed_lines) > 0, cut).otherwise(text)


def repeated_words(hashes: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more among the word hashes of a text."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        again = bound(placed, lambda s: F.filter(s, lambda x, k: F.coalesce((F.get(s, k - 1)["w"] == x["w"]), F.lit(False)) | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False))))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        steps = bound(places, lambda p: F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    either = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0)
    return bound(hashes, lambda h: F.when(F.size(h) > WINDOW, bound(windows(h), either)).otherwise(0))


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, no space at the ends."""
    return F.lower(F.trim(F.translate(line, "\t\x0b\x0c\r123456789", "    000000000")))


def judged_lines(
    events: DataFrame,
    max_documents: int = 100,
    max_removed_percent: int = 50,
    id_col: str = "event_id",
    text_col: str = "raw",
    host_col: str = "sensor",
    max_host_percent: int = 1,
    keep_holders: bool = True,
) -> DataFrame:
    """Judge the raw record of every event by its own words and by how common its lines are at its sensor.

    Base rules: a record fails with fewer than MIN_WORDS words, or if more than MAX_REPEATED_PERCENT of
    its words stand in repeated windows of WINDOW words. Method: lines are normalised and hashed; for
    each sensor the distinct records that hold a line are counted, exact copies of a record once. A line is
    above the limit with more than ``max_documents`` records and more than ``max_host_percent`` of
    the sensor's distinct records. Such lines are removed, and a record that loses more than
    ``max_removed_percent`` of the characters of its lines is depleted and rejected. With ``keep_holders``,
    of the records of a sensor with the same set of such lines that pass the base rules the one of the least id loses
    none, so that each passage stays once, and one member of a large group of near copies with it.

    Returns ``event_id``, ``body`` (hash of the text), ``host``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``removed_chars`` (characters of its lines above the limit),
    ``base_failed``, ``kept`` and ``removed_lines`` (their places, null if none; see ``remaining``); one
    row for each input row, repeated rows included and judged alike. A null or empty record has no words
    and fails. A null sensor counts as ''. Other columns are not read.

    Only DataFrame functions. Texts are read once; counts and line hashes are staged. Counting first
    merges equal (sensor, line, record) triples on the map side, so a line that every record holds is as
    light as any other; the removal join is salted by record.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = events.select(
        F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host")
    )
    hashes = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    counts = bound(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n_words"), repeated_words(h).cast("long").alias("n_repeat_words")))
    lines = bound(
        lines_of(F.col("text")),
        lambda ls: F.struct(
            (F.size(ls) - F.size(F.array_distinct(ls["line"]))).cast("long").alias("n_dup_lines"),
            F.transform(ls, lambda x: F.struct(F.xxhash64(normalised(x["line"])).alias("line"), F.length(x["line"]).alias("chars"), x["place"].alias("place"))).alias("each"),
        ),
    )
    failed = (F.col("c.n_words") < MIN_WORDS) | (100 * F.col("c.n_repeat_words") > MAX_REPEATED_PERCENT * F.col("c.n_words"))
    judged = stage(
        rows.select(
            "id",
            "host",
            F.xxhash64("text").alias("body"),
            counts.alias("c"),
            F.length(without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
            (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
            lines.alias("l"),
        )
    )
    held = judged.select("host", "body", F.explode(F.array_distinct("l.each.line")).alias("line"))
    common = held.groupBy("host", "line").agg(F.count_distinct("body").alias("documents")).filter(F.col("documents") > max_documents)
    if max_host_percent:
        hosts = judged.groupBy("host").agg(F.count_distinct("body").alias("of"))
        common = common.join(hosts, "host").filter(100 * F.col("documents") > max_host_percent * F.col("of"))
    salted = common.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    each = judged.select("id", "body", "host", "l", failed.alias("failed")).dropDuplicates(["id", "body", "host"])
    each = each.select("id", "body", "host", "failed", F.pmod("body", F.lit(SALTS)).cast("int").alias("salt"), F.explode("l.each").alias("x"))
    each = each.select("id", "body", "host", "failed", "salt", F.col("x.line").alias("line"), F.col("x.chars").alias("chars"), F.col("x.place").alias("place"))
    removed = each.join(salted, ["host", "line", "salt"]).groupBy("id", "body", "host", "failed")
    removed = removed.agg(F.sum("chars").alias("removed"), F.sort_array(F.collect_list("place")).alias("places"), F.xxhash64(F.sort_array(F.collect_set("line"))).alias("lines"))

    def add(rows: DataFrame, more: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``more`` for the same id, text and host, or nulls."""
        of = more.withColumnsRenamed({c: f"of_{c}" for c in ("id", "body", "host")})
        same = rows["id"].eqNullSafe(of["of_id"]) & (rows["body"] == of["of_body"]) & (rows["host"] == of["of_host"])
        return rows.join(of, same, "left").drop("of_id", "of_body", "of_host")

    if keep_holders:
        removed = stage(removed)
        first = removed.filter("NOT failed").groupBy("host", "lines").agg(F.min(F.struct("id", "body")).alias("first"))
        removed = add(removed, first.select("first.id", "first.body", "host", F.lit(True).alias("holder")))
    else:
        removed = removed.withColumn("holder", F.lit(None).cast("boolean"))
    total = F.aggregate("l.each", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    out = add(judged, removed.drop("lines", "failed"))
    removed_chars, holder = F.coalesce("removed", F.lit(0).cast("long")), F.coalesce("holder", F.lit(False))
    return out.select(
        F.col("id").alias(id_col),
        "body",
        "host",
        "c.n_words",
        "word_chars",
        "n_symbols",
        "l.n_dup_lines",
        "c.n_repeat_words",
        removed_chars.alias("removed_chars"),
        failed.alias("base_failed"),
        (~failed & (holder | (100 * removed_chars <= max_removed_percent * total))).alias("kept"),
        F.when(~holder, F.col("places")).alias("removed_lines"),
    )


def line_quality(events: DataFrame, *args, **options) -> DataFrame:
    """The counts and verdicts of ``judged_lines``, without what its removal needs."""
    return judged_lines(events, *args, **options).drop("body", "host", "removed_lines")


def remove_common_lines(
    events: DataFrame, id_col: str = "event_id", text_col: str = "raw", host_col: str = "sensor", changed_col: str = "lines_removed", **options
) -> DataFrame:
    """Whole rows of the events that ``judged_lines`` keeps, with the lines above the limits taken out of the raw record.

    All columns stay; ``changed_col`` tells whether lines went. Repeated rows stay repeated. ``options`` are those of ``judged_lines``.
    """
    judged = judged_lines(events, id_col=id_col, text_col=text_col, host_col=host_col, **options).filter("kept")
    judged = judged.select(F.struct(F.col(id_col).alias("id"), "body", "host", "removed_lines").alias("judged")).distinct()
    whole = events.select(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("event"))
    of = lambda c: F.col(f"event.`{c}`")
    text, host = F.coalesce(of(text_col).cast("string"), F.lit("")), F.coalesce(of(host_col).cast("string"), F.lit(""))
    same = of(id_col).eqNullSafe(F.col("judged.id")) & (F.xxhash64(text) == F.col("judged.body")) & (host == F.col("judged.host"))
    places = F.col("judged.removed_lines")
    kept = {c: remaining(of(c), places) if c == text_col else of(c) for c in events.columns}
    return whole.join(judged, same).select(*[v.alias(c) for c, v in kept.items()], places.isNotNull().alias(changed_col))
