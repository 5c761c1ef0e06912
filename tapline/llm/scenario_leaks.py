"""Records that repeat an evaluation scenario, also with other numbers, names or units in its slots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .rows import id_and_text, id_type, text_slices

WINDOW = 8
MIN_LITERALS = 4  # a window of fewer plain words would match anything of its shape
FILTER_BITS = 24
SALTS = 16
CACHED = 500_000
_EDGE = ".,!?;:\"'()[]{}*#$%&|<>~`«»¡¿…-–—"
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:e[+-]?\d+)?([a-zµ%°]{0,5})$")
_ADDRESS = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?$|(?:[0-9a-f]{0,4}:){3,}[0-9a-f]{0,4}$|[0-9a-f]{2}(?:-[0-9a-f]{2}){5}$|0x[0-9a-f]+$|(?=[0-9a-f]*\d)[0-9a-f]{12,}$")
# Words that count as a unit after a number.
UNITS = frozenset(
    "b kb mb gb tb kib mib gib bit bits byte bytes bps kbps mbps gbps pps packet packets flow flows ms us ns s sec secs second seconds min mins minute minutes h hr hrs "
    "hour hours day days week weeks month months year years hz khz mhz ghz m km cm mm mile miles g kg mg lb lbs percent usd eur dollar dollars euro euros".split()
)
# Streams of tokens of a text: a token a word; runs of names and numbers with their unit as one token, sentence
# starts as names too; plain words only, for scenarios that have no window of the others.
WORDS, RUNS, EXACT = range(3)
NEAR = 4  # fragments whose shifts differ by no more are added up
LITERAL, NUMBER, CAPITAL, UNIT, ADDRESS = range(5)
PLACEHOLDERS = {NUMBER: "<number>", CAPITAL: "<name>", UNIT: "<unit>", ADDRESS: "<address>"}
_hash = lambda x: xxhash.xxh3_64_intdigest(x.encode())
_HOLDER = np.array([0, *(_hash(PLACEHOLDERS[k]) for k in (NUMBER, CAPITAL, UNIT, ADDRESS))], np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_known: dict[str, tuple[int, int, bool]] = {}


def word_class(word: str) -> tuple[int, int, bool]:
    """Hash of the bare lower-case word, what it may be, and whether a sentence ends after it."""
    bare = word.strip(_EDGE)
    low = bare.lower()
    ends = word.rstrip("\"')]»*#$%&|")[-1:] in (".", "!", "?", ":", ";")
    if _ADDRESS.match(low):
        kind = ADDRESS
    elif _NUMBER.match(low):
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    else:
        kind = CAPITAL if bare[:1].isupper() and not (bare.isupper() and len(bare) > 1) else LITERAL
    return _hash(low), kind, ends


class Template:
    """The words of several texts in a row, as template tokens: their hashes, kinds and places."""

    def __init__(self, texts: list[str]):
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        coded = lists.values.dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.lists = lists.offsets.to_numpy().astype(np.int64)
        if len(_known) > CACHED:
            _known.clear()
        names = self.words.to_pylist()
        classes = list(map(_known.get, names))
        for i, c in enumerate(classes):
            if c is None:
                classes[i] = _known[names[i]] = word_class(names[i])
        h, kind, ends = (np.array([c[k] for c in classes], t) for k, t in enumerate((np.uint64, np.int8, bool)))
        n = len(self.codes)
        self.h, kind, ends = h[self.codes], kind[self.codes], ends[self.codes]
        begins = np.ones(n, bool)
        begins[1:] = ends[:-1]
        begins[self.lists[:-1][self.lists[:-1] < n]] = True
        after_number = np.zeros(n, bool)
        after_number[1:] = kind[:-1] == NUMBER
        self.begins, self.after_number, self.raw = begins, after_number, kind
        self.use(WORDS)

    def use(self, stream: int) -> Template:
        """Set the tokens to those of a stream."""
        kind = self.raw
        if stream == EXACT:
            kind = np.full(len(kind), LITERAL, np.int8)
        elif stream == RUNS:
            kind = np.where((kind == UNIT) & ~self.after_number, LITERAL, kind)
        else:
            kind = np.where((kind == CAPITAL) & self.begins | (kind == UNIT) & ~self.after_number, LITERAL, kind)
        goes_on = np.zeros(len(kind), bool)
        if stream == RUNS:
            goes_on[1:] = ((kind[1:] == UNIT) | (kind[1:] == CAPITAL) & (kind[:-1] == CAPITAL)) & ~self.begins[1:]
        self.stream, self.at = stream, np.append(np.flatnonzero(~goes_on), len(kind))
        self.starts = np.searchsorted(self.at, self.lists)
        self.kind = kind[self.at[:-1]]
        self.token = np.where(self.kind == LITERAL, self.h[self.at[:-1]], _HOLDER[self.kind])
        return self

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place and text number of every window of so many tokens with enough plain words."""
        n = len(self.token) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        value, plain = np.full(n, size + 16 * self.stream, np.uint64), np.zeros(n, np.int16)
        for k in range(size):
            value = (value ^ self.token[k : k + n]) * _MULTIPLIER
            value ^= value >> np.uint64(29)
            plain += self.kind[k : k + n] == LITERAL
        text = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))[:n]
        whole = (np.arange(n) + size <= self.starts[1:][text]) & (plain >= min(MIN_LITERALS, size))
        return value[whole], np.flatnonzero(whole), text[whole]

    def slots(self, place: int, size: int) -> list[str]:
        """``kind:word`` of the placeholders of a window, in order."""
        out = []
        for i in range(place, place + size):
            if self.kind[i] != LITERAL:
                run = [self.words[int(c)].as_py().strip(_EDGE).lower() for c in self.codes[self.at[i] : self.at[i + 1]]]
                if self.stream == RUNS and self.kind[i] == NUMBER:  # the number by itself, and with its unit
                    unit = _NUMBER.match(run[0])[1]
                    run = [run[0].removesuffix(unit), *filter(None, [unit]), *run[1:]]
                    out.append(PLACEHOLDERS[NUMBER] + run[0])
                    out.append(PLACEHOLDERS[UNIT] + " ".join(run))
                    continue
                out.append(PLACEHOLDERS[int(self.kind[i])] + " ".join(run))
        return out


def scenario_windows(scenarios: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Template windows of the scenarios: of WINDOW tokens, or of all tokens of a shorter one, in each stream.

    A scenario without any such window, as it has too few plain words, has windows of the EXACT stream.
    ``word`` and ``upto`` are the places of a window in words, ``length`` is in words.
    """
    kind = id_type(scenarios, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            for i, text in enumerate(texts):
                t, found = Template([text]), False
                for stream in (WORDS, RUNS, EXACT):
                    size = min(WINDOW, len(t.use(stream).token))
                    if size < 3 or stream == EXACT and found:
                        continue
                    value, place, _ = t.windows(size)
                    n = len(value)
                    found = found or n > 0
                    columns = [
                        pa.array(value.view(np.int64)), pa.array(place), pa.array([size] * n, pa.int32()), pa.array([stream] * n, pa.int32()),
                        pa.array(t.at[place]), pa.array(t.at[place + size]), pa.array([len(t.codes)] * n, pa.int64()),
                        pa.array([t.slots(int(p), size) for p in place], pa.list_(pa.string())), pa.concat_arrays([part.column(0).slice(i, 1)] * n) if n else part.column(0).slice(0, 0),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["window", "at", "size", "stream", "word", "upto", "length", "slots", "scenario"])

    rows = id_and_text(scenarios, id_col, text_col)
    return rows.mapInArrow(run, f"window long, at long, size int, stream int, word long, upto long, length long, slots array<string>, scenario {kind}")


def window_filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Which values of FILTER_BITS bits some window has, and the sizes of windows (16 x stream + size); of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sizes = np.zeros(1 << FILTER_BITS, bool), set()
        for batch in batches:
            seen[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
            sizes.update(batch.column(1).to_pylist())
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary()), pa.array([sorted(sizes)], pa.list_(pa.int32()))], names=["bits", "sizes"])

    found, sizes = np.zeros(1 << FILTER_BITS >> 3, np.uint8), set()
    for row in windows.select("window", (16 * F.col("stream") + F.col("size")).cast("int").alias("size")).coalesce(8).mapInArrow(run, "bits binary, sizes array<int>").toLocalIterator():
        found |= np.frombuffer(row.bits, np.uint8)
        sizes.update(row.sizes)
    return np.unpackbits(found).view(bool), sorted(sizes)


def find_leaks(
    events: DataFrame,
    scenarios: DataFrame,
    min_tokens: int = 13,
    min_percent: int = 50,
    id_col: str = "event_id",
    text_col: str = "raw",
    scenario_id_col: str = "scenario_id",
    scenario_text_col: str = "raw",
) -> DataFrame:
    """Pairs of an event whose raw record repeats an evaluation scenario and that scenario.

    Numbers, addresses, names (capitals inside a sentence) and units after a number become typed
    placeholders; windows of WINDOW template tokens (or the whole of a shorter scenario, of three tokens
    and more) are joined by hash. A second stream of tokens has a run of names, or a number with its unit,
    as one token, and takes capitals at a sentence start for names, so slots may change their number of
    words. Scenarios with too few plain words for any window are matched word by word. Matches at
    one distance between the places in both texts form an alignment, and those at distances of up to NEAR more
    are added up as another; it counts if each slot value of the scenario stands for one value of the
    record, and it covers ``min_tokens`` words or ``min_percent`` of the scenario.

    Returns ``event_id``, ``scenario_id``, ``n_windows``, ``covered`` (words), ``percent`` and
    ``reparameterised`` (a slot differs), one row for each pair, of its best alignment. Null and empty
    texts match nothing; repeated rows give one pair. Whole records are read, other columns are not.

    Records are read once. A bit table of fixed size, broadcast, drops windows that no scenario has;
    what passes is joined on the hash, salted by record, so a passage that every record holds is spread.
    """
    windows = stage(scenario_windows(scenarios, scenario_id_col, scenario_text_col))
    bits, sizes = window_filter(windows)
    spark = events.sparkSession
    shared, kind = spark.sparkContext.broadcast((np.packbits(bits), sizes)), id_type(events, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, lengths = shared.value
        known = np.unpackbits(packed).view(bool)
        for part, texts in text_slices(batches):
            t = Template(texts)
            for stream, size in (divmod(x, 16) for x in lengths):
                if stream != t.stream:
                    t.use(stream)
                value, place, text = t.windows(size)
                hit = np.flatnonzero(known[value >> np.uint64(64 - FILTER_BITS)])
                columns = [
                    part.column(0).take(pa.array(text[hit])), pa.array(value[hit].view(np.int64)), pa.array(place[hit] - t.starts[text[hit]]),
                    pa.array([t.slots(int(p), size) for p in place[hit]], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "window", "place", "found"])

    hits = id_and_text(events, id_col, text_col).mapInArrow(run, f"id {kind}, window long, place long, found array<string>")
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("id", "place"), F.lit(SALTS)).cast("int"))
    salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Stored, as several branches read the matches: every text is taken apart once.
    met = stage(hits.join(salted, ["window", "salt"]).withColumn("shift", F.col("place") - F.col("at")))
    # Alignments: every shift alone, and chains of neighbouring shifts (numbered by the first) as well.
    shifts = met.select("id", "scenario", "stream", "shift").distinct()
    each = Window.partitionBy("id", "scenario", "stream").orderBy("shift")
    opens = F.when(F.coalesce(F.col("shift") - F.lag("shift").over(each) > NEAR, F.lit(True)), F.col("shift"))
    chains = shifts.withColumn("opens", opens).withColumn("chain", F.last("opens", ignorenulls=True).over(each)).drop("opens")
    chain = Window.partitionBy("id", "scenario", "stream", "chain")
    chains = chains.withColumn("several", F.min("shift").over(chain) != F.max("shift").over(chain))
    chains = chains.filter("several").select(*[F.col(c).alias(f"of_{c}") for c in ("id", "scenario", "stream", "shift")], "chain")
    keys = [met[c].eqNullSafe(chains[f"of_{c}"]) for c in ("id", "scenario", "stream", "shift")]
    chained = met.join(chains, keys[0] & keys[1] & keys[2] & keys[3]).select(*[met[c] for c in met.columns if c != "shift"], F.col("chain").alias("shift"), F.lit(True).alias("chained"))
    met = met.withColumn("chained", F.lit(False)).unionByName(chained)
    by = ["id", "scenario", "stream", "chained", "shift"]
    spans = F.sort_array(F.collect_set(F.struct("word", "upto")))
    counted = met.groupBy(*by).agg(F.count_distinct("at").alias("n_windows"), spans.alias("spans"), F.max("length").alias("length"))
    pairs = met.filter(F.size("slots") > 0).select(*by, F.explode(F.arrays_zip("slots", "found")).alias("s"))
    values = pairs.groupBy(*by, F.col("s.slots").alias("slot")).agg(F.min("s.found").alias("low"), F.max("s.found").alias("high"))
    checked = values.groupBy(*by).agg(F.max((F.col("low") != F.col("high")).cast("int")).alias("broken"), F.max((F.col("low") != F.col("slot")).cast("int")).alias("changed"))
    keys = [counted[c].eqNullSafe(checked[c]) for c in by]
    whole = counted.join(checked, keys[0] & keys[1] & keys[2] & keys[3] & keys[4], "left").select(counted["*"], F.coalesce("broken", F.lit(0)).alias("broken"), F.coalesce("changed", F.lit(0)).alias("changed"))
    step = lambda x, i: F.least(x["upto"], F.coalesce(F.get("spans", i + 1)["word"], x["upto"])) - x["word"]
    covered = F.aggregate(F.transform("spans", step), F.lit(0).cast("long"), lambda a, x: a + x)
    good = whole.filter("broken = 0").withColumn("covered", covered).filter((F.col("covered") >= min_tokens) | (100 * F.col("covered") >= min_percent * F.col("length")))
    best = F.row_number().over(Window.partitionBy("id", "scenario").orderBy(F.desc("covered"), "changed", "stream", "chained", "shift"))
    return good.withColumn("best", best).filter("best = 1").select(
        F.col("id").alias(id_col),
        F.col("scenario").alias(scenario_id_col),
        "n_windows",
        "covered",
        (100.0 * F.col("covered") / F.col("length")).alias("percent"),
        (F.col("changed") > 0).alias("reparameterised"),
    )
