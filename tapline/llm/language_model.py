"""Language of raw records by prediction by partial matching over byte contexts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rows import id_and_text, id_type, text_slices

ORDER = 5
SALTS = 16
CODED = 1 << 18  # bytes looked up at once
NONE = "und"


class ContextTree:
    """Byte contexts of up to ORDER bytes of one language, with frozen counts.

    In a context seen n times with d different next bytes, a seen byte costs -log2(count / (n + d)) bits
    and an escape to the next shorter context -log2(d / (n + d)); below the empty context a byte costs 8.
    Contexts begin at the space before a word, so the length of a text is the sum over its words.
    """

    def __init__(self, words: Counter):
        self.follow: dict[bytes, Counter] = {}
        for word, n in words.items():
            data = b" " + word.encode() + b" "
            for i in range(1, len(data)):
                for start in range(max(0, i - ORDER), i + 1):
                    self.follow.setdefault(data[start:i], Counter())[data[i]] += n

    def length(self, word: str) -> float:
        """Exact code length of a word and the space after it, in bits, context by context."""
        data, out = b" " + word.encode() + b" ", 0.0
        for i in range(1, len(data)):
            for start in range(max(0, i - ORDER), i + 1):
                seen = self.follow.get(data[start:i])
                if seen:
                    total = seen.total() + len(seen)
                    if data[i] in seen:
                        out -= math.log2(seen[data[i]] / total)
                        break
                    out -= math.log2(len(seen) / total)
            else:
                out += 8.0
        return out


class LanguageModel:
    """Context trees of several languages, as sorted tables of every context and of every byte seen after it.

    As the counts are frozen, what a byte costs follows from the up to ORDER bytes before it in its word. They
    and the byte are packed into one integer without loss; each distinct one is looked up from the longest
    context to the empty one, as ``ContextTree.length`` does, for all languages at once. The tables hold
    the whole trees and only what was seen, so they are as large as the training words make them.
    """

    def __init__(self, samples: pd.DataFrame):
        counts: dict[str, Counter] = {}
        for lang, text in zip(samples["lang"], samples["text"], strict=True):
            counts.setdefault(lang, Counter()).update(text.lower().split())
        self.langs = sorted(counts)
        seen: list[dict[int, dict[int, float]]] = [{} for _ in range(ORDER + 1)]
        escape: list[dict[int, dict[int, float]]] = [{} for _ in range(ORDER + 1)]
        for k, lang in enumerate(self.langs):
            for context, follow in ContextTree(counts[lang]).follow.items():
                total, key = follow.total() + len(follow), int.from_bytes(context)
                escape[len(context)].setdefault(key, {})[k] = -math.log2(len(follow) / total)
                for x, n in follow.items():
                    seen[len(context)].setdefault(key << 8 | x, {})[k] = -math.log2(n / total)
        self.seen = [self._table(x, np.nan) for x in seen]
        self.escape = [self._table(x, 0.0) for x in escape]

    def _table(self, entries: dict[int, dict[int, float]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys, and a row of bits in each language for each key and (the last) for any other key."""
        keys = sorted(entries)
        bits = np.full((len(keys) + 1, len(self.langs)), missing)
        for i, key in enumerate(keys):
            bits[i, list(entries[key])] = list(entries[key].values())
        return np.array(keys, np.uint64), bits

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits in each language of packed bytes: in 8-bit fields from the lowest, a byte and those before it, and at ORDER + 1 their number."""

        def rows(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
            keys, bits = table
            at = np.searchsorted(keys, key)
            at[at < len(keys)] = np.where(keys[at[at < len(keys)]] == key[at < len(keys)], at[at < len(keys)], len(keys))
            return bits[at]

        out, open_ = np.zeros((len(grams), len(self.langs))), np.ones((len(grams), len(self.langs)), bool)
        before = (grams >> np.uint64(8 * (ORDER + 1))).astype(np.int64)
        for order in range(ORDER, -1, -1):
            at = np.flatnonzero((before >= order) & open_.any(axis=1))
            key = grams[at] & np.uint64((1 << 8 * (order + 1)) - 1)
            bits = rows(self.seen[order], key)
            found = ~np.isnan(bits)
            out[at] += np.where(open_[at], np.where(found, bits, rows(self.escape[order], key >> np.uint64(8))), 0.0)
            open_[at] &= ~found
        return out + 8.0 * open_

    def lengths(self, words: list[str]) -> np.ndarray:
        """Code length of every word and the space after it in each language, in bits."""
        data = [b" " + w.encode() + b" " for w in words]
        starts = np.cumsum([0, *map(len, data)])[:-1]
        flat = np.frombuffer(b"".join(data), np.uint8)
        total = np.zeros((len(words), len(self.langs)))
        for low in range(0, len(flat), CODED):
            place = np.arange(low, min(low + CODED, len(flat)))
            word = np.searchsorted(starts, place, side="right") - 1
            before = place - starts[word]
            word, place, before = word[before > 0], place[before > 0], np.minimum(before[before > 0], ORDER)
            grams = before.astype(np.uint64) << np.uint64(8 * (ORDER + 1))
            for k in range(ORDER + 1):
                grams |= np.where(before >= k, flat[place - np.minimum(before, k)], 0).astype(np.uint64) << np.uint64(8 * k)
            distinct, which = np.unique(grams, return_inverse=True)
            bits = self.costs(distinct)
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(word, bits[which, k], len(words))
        return total

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language of the shortest code, the first by name of equals, and its posterior share."""
        if not self.langs or not texts:
            return [(NONE, 0.0)] * len(texts)
        lists = pc.utf8_split_whitespace(pa.array([t.lower().strip() for t in texts], pa.large_string()))
        coded = lists.values.dictionary_encode()
        table = self.lengths(coded.dictionary.to_pylist())
        each, ranges = table[coded.indices.to_numpy()], lists.offsets.to_numpy()
        out = []
        for text, a, b in zip(texts, ranges[:-1], ranges[1:], strict=True):
            if not any(map(str.isalpha, text)):
                out.append((NONE, 0.0))
                continue
            bits = each[a:b].sum(axis=0)
            best = int(bits.argmin())
            out.append((self.langs[best], float(1.0 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum())))
        return out


def train_language(events: DataFrame, rows_per_language: int = 160, id_col: str = "event_id", text_col: str = "raw", label_col: str = "lang") -> LanguageModel:
    """Context trees from labelled events (null labels and texts are left out).

    At most ``rows_per_language`` records of each label train, those with the least hash of their id in each
    of SALTS parts of the label, which share the number: a documented bound on what is broadcast and collected, and no
    task sorts a whole label. Records are counted, not ids; equal records of an id count once.
    """
    keyed = events.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keyed = keyed.filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    order = F.xxhash64(F.col("id").cast("string"))
    keyed = keyed.withColumn("body", F.xxhash64("text"))
    rows = keyed.select("id", "lang", "body", order.alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "id", "body"))
    share = rows_per_language // SALTS + (F.col("salt") < rows_per_language % SALTS).cast("int")
    few = rows.withColumn("place", place).filter(F.col("place") <= share).select("id", "lang", "body")
    return LanguageModel(keyed.join(F.broadcast(few), ["id", "lang", "body"]).dropDuplicates(["id", "lang", "body"]).select("lang", "text").toPandas())


def identify_language(events: DataFrame, model: LanguageModel, id_col: str = "event_id", text_col: str = "raw") -> DataFrame:
    """Language of the raw record of every event.

    The project's records have no natural-language field of their own; ``raw`` may be any text, such as a
    decoded payload, and the labels any classes of text. Returns ``event_id``, ``lang_pred`` and ``score``
    (0 to 1); one row for each input row, repeated rows included. A null record, or one without a letter,
    is 'und' with score 0. Whole records are scored: the code length of a text is the sum over its
    words, each distinct one coded once a slice. The model holds every context of its bounded training
    sample; it is broadcast, and there is no shuffle.
    """
    shared, kind = events.sparkSession.sparkContext.broadcast(model), id_type(events, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for part, texts in text_slices(batches):
            made = fitted.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["id", "lang_pred", "score"]
            )

    return id_and_text(events, id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
