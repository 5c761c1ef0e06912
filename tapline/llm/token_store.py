"""Token ids in shards, each a wavelet matrix that answers access, rank and select from its own bytes."""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rows import id_and_text, id_type, text_slices
from .units import UnitCache

SHARD_TOKENS = 1 << 20
_BLOCK = 512  # bits between two stored ranks
_HEAD = struct.Struct("<4sIII")


class WaveletMatrix:
    """A sequence of ids as bit-planes over the ids that occur, highest bit first.

    Each plane is the sequence stably parted by the planes above, so a range of one plane maps to a range
    of the next by two ranks. ``blocks`` has the ones before each 512th bit.
    """

    def __init__(self, alphabet: np.ndarray, size: int, planes: list[np.ndarray]):
        self.alphabet, self.size, self.planes = alphabet, size, planes
        self.blocks = []
        for plane in planes:
            ones = np.bitwise_count(plane.view("<u8")).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.int64)
            self.blocks.append(np.concatenate([[0], np.cumsum(ones)]))
        self.zeros = [size - int(b[-1]) for b in self.blocks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = int(ids.max()) + 1 if len(ids) else 1
        present = np.zeros(width, bool)
        present[ids] = True
        alphabet = np.flatnonzero(present).astype("<u4")
        code = np.zeros(width, np.uint32)
        code[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
        codes = code[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        planes, parted = [], np.empty_like(codes)
        for level in reversed(range(max(0, len(alphabet) - 1).bit_length())):
            bit = (codes >> codes.dtype.type(level) & codes.dtype.type(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % (_BLOCK // 8), np.uint8)]))
            zeros = len(bit) - np.count_nonzero(bit)
            np.compress(~bit, codes, out=parted[:zeros])
            np.compress(bit, codes, out=parted[zeros:])
            codes, parted = parted, codes
        return cls(alphabet, len(ids), planes)

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(b"WVM1", self.size, len(self.alphabet), len(self.planes))
        return b"".join([head, self.alphabet.tobytes(), *[p.tobytes() for p in self.planes]])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, size, letters, levels = _HEAD.unpack_from(data)
        if magic != b"WVM1":
            raise ValueError("not a wavelet shard")
        at = _HEAD.size
        alphabet = np.frombuffer(data, "<u4", letters, at)
        at += 4 * letters
        each = (size + _BLOCK - 1) // _BLOCK * (_BLOCK // 8)
        return cls(alphabet, size, [np.frombuffer(data, np.uint8, each, at + k * each) for k in range(levels)])

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position ``i``."""
        block = i // _BLOCK
        start = block * _BLOCK // 8
        rest = np.unpackbits(self.planes[level][start : start + (i % _BLOCK + 7) // 8], bitorder="little")[: i % _BLOCK]
        return int(self.blocks[level][block]) + int(rest.sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value in a plane."""
        before = self.blocks[level] if bit else np.arange(len(self.blocks[level])) * _BLOCK - self.blocks[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        start = block * _BLOCK // 8
        bits = np.unpackbits(self.planes[level][start : start + _BLOCK // 8], bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        code = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, code: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._ones(level, start), self._ones(level, stop)
            if code >> (len(self.planes) - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often the id occurs at positions from ``start`` to before ``stop``."""
        code = self._code(token)
        if code is None:
            return 0
        a, b = self._range(code, start, self.size if stop is None else stop)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the id; ValueError if there are fewer."""
        code = self._code(token)
        a, b = self._range(code, 0, self.size) if code is not None else (0, 0)
        if not 0 <= k < b - a:
            raise ValueError("no such occurrence")
        i = a + k
        for level in reversed(range(len(self.planes))):
            bit = code >> (len(self.planes) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """The whole sequence, from the lowest plane upwards."""
        codes = np.zeros(self.size, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for depth, level in enumerate(reversed(range(len(self.planes)))):
            bit = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            above = np.empty_like(codes)
            above[np.flatnonzero(~bit)] = codes[: self.zeros[level]]
            above[np.flatnonzero(bit)] = codes[self.zeros[level] :] | codes.dtype.type(1 << depth)
            codes = above
        return self.alphabet[codes] if self.size else np.empty(0, "<u4")


@lru_cache(maxsize=2)
def library_units(path: str) -> UnitCache:
    """Unit cache over the tokenizers library, one for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    starts = np.zeros(tokenizer.get_vocab_size(), bool)
    starts[[k for token, k in tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True
    encode = tokenizer.encode_batch_fast

    def resolve(units: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in encode(units, add_special_tokens=False)]

    def resolve_spaced(units: list[str]) -> list[bytes]:
        """Units that each start with their only space are encoded in a row, and cut at tokens that start with one."""
        made = []
        for at in range(0, len(units), 4000):
            lot = units[at : at + 4000]
            # the library is quicker over short rows; each starts with a space, so their ids follow one another as those of one row
            rows = [" " + " ".join(lot[i : i + 100]) for i in range(0, len(lot), 100)]
            if any("<|" in row for row in rows):  # an added token may stand in a unit
                made += resolve([" " + u for u in lot])
                continue
            data = b"".join(resolve(rows))
            ids = np.frombuffer(data, "<u4")
            first = np.flatnonzero(starts[ids])
            if len(first) != len(lot):
                raise ValueError("the units of a row were not kept apart")
            ends = [*(4 * first[1:]).tolist(), 4 * len(ids)]
            made += [data[a:b] for a, b in zip((4 * first).tolist(), ends, strict=True)]
        return made

    return UnitCache(resolve, resolve_spaced, limit=500_000)


def write_token_shards(
    events: DataFrame, path: str, folder: str, end_id: int, shard_tokens: int = SHARD_TOKENS, id_col: str = "event_id", text_col: str = "raw"
) -> None:
    """Encode the raw record of every event and write the ids, in ascending order of ``event_id``, to shards.

    Events are dealt by ranges of their id and sorted in each range; a task closes a shard at the first
    event that makes it ``shard_tokens`` long, so memory follows the shard and the longest record. The
    folder gets Parquet rows of (part, inside, size, event_ids, n_tokens, wavelet), where ``inside`` is the
    number of ids before the shard in its part; the committer of the
    writer makes lost or repeated tasks harmless. Every event's ids end with ``end_id``. Null and empty
    records have only that id; a null event_id sorts first; repeated rows stay, equal ids by their
    record. Other columns are not read.
    """
    kind = id_type(events, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part, inside = library_units(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        held, ids, lengths = [], [], []

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(ids))
            row = [[part], [inside], [total], pa.array([pa.chunked_array(held).to_pylist()], pa.list_(held[0].type)), [lengths], [matrix.to_bytes()]]
            types = [pa.int32(), pa.int64(), pa.int64(), None, pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([x if t is None else pa.array(x, t) for x, t in zip(row, types, strict=True)], names=names)

        total = 0
        for batch, texts in text_slices(batches, chars=8_000_000):
            start = 0
            for i, made in enumerate(units.encode(texts)):
                ids += [made, end]
                lengths.append(len(made) + 1)
                total += lengths[-1]
                if total >= shard_tokens:
                    held.append(batch.column(0).slice(start, i + 1 - start))
                    yield close()
                    held, ids, lengths, total, start, inside = [], [], [], 0, i + 1, inside + total
            if start < batch.num_rows:
                held.append(batch.column(0).slice(start))
        if held:
            yield close()

    names = ["part", "inside", "size", "event_ids", "n_tokens", "wavelet"]
    dealt = id_and_text(events, id_col, text_col).repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    made = dealt.mapInArrow(run, f"part int, inside long, size long, event_ids array<{kind}>, n_tokens array<int>, wavelet binary")
    made.write.parquet(folder)


def read_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every event's ids from the shards of ``write_token_shards``.

    Returns ``event_id``, ``start`` (ids of all events before it), ``n_tokens`` (with the end id) and
    ``ids`` (binary, unsigned 32-bit little-endian). Shards stay where they are read: what is before a part
    comes from a table of one row for each task that wrote, so no larger than the writer's partitions.
    """
    shards = spark.read.parquet(folder)
    kind = shards.schema["event_ids"].dataType.elementType.simpleString()
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("size").alias("size"))
    parts = parts.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0).cast("long")).alias("base"))
    start = (F.col("base") + F.col("inside")).alias("start")
    rows = shards.join(F.broadcast(parts), "part").select("event_ids", "n_tokens", "wavelet", start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = WaveletMatrix.from_bytes(batch.column(2)[i].as_py()).ids()
                lengths = np.asarray(batch.column(1)[i].values, dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                offsets = pa.py_buffer((ends * 4).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i].values,
                        pa.array(ends[:-1] + batch.column(3)[i].as_py(), pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, offsets, data]),
                    ],
                    names=["event_id", "start", "n_tokens", "ids"],
                )

    return rows.mapInArrow(run, f"event_id {kind}, start long, n_tokens long, ids binary")
