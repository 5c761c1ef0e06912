"""BPE encoding and decoding: a segment tree over adjacent pair ranks picks every merge."""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import map_texts
from .units import UNIT_CHARS, UnitCache

# Fixed value: the splitting rule of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_POSITION = 32
_NONE = 1 << 62
KNOWN_WORDS = 200_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class PairTree:
    """Minimum tree over the ranks of adjacent pairs.

    A leaf is ``rank << 32 | position``, so the root, element 1, is the leftmost pair of the lowest rank. A
    merge changes three leaves at most; each is carried upwards, in logarithmic time, until a node keeps
    its minimum.
    """

    def __init__(self, leaves: list[int]):
        size = 1
        while size < len(leaves):
            size *= 2
        tree = [_NONE] * size + leaves + [_NONE] * (size - len(leaves))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.size, self.tree = size, tree


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary file (JSON with ``vocab`` and ``merges``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.byte_ids = [vocab[c] for c in chars]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        byte_of = {c: b for b, c in enumerate(chars)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.pieces = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, k in [*vocab.items(), *added.items()]:
            self.pieces[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.added = {a: np.array([k], "<u4").tobytes() for a, k in added.items()}
        self.at_added = regex.compile("|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True))) if added else None
        self.byte_array, self.merged_array = np.array(self.byte_ids), np.array(self.merged)
        keys = np.array([(k >> 32) * len(self.pieces) + (k & 0xFFFFFFFF) for k in self.ranks])
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.ranks.values()))[order]
        self.split, self.words = regex.compile(SPLIT), {}
        self.units = UnitCache(self.resolve)

    def word(self, word: str) -> bytes:
        """Ids of one piece of the splitting rule."""
        ids = self.byte_ids
        symbols = [ids[b] for b in word.encode()]
        n = len(symbols)
        if n > 1:
            ranks, merged = self.ranks.get, self.merged
            leaves = []
            for i in range(n - 1):
                rank = ranks(symbols[i] << 32 | symbols[i + 1])
                leaves.append(_NONE if rank is None else rank << _POSITION | i)
            pairs = PairTree(leaves)
            tree, size = pairs.tree, pairs.size
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while (top := tree[1]) != _NONE:
                i, rank = top & 0xFFFFFFFF, top >> _POSITION
                j = after[i]
                k = after[j] if j < n else n
                symbols[i] = now = merged[rank]
                symbols[j] = -1
                after[i] = k
                changed = []
                if (h := before[i]) >= 0:
                    rank = ranks(symbols[h] << 32 | now)
                    changed.append((h, _NONE if rank is None else rank << _POSITION | h))
                rank = None
                if k < n:
                    before[k] = i
                    rank = ranks(now << 32 | symbols[k])
                    changed.append((j, _NONE))
                changed.append((i, _NONE if rank is None else rank << _POSITION | i))
                for at, leaf in changed:
                    at += size
                    while True:
                        tree[at] = leaf
                        if at == 1:
                            break
                        beside = tree[at ^ 1]
                        if beside < leaf:
                            leaf = beside
                        at >>= 1
                        if tree[at] == leaf:
                            break
            symbols = [s for s in symbols if s >= 0]
        return array("I", symbols).tobytes()

    def leaves(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = left * len(self.pieces) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[at] << 6 | position, _NONE)

    def same_size(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of many pieces of at most ``width + 1`` bytes: their trees are the rows of one array.

        Every step takes the root of each tree, merges that pair and carries the changed leaves upwards.
        """
        sizes = np.array([len(w) for w in words])
        symbols = np.full((len(words), width + 3), -1, np.int64)
        symbols[:, : width + 1][np.arange(width + 1) < sizes[:, None]] = self.byte_array[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((len(words), 2 * width), _NONE, np.int64)
        tree[:, width:] = self.leaves(symbols[:, :width], symbols[:, 1 : width + 1], np.arange(width))
        for i in range(width - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        after = np.tile(np.arange(1, width + 4), (len(words), 1))
        before = np.tile(np.arange(-1, width + 2), (len(words), 1))

        def put(rows: np.ndarray, position: np.ndarray, leaf: np.ndarray | int) -> None:
            at = position + width
            tree[rows, at] = leaf
            while at[0] > 1:
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            top = tree[rows, 1]
            i = top & 63
            j = after[rows, i]
            k = after[rows, j]
            h = before[rows, i]
            now = self.merged_array[top >> 6]
            symbols[rows, i], symbols[rows, j], after[rows, i], before[rows, k] = now, -1, k, i
            put(rows, i, self.leaves(now, symbols[rows, k], i))
            for mine, position, leaf in ((j < width, j, None), (h >= 0, h, now)):
                if mine.any():
                    r, at = rows[mine], position[mine]
                    put(r, at, _NONE if leaf is None else self.leaves(symbols[r, at], leaf[mine], at))
            rows = rows[tree[rows, 1] != _NONE]
        kept = symbols >= 0
        data, ends = symbols[kept].astype("<u4").tobytes(), 4 * np.cumsum(kept.sum(axis=1))
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pieces: short ones together, by the size of their trees, long ones one by one."""
        out, bins = {}, {}
        for word in words:
            data = word.encode()
            if len(data) == 1:
                out[word] = array("I", [self.byte_ids[data[0]]]).tobytes()
            elif len(data) <= 33:
                bins.setdefault(max(2, 1 << (len(data) - 2).bit_length()), []).append((word, data))
            else:
                out[word] = self.word(word)
        for width, members in bins.items():
            out.update(zip([w for w, _ in members], self.same_size([d for _, d in members], width), strict=True))
        return out

    def resolve(self, units: list[str]) -> list[bytes]:
        """Ids of units, with added tokens matched first."""
        split, cut, missing = self.split.findall, [], {}
        for unit in units:
            if self.at_added is not None and self.at_added.search(unit):
                words, at = [], 0
                for found in self.at_added.finditer(unit):
                    words += [*split(unit[at : found.start()]), self.added[found.group()]]
                    at = found.end()
                words += split(unit[at:])
            else:
                words = split(unit)
            cut.append(words)
            for word in words:
                if word not in self.words and isinstance(word, str):
                    missing[word] = None
        new = self.learn(list(missing))
        if len(self.words) + len(new) > KNOWN_WORDS:
            self.words = {w: self.words[w] for words in cut for w in words if w in self.words}
        self.words.update(new)
        known = self.words
        out = [b"".join([w if isinstance(w, bytes) else known[w] for w in words]) for words in cut]
        for word in new:
            if len(word) > UNIT_CHARS:
                del known[word]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.units.encode(texts)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec, with what it remembers, for each worker process."""
    return Codec(path)


def int_lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    values = np.concatenate(ids) if ids else np.empty(0, "<u4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32)))


def encode_records(events: DataFrame, path: str, id_col: str = "event_id", text_col: str = "raw") -> DataFrame:
    """Token ids of the raw record of every event, and the text decoded from them.

    ``path`` names a byte-level BPE vocabulary that every executor can open. Returns ``event_id``,
    ``n_tokens`` (long), ``token_ids`` (array of int) and ``decoded`` (string), one row for each input
    row, repeated rows included. A null or empty record has no tokens and decodes to ''. Very long
    records are encoded whole: a merge costs the logarithm of the piece's length. Added tokens of the
    vocabulary that stand in a record are matched before it is split. Other columns are not read.

    Rows stay where they are read; there is no shuffle, and a lost task is run again alone.
    """

    def one():
        c = codec(path)

        def apply(texts: list[str]) -> list[pa.Array]:
            ids = c.encode(texts)
            return [pa.array([len(i) for i in ids], pa.int64()), int_lists(ids), pa.array([c.decode(i) for i in ids], pa.string())]

        return apply

    return map_texts(events, id_col, text_col, one, "n_tokens long, token_ids array<int>, decoded string").withColumnRenamed("id", id_col)


def record_digests(encoded: DataFrame) -> DataFrame:
    """Replace ids and text of ``encode_records`` by their SHA-256 (decimal ids joined by commas, UTF-8)."""
    joined = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return encoded.select(
        *[c for c in encoded.columns if c not in ("token_ids", "decoded")],
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
