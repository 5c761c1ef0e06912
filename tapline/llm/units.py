"""Distinct parts of many texts, so that each is looked up once; and units that a byte-level BPE encodes apart."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNIT_CHARS = 64
CACHE_UNITS = 240_000
# A space is a safe place to cut before if a character follows that no Unicode version takes for white space.
_SAFE = "[!-~¡-ʯぁ-힣]"
_CUT = re.compile(f" (?={_SAFE})")
_starts_safe = re.compile(f"\n?{_SAFE}").match


def distinct_parts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct parts between single spaces, the number of each part in its order, and each text's range."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = lists.values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().copy(), lists.offsets.to_numpy().astype(np.int64)


def gather(pieces: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unsigned 32-bit numbers of the pieces laid out in an order, and how many each place got."""
    sizes = np.fromiter(map(len, pieces), np.int32, len(pieces)) >> 2
    flat, first = np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
    placed = sizes[order]
    ends = np.cumsum(placed, dtype=np.int32)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(first[order] - (ends - placed), placed)
    at += np.arange(total, dtype=np.int32)
    return flat[at], placed


class UnitCache:
    """Ids of texts as arrays of unsigned 32-bit integers, from the ids of their units.

    The splitting rule of byte-level BPE puts the last space before a word into the word's own piece, so
    a text may be cut before every such space without a change of the ids; likewise before a line feed
    between two characters that are no space. ``resolve`` gets a list of units not seen lately and returns
    the bytes of their ids; ``resolve_spaced`` does so for units that stand after one space and hold none,
    without that space. Units longer than UNIT_CHARS are resolved every time; at ``limit`` entries
    the older half of the memory is dropped, so it is bounded by that and what one slice of texts adds.
    """

    def __init__(self, resolve: Callable[[list[str]], list[bytes]], resolve_spaced: Callable[[list[str]], list[bytes]] | None = None, limit: int = CACHE_UNITS):
        self.resolve, self.known, self.older, self.limit = resolve, {}, {}, limit
        self.resolve_spaced = resolve_spaced or (lambda units: resolve([" " + u for u in units]))

    def look_up(self, units: list[str], safe: Callable[[str], object]) -> list[bytes | None]:
        """Ids of distinct units, those that start with a space written without it; None for unsafe ones."""
        got = list(map(self.known.get, units))
        if None not in got:
            return got
        older, spaced, others = self.older.get, [], []
        for i, made in enumerate(got):
            if made is None:
                unit = units[i]
                if (made := older(unit)) is not None:
                    got[i] = self.known[unit] = made
                elif safe(unit):
                    (others if unit[0] == "\n" or " " in unit else spaced).append(i)
        for places, resolve in ((spaced, self.resolve_spaced), (others, self.resolve_others)):
            if places:
                wanted = [units[i] for i in places]
                for i, unit, ids in zip(places, wanted, resolve(wanted), strict=True):
                    got[i] = ids
                    if len(unit) <= UNIT_CHARS:
                        self.known[unit] = ids
        if len(self.known) > self.limit // 2:
            self.known, self.older = {}, self.known
        return got

    def resolve_others(self, units: list[str]) -> list[bytes]:
        return self.resolve([u if u[0] == "\n" else " " + u for u in units])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        marked = [t.replace("\n", " \n") for t in texts]
        parts, order, ranges = distinct_parts(marked)
        pieces = self.look_up(parts, _starts_safe)
        heads = [t.partition(" ")[0] for t in marked]
        cuts = {}
        if None in pieces:
            unsafe = np.array([p is None for p in pieces])
            pieces = [p or b"" for p in pieces]
            hit = unsafe[order]
            hit[ranges[:-1]] = False
            for i in np.flatnonzero(np.add.reduceat(hit, ranges[:-1], dtype=np.int64)).tolist():
                cuts[i] = _CUT.split(texts[i])
                heads[i] = cuts[i][0]
                order[ranges[i] : ranges[i + 1]] = order[ranges[i]]
        numbers = {h: k for k, h in enumerate(dict.fromkeys(heads), len(pieces))}
        pieces += self.resolve(list(numbers))
        order[ranges[:-1]] = [numbers[h] for h in heads]
        flat, placed = gather(pieces, order)
        out = np.split(flat, np.cumsum(np.add.reduceat(placed, ranges[:-1]))[:-1])
        if cuts:
            extra = list(dict.fromkeys(p for cut in cuts.values() for p in cut[1:]))
            made = dict(zip(extra, self.look_up(extra, bool), strict=True))
            made[""] = b""
            for i, cut in cuts.items():
                out[i] = np.frombuffer(b"".join([pieces[numbers[cut[0]]], *map(made.__getitem__, cut[1:])]), "<u4")
        return out
