"""Token counts of a BPE piece model at every prefix of a text, by dynamic programming."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import map_texts
from .units import distinct_parts

SPACE = "▁"
CACHED = 400_000
CACHED_CHARS = 64


class PrefixCounts:
    """Exact token counts of every prefix under a SentencePiece BPE model without normalisation.

    No piece of such a model holds a space mark after another character, so a text falls into segments
    (a run of space marks and the word after it) that are encoded apart from each other. In a segment,
    the encoding of a prefix is the encoding of a shorter prefix and one more piece: the only piece that
    may follow the shorter one's last piece. So one pass keeps, for each prefix, its last piece and count.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece crosses a space: segments would depend on each other")
        if model.encode("a  ") == model.encode("a") or not model.is_byte(model.piece_to_id("<0x00>")):
            raise ValueError("the model must keep spaces and fall back to bytes")
        self.trie: dict = {}
        for piece in self.score:
            node = self.trie
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = piece
        by_score = sorted((p for p in self.score if len(p) > 1), key=lambda p: -self.score[p])
        self.rank = {p: i for i, p in enumerate(by_score)}
        self.parts: dict[str, tuple[int, str, str]] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        self.totals: dict[str, int] = {}  # of segments after a space
        self.cut_totals: dict[str, int] = {}  # of segments after a space, or that start with a line feed

    def merge(self, text: str, parts: int = 1) -> list[str]:
        """Pieces of a short text, merge by merge, until there are so few or nothing merges."""
        few, parts, score = parts, list(text), self.score.get
        while len(parts) > few:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def made_of(self, piece: str) -> tuple[int, str, str]:
        """Rank of the merge that makes a piece, and its two parts; rank -1 for one character."""
        if (known := self.parts.get(piece)) is None:
            if len(piece) == 1:
                known = (-1, "", "")
            else:
                left, right = self.merge(piece, parts=2)
                known = (self.rank[piece], left, right)
            self.parts[piece] = known
        return known

    def may_follow(self, last: str, piece: str) -> bool:
        """Whether the two pieces stay apart when their texts are encoded as one.

        Undoes the later of the merges that made them, again and again: they stay apart unless the pieces
        at the border could have merged before that.
        """
        key = (last, piece)
        if (known := self.follows.get(key)) is not None:
            return known
        if len(self.follows) > 2 * CACHED:
            self.follows.clear()
        if not last:
            known = self.merge(piece) == [piece]
        else:
            rank, known = self.rank.get, False
            limit = len(self.rank) + 1
            while True:
                joined = rank(last + piece)
                if joined is not None and joined < limit:
                    break
                (a, _, inner), (b, outer, _) = self.made_of(last), self.made_of(piece)
                if a > b:
                    limit, last = a, inner
                elif b >= 0:
                    limit, piece = b + 1, outer
                else:
                    known = True
                    break
        self.follows[key] = known
        return known

    def counts(self, segment: str) -> list[int]:
        """Token counts of the segment's prefixes, the empty one included."""
        root, follows, n = self.trie, self.follows.get, len(segment)
        counts, last = [0] * (n + 1), [""] + [None] * n
        for start in range(n):
            before, count, node = last[start], counts[start] + 1, root
            for end in range(start, n):
                if (node := node.get(segment[end])) is None:
                    break
                if (piece := node.get("")) is not None and last[end + 1] is None:
                    known = follows((before, piece))
                    if self.may_follow(before, piece) if known is None else known:
                        counts[end + 1], last[end + 1] = count, piece
            if last[start + 1] is None:  # a character that no piece has, as bytes
                letter = segment[start]
                counts[start + 1], last[start + 1] = count - 1 + len(letter.encode("utf-8", "surrogatepass")), letter
        return counts

    def segments(self, text: str) -> list[str]:
        """Segments of a text that is not empty, each without the first of its space marks."""
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return parts
        out, run = [], 0
        for part in parts:
            if part:
                out.append(SPACE * run + part)
                run = 0
            else:
                run += 1
        return out + [SPACE * (run - 1)] if run else out

    def total(self, text: str) -> tuple[int, list[str], list[int]]:
        if not text:
            return 0, [], []
        if len(self.totals) > CACHED:
            self.totals = {}
        segments, totals = self.segments(text), self.totals
        got = list(map(totals.get, segments))
        if None in got:
            for i, size in enumerate(got):
                if size is None:
                    got[i] = size = self.counts(SPACE + segments[i])[-1]
                    if len(segments[i]) <= CACHED_CHARS:
                        totals[segments[i]] = size
        return sum(got), segments, got

    def sizes(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts; a segment that many of them share is looked up once."""
        if not texts:
            return []
        cut = [t.replace(SPACE, " ") for t in texts]
        if "\n" not in self.trie:  # then no piece holds a line feed, and nothing merges across one
            cut = [t.replace("\n", " \n") for t in cut]
        parts, order, ranges = distinct_parts(cut)
        if len(self.cut_totals) > CACHED:
            self.cut_totals = {}
        totals = self.cut_totals
        got = list(map(totals.get, parts))
        for i, size in enumerate(got):
            if size is None:
                part = parts[i]
                got[i] = size = self.counts(part if part[:1] == "\n" else SPACE + part)[-1]
                if part and len(part) <= CACHED_CHARS:
                    totals[parts[i]] = size
        out = np.add.reduceat(np.array(got)[order], ranges[:-1])
        if "" in parts:  # next to another space a mark belongs to a longer segment
            for i in np.flatnonzero(np.add.reduceat(order == parts.index(""), ranges[:-1], dtype=np.int64)):
                out[i] = self.total(texts[i])[0]
        return out.tolist()

    def longest_within(self, text: str, limit: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens."""
        size, segments, sizes = self.total(text)
        if size <= limit:
            return len(text)
        used = end = 0
        for segment, n in zip(segments, sizes, strict=True):
            fit = max((p for p, c in enumerate(self.counts(SPACE + segment)) if used + c <= limit), default=0) if used + n > limit else len(segment) + 1
            if not fit:
                break
            end = end + fit
            used += n
            if used > limit:
                break
        return max(0, end - 1)  # the mark before the first segment is no character of the text

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of all prefixes: element i is the count of the first i code points."""
        out, base = [np.zeros(1, np.int32)], 0
        for segment in self.segments(text) if text else ():
            counts = np.array(self.counts(SPACE + segment), np.int32) + base
            out.append(counts[1:])
            base = int(counts[-1])
        table = np.concatenate(out)
        return np.concatenate([table[:1], table[2:]]) if text else table


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounts:
    """One counter, with what it remembers, for each worker process."""
    return PrefixCounts(path)


def token_budget(
    events: DataFrame, path: str, limit: int = 4096, keep_prefixes: bool = False, id_col: str = "event_id", text_col: str = "raw"
) -> DataFrame:
    """Token count of the raw record of every event, and how much of it fits a token limit.

    ``path`` names a SentencePiece BPE model (no normalisation, byte fallback) that every executor can
    open. Returns ``event_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` and ``fit_chars``, the
    code points of the longest prefix of at most ``limit`` tokens; with ``keep_prefixes`` also
    ``prefix_tokens`` (array of int), from which ``tokens_before`` and ``chars_within`` answer any later
    question without encoding again. One row for each input row, repeated rows included; a null or empty
    record has 0 bytes and tokens. Records are counted whole, in time proportional to their length. Other
    columns are not read. There is no shuffle.
    """

    def one():
        c = counter(path)

        def apply(texts: list[str]) -> list[pa.Array]:
            sizes = c.sizes(texts)
            made = [
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array([n > limit for n in sizes], pa.bool_()),
                pa.array([c.longest_within(t, limit) if n > limit else len(t) for t, n in zip(texts, sizes, strict=True)], pa.int64()),
            ]
            if keep_prefixes:
                made.append(pa.array([c.prefixes(t) for t in texts], pa.list_(pa.int32())))
            return made

        return apply

    columns = "n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_tokens array<int>" * keep_prefixes
    return map_texts(events, id_col, text_col, one, columns).withColumnRenamed("id", id_col)


def tokens_before(prefix_tokens: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points."""
    return F.get(prefix_tokens, F.lit(chars) if isinstance(chars, int) else chars)


def chars_within(prefix_tokens: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return F.size(prefix_tokens) - F.array_position(F.transform(F.reverse(prefix_tokens), lambda n: n <= budget), True).cast("int")
