"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

Among all ways to cut a text into pieces the one with the greatest sum of scores is
taken. Texts fall into units (see ``pieces``) that no piece crosses; the distinct
units of a slice are searched once. Units of equal length advance together as one
matrix: the hashes of all their substrings of one length are looked up in the
sorted piece keys at once (and the bytes of what is found are compared), and for each
end position the maximum over the last piece's length is taken for all units together,
which leaves a back pointer. Of equal sums the shorter last piece wins. Units of more
than ``LONG`` bytes are searched one by one in the same way, from a window of start
positions at a time, so an unbroken run of any length needs a few bytes a position. A character that is no piece costs the
least score less 10 and becomes its bytes' pieces, so that decoding gives the text
back whole.

The public model file at hand holds merge ranks as scores; the search takes them as
they are, so its cut differs from a merge-by-merge encoder's.

Null and empty texts have no tokens; decoding a null gives null.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import Pieces, prefixed, units
from .shared import without
from .vectext import POWERS, ROLLING, list_array, mix64, slices, with_columns

SLICE = 1 << 20
#: Cells (units times length) that one matrix holds.
CELLS = 1 << 18
#: Units of more bytes are searched one by one, this many start positions at a time.
LONG, WINDOW = 512, 1 << 14
_CHAR = np.zeros(256, dtype=np.int8)
_CHAR[:128], _CHAR[192:224], _CHAR[224:240], _CHAR[240:248] = 1, 2, 3, 4


class Lattice:
    """Sorted piece keys with scores and ids."""

    def __init__(self, pieces: Pieces):
        raw = [t.encode() for t in pieces.text]
        POWERS.need(max(map(len, raw)) + 1)
        keys = np.array([_key(np.frombuffer(b, np.uint8)) for b in raw], dtype=np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces of the model have the same key")
        order = np.argsort(keys)
        self.bytes = np.zeros((len(raw), max(map(len, raw))), dtype=np.uint8)
        for k, j in enumerate(order.tolist()):
            self.bytes[k, : len(raw[j])] = np.frombuffer(raw[j], np.uint8)
        self.keys, self.score = keys[order], np.array(pieces.score, dtype=np.float64)[order]
        self.ids, self.byte_ids = np.array(pieces.ids, dtype=np.int32)[order], np.array(pieces.byte_ids, dtype=np.int32)
        self.lengths = np.unique([len(b) for b in raw])
        self.unknown = float(self.score.min()) - 10.0
        self.alone = pieces.alone
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the pieces, or -1."""
        out = np.full(keys.shape, -1, dtype=np.int32)
        some = np.nonzero(self.maybe[keys >> np.uint64(44)])
        own = keys[some]
        k = np.searchsorted(self.keys, own)
        k[k == len(self.keys)] = 0
        out[some] = np.where(self.keys[k] == own, k, -1)
        return out

    def matches(self, text: np.ndarray, m: int) -> np.ndarray:
        """For each unit and start position the piece of ``m`` bytes there, or -1."""
        n, length = text.shape
        sums = np.zeros((n, length + 1), dtype=np.uint64)
        np.cumsum(ROLLING[text] * POWERS.up[:length], axis=1, out=sums[:, 1:])
        return self._matches(text, sums, m)

    def _matches(self, text: np.ndarray, sums: np.ndarray, m: int) -> np.ndarray:
        length = text.shape[1]
        here = self.lookup(mix64((sums[:, m:] - sums[:, :-m]) * POWERS.down[: length - m + 1] + np.uint64(m)))
        unit, start = np.nonzero(here >= 0)
        k = here[unit, start]
        other = (np.lib.stride_tricks.sliding_window_view(text, m, axis=1)[unit, start] != self.bytes[k, :m]).any(axis=1)
        here[unit[other], start[other]] = -1
        return here

    def search_long(self, text: np.ndarray) -> np.ndarray:
        """Ids of the tokens of one long unit."""
        length, widest = len(text), int(self.lengths[-1])
        POWERS.need(WINDOW + widest + 1)
        best, size, piece = [0.0] + [-np.inf] * length, np.zeros(length + 1, np.int32), np.full(length + 1, -1, np.int32)
        score = self.score.tolist()
        for c in range(0, length, WINDOW):
            part = text[None, c : c + WINDOW + widest - 1]
            own = min(WINDOW, length - c)
            starts, sizes, pieces = [], [], []
            plain = _CHAR[part[0, :own]].astype(np.int64)  # characters that may be no piece
            for m in self.lengths[self.lengths <= part.shape[1]].tolist():
                here = self.matches(part, m)[0, :own]
                at = np.flatnonzero(here >= 0)
                plain[at[plain[at] == m]] = 0
                starts.append(at)
                sizes.append(np.full(len(at), m))
                pieces.append(here[at])
            at = np.flatnonzero(plain)
            starts, sizes, pieces = (np.concatenate(x) for x in ([*starts, at], [*sizes, plain[at]], [*pieces, np.full(len(at), -1, np.int32)]))
            order = np.lexsort((sizes, starts))
            for s, m, k in zip((starts[order] + c).tolist(), sizes[order].tolist(), pieces[order].tolist(), strict=True):
                value, end = best[s] + (score[k] if k >= 0 else self.unknown), s + m
                if end <= length and (value > best[end] or (value == best[end] and m < size[end])):
                    best[end], size[end], piece[end] = value, m, k
        out, at = [], length
        while at > 0:
            m, k = int(size[at]), int(piece[at])
            out += [int(self.ids[k])] if k >= 0 else self.byte_ids[text[at - m : at]][::-1].tolist()
            at -= m
        return np.array(out[::-1], dtype=np.int32)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens of equally long units (a matrix of bytes), unit after unit, and their numbers."""
        n, length = text.shape
        POWERS.need(length + 1)
        sums = np.zeros((n, length + 1), dtype=np.uint64)
        np.cumsum(ROLLING[text] * POWERS.up[:length], axis=1, out=sums[:, 1:])
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        size = np.zeros((length + 1, n), dtype=np.int32)
        piece = np.full((length + 1, n), -1, dtype=np.int32)
        char = _CHAR[text]
        found = {}
        for m in self.lengths[self.lengths <= length].tolist():
            found[m] = self._matches(text, sums, m).T.copy()
        for end in range(1, length + 1):
            for m in found:
                if m > end:
                    break
                here = found[m][end - m]
                value = np.where(here >= 0, best[end - m] + self.score[here], -np.inf)
                if m <= 4:
                    value = np.where((here < 0) & (char[:, end - m] == m), best[end - m] + self.unknown, value)
                up = value > best[end]
                if up.any():
                    best[end][up], size[end][up], piece[end][up] = value[up], m, here[up]
            for m in range(2, min(4, end) + 1):
                if m not in found:
                    value = np.where(char[:, end - m] == m, best[end - m] + self.unknown, -np.inf)
                    up = value > best[end]
                    best[end][up], size[end][up], piece[end][up] = value[up], m, -1
        # back along the pointers, all units together
        at, unit = np.full(n, length, dtype=np.int64), np.arange(n)
        steps: list = []
        while len(unit):
            m, p = size[at, unit], piece[at, unit]
            steps.append((unit, at - m, m, p))
            at = at - m
            unit, at = unit[at > 0], at[at > 0]
        unit, start, m, p = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((start, unit))
        unit, start, m, p = unit[order], start[order], m[order], p[order]
        width = np.where(p < 0, m, 1)
        first = np.cumsum(width) - width
        out = np.empty(int(width.sum()), dtype=np.int32)
        out[first[p >= 0]] = self.ids[p[p >= 0]]
        for k in np.flatnonzero(p < 0).tolist():
            out[first[k] : first[k] + m[k]] = self.byte_ids[text[unit[k], start[k] : start[k] + m[k]]]
        return out, np.bincount(unit, weights=width, minlength=n).astype(np.int64)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, row after row, and the number of each row's."""
        raw, at = prefixed(raw, at)
        starts, ends, hashes, rows = units(raw, at, self.alone)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        starts, length = starts[one], (ends - starts)[one]
        groups = defaultdict(list)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        ids, count, first = [], np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        total = 0
        for own in np.split(order, cuts) if len(order) else []:
            groups[int(length[own[0]])] = own
        for m, own in groups.items():
            step = max(1, CELLS // m)
            for k in range(0, len(own), step):
                some = own[k : k + step]
                if m > LONG:
                    each = [self.search_long(raw[starts[j] : starts[j] + m]) for j in some.tolist()]
                    got, numbers = np.concatenate(each), np.array([len(x) for x in each])
                else:
                    got, numbers = self.search(raw[starts[some][:, None] + np.arange(m)])
                ids.append(got)
                count[some], first[some] = numbers, total + np.cumsum(numbers) - numbers
                total += len(got)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        n = count[which]
        out = flat[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        upto = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(n, out=upto[1:])
        return out, np.diff(upto[rows])


def _key(raw: np.ndarray) -> int:
    value = (ROLLING[raw] * POWERS.up[: len(raw)]).sum(dtype=np.uint64)
    return int(mix64(np.array([value + np.uint64(len(raw))], dtype=np.uint64))[0])


class Decoder:
    """The bytes of every id, laid end to end."""

    def __init__(self, pieces: Pieces):
        n = max([*pieces.ids, *pieces.byte_ids]) + 1
        text = [b""] * n
        for i, t in zip(pieces.ids, pieces.text, strict=True):
            text[i] = t.encode()
        for b, i in enumerate(pieces.byte_ids):
            text[i] = bytes([b])
        self.length = np.array([len(t) for t in text], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(text), dtype=np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' bytes, and each row's number of bytes, without the space put first."""
        n = self.length[ids]
        where = np.repeat(self.first[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out, upto = self.bytes[where], np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(n, out=upto[1:])
        rows = np.concatenate([[0], np.cumsum(counts)])
        edge = upto[rows]
        size = np.diff(edge)
        full = size > 0
        keep = np.ones(len(out), dtype=bool)
        keep[edge[:-1][full]] = False
        return out[keep], size - full


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", carry: list[str] | None = None, check: bool = False) -> DataFrame:
    """``carry`` (all columns if None) plus ids; with ``check`` also round_trip: whether decoding the ids gives the text's bytes (U+2581 as a space)."""
    made = ("ids", "round_trip") if check else ("ids",)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, decoder = Lattice(shared.value), Decoder(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi, raw, at in slices(column, SLICE):
                ids, counts = lattice.encode(raw, at)
                new = {"ids": list_array(pa.array(ids, pa.int32()), counts)}
                if check:
                    back, size = decoder.decode(ids, counts)
                    want = raw
                    wide = np.diff(at)
                    if b"\xe2\x96\x81" in raw.tobytes():
                        want, edges = prefixed(raw, at)
                        want, wide = want[np.setdiff1d(np.arange(len(want)), edges[:-1][np.diff(edges) > 0])], np.diff(edges) - (np.diff(edges) > 0)
                    same = size == wide
                    if same.all() and len(back) == len(want):
                        off = np.flatnonzero(back != want)
                        same[np.searchsorted(np.cumsum(wide), off, side="right")] = False
                    else:
                        edges, own = np.concatenate([[0], np.cumsum(wide)]), np.concatenate([[0], np.cumsum(size)])
                        same = np.array([back[own[k] : own[k + 1]].tobytes() == want[edges[k] : edges[k + 1]].tobytes() for k in range(hi - lo)], dtype=bool)
                    new["round_trip"] = pa.array(same)
                yield with_columns(batch.slice(lo, hi - lo), carry, new)

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("round_trip", T.BooleanType())] * check
    return docs.select(*dict.fromkeys([*carry, text_col])).mapInArrow(run, T.StructType([*without(docs.select(*carry).schema, made).fields, *fields]))


def decode(tokens: DataFrame, model_path: str, *, ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns if None) plus text, decoded from the ids; null stays null, bytes that are no UTF-8 become U+FFFD."""
    carry = [c for c in (tokens.columns if carry is None else carry) if c != "text"]
    shared = tokens.sparkSession.sparkContext.broadcast(Pieces.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = []
            for row in batch.column(batch.schema.get_field_index(ids_col)):
                if row.is_valid:
                    ids = row.values.to_numpy(zero_copy_only=False).astype(np.int64)
                    texts.append(decoder.decode(ids, np.array([len(ids)]))[0].tobytes().decode(errors="replace"))
                else:
                    texts.append(None)
            yield with_columns(batch, carry, {"text": pa.array(texts, pa.string())})

    schema = T.StructType([*without(tokens.select(*carry).schema, ("text",)).fields, T.StructField("text", T.StringType())])
    return tokens.select(*dict.fromkeys([*carry, ids_col])).mapInArrow(run, schema)
