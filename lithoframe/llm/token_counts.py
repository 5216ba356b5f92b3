"""Token counts of a SentencePiece BPE model, without making identifiers.

The characters of a unit of text are the first symbols. A heap holds the adjacent
pairs that are pieces, by rank; the pair of lowest rank (the leftmost of equals) is
popped and merged in a linked list, and its new neighbours are pushed, until no
pair is left. A unit's count is its symbols less the merges; a character that is no
piece counts its UTF-8 bytes. Units repeat, so each task keeps counts of units that
it has seen, by their bytes, in a table of bounded size; inside a slice, units of equal
hash and length are counted once after their bytes were compared.

Null and empty texts count 0. Repeated rows, very long texts and ties need nothing
special: rows are counted each for itself, and a unit of n characters costs n log n.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import Pieces, prefixed, units
from .shared import without
from .vectext import same_spans, slices, with_columns

#: Units whose counts a task keeps, and the longest of them in bytes.
KEPT_UNITS, KEPT_BYTES = 600_000, 256


def ranks_of(pieces: Pieces) -> dict[str, int]:
    order = sorted(range(len(pieces.text)), key=lambda k: -pieces.score[k])
    return {pieces.text[k]: r for r, k in enumerate(order)}


def count_unit(unit: str, rank: dict[str, int]) -> int:
    """The number of tokens of one unit."""
    n, get = len(unit), rank.get
    total = n
    for c in unit:
        if c not in rank:
            total += len(c.encode()) - 1
    if n < 2:
        return total
    symbol: list = list(unit)
    heap = [r << 32 | i for i in range(n - 1) if (r := get(unit[i : i + 2])) is not None]
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        j = after[i]
        if symbol[i] is None or j >= n or get(both := symbol[i] + symbol[j]) != top >> 32:
            continue  # one of the two was merged meanwhile
        symbol[i], symbol[j] = both, None
        total -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(both + symbol[k])) is not None:
                heappush(heap, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := get(symbol[h] + both)) is not None:
            heappush(heap, r << 32 | h)
    return total


def token_counts(docs: DataFrame, model_path: str, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns if None) plus n_bytes and n_tokens."""
    made = ("n_bytes", "n_tokens")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    pieces = Pieces.load(model_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks_of(pieces), pieces.alone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, alone = shared.value
        known: dict[bytes, int] = {}
        for batch in batches:
            n_bytes, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, raw, at in slices(batch.column(batch.schema.get_field_index(text_col))):
                n_bytes.append(np.diff(at))
                raw, at = prefixed(raw, at)
                starts, ends, hashes, rows = units(raw, at, alone)
                _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
                alike = (ends - starts == (ends - starts)[one][which]).all() and same_spans(raw, starts, ends, starts[one][which])
                if not alike:  # two units with one hash: each is looked up for itself
                    one, which = np.arange(len(starts)), np.arange(len(starts))
                data, counts = raw.tobytes(), []
                for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True):
                    unit = data[s:e]
                    c = known.get(unit)
                    if c is None:
                        c = count_unit(unit.decode(), rank)
                        if e - s <= KEPT_BYTES:
                            known[unit] = c
                    counts.append(c)
                total = np.zeros(len(hashes) + 1, dtype=np.int64)
                np.cumsum(np.array(counts, dtype=np.int64)[which], out=total[1:])
                n_tokens.append(np.diff(total[rows]))
                if len(known) > KEPT_UNITS:
                    known.clear()
            yield with_columns(batch, carry, {"n_bytes": pa.array(np.concatenate(n_bytes)), "n_tokens": pa.array(np.concatenate(n_tokens))})

    schema = T.StructType([*without(docs.select(*carry).schema, made).fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(*dict.fromkeys([*carry, text_col])).mapInArrow(run, schema)
