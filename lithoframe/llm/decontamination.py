"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Every benchmark item gives windows of ``size`` consecutive words (an item of
fewer words is one window). A document holds a window only if it holds the
window's rarest word, so one prefix token per window is enough: words are ordered
by their frequency over all documents, the rarest word of each window is its
prefix token, and only documents' words that equal a prefix token become
candidates. A candidate must leave room for the window on both sides (length and
position); it is looked up by one hash of all its words, and the words of what is found
are compared as bytes.

At most ``max_windows`` distinct windows are broadcast as an index. Of more, prefix tokens
and windows are joined by shuffles, with the same results and two passes over the
documents whatever the benchmark's size: words are counted, then the places of prefix
tokens leave a candidate each, with the words that would be the window, if two bit filters
of fixed size (``FILTER_BITS``; prefix tokens and whole windows, both without false
negatives) let it through. Candidates meet windows by their words, not by hashes. A text is
joined once, however many documents have it. A window without a word of the corpus occurs
nowhere and drops out before.

Nulls and empty texts have no words: no window, no hit. Repeated rows are judged
each for itself; an item id that repeats is one item. An item without an id marks words
as hit, but is not listed among the items. Input columns that clash with the output's are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import counted, materialize, release, small, without
from .vectext import ALNUM, LOWER, list_array, mix64, same_spans, slices, span_hashes, spans, with_columns, words

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a filter, as a power of two: 16 MB are broadcast.
FILTER_BITS = 27
#: Rows of (word, count) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Parts over which the documents of one text are dealt.
SALTS = 16
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def item_windows(benchmark: DataFrame, size: int, text_col: str, id_col: str) -> DataFrame:
    """One row per item and distinct window: item_id string, w array of word hashes, t its words (A-Z lower-cased), joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in slices(batch.column(1)):
                starts, ends, rows = spans(raw, at, ALNUM)
                h, low = span_hashes(raw, starts, ends), LOWER[raw].tobytes()
                ids, grams, texts = [], [], []
                for k, item in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    own = h[rows[k] : rows[k + 1]].view(np.int64)
                    if len(own):
                        grams += [own] if len(own) <= size else list(np.lib.stride_tricks.sliding_window_view(own, size))
                        named = [low[s:e].decode() for s, e in zip(starts[rows[k] : rows[k + 1]].tolist(), ends[rows[k] : rows[k + 1]].tolist(), strict=True)]
                        texts += [" ".join(named[i : i + size]) for i in range(len(grams) - len(ids))]
                        ids += [item] * (len(grams) - len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([g.tolist() for g in grams], pa.list_(pa.int64())), pa.array(texts, pa.string())], names=["item_id", "w", "t"])

    return benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "item_id string, w array<bigint>, t string").distinct()


def word_frequencies(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> DataFrame:
    """word, n: how often each word of a bounded vocabulary occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen = np.zeros(len(known), dtype=np.int64)
        maybe = _bitmap(known.view(np.uint64))
        for batch in batches:
            for _, _, raw, at in slices(batch.column(0)):
                h, _ = words(raw, at, ALNUM)
                h = h[maybe[h >> np.uint64(44)]].view(np.int64)
                k = np.searchsorted(known, h)
                k[k == len(known)] = 0
                seen += np.bincount(k[known[k] == h], minlength=len(known))
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(known[full]), pa.array(seen[full])], names=["word", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, dtype=bool)
    out[hashes >> np.uint64(44)] = True
    return out


def _joint(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of words given column by column."""
    out = mix64(columns[0] + np.uint64(len(columns)))
    for c in columns[1:]:
        out = mix64(out) + c * _ODD
    return mix64(out)


class WindowIndex:
    """Distinct windows by their prefix token.

    Windows of one length whose prefix token stands at one place form a group. A
    document's word that is a prefix token of a group fixes where such a window would
    start; that stretch is looked up among the group's windows by one hash of all its
    words, and what is found is compared word by word, as bytes. A word thus costs at
    most one look-up per group, however many windows share their prefix token.
    """

    def __init__(self, windows: list[list[int]], texts: list[str], items: list[list[str]], rarity: dict[int, int], size: int):
        full = np.zeros((len(windows), size), dtype=np.int64)
        self.length = np.array([len(w) for w in windows], dtype=np.int64)
        for k, w in enumerate(windows):
            full[k, : len(w)] = w
        offset = np.array([min(range(len(w)), key=lambda j, w=w: (rarity.get(w[j], 0), w[j], j)) for w in windows], dtype=np.int64)
        token = full[np.arange(len(windows)), offset]
        self.items = items
        self.tokens = np.unique(token)
        self.maybe = _bitmap(self.tokens.view(np.uint64))
        self.groups = []
        for n, j in np.unique(np.stack([self.length, offset], axis=1), axis=0).tolist() if len(windows) else ():
            own = np.flatnonzero((self.length == n) & (offset == j))
            keys = _joint([full[own, c].view(np.uint64) for c in range(n)])
            order = np.argsort(keys, kind="stable")
            self.groups.append((n, j, np.isin(self.tokens, token[own]), keys[order], own[order], int(np.unique(keys, return_counts=True)[1].max())))
        # the words of all windows as bytes, laid end to end
        words = [w.encode() for t in texts for w in t.split(" ")]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.bytes, self.word_start = np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(sizes) - sizes
        self.word_size, self.first_word = sizes, np.cumsum(self.length) - self.length

    def find(self, h: np.ndarray, rows: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window number, first word and row of every occurrence among the rows' words; ``low``: lower-cased bytes, starts and ends: of the words."""
        at = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        signed = h.view(np.int64)
        k = np.searchsorted(self.tokens, signed[at])
        k[k == len(self.tokens)] = 0
        same = self.tokens[k] == signed[at]
        at, k = at[same], k[same]
        row = np.searchsorted(rows, at, side="right") - 1
        out: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        for n, j, tokens, keys, window, most in self.groups:
            own = tokens[k]
            start, r = at[own] - j, row[own]
            fits = (start >= rows[r]) & (start + n <= rows[r + 1])
            start, r = start[fits], r[fits]
            if not len(start):
                continue
            key = _joint([h[start + c] for c in range(n)])
            place = np.searchsorted(keys, key)
            for d in range(most):  # more than once only where two windows have one hash
                p = np.minimum(place + d, len(keys) - 1)
                hit = (place + d < len(keys)) & (keys[p] == key)
                w, s, q = window[p[hit]], start[hit], r[hit]
                if len(w):
                    equal = self._equal(w, s, n, low, starts, ends)
                    out.append((w[equal], s[equal], q[equal]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _equal(self, window: np.ndarray, start: np.ndarray, n: int, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the words from ``start`` on are the window's, by their bytes."""
        step = np.arange(n)
        mine, theirs = (start[:, None] + step).ravel(), (self.first_word[window][:, None] + step).ravel()
        s, size, t = starts[mine], ends[mine] - starts[mine], self.word_start[theirs]
        fine = size == self.word_size[theirs]
        if fine.all() and same_spans(np.concatenate([low, self.bytes]), s, s + size, t + len(low)):
            return np.ones(len(window), dtype=bool)
        for x in np.flatnonzero(fine).tolist():
            fine[x] = np.array_equal(low[s[x] : s[x] + size[x]], self.bytes[t[x] : t[x] + size[x]])
        return fine.reshape(-1, n).all(axis=1)


class BitFilter:
    """The hashes of a column as set bits, made by tasks: the driver gets 2 ** bits / 64 words at most, whatever the table's size."""

    def __init__(self, hashes: DataFrame, column: str, bits: int):
        at = hashes.select(F.expr(f"shiftrightunsigned(`{column}`, {64 - bits})").alias("at"))
        made = at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("set")).toArrow()
        self.bits, self.words = bits, np.zeros(1 << (bits - 6), dtype=np.int64)
        self.words[made.column("word").to_numpy()] = made.column("set").to_numpy()

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.bits)).view(np.int64)
        return (self.words[at >> 6] >> (at & 63)) & 1 == 1


def _token_keys(h: np.ndarray, n: int, j: int) -> np.ndarray:
    """One hash for a prefix token that stands at place j of a window of n words."""
    return mix64(h ^ mix64(np.array([n << 32 | j], dtype=np.uint64)))


def _word_counts(docs: DataFrame, known: BitFilter, text_col: str) -> DataFrame:
    """word, n: how often the words that pass the filter occur in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, at in slices(batch.column(0)):
                h, _ = words(raw, at, ALNUM)
                word, n = np.unique(h[shared.value.has(h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _window_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From w and j, the place of the prefix token: hash of the token at its place, hash of all words, n, j."""
    for batch in batches:
        column, j = batch.column(0), batch.column(1).to_numpy().astype(np.int64)
        length, flat = np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy().view(np.uint64)
        first = np.cumsum(length) - length
        for n, at in np.unique(np.stack([length, j], axis=1), axis=0).tolist() if len(j) else ():
            own = first[(length == n) & (j == at)]
            token, whole = _token_keys(flat[own + at], n, at), _joint([flat[own + c] for c in range(n)])
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(np.full(len(own), n, np.int32)), pa.array(np.full(len(own), at, np.int32))], names=["token", "whole", "n", "j"])


def _candidates(tokens, wholes, groups: list[tuple[int, int]]):
    """Of texts and their keys: key, first word, end and the words themselves of each stretch that may be a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in slices(batch.column(1)):
                starts, ends, rows = spans(raw, at, ALNUM)
                h = span_hashes(raw, starts, ends)
                low = LOWER[raw].tobytes()
                key = batch.column(0).slice(lo, hi - lo)
                for n, j in groups if len(h) else ():
                    p = np.flatnonzero(tokens.value.has(_token_keys(h, n, j)))
                    r, start = np.searchsorted(rows, p, side="right") - 1, p - j
                    fits = (start >= rows[r]) & (start + n <= rows[r + 1])
                    start, r = start[fits], r[fits]
                    if len(start):
                        found = wholes.value.has(_joint([h[start + c] for c in range(n)]))
                        start, r = start[found], r[found]
                    texts = [b" ".join(low[a:b] for a, b in zip(starts[s : s + n].tolist(), ends[s : s + n].tolist(), strict=True)).decode() for s in start.tolist()]
                    place = (start - rows[r]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(r)), pa.array(place), pa.array(place + np.int32(n)), pa.array(texts, pa.string())], names=["__key", "start", "end", "t"])

    return run


def _shuffled_hits(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """__key (sha-256 of a text), hit_spans, items of all texts that hold a window. Materialised."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    vocabulary = materialize(windows.select(F.explode("w").alias("word")).distinct(), "vocabulary")
    counts = _word_counts(docs, BitFilter(vocabulary, "word", FILTER_BITS), text_col)
    counts = materialize(counts.join(small(vocabulary, BROADCAST_ROWS), "word", "left_semi"), "counts")
    # a word that no document has is not in counts: it is the rarest, and its windows drop out
    each = windows.select("t", F.posexplode("w").alias("j", "word")).join(small(counts, BROADCAST_ROWS), "word", "left")
    prefix = each.groupBy("t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "j")).alias("p")).filter("p.n > 0").select("t", "p.j")
    keys = materialize(windows.select("t", "w").join(prefix, "t").select("w", "j").mapInArrow(_window_keys, "token bigint, whole bigint, n int, j int"), "keys")
    groups = sorted(tuple(r) for r in keys.select("n", "j").distinct().collect())  # at most size * size rows
    find = _candidates(share(BitFilter(keys, "token", FILTER_BITS)), share(BitFilter(keys, "whole", FILTER_BITS)), groups)
    text = F.col(text_col).cast("string")
    found = docs.select(F.sha2(text, 256).alias("__key"), text.alias("t")).filter("t is not null").mapInArrow(find, "__key string, start int, end int, t string").distinct()
    found = materialize(found.join(windows.select("t"), "t", "left_semi"), "found")
    at = found.groupBy("__key").agg(F.collect_set(F.struct("start", "end")).alias("hit_spans"))
    # items of each text once, however often it holds their windows
    names = found.select("__key", "t").distinct().join(windows.select("t", F.explode("items").alias("item")), "t").groupBy("__key").agg(F.collect_set("item").alias("items"))
    hits = materialize(at.join(names, "__key", "left"), "hits")
    release([vocabulary, counts, keys, found])
    return hits


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, *, text_col: str = "text", item_text: str = "text", item_id: str = "item_id", carry: list[str] | None = None, max_windows: int = 200_000) -> DataFrame:
    """``carry`` (all columns if None) plus n_words, hit_spans (word positions, end exclusive, merged) and items (ids, sorted as strings)."""
    spark = docs.sparkSession
    made = ("n_words", "hit_spans", "items")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    windows = item_windows(benchmark, size, item_text, item_id).groupBy("w", "t").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    windows = materialize(windows, "windows")
    own = docs.select(*dict.fromkeys([*carry, text_col]))
    schema = T.StructType([*without(own.select(*carry).schema, made).fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    if counted(windows) > max_windows:
        hits = _shuffled_hits(docs, windows, text_col).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        release([windows])
        # a salt of any kind will do: every part has all hits
        keyed = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text_col])], F.sha2(F.col(text_col).cast("string"), 256).alias("__key"), (F.spark_partition_id() % SALTS).alias("__salt"))
        joint = keyed.join(hits, ["__key", "__salt"], "left").select(*own.columns, F.coalesce("hit_spans", F.array().cast(SPANS)).alias("hit_spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        return joint.mapInArrow(_pass(None, text_col, carry, True), schema)
    rows = windows.collect()  # at most max_windows rows
    vocabulary = np.unique(np.array([x for r in rows for x in r.w], dtype=np.int64))
    rarity = {r.word: r.n for r in word_frequencies(docs, vocabulary, text_col).collect()} if len(vocabulary) else {}
    index = spark.sparkContext.broadcast(WindowIndex([r.w for r in rows], [r.t for r in rows], [list(r["items"]) for r in rows], rarity, size)) if rows else None
    release([windows])
    return own.mapInArrow(_pass(index, text_col, carry, False), schema)


def _pass(index, text_col: str, kept: list[str], more: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value if index is not None else None
        for batch in batches:
            n_words, n_spans, flat, n_items, names = [], [], [], [], []
            column = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi, raw, at in slices(column):
                starts, ends, rows = spans(raw, at, ALNUM)
                h = span_hashes(raw, starts, ends)
                n_words.append(np.diff(rows))
                window, start, row = own.find(h, rows, LOWER[raw], starts, ends) if own is not None and len(h) else (np.zeros(0, np.int64),) * 3
                end = start + own.length[window] if len(window) else start
                if more:  # what a join found
                    had = [(rows[k] + s["start"], rows[k] + s["end"], k) for k, ss in enumerate(batch.column("hit_spans").slice(lo, hi - lo).to_pylist()) for s in ss]
                    if had:
                        s0, e0, r0 = np.array(had, dtype=np.int64).T
                        start, end, row_all = np.append(start, s0), np.append(end, e0), np.append(row, r0)
                    else:
                        row_all = row
                else:
                    row_all = row
                edge = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, end, -1)
                hit = np.zeros(len(h) + 2, dtype=bool)
                hit[1:-1] = np.cumsum(edge)[: len(h)] > 0
                # a run of hits ends with its row
                jump = np.flatnonzero(hit[1:] != hit[:-1])
                cuts = rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] < len(h))]
                cuts = np.unique(cuts[hit[cuts] & hit[cuts + 1]]) if len(cuts) else cuts
                marks = np.sort(np.concatenate([jump, cuts, cuts]))
                s, e = marks[::2], marks[1::2]
                r = np.searchsorted(rows, s, side="right") - 1
                n_spans.append(np.bincount(r, minlength=hi - lo))
                flat.append(np.stack([s - rows[r], e - rows[r]], axis=1))
                found: list[set] = [set() for _ in range(hi - lo)]
                for k, w in np.unique(np.stack([row, window], axis=1), axis=0).tolist() if len(row) else ():
                    found[k].update(own.items[w])
                if more:
                    for k, x in enumerate(batch.column("items").slice(lo, hi - lo).to_pylist()):
                        found[k].update(x)
                n_items += [len(x) for x in found]
                names += [y for x in found for y in sorted(x)]
                del row_all
            both = np.concatenate(flat) if flat else np.zeros((0, 2), np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(both[:, 0].astype(np.int32)), pa.array(both[:, 1].astype(np.int32))], names=["start", "end"])
            yield with_columns(batch, kept, {
                "n_words": pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64), pa.int64()),
                "hit_spans": list_array(pairs, np.concatenate(n_spans) if n_spans else np.zeros(0, np.int64)),
                "items": list_array(pa.array(names, pa.string()), np.array(n_items, dtype=np.int64)),
            })

    return run
