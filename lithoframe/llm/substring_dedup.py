"""Removal of long repeated byte strings, by content-defined phrases of the text.

A byte is removed if a string of ``length`` bytes covers it that also starts
anywhere else. Positions are not compared one by one; texts are parsed first:

* Triggers. The rolling hash of 16 bytes gives each position p the place a(p) of the
  least hash among the next ``SPAN`` positions (the leftmost of equals). a(p) depends
  only on bytes of the string that starts at p, so equal strings have equal triggers.
  Runs of positions with the same trigger are the phrases of the parse.
* Dictionary. A phrase's word is the bytes from its first position to the end of the
  string that starts at its last position. A word that occurs twice in the corpus
  repeats all strings that start in the phrase: this settles copied text, phrase by
  phrase, without looking inside.
* Order. Two equal strings in different words share the bytes behind their trigger, so
  only words that share these (a class) go on, one place of each. Their phrases are cut
  into bands of ``BAND`` positions, counted from the trigger. All strings of a band
  share its core, so a band whose core occurs once repeats nothing; a band whose whole
  stretch, from its first position to the end of its last string, occurs twice is
  repeated throughout. Only in bands between the two, which lie at the ends of repeated
  passages, are strings at single positions compared.

The method's suffix arrays of dictionary and parse are not formed. Equality up to
``length`` bytes needs no order beyond it, and such arrays hold a row for each byte of
the dictionary, most of which repeats nothing; classes and bands give the same intervals
with a few rows for each end of a repeated passage. Stretches are compared by 61-bit
hashes (see ``vectext.span_hashes``).

Texts are whole UTF-8 bytes, a null is empty, and nothing crosses documents. Equal
texts are parsed once and count as repeated. Long texts are parsed in chunks, which
only adds phrases. Columns of the input that clash with the output's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import counted, materialize, release, small, without
from .vectext import POWERS, ROLLING, list_array, mix64, slices, stretch_hashes

GRAM, SPAN, BAND = 16, 256, 32
#: Most positions of a long text that are parsed at a time.
CHUNK = 1 << 19
#: Rows of ids that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 28) - 1)


def triggers(raw: np.ndarray) -> np.ndarray:
    """For each position the place of its trigger, as if the text went on forever."""
    m = len(raw) - GRAM + 1
    POWERS.need(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(ROLLING[raw] * POWERS.up[: len(raw)], out=sums[1:])
    least = (sums[GRAM:] - sums[:m]) * POWERS.down[:m] * _SPREAD
    least = (least & ~_PLACE) | np.arange(m, dtype=np.uint64)
    width = 1
    while width < SPAN:  # minima over runs of 2, 4, ... positions
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return (least & _PLACE).astype(np.int64)


def parse(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first and last position and trigger of all phrases of the rows (positions within ``raw``), and the hashes of their words and of the bytes behind their triggers."""
    count = np.maximum(np.diff(at) - length + 1, 0)  # positions of each row where a string starts
    if not count.any():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    row = np.repeat(np.arange(len(count)), count)
    p = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    place = triggers(raw)[p]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    first, last, t = p[new], p[np.append(new[1:], len(p)) - 1], place[new]
    return row[new], first, last, t, stretch_hashes(raw, first, last + length), stretch_hashes(raw, t, t + length - SPAN + 1)


def _parse_all(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in slices(batch.column(2)):
                th, copies = (batch.column(k).slice(lo, hi - lo).to_numpy() for k in (0, 1))
                # a text longer than a slice comes alone and is parsed in chunks
                starts = range(0, max(1, len(raw) - length + 1), CHUNK) if hi - lo == 1 else (0,)
                for c in starts:
                    part, edges = (raw[c : c + CHUNK + length - 1], np.array([0, min(CHUNK + length - 1, len(raw) - c)])) if hi - lo == 1 else (raw, at)
                    row, first, last, t, word, behind = parse(part, edges, length)
                    if len(row):
                        base = edges[:-1][row] - c
                        ints = [pa.array((x - base).astype(np.int32)) for x in (first, last, t)]
                        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(behind.view(np.int64)), pa.array(th[row]), *ints, pa.array(copies[row].astype(np.int32))], names=["word", "behind", "th", "lo", "hi", "t", "n"])

    return run


def _bands(length: int):
    """The bands of each phrase, given its bytes: hashes of core and whole stretch (null if the phrase holds a part of the band only), place, times it counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in slices(batch.column(5)):
                th, lo, hi, t, n = (batch.column(k).slice(a, b - a).to_numpy().astype(np.int64) for k in range(5))
                near, far = t - hi, t - lo  # distances from the trigger
                k = far // BAND - near // BAND + 1
                row = np.repeat(np.arange(b - a), k)
                band = np.repeat(near // BAND - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                base = at[:-1][row] - lo[row]
                top = t[row] - BAND * band  # the band's last position, if the phrase holds it
                core = stretch_hashes(raw, base + top, base + top + length - BAND + 1)
                full = (top <= hi[row]) & (top - BAND + 1 >= lo[row])
                whole = np.zeros(len(row), dtype=np.uint64)
                whole[full] = stretch_hashes(raw, (base + top - BAND + 1)[full], (base + top + length)[full])
                tag = band.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(mix64(core ^ mix64(tag)).view(np.int64)), pa.array(mix64(whole ^ mix64(tag)).view(np.int64), mask=~full), pa.array(th[row]), pa.array(lo[row].astype(np.int32)),
                    pa.array(np.maximum(top - BAND + 1, lo[row]).astype(np.int32)), pa.array(np.minimum(top, hi[row]).astype(np.int32)), pa.array(n[row].astype(np.int32)),
                ], names=["core", "whole", "th", "lo", "a", "b", "n"])

    return run


def _strings(length: int):
    """A row for each position of the bands listed: hash of the string there, text, position, times it counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, raw, at in slices(batch.column(3)):
                th, lo, n = (batch.column(k).slice(x, y - x).to_numpy().astype(np.int64) for k in range(3))
                bands = batch.column(4).slice(x, y - x)
                owner = np.repeat(np.arange(y - x), np.diff(bands.offsets.to_numpy()))
                a, b = (bands.flatten().field(c).to_numpy().astype(np.int64) for c in ("a", "b"))
                k = b - a + 1
                row, p = np.repeat(owner, k), np.repeat(a - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                start = at[:-1][row] + p - lo[row]
                yield pa.RecordBatch.from_arrays([pa.array(stretch_hashes(raw, start, start + length).view(np.int64)), pa.array(th[row]), pa.array(p.astype(np.int32)), pa.array(n[row].astype(np.int32))], names=["h", "th", "p", "n"])

    return run


def _cut(length: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, flat, kept = [], [], []
            texts, marks = (batch.column(batch.schema.get_field_index(n)) for n in ("__text", "__marks"))
            for text, own in zip(texts, marks, strict=True):
                raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                edge = np.zeros(len(raw) + 2, dtype=np.int32)
                np.add.at(edge, own.values.field("a").to_numpy(), 1)
                np.add.at(edge, own.values.field("b").to_numpy() + length, -1)
                gone = np.cumsum(edge)[: len(raw)] > 0
                jump = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                counts.append(len(jump) // 2)
                flat.append(jump.reshape(-1, 2))
                kept.append(raw[~gone].tobytes())
            both = np.concatenate(flat) if flat else np.zeros((0, 2), np.int64)
            spans = pa.StructArray.from_arrays([pa.array(both[:, 0].astype(np.int32)), pa.array(both[:, 1].astype(np.int32))], names=["start", "end"])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in carry], list_array(spans, np.array(counts, dtype=np.int64)), pa.array(kept, pa.binary())], names=[*carry, "removed", "kept"])

    return run


def _twice(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that count twice or more."""
    return rows.groupBy(key).agg(F.sum("n").alias("__n")).filter("__n > 1").select(key)


def repeated_starts(long: DataFrame, copied: DataFrame, length: int) -> DataFrame:
    """th, marks: runs (a, b) of positions at which a repeated string starts, for the texts (th, text) that have any and aren't ``copied`` whole. Materialised."""
    marked = small(copied.withColumn("copied", F.lit(True)), BROADCAST_ROWS, counted(copied))
    once = long.join(marked, "th", "left")
    single = once.filter("copied is null").select("th", F.lit(1).alias("n"), "text")
    several = once.filter("copied").groupBy("th").agg(F.first("text").alias("text")).select("th", F.lit(2).alias("n"), "text")
    schema = "word bigint, behind bigint, th bigint, lo int, hi int, t int, n int"
    phrases = materialize(single.mapInArrow(_parse_all(length), schema).union(several.mapInArrow(_parse_all(length), schema)), "phrases")
    words = phrases.groupBy("word").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("behind", "th", "lo", "hi", "t")])
    words = materialize(words, "words")
    # phrases whose word is repeated
    whole = phrases.filter("n = 1").join(small(materialize(words.filter("n > 1").select("word"), "repeated"), BROADCAST_ROWS), "word", "left_semi").select("th", F.col("lo").alias("a"), F.col("hi").alias("b"))
    # one place of each word in a class of several words, with its bytes
    classes = words.groupBy("behind").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("behind")
    some = words.join(small(materialize(classes, "classes"), BROADCAST_ROWS), "behind", "left_semi").groupBy("th").agg(F.collect_list(F.struct("lo", "hi", "t", F.least("n", F.lit(2)).cast("int").alias("n"))).alias("words"))
    some = materialize(some, "some")
    texts = long.join(small(some.select("th"), BROADCAST_ROWS, counted(some)), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    each = texts.join(some, "th").select("th", "text", F.explode("words").alias("w")).select("th", "w.*", F.expr(f"substring(text, w.lo + 1, w.hi - w.lo + {length})").alias("bytes"))
    contexts = materialize(each.select("th", "lo", "hi", "t", "n", "bytes"), "contexts")
    bands = materialize(contexts.mapInArrow(_bands(length), "core bigint, whole bigint, th bigint, lo int, a int, b int, n int"), "bands")
    shared = materialize(bands.join(_twice(bands, "core"), "core", "left_semi"), "shared")
    full = materialize(_twice(shared.filter("whole is not null"), "whole"), "full")
    settled = shared.join(small(full.withColumn("full", F.lit(True)), BROADCAST_ROWS, counted(full)), "whole", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    settled = materialize(settled, "settled")
    # strings are compared where a core has a band that isn't settled; settled ones are their partners
    openings = settled.filter("not full and n = 1").select("core").distinct()
    listed = settled.join(openings, "core", "left_semi").groupBy("th", "lo").agg(F.collect_list(F.struct("a", "b")).alias("bands"))
    strings = contexts.join(listed, ["th", "lo"]).select("th", "lo", "n", "bytes", "bands").mapInArrow(_strings(length), "h bigint, th bigint, p int, n int")
    strings = materialize(strings, "strings")
    places = strings.filter("n = 1").join(_twice(strings, "h"), "h", "left_semi").select("th", F.col("p").alias("a"), F.col("p").alias("b"))
    runs = whole.unionByName(settled.filter("full and n = 1").select("th", "a", "b")).unionByName(places)
    marks = materialize(runs.groupBy("th").agg(F.collect_list(F.struct("a", "b")).alias("marks")), "marks")
    release([phrases, words, some, contexts, bands, shared, full, settled, strings])
    return marks


def remove_repeats(docs: DataFrame, length: int = 400, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns if None) plus removed (array of byte spans, end exclusive) and kept (binary: the bytes left)."""
    if length < SPAN + GRAM + BAND:
        raise ValueError(f"length is at least {SPAN + GRAM + BAND}")
    made = ("removed", "kept")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    own = docs.select(*[F.col(f"`{c}`") for c in carry], F.xxhash64(text).alias("__th"), text.alias("__text"))
    long = own.filter(F.octet_length("__text") >= length).select(F.col("__th").alias("th"), F.col("__text").alias("text"))
    # equal texts are parsed once; everything in them is repeated
    copied = materialize(long.groupBy("th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("th"), "copied")
    marks = repeated_starts(long, copied, length)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = T.StructType([*without(own.select(*carry).schema, made).fields, T.StructField("removed", spans), T.StructField("kept", T.BinaryType())])
    known = materialize(marks.select(F.col("th").alias("__th"), F.lit(False).alias("__all")).union(copied.select("th", F.lit(True))), "known")
    kinds = own.join(small(known, BROADCAST_ROWS), "__th", "left")
    gone = F.array(F.struct(F.lit(0).alias("start"), F.octet_length("__text").alias("end")))
    plain = kinds.filter("__all is null or __all").select(
        *carry, F.when(F.col("__all"), gone).otherwise(F.array().cast(spans)).cast(spans).alias("removed"), F.when(F.col("__all"), F.lit("").cast("binary")).otherwise(F.col("__text")).alias("kept")
    )
    cut = kinds.filter("not __all").join(marks.select(F.col("th").alias("__th"), F.col("marks").alias("__marks")), "__th").select(*carry, "__text", "__marks").mapInArrow(_cut(length, carry), out)
    return plain.unionByName(cut)
