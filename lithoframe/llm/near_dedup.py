"""MinHash near-duplicate components by a multi-index Hamming join.

A text's set holds the distinct shingles of ``n`` words, as hashes. Texts with the
same set are one class at once, so exact copies cost one grouped row. Each class has
a signature of 60 b-bit MinHash symbols (``bits``: 8, or 16 for corpora of 10**9
classes and more, where 8 make too many classes meet by chance), split into 12 chunks
of 5. By the pigeonhole principle two signatures that differ in at most
``2 * 12 - 1`` symbols have a chunk with at most one differing symbol; every chunk
is therefore indexed under each of its 5 allowed errors (the chunk without one
symbol). All pairs under that distance meet in a bucket, and nothing depends on
how large a bucket is:

1. Each class is compared with the least member of the bucket that it shares most
   often. Confirmed links give first components; a large group of near copies becomes
   one component here.
2. In buckets that still hold several components, the members outside the largest
   one are compared with a few members of it, which joins most of the rest; how
   many buckets two components share makes no more pairs.
3. Buckets that hold several components even then are finished exactly: small ones
   by a self join whose pairs go on only if their signatures are near, others in
   blocks, in which only members outside the largest component visit all blocks. In a
   block, signatures are compared first and full sets only where they are near; a block
   gives only as many links as join its components.
   Pairs inside a component are never listed.

Candidates are confirmed on the full sets, made once from the whole texts of the
classes that share a bucket. A pair exactly at the similarity 0.8 shares no bucket with
a chance of about 1e-7; words, sets and classes are compared by hashes.

Nulls, empty texts and texts without words have an empty set and stay alone.
Repeated rows and repeated ids keep a row each. A null id is never a component's
name unless all ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, forests
from .shared import counted, materialize, release, small
from .vectext import NON_SPACE, gram_hashes, mix64, slices, words

CHUNKS, WIDTH = 12, 5
SYMBOLS = CHUNKS * WIDTH
#: Signatures further apart than this are not candidates: beyond it lie fewer than one in a million pairs of similarity 0.8.
FAR = 29
#: Rows of a block, and shingles of a block (8 bytes each) unless one set holds more.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Buckets of so many members or fewer are compared pair by pair.
FEW = 32
#: Members of a bucket's largest component that its strangers are compared with before all others.
PROBES = 8
#: Rows that may be broadcast (ids, or ids with a signature: 140 bytes at most); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a text of fewer words is one shingle."""
    h, rows = words(raw, at, NON_SPACE)
    grams = gram_hashes(h, n)
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if hi - lo >= n:
            g = np.sort(grams[lo : hi - n + 1])
            yield g[np.concatenate([[True], g[1:] != g[:-1]])]
        elif hi > lo:
            yield gram_hashes(h[lo:hi], hi - lo) ^ np.uint64(hi - lo)
        else:
            yield h[:0]


def fingerprint(own: np.ndarray) -> int:
    """A 64-bit hash of a whole set."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(own))], dtype=np.uint64)).view(np.int64)[0])


def signature(own: np.ndarray, bits: int = 8) -> np.ndarray:
    least = np.full(SYMBOLS, (1 << 64) - 1, dtype=np.uint64)
    for k in range(0, len(own), 4096):
        np.minimum(least, (own[k : k + 4096] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    return (mix64(least) & np.uint64((1 << bits) - 1)).astype(np.uint8 if bits == 8 else np.uint16)


def _symbols(column: pa.Array) -> np.ndarray:
    """A row of symbols for each signature; a symbol has as many bytes as the signatures' length tells."""
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    return flat.view(np.uint8 if len(flat) == SYMBOLS * len(column) else np.uint16).reshape(-1, SYMBOLS)


def _sketch(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, prints, sigs = [], [], []
            for _, _, raw, at in slices(batch.column(2)):
                for own in shingle_sets(raw, at, n):
                    size.append(len(own))
                    prints.append(fingerprint(own) if len(own) else None)
                    sigs.append(signature(own, bits).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(prints, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "th", "n", "fp", "sig"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk and allowed error: key (a hash of the symbols left, the chunk and the error), fp."""
    tag = mix64(np.arange(SYMBOLS, dtype=np.uint64)).reshape(CHUNKS, WIDTH)
    for batch in batches:
        if not len(batch):
            continue
        sig = _symbols(batch.column(1)).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        out = np.empty(sig.shape, dtype=np.uint64)
        for k in range(WIDTH):
            left = [j for j in range(WIDTH) if j != k]
            out[:, :, k] = mix64(tag[:, k] ^ sum(sig[:, :, j] << np.uint64(16 * i) for i, j in enumerate(left)))
        yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), SYMBOLS))], names=["key", "fp"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are near enough, of columns a, b, sig_a, sig_b."""
    for batch in batches:
        if len(batch):
            x, y = _symbols(batch.column(2)), _symbols(batch.column(3))
            batch = batch.filter(pa.array((x != y).sum(axis=1) <= FAR))
        yield batch.select(["a", "b"])


def _confirm(percent: int):
    """A forest of the pairs (a, b, s_a, s_b) that are similar enough: as many links as join what they join."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                k = np.searchsorted(y, x)
                k[k == len(y)] = 0
                both = int((y[k] == x).sum()) if len(x) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return lambda batches: forests(similar(batches))


def _block_links(percent: int):
    """Links between visitors and members of one block, found on the full sets: of the links between the same two components one is kept, and none that earlier ones imply."""

    def run(t: pa.Table) -> pa.Table:
        fp, comp, visitor, n = (t[c].to_numpy() for c in ("fp", "comp", "visitor", "n"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["s"]]
        signs = _symbols(t["sig"]) if len(t) else np.zeros((0, SYMBOLS), np.uint8)
        members = np.flatnonzero(~visitor)
        flat = np.concatenate([sets[k] for k in members.tolist()]) if len(members) else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(members)), n[members])[order]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        links = []
        for k in np.flatnonzero(visitor).tolist() if len(members) else ():
            mine = find(int(comp[k]))
            able = ((signs[members] != signs[k]).sum(axis=1) <= FAR) & (100 * np.minimum(n[members], n[k]) >= percent * np.maximum(n[members], n[k]))
            able &= np.fromiter((find(c) != mine for c in comp[members].tolist()), dtype=bool, count=len(members))
            if not able.any():
                continue
            lo, hi = np.searchsorted(flat, sets[k]), np.searchsorted(flat, sets[k], side="right")
            reps = hi - lo
            both = np.bincount(owner[np.repeat(lo - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())], minlength=len(members))
            near = members[able & (100 * both >= percent * (n[members] + n[k] - both))]
            for c, j in zip(*np.unique(comp[near], return_index=True), strict=True):
                x, y = find(int(c)), find(int(comp[k]))
                if x != y:
                    root[x] = y
                    links.append(sorted((int(fp[k]), int(fp[near[j]]))))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


class NearDuplicates:
    """One run of the join; ``percent`` is the least similarity in percent."""

    def __init__(self, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, bits: int = 8):
        if bits not in (8, 16):
            raise ValueError("bits is 8 or 16")
        self.n, self.percent, self.made = n, percent, []
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
        self.sketches = materialize(self.docs.mapInArrow(_sketch(n, bits), "doc_id bigint, th bigint, n bigint, fp bigint, sig binary"), "sketches")
        classes = self.sketches.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("th").alias("th"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.count(F.lit(1)).alias("rows"))
        self.classes = self.keep(classes, "classes")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(out := materialize(df, name))
        return out

    def buckets(self) -> DataFrame:
        """key, fp, center of all buckets with two members or more. Materialised."""
        keys = self.classes.select("fp", "sig").mapInArrow(_keys, "key bigint, fp bigint")
        shared = keys.groupBy("key").agg(F.min("fp").alias("center"), F.max("fp").alias("other")).filter("center <> other").select("key", "center")
        return self.keep(keys.join(shared, "key"), "buckets")

    def stars(self, buckets: DataFrame) -> DataFrame:
        """One pair (a, b) for each class that isn't the least of all its buckets: with the center of most of its buckets."""
        met = buckets.filter("fp <> center").groupBy("fp", "center").agg(F.count(F.lit(1)).alias("times"))
        best = met.groupBy("fp").agg(F.max(F.struct("times", "center")).alias("best"))
        return best.select(F.least("fp", "best.center").alias("a"), F.greatest("fp", "best.center").alias("b"))

    def sets(self, buckets: DataFrame) -> DataFrame:
        """fp, n, sig and s (the whole set) of all classes that share a bucket, from whole texts. Materialised."""
        met = self.keep(buckets.groupBy("fp").agg(F.count(F.lit(1)).alias("times")).select("fp"), "met")
        self.side = self.keep(self.classes.join(small(met, BROADCAST_ROWS), "fp", "left_semi").select("fp", "th", "n", "sig"), "side")
        own, n = small(self.side, BROADCAST_ROWS), self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps, sizes, signs = batch.column(1), batch.column(2), batch.column(3)
                for lo, hi, raw, at in slices(batch.column(0)):
                    sets = [x.tobytes() for x in shingle_sets(raw, at, n)]
                    yield pa.RecordBatch.from_arrays([fps.slice(lo, hi - lo), sizes.slice(lo, hi - lo), signs.slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["fp", "n", "sig", "s"])

        # one text of each class goes on, that of least hash; copies of it are dropped before their sets travel
        texts = self.docs.select("th", "text").join(own, "th").select("text", "fp", "n", "sig")
        return self.keep(texts.mapInArrow(run, "fp bigint, n bigint, sig binary, s binary").dropDuplicates(["fp"]), "sets")

    def close(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that size and signature allow."""
        side = self.side.select("fp", "n", "sig")
        x, y = (small(side.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")), BROADCAST_ROWS, counted(self.side)) for c in "ab")
        both = pairs.join(x, "a").join(y, "b").filter(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)")
        return both.select("a", "b", "sig_a", "sig_b").mapInArrow(_close, "a bigint, b bigint")

    def confirmed(self, close: DataFrame, sets: DataFrame) -> DataFrame:
        """Links that join all that the similar ones of the pairs (a, b) join, by their full sets."""
        x, y = (sets.select(F.col("fp").alias(c), F.col("s").alias(f"s_{c}")) for c in "ab")
        return close.join(x, "a").join(y, "b").select("a", "b", "s_a", "s_b").mapInArrow(_confirm(self.percent), "a bigint, b bigint")

    def mixed(self, buckets: DataFrame, roots: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components: key, fp, comp, count, and whether fp is a stranger to the bucket's largest component. Materialised."""
        sizes = small(self.keep(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sizes"), BROADCAST_ROWS)
        comp = roots.join(sizes, "root").select(F.col("node").alias("fp"), F.col("root").alias("comp"), "size")
        rows = buckets.select("key", "fp").join(small(comp, BROADCAST_ROWS, counted(roots)), "fp", "left").select("key", "fp", F.coalesce("comp", "fp").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
        stats = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("count"), F.max(F.struct("size", "comp")).alias("most")).filter("lo <> hi").select("key", "count", F.col("most.comp").alias("main"))
        return self.keep(rows.join(small(self.keep(stats, "stats"), BROADCAST_ROWS), "key").select("key", "fp", "comp", "count", "main", F.expr("comp <> main").alias("stranger")), "mixed")

    def probes(self, mixed: DataFrame) -> DataFrame:
        """Near pairs of each stranger with a few members of each largest component that it meets, in however many buckets, spread by salted hashes."""
        mates = [f"m{k}" for k in range(PROBES)]
        main = mixed.filter("not stranger").groupBy("key").agg(*[F.min(F.struct(F.xxhash64("fp", F.lit(k)), "fp")).alias(m) for k, m in enumerate(mates)])
        met = mixed.filter("stranger").select("key", "fp", "main").join(main, "key").groupBy("fp", "main").agg(*[F.min(m)["fp"].alias(m) for m in mates])
        pairs = met.select("fp", F.explode(F.array_distinct(F.array(*mates))).alias("mate"))
        return self.close(pairs.select(F.least("fp", "mate").alias("a"), F.greatest("fp", "mate").alias("b")).distinct())

    def few(self, mixed: DataFrame) -> DataFrame:
        """All near pairs of different components that share a small bucket, each once."""
        rows = mixed.filter(f"count <= {FEW}").join(small(self.side.select("fp", "n", "sig"), BROADCAST_ROWS, counted(self.side)), "fp")
        x, y = (rows.select("key", F.col("fp").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("comp", "n", "sig")]) for c in "ab")
        pairs = x.join(y, "key").filter(f"a < b and comp_a <> comp_b and 100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)")
        return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_close, "a bigint, b bigint").distinct()

    def many(self, mixed: DataFrame, sets: DataFrame) -> DataFrame:
        """Links that join the components of the larger buckets.

        Buckets with the same largest component are compared as one: whatever is a
        stranger to that component visits all that these buckets hold, block by block.
        """
        here = self.keep(mixed.filter(f"count > {FEW}").select("main", "fp", "comp", "stranger").distinct(), "here")
        if not counted(here):
            return mixed.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
        own = here.join(sets, "fp")
        blocks = lambda rows, size: F.ceil(F.greatest(rows / BLOCK, size / BLOCK_SHINGLES)).cast("bigint")
        size = own.groupBy("main").agg(
            blocks(F.count(F.lit(1)), F.sum("n")).alias("bm"), blocks(F.count_if("stranger"), F.sum(F.when(F.col("stranger"), F.col("n")).otherwise(0))).alias("bv")
        )
        own = own.join(small(self.keep(size.filter("bv > 0"), "blocks"), BROADCAST_ROWS), "main")
        cell, columns = F.xxhash64("fp"), ("main", "fp", "comp", "n", "sig", "s")
        members = own.select(*columns, F.lit(False).alias("visitor"), F.pmod(cell, "bm").alias("m"), F.explode(F.expr("sequence(0L, bv - 1L)")).alias("v"))
        visitors = own.filter("stranger").select(*columns, F.lit(True).alias("visitor"), F.explode(F.expr("sequence(0L, bm - 1L)")).alias("m"), F.pmod(cell, "bv").alias("v"))
        return members.unionByName(visitors).groupBy("main", "m", "v").applyInArrow(_block_links(self.percent), "a bigint, b bigint")

    def joined(self, roots: DataFrame, links: DataFrame) -> DataFrame:
        """The components after further links: only links between roots are followed, then the nodes are renamed. Materialised."""
        links = self.keep(links, "links")
        if not counted(links):
            return roots
        self.made.append(roots)
        table = lambda c: small(roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")), BROADCAST_ROWS, counted(roots))
        tops = links.join(table("a"), "a", "left").join(table("b"), "b", "left").select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b"))
        renamed = components(tops)
        self.made.append(renamed)
        moved = small(renamed.select(F.col("node").alias("root"), F.col("root").alias("top")), BROADCAST_ROWS, counted(renamed))
        old = roots.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        # nodes that no root's component had before
        fresh = renamed.join(small(roots.select("node"), BROADCAST_ROWS, counted(roots)), "node", "left_anti").select("node", "root")
        return materialize(old.unionByName(fresh), "roots")

    def result(self) -> DataFrame:
        buckets = self.buckets()
        sets = self.sets(buckets)
        roots = components(self.confirmed(self.close(self.stars(buckets)), sets), flat=True)
        mixed = self.mixed(buckets, roots)
        if counted(mixed):
            roots = self.joined(roots, self.confirmed(self.probes(mixed), sets))
            mixed = self.mixed(mixed, roots)
        if counted(mixed):
            roots = self.joined(roots, self.confirmed(self.few(mixed), sets).union(self.many(mixed, sets)))
        # a name for every class that isn't one row of its own
        table = small(roots.select(F.col("node").alias("fp"), "root"), BROADCAST_ROWS, counted(roots))
        named = self.keep(self.classes.select("fp", "rep", "rows").join(table, "fp", "left").filter("rows > 1 or root is not null").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "named")
        least = self.keep(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
        names = materialize(named.join(small(least, BROADCAST_ROWS), "root").select("fp", F.col("root").alias("group_id"), "component_id"), "names")
        docs = self.sketches.select("doc_id", "th", F.col("n").alias("n_shingles"), "fp").join(small(names, BROADCAST_ROWS), "fp", "left")
        docs = docs.withColumn("component_id", F.coalesce("component_id", "doc_id")).withColumn("group_id", F.coalesce("group_id", "fp")).withColumn("kept", F.expr("doc_id <=> component_id"))
        release([*self.made, roots])
        return docs


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 8) -> DataFrame:
    """A row per document: doc_id, th (hash of its text), n_shingles, fp (of its set), group_id (of its component; null without words), component_id, kept."""
    return NearDuplicates(docs, n, percent, id_col, text_col, bits).result()


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group one row stays, of the least id (and of its texts, if an id repeats, that of least hash). Texts without words all stay."""
    groups = materialize(near_duplicates(docs, n, percent, id_col=id_col, text_col=text_col, bits=bits).filter("group_id is not null").select("doc_id", "th", "group_id", "kept"), "groups")
    # of each group few rows have the least id: one, but for repeated rows and ids
    least = groups.filter("kept").groupBy("group_id", "doc_id", "th").agg(F.count(F.lit(1)).alias("times"))
    first = F.min("th").over(Window.partitionBy("group_id"))
    least = least.withColumn("stays", F.col("th") == first).filter("times > 1 or not stays").select("doc_id", "th", "stays")
    rows = groups.filter("not kept").select("doc_id", "th", F.lit(False).alias("stays")).unionByName(least)
    rows = materialize(rows.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "stays"), "leavers")
    same = (F.col(id_col).cast("bigint").eqNullSafe(F.col("__id"))) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__th"))
    out = docs.join(small(rows.select("__id", "__th"), BROADCAST_ROWS, counted(rows)), same, "left_anti")
    again = materialize(rows.filter("stays").select("__id", "__th"), "again")
    if counted(again):  # repeated rows of which one stays
        once = docs.join(small(again, BROADCAST_ROWS), same, "left_semi").withColumn("__th", F.xxhash64(F.col(text_col).cast("string"))).dropDuplicates([id_col, "__th"]).drop("__th")
        out = out.unionByName(once)
    release([groups])
    return out
