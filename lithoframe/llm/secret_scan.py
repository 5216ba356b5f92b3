"""Secret scans with ownership frequency over the corpus, in DataFrame functions only.

Base findings of a text are the leftmost matches of three patterns that are long
enough: ``assign`` (a value given to a password-like name), ``access`` (access key
ids) and ``hex`` (long hexadecimal runs). The corpus adds what one text can't tell.
Candidate strings (base values, and ``owned`` candidates: long runs of letters and
digits mixed) are hashed, and for each hash the distinct repositories and owners
that hold it are counted over all documents. A string that more than
``max_repositories`` repositories or owners hold is a widely copied ``example`` (so a
document mirrored in a second place keeps its secrets);
one that belongs to few and isn't a placeholder is ``live``. ``owned`` candidates
become findings only if they are live and overlap no base finding; base findings
always stay and carry their verdict.

Positions count code points, the end is exclusive. A match's place is the sum of
the lengths of the pieces between matches and of the matches before it.

Null and empty texts have no findings. A null repository or owner counts as none.
Repeated rows are judged each for itself. Columns of the input that clash with
``findings`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, small

#: name, pattern, group of the value, least length of the value, in the order of listing.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
OWNED = ("owned", r"[A-Za-z0-9+/_=-]{24,}", 0, 24)
_MIXED = r"^(?=(?:[^0-9]*[0-9]){3})(?=(?:[^A-Za-z]*[A-Za-z]){3})"
_PLACEHOLDER = r"(?i)example|changeme|placeholder|your_|xxxx|0123456789|(.)\1{7}"
_KINDS = [k[0] for k in (*BASE, OWNED)]
_ROW = "struct<start:int,kind:int,end:int,hash:bigint,plain:boolean>"
_FOUND = f"array<{_ROW}>"
#: Rows folded at a time, code points of a block of text, and counts that may be broadcast.
RUN, BLOCK, BROADCAST_ROWS = 64, 1024, 200_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(rows: Column, total: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str, zero: int = 0) -> Column:
    """emit(state, row) for every row of an array; the state of a row is ``total`` folded over all rows before it.

    An aggregate that appends copies what it has, so rows are folded in chunks of
    ``RUN``: first one state for each chunk, then inside each. The work is linear but for
    rows / RUN squared.
    """

    def of_rows(r: Column) -> Column:
        chunks = F.when(F.size(r) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / RUN).cast("int")), lambda j: F.slice(r, j * RUN + 1, F.lit(RUN)))).otherwise(F.slice(F.array(r), 1, 0))
        return _let(chunks, of_chunks)

    def of_chunks(chunks: Column) -> Column:
        inner = F.transform(chunks, lambda c: F.aggregate(c, F.lit(zero), total))
        empty = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
        # a chunk's fold starts at zero, so states add or take the greater, as total does for whole rows
        before = F.aggregate(inner, empty, lambda acc, t: F.struct((acc["at"] + t if total is _ends_sum else F.greatest(acc["at"], t)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        none = F.array().cast(f"array<{kind}>")

        def inside(c: Column, first: Column) -> Column:
            start = F.struct(first.alias("at"), none.alias("out"))
            return F.aggregate(c, start, lambda acc, x: F.struct(total(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out")), lambda acc: acc["out"])

        return F.flatten(F.zip_with(chunks, before, inside))

    return _let(rows, of_rows)


def _ends_sum(at: Column, x: Column) -> Column:
    return at + F.length(x["gap"]) + F.length(x["whole"])


def _ends_most(at: Column, x: Column) -> Column:
    return F.greatest(at, x["end"])


def _matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """All matches of one kind as (start, kind, end, hash of the value, whether it looks like a placeholder)."""
    pieces = F.split(text, pattern, -1)
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    rows = _let(whole, lambda w: F.arrays_zip(F.slice(pieces, F.lit(1), F.size(w)).alias("gap"), w.alias("whole"), (value if group else w).alias("value")))

    def one(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        keep = F.length(x["value"]) >= least
        if kind == len(BASE):
            keep &= F.rlike(x["value"], F.lit(_MIXED))
        found = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["whole"])).alias("end"), F.xxhash64(x["value"]).alias("hash"), F.rlike(x["value"], F.lit(_PLACEHOLDER)).alias("plain"))
        return F.when(keep, found)

    found = F.filter(_running(rows, _ends_sum, one, _ROW), lambda x: x.isNotNull())
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(_FOUND))


def scan(docs: DataFrame, *, text_col: str = "text", carry: list[str]) -> DataFrame:
    """``carry`` plus __found: all matches by pattern alone."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*carry, F.concat(*[_matches(text, k, *kind[1:]) for k, kind in enumerate((*BASE, OWNED))]).alias("__found"))


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners over all candidates (hash, repository, owner)."""
    distinct = candidates.distinct()
    return distinct.groupBy("hash").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))


def secret_findings(docs: DataFrame, *, text_col: str = "text", repository_col: str = "source", owner_col: str = "source", carry: list[str] | None = None, max_repositories: int = 2) -> DataFrame:
    """``carry`` (all columns if None) plus findings: array of (start, kind, end, n_repositories, n_owners, verdict), by start, then kind."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "findings"]
    own = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text_col])], F.col(repository_col).cast("string").alias("__repository"), F.col(owner_col).cast("string").alias("__owner"))
    scanned = scan(own, text_col=text_col, carry=[*carry, "__repository", "__owner"])
    scanned = materialize(scanned.withColumn("__row", F.monotonically_increasing_id()), "secrets")  # the row numbers are fixed once written
    some = scanned.filter(F.size("__found") > 0)
    rows = some.select("__row", F.col("__repository").alias("repository"), F.col("__owner").alias("owner"), F.explode("__found").alias("f")).select("__row", "repository", "owner", "f.*")
    # owned candidates that overlap no base match: neither one before that ends later nor one behind that starts earlier
    base = F.col("kind") < len(BASE)
    # (both frames begin unbounded: those that end so cost the square of their rows)
    up, down = (Window.partitionBy("__row").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (("start", "kind"), (F.desc("start"), F.desc("kind"))))
    before, behind = F.max(F.when(base, F.col("end"))).over(up), F.min(F.when(base, F.col("start"))).over(down)
    rows = rows.withColumn("apart", base | ((F.coalesce(before, F.lit(0)) <= F.col("start")) & (behind.isNull() | (behind >= F.col("end")))))
    rows = materialize(rows.filter("apart").drop("apart"), "candidates")
    counts = ownership(rows.select("hash", "repository", "owner"))
    live = (F.col("n_repositories") <= max_repositories) & (F.col("n_owners") <= max_repositories) & ~F.col("plain")
    judged = rows.join(small(materialize(counts, "owners"), BROADCAST_ROWS), "hash").withColumn("verdict", F.when(live, "live").otherwise("example")).filter((F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))
    names = F.array(*map(F.lit, _KINDS))
    listed = judged.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_repositories", "n_owners", "verdict"))).alias("findings"))
    named = F.transform("findings", lambda x: F.struct(x["start"].alias("start"), F.element_at(names, x["kind"] + 1).alias("kind"), x["end"].alias("end"), x["n_repositories"].alias("n_repositories"), x["n_owners"].alias("n_owners"), x["verdict"].alias("verdict")))
    full = some.select(*carry, "__row").join(listed, "__row", "left").select(*carry, F.coalesce(named, F.array().cast(_NAMED)).alias("findings"))
    none = scanned.filter(F.size("__found") == 0).select(*carry, F.array().cast(_NAMED).alias("findings"))
    return none.unionByName(full)


_NAMED = "array<struct<start:int,kind:string,end:int,n_repositories:bigint,n_owners:bigint,verdict:string>>"


def joined(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found stretch replaced; overlapping findings become one mark."""
    # blocks of the text, so that a stretch is cut out without walking to it from the start
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def stretch(b: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
        within = F.substring(F.element_at(b, first + 1), start % BLOCK + 1, end - start)
        across = F.concat(F.substring(F.element_at(b, first + 1), start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(b, first + 2, last - first - 1), ""), F.substring(F.element_at(b, last + 1), F.lit(1), (end - 1) % BLOCK + 1))
        return F.when(end <= start, F.lit("")).when(first == last, within).otherwise(across)

    def of_blocks(b: Column) -> Column:
        piece = lambda at, x: F.when(x["start"] >= at, F.concat(stretch(b, at, x["start"]), F.lit(mark))).otherwise(F.lit(""))
        rest = _let(F.aggregate(findings, F.lit(0), _ends_most), lambda at: stretch(b, at, F.length(text)))
        return F.concat(F.array_join(_running(findings, _ends_most, piece, "string"), ""), rest)

    return F.when(F.size(findings) > 0, _let(blocks, of_blocks)).otherwise(text)
