"""Structured words, huge numbers, very long runs and mirrored documents."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.llm import components as cc
from lithoframe.llm import piece_viterbi as pv
from lithoframe.llm import queries as q
from lithoframe.llm.components import components
from lithoframe.llm.decontamination import contamination
from lithoframe.llm.near_dedup import near_duplicates
from lithoframe.llm.pieces import Pieces
from lithoframe.llm.quality import Machine
from lithoframe.llm.secret_scan import redact, secret_findings
from lithoframe.llm.shared import materialize, release_all, shared_dir
from lithoframe.llm.substring_dedup import remove_repeats
from lithoframe.llm.token_counts import token_counts
from lithoframe.llm.topk_search import top_k

from . import brute

MODEL = q.model_path()


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


WORDS = [w for n in (1024, 2048, 4096, 65_536) for w in thue_morse(n)]
TEXTS = [*WORDS, *(f"{w} x" for w in WORDS), *(f"x {w} y" for w in WORDS)]


@pytest.fixture(scope="module")
def morse(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_near_duplicates_of_thue_morse_words(morse):
    for bits in (8, 16):
        got = rows(near_duplicates(morse, 2, bits=bits), "doc_id", "n_shingles", "component_id", "kept")
        assert got == sorted(brute.near_duplicates(list(enumerate(TEXTS)), 2), key=repr)


def test_contamination_by_thue_morse_words(spark, morse):
    items = [(1, WORDS[0]), (2, f"{WORDS[3]} x"), (3, " ".join("uvw"[k % 3] for k in range(12)))]
    more = [(1000, " ".join("uvw"[k % 3] for k in range(400)) + " uv")]
    docs = morse.union(spark.createDataFrame(more, morse.schema))
    got = contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    n = F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.start)")
    want = brute.contamination([*enumerate(TEXTS), *more], items)
    assert rows(got, "doc_id", "n_words", n, F.size("items"), F.sha2(F.array_join("items", ","), 256), n > 0) == sorted(want, key=repr)


def test_windows_of_few_words(spark):
    """Thousands of windows that share their rarest word, and a text made of these words."""
    R = random.Random(3)
    item, text = (" ".join(R.choice(["u", "v", "w"]) for _ in range(n)) for n in (3000, 20_000))
    docs, items = [(1, text), (2, None)], [(7, item), (None, "p q")]
    got = contamination(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    n = F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.start)")
    assert rows(got, "doc_id", "n_words", n, F.size("items")) == [r[:4] for r in brute.contamination(docs, items)]


def test_token_counts_of_thue_morse_words(morse):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert rows(token_counts(morse, MODEL, carry=["doc_id"]), "doc_id", "n_tokens") == sorted(((k, len(model.encode(t))) for k, t in enumerate(TEXTS)), key=repr)


def test_components_by_star_rounds(spark, monkeypatch):
    R = random.Random(4)
    pairs = [(k, k + 1) for k in range(0, 90)] + [(200, x) for x in range(201, 260)] + [(R.randrange(300, 400), R.randrange(300, 400)) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(5)
    once = rows(components(df), "node", "root")
    monkeypatch.setattr(cc, "ONE_TASK", 0)
    assert rows(components(df), "node", "root") == once
    assert (90, 0) in once and (259, 200) in once and (0, 0) in once


def test_large_components_of_vectors(spark):
    R = random.Random(6)
    data = [(k, [float(R.choice([-1, 1]) * R.randrange(4 * 10**8, 5 * 10**8)) / 256 for _ in range(53)]) for k in range(60)]
    exact = [(i, [int(256 * x) for x in v]) for i, v in data]
    want = []
    for i, x in exact:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in exact if j != i)
            want += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:5], 1)]
    got = top_k(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    unequal = [(0, [1.0, 2.0]), (1, [1.0]), (2, [0.5, 0.5, 9.0]), (2, [0.5, 0.5, 9.0]), (3, [])]
    got = top_k(spark.createDataFrame(unequal, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0)
    assert rows(got, "query_id", "rank", "vec_id", "score") == [(0, 1, 2, 256 * 128 + 512 * 128), (0, 2, 2, 256 * 128 + 512 * 128), (0, 3, 1, 65_536), (0, 4, 3, 0)]


def test_repeats_in_texts_beyond_one_chunk(spark, monkeypatch):
    from lithoframe.llm import substring_dedup as sd

    R = random.Random(8)
    prose = lambda n: "".join(R.choice("abcdef ghij") for _ in range(n))
    passage = prose(900)
    long = prose(5000) + passage + prose(4000) + passage[100:700] + prose(3000)
    docs = [(1, long), (2, prose(300) + passage + prose(50)), (3, prose(6000)), (4, "é" * 900), (5, prose(399)), (6, long[:3000])]
    monkeypatch.setattr(sd, "CHUNK", 512)
    n = F.expr("aggregate(removed, 0L, (n, s) -> n + s.end - s.start)")
    size = 600_000  # and one text beyond the true size of a slice
    for texts in (docs, [(1, prose(1000) + "x" * size + passage), (2, passage + prose(size * 2) + passage)]):
        df = spark.createDataFrame(texts, "doc_id int, text string")
        got = rows(remove_repeats(df, carry=["doc_id"]), "doc_id", F.octet_length("kept") + n, n, F.size("removed"), F.sha2("kept", 256))
        assert got == sorted(brute.repeats(texts), key=repr)
        monkeypatch.undo()


def test_repeats_query_removes_passages_from_400_bytes_on(spark, tmp_path):
    R = random.Random(11)
    words = lambda n: "".join("".join(R.choice("abcdefgh") for _ in range(6)) + " " for _ in range(n))
    long, short = words(57) + "z", words(57)  # over 50 words each, 400 and 399 bytes
    assert min(len(x.split()) for x in (long, short)) > 50 and (len(long), len(short)) == (400, 399)
    texts = [(1, f"{words(90)}1{long}2é"), (2, f"3{long}4{words(20)}"), (3, f"{words(90)}5{short}6é"), (4, f"7{short}8{words(20)}"), (5, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = q.op3_substring_dedup(spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == brute.repeats(texts)
    # n_bytes is the size of the input, whatever is removed
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in got.collect()} == {k: (len((t or "").encode()), 400 * (k < 3)) for k, t in texts}


def test_pairwise_sum_of_the_machine():
    R = np.random.default_rng(1)
    m = Machine(0.3, R.normal(size=50).astype(np.float32), R.normal(size=(50, 8)).astype(np.float32), np.zeros((0, 0)))
    index, value, first = R.integers(0, 50, 30), R.normal(size=30).astype(np.float32), np.array([0, 7, 19])
    got = m.raw_scores(index, value, first)[0]
    for k, (lo, hi) in enumerate(itertools.pairwise([*first, 30])):
        pairs = sum(m.v[index[i]] @ m.v[index[j]] * value[i] * value[j] for i in range(lo, hi) for j in range(i + 1, hi))
        assert got[k] == pytest.approx(m.w0 + (m.w[index[lo:hi]] * value[lo:hi]).sum() + pairs, abs=1e-4)


def plain_viterbi(text, pieces):
    """Ids of the cut with the greatest sum of scores; the shorter last piece wins ties."""
    own, worst = {t.encode(): (s, i) for t, s, i in zip(pieces.text, pieces.score, pieces.ids, strict=True)}, min(pieces.score) - 10
    widest, n = max(map(len, own)), len(text)
    best: list = [(0.0, 0, None)] + [(-np.inf, 0, None)] * n
    char = {k: len(c.encode()) for k, c in zip(np.cumsum([0, *(len(c.encode()) for c in text.decode())]).tolist(), text.decode(), strict=False)}
    for end in range(1, n + 1):
        for m in range(1, min(widest, end) + 1):
            start, piece = end - m, text[end - m : end]
            score, ids = own.get(piece, (None, None))
            if score is None and char.get(start) == m:
                score, ids = worst, [pieces.byte_ids[b] for b in piece]
            if score is not None and best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, m, ids if isinstance(ids, list) else [ids])
    out, at = [], n
    while at:
        out = best[at][2] + out
        at -= best[at][1]
    return out


def test_cuts_have_the_greatest_sum(spark):
    pieces = Pieces.load(MODEL)
    lattice = pv.Lattice(pieces)
    R = random.Random(9)
    units = [" the", " Straße", " 数据集", " naïve\U0001f600", " aaaaaaaa", " " * 5 + "x", "\n", *(" " + "".join(R.choice("etaoinshrdlu") for _ in range(R.randint(1, 14))) for _ in range(150)), " " + "".join(R.choice("etaoin") for _ in range(900))]
    for u in units:
        raw = np.frombuffer(u.encode(), np.uint8)
        want = plain_viterbi(u.encode(), pieces)
        assert lattice.search(raw[None, :].copy())[0].tolist() == want, u
        assert lattice.search_long(raw).tolist() == want, u


def test_decoding_agrees_with_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["a b", " two  spaces", "Straße 数据 \U0001f600", "line\nfeed\tand tab"]
    for r in pv.decode(pv.encode(spark.createDataFrame([(t,) for t in texts], "was string"), MODEL, text_col="was"), MODEL).collect():
        assert r.text == r.was == model.decode(r.ids)


def test_a_megabyte_of_secrets(spark):
    R = random.Random(2)
    many = "\n".join("".join(R.choice("0123456789abcdef") for _ in range(32)) for _ in range(32_000))
    docs = [(1, many), (2, "é" * 3000 + " token=abcdef9 " + "x" * 5000 + " é"), (3, None)]
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumn("source", F.lit("s"))
    began = time.time()
    found = secret_findings(df)
    got = {r.doc_id: ([(f.kind, f.start, f.end) for f in r.findings], r.clean) for r in found.select("doc_id", "findings", redact(F.col("text"), F.col("findings")).alias("clean")).collect()}
    assert time.time() - began < 60
    assert got[1][0] == [("hex", 33 * k, 33 * k + 32) for k in range(32_000)] and got[1][1] == "\n".join(["[SECRET]"] * 32_000)
    assert got[2][1] == "é" * 3000 + " [SECRET] " + "x" * 5000 + " é" and got[3] == ([], None)


def test_mirrored_documents_keep_their_secrets(spark):
    value = "q7Rt9Zx2Lm4Wv8Kp1Ns6Yd3Bf5"
    mirrored = [(k, f"at {value} end", s) for k, s in enumerate(["a", "b", "a", "a"])]
    copied = [(10 + k, f"at {value[::-1]} end", s) for k, s in enumerate("abcde")]
    got = {r.doc_id: [(f.kind, f.verdict, f.n_owners) for f in r.findings] for r in secret_findings(spark.createDataFrame([*mirrored, *copied], "doc_id int, text string, source string")).collect()}
    assert all(got[k] == [("owned", "live", 2)] for k in range(4)) and not any(got[10 + k] for k in range(5))


def test_release_all_deletes_what_was_written(spark):
    kept = materialize(spark.range(3), "kept")
    other = materialize(spark.range(3), "other")
    release_all(spark, keep=[kept])
    assert kept.count() == 3 and shared_dir(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist|No such file"):
        spark.read.parquet(other._shared_path).count()


def test_pairs_of_small_buckets_are_near(spark):
    """Copies of a few texts with more and more words changed: strangers are listed only with texts that their signatures allow, and no link is lost."""
    from lithoframe.llm import near_dedup as nd

    R = random.Random(12)
    word = lambda: "".join(R.choice("abcdefgh") for _ in range(5))
    docs = []
    for _ in range(6):
        base = [word() for _ in range(60)]
        docs += [" ".join(word() if R.random() < rate else w for w in base) for rate in (0, 0.01, 0.03, 0.06, 0.09, 0.12, 0.15, 0.2, 0.25, 0.3) for _ in range(6)]
    data = list(enumerate(docs))
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    run = nd.NearDuplicates(df, 2, 80, "doc_id", "text")
    buckets = run.buckets()
    sets = run.sets(buckets)
    mixed = run.mixed(buckets, components(run.confirmed(run.close(run.stars(buckets)), sets), flat=True))
    sign = {r.fp: (r.n, np.frombuffer(r.sig, np.uint8)) for r in sets.collect()}
    for pairs in (run.probes(mixed).collect(), run.few(mixed).collect()):
        assert pairs and len(set(pairs)) == len(pairs)
        for a, b in pairs:
            (n, x), (m, y) = sign[a], sign[b]
            assert a < b and (x != y).sum() <= nd.FAR and 100 * min(n, m) >= 80 * max(n, m)
    got = rows(near_duplicates(df, 2), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_duplicates(data, 2), key=repr)
