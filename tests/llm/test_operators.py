"""The ten operators against plain versions, on edge cases and on the small tables."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from lithoframe.llm import queries as q
from lithoframe.llm.decontamination import contamination
from lithoframe.llm.license_scan import TEMPLATES, license_matches
from lithoframe.llm.near_dedup import near_duplicates, one_of_each
from lithoframe.llm.piece_viterbi import decode, encode
from lithoframe.llm.quality import fit_quality, quality_scores
from lithoframe.llm.secret_scan import joined, redact, secret_findings
from lithoframe.llm.shared import table
from lithoframe.llm.substring_dedup import remove_repeats
from lithoframe.llm.token_counts import token_counts
from lithoframe.llm.topk_search import top_k
from lithoframe.llm.url_filter import judge_urls

from . import brute

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(600)] + ["Straße", "naïve", "数据", "ÄÖ"]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def changed(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


def edge_texts():
    seed = prose(120)
    group = [changed(seed, R.randint(0, 14)) for _ in range(150)]  # one bucket of many members, on both sides of the limit
    key = "0123456789abcdef" * 2 + "77"
    own = "q7Rt9Zx2Lm4Wv8Kp1Ns6Yd3Bf5"
    return [
        None, "", "   \t\n", "word", "Word", "a b", "A  B", "\x00x \x01y", *group, seed, seed, prose(9000), prose(400) + seed, prose(300),
        f"password = '{key}' AKIA{'Q' * 16}2 and AKIA1", f"TOKEN:abcde apikey:{key}, api_key=\"zzzzzzz\"", f"see {own} here", f"é{key}é API_KEY=12345 secret=======", "say " + own[::-1] + " twice",
        "x" * 50_000, "\n".join(TEMPLATES.values()), "Released under the MIT License.\nmore text", "MIT License released under the.", "▁ a ▁b\U0001f600",
    ]


TEXTS = edge_texts()
ITEMS = [(1, None), (2, ""), (3, " ".join(TEXTS[160].split(" ")[50:75])), (4, "zwei WORDS only"), (5, "a b"), (10, " ".join(TEXTS[160].split(" ")[60:80])), (11, "a b")]
MODEL = q.model_path()


@pytest.fixture(scope="module")
def docs(spark):
    """Ids on both sides of zero, a repeated row, and columns whose names clash with those made on the way."""
    rows = [(k * 3 - 20, t, f"s{k % 3}" if k % 7 else None, len(t or "")) for k, t in enumerate(TEXTS)]
    rows.append(rows[20])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint").repartition(3)
    for c in ("fp", "key", "removed", "kept", "findings", "score", "n_words", "items", "ids", "matches", "n_tokens", "lang", "th", "hash", "host"):
        df = df.withColumn(c, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(got, want):
    want = sorted(want, key=repr)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3] == []


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, pairs, n):
    same(rows(near_duplicates(docs, n), "doc_id", "n_shingles", "component_id", "kept"), brute.near_duplicates(pairs, n))


def test_one_of_each(docs, pairs):
    kept = sorted({i for i, _, c, k in brute.near_duplicates(pairs, 5) if k})
    left = one_of_each(docs, 5)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == kept


def test_top_k(spark):
    data = [(k, [R.uniform(-1, 1) if R.random() < 0.7 else 0.5 for _ in range(6)]) for k in range(130)]
    data += [(150, data[0][1]), (151, data[0][1]), (152, None), (153, [None] * 6), (154, [float("nan")] * 6), (155, [float("inf")] + [0.0] * 5), (None, data[1][1]), (3, data[3][1])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").withColumn("row", F.lit(1)).withColumn("v", F.lit("x"))
    exact = [(i, v and [None if x is None else float(F_(x)) for x in v]) for i, v in data]
    same(rows(top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score"), brute.top_k(exact))
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def F_(x):
    import numpy as np

    return np.float32(x)


def test_remove_repeats(docs, pairs):
    got = remove_repeats(docs, carry=["doc_id"])
    n = F.expr("aggregate(removed, 0L, (n, s) -> n + s.end - s.start)")
    same(rows(got, "doc_id", F.octet_length("kept") + n, n, F.size("removed"), F.sha2("kept", 256)), brute.repeats(pairs))


def test_quality(spark, docs, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table has too few labels to hold any out
    own, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    machine = fit_quality(own, labels)
    held = quality_scores(own, machine).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").select("score", "quality").collect()
    assert held and sum((r.score >= 0.3) == (r.quality == 1) for r in held) >= 0.9 * len(held)
    again = quality_scores(docs, machine)
    assert sorted(again.columns) == sorted(docs.columns)
    assert all(0 <= r.score <= 1 for r in again.collect())
    none = fit_quality(own, labels.limit(0))
    assert {r.score for r in quality_scores(docs, none).select("score").collect()} == {0.5}


def test_quality_query_marks_held_out(spark, sf_dir):
    for r in q.op4_quality(spark, sf_dir).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)


def test_license_matches(docs):
    found = {r.doc_id: {(m.template, round(m.dice, 9)) for m in r.matches} for r in license_matches(docs, carry=["doc_id"]).collect()}
    by_text = {t: found[k * 3 - 20] for k, t in enumerate(TEXTS)}
    assert {t for t, _ in by_text["\n".join(TEMPLATES.values())]} == set(TEMPLATES)
    assert by_text["Released under the MIT License.\nmore text"] == {("MIT", 1.0), ("MIT", 0.8)}  # the line, and the whole text
    assert not by_text[None] and not by_text[""] and not by_text["MIT License released under the."]
    assert not license_matches(docs, templates={}).filter("size(matches) > 0").count()


def test_urls(spark, sf_dir):
    pages = [tuple(r) for r in table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    link = "<a class='x' href=\"{}\">t</a>"
    pages += [(9001, None, link.format("http://good.net/de/1")), (9002, "", None), (9003, "no scheme", ""), (9004, "HTTP://Sub.Example.COM/en/7?x#y", link.format("//evil.org/es/")), (9005, "http://evil.org/es/1", link.format("http://near.example/a")), (9006, "http://near.example/a", link.format("http://evil.org/")), (9006, "http://near.example/a", link.format("http://evil.org/")), (9007, "ftp://example.net/de/8#/en/", None), (9008, "http://acom/en/", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("mine")).withColumn("source", F.lit(1))
    same(rows(judge_urls(df, carry=["page_id"]), "page_id", "host", "path", "rule", "verdict"), brute.judge_urls(pages))
    assert judge_urls(df.limit(0)).count() == 0


def test_encode_decode(docs):
    coded = encode(docs, MODEL, check=True)
    assert sorted(coded.columns) == sorted([*docs.columns, "round_trip"])
    assert not coded.filter("not round_trip").count()
    for r in decode(coded.withColumnRenamed("text", "was"), MODEL, carry=["was"]).collect():
        assert r.text == (r.was or "").replace("▁", " ")


def test_decontamination(spark, docs, pairs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    n = F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.start)")
    for most in (200_000, 7):  # in one block, and in several
        got = contamination(docs, items, carry=["doc_id"], max_windows=most)
        same(rows(got, "doc_id", "n_words", n, F.size("items"), F.sha2(F.array_join("items", ","), 256), n > 0), brute.contamination(pairs, ITEMS))
    assert not contamination(docs, items.limit(0)).filter("size(items) > 0").count()


def test_secrets(docs, pairs):
    found = secret_findings(docs, carry=["doc_id", "text"]).cache()
    number = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind))
    base = F.filter("findings", lambda x: x["kind"] != "owned")
    same(rows(found, "doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(base), 256)), brute.secrets(pairs))
    owned = [r.text for r in found.filter(number("owned") > 0).collect()]
    assert owned and all(t.startswith(("see ", "say ")) for t in owned)
    for r in found.select("text", "findings", redact(F.col("text"), F.col("findings")).alias("clean")).collect():
        assert all(r.text[f.start : f.end] not in (r.clean or "") for f in r.findings) and (r.findings or r.clean == r.text)


def test_copied_secret_is_an_example(spark):
    value = "q7Rt9Zx2Lm4Wv8Kp1Ns6Yd3Bf5"
    df = spark.createDataFrame([(1, f"at {value} end", "a"), (2, f"{value}", "b"), (3, f"token={value}", "c")], "doc_id int, text string, source string")
    got = {r.doc_id: [(f.kind, f.verdict, f.n_owners) for f in r.findings] for r in secret_findings(df).collect()}
    assert got == {1: [], 2: [], 3: [("assign", "example", 3)]}


def test_token_counts(docs, pairs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in pairs]
    same(rows(token_counts(docs, MODEL, carry=["doc_id"]), "doc_id", "n_bytes", "n_tokens"), want)


@pytest.mark.parametrize("name", sorted(q.ENTRIES))
def test_empty_tables(spark, sf_dir, tmp_path, name):
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        table(spark, sf_dir, t).limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert q.ENTRIES[name](spark, str(tmp_path)).count() == 0


