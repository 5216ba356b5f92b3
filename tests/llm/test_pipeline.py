"""run() against the plain versions of its stages; the classifier's scores are taken from the operator."""

import corpus_pipeline as pipeline
from lithoframe.llm.piece_viterbi import decode
from lithoframe.llm.quality import fit_quality, quality_scores
from lithoframe.llm.queries import model_path
from lithoframe.llm.shared import table

from . import brute


def redacted(text):
    out, at = "", 0
    for start, _, end, _ in brute.base_secrets(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_run(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    scores = quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    good = [(r.doc_id, r.text) for r in scores.filter("score >= 0.3").collect()]
    first = {i for i, _, _, kept in brute.near_duplicates(good, 5) if kept}
    clean = {i for i, *_, bad in brute.contamination([d for d in good if d[0] in first], items) if not bad}
    want = {i: redacted(t) for i, t in good if i in clean}
    out = pipeline.run(spark, sf_dir)
    got = {r.doc_id: r.text for r in decode(out, model_path(), carry=["doc_id"]).collect()}
    assert got == want
    assert not out.filter("not round_trip").count()
