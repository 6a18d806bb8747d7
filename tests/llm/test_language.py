"""Language identification: its features, its descent and its calibration, held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id
from millrace.llm.words import mixed


def plain_features(word):
    """Buckets of one word's features, gram by gram."""
    marked = [ord(c) for c in f"<{word}>"]
    one = lambda x: int(mixed(np.array([x], np.uint64))[0])
    spread = [one((c + 0x9E3779B97F4A7C15) % 2**64) for c in marked]
    top = lambda x: (one(x % 2**64) >> 48) % language_id.BUCKETS
    grams = [top(sum(spread[i + k] * (one(k + 1) | 1) for k in range(n)) + n) for n in language_id.GRAMS for i in range(len(marked) - n + 1)]
    return sorted([*grams, top(sum(one((s + k) % 2**64) for k, s in enumerate(spread)))])


@pytest.mark.parametrize("cut", [7, 200_000])
def test_features_are_all_grams_and_the_word(monkeypatch, cut):
    monkeypatch.setattr(language_id, "CUT", cut)
    found = ["a", "the", "éàß", "日本", "longerword" * 3]
    got = [[] for _ in found]
    for bucket, word in language_id.subwords(pa.array(found, pa.large_string())):
        assert (np.diff(word) >= 0).all()
        for b, w in zip(bucket.tolist(), word.tolist()):
            got[w].append(b)
    assert [sorted(x) for x in got] == [plain_features(w) for w in found]
    buckets, counts = language_id.features_of(pa.array(["The the 12, a!", None, "?!", "éàß"], pa.large_string()))
    assert counts.tolist() == [2 * len(plain_features("the")) + len(plain_features("a")), 0, 0, len(plain_features("éàß"))]
    assert sorted(buckets[-counts[-1] :].tolist()) == plain_features("éàß")


def test_means_are_those_of_all_features():
    rng = np.random.default_rng(1)
    model = language_id.Model(["x", "y"], rng.normal(size=(language_id.BUCKETS, language_id.WIDTH)).astype(np.float32), rng.normal(size=(2, language_id.WIDTH)).astype(np.float32), np.array([0.5, -1.0], np.float32))
    texts = ["a word, a WORD", "éàß", "", None, "12 !?"]
    got, has = model.logits(pa.array(texts))
    want = [np.mean([model.table[b] for w in t for b in plain_features(w)], axis=0) for t in (["a", "word", "a", "word"], ["éàß"])]
    assert np.allclose(got[:2], [model.weights @ v + model.shift for v in want], atol=1e-4)
    assert has.tolist() == [True, True, False, False, False]


def test_descent_lowers_the_loss_and_scores_are_calibrated():
    rng = np.random.default_rng(2)
    letters = {"p": "abcdefg", "q": "efghijk", "r": "ijklmna"}
    def some(n):
        y = rng.integers(0, 3, n)
        return pa.array([" ".join("".join(rng.choice(list(letters["pqr"[k]]), 2)) for _ in range(int(rng.integers(1, 4)))) for k in y], pa.large_string()), y
    texts, y = some(3000)
    model = language_id.descend(texts, y, ["p", "q", "r"])
    model = language_id.calibrate(model, *some(2000))
    new, truth = some(3000)
    best, score = model.predict(new)
    right = best == truth
    assert right.mean() > 0.85
    # of predictions with a score near s, a share of about s is right, and few above the limit are wrong
    assert abs(score.mean() - right.mean()) < 0.03
    accepted = score >= model.limit
    assert 0.3 < accepted.mean() < 1 and (~right[accepted]).mean() < 0.03 < (~right).mean()


def test_held_out_documents_get_their_language(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_and_labels(spark, odd_documents, odd_rows, no_documents):
    again = language_id.languages(odd_documents)
    got = again.collect()
    assert len(got) == len(odd_rows)
    assert {(r.lang_pred, r.score, r.rejected) for r in got if r.doc_id in (5, 6, 7)} == {("und", 0.0, True)}
    assert {r.lang_pred for r in got if r.doc_id not in (5, 6, 7)} == {"en"}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert sorted(map(repr, got)) == sorted(map(repr, language_id.languages(odd_documents.repartition(5)).collect()))
    unknown = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language_id.languages(unknown).collect()} == {("und", 0.0)}
    assert language_id.languages(no_documents).count() == 0


def test_sample_is_bounded_and_even(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "concat('text ', id) as text", "case when id % 100 = 0 then 'rare' when id % 3 = 0 then 'a' else 'b' end as lang")
    rows = rows.unionByName(spark.range(2000).selectExpr("7L as doc_id", "concat('copy ', id) as text", "'b' as lang"))
    got = language_id.sample(rows, most=300).groupBy("lang").count().collect()
    counts = {r["lang"]: r["count"] for r in got}
    assert counts["a"] == counts["b"] == 100 and 30 < counts["rare"] <= 60
    assert language_id.sample(rows, most=300).where(language_id.held_out(F.col("doc_id"))).count() == 0
    pieces = language_id.pieces(language_id.sample(rows.withColumn("text", F.repeat("text", 400)), most=30))
    assert pieces.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= language_id.PIECES
