import zlib

import numpy as np
from pyspark.sql import functions as F

from cooframe.llm import langid, queries, quality

from .helpers import AWKWARD, docs

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_languages_held_out(spark):
    got = {r.doc_id: r for r in queries.op7_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in queries.documents(spark, SF).select("doc_id", "lang").collect()}
    assert set(got) == set(truth) and all(got[i].held_out == held(i) for i in got)
    test = [i for i in got if held(i)]
    assert np.mean([got[i].lang_pred == truth[i] for i in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_languages_of_awkward_rows(spark):
    d = docs(spark, AWKWARD)
    got = langid.predict(d.withColumn("row", F.struct(*d.columns)), langid.fit(d, ~langid.held_out("doc_id")), keep=("row",))
    assert got.columns == ["doc_id", "row", "lang_pred", "score"]
    rows = [(r[0], r[2], r[3]) for r in got.collect()]
    assert len(rows) == len(AWKWARD) and {x[1] for x in rows if x[0] in (1, 2, 3)} == {"und"}
    none = langid.predict(d, langid.fit(d.where("false"), F.lit(True))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.predict(d.where("false"), {}).collect() == []


def test_bundles_are_sums_of_bound_letters():
    v = langid.letter_vector
    word = lambda a, b, c: np.roll(v(a), 2) * np.roll(v(b), 1) * v(c)
    want = word(0, ord("a"), ord("b")) + word(ord("a"), ord("b"), 0)
    got = langid.bundles(["Ab", "1 ab?", "", "12"])
    assert np.array_equal(got[0], want) and np.array_equal(got[1], want) and not got[2:].any()


def test_bundles_by_brute_force_with_many_letters():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 200))) for _ in range(40)] + ["Ünd so, weiter"]
    v = langid.letter_vector
    for text, got in zip(texts, langid.bundles(texts)):
        codes = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
        want = sum(np.roll(v(a), 2).astype(int) * np.roll(v(b), 1) * v(c) for a, b, c in zip(codes, codes[1:], codes[2:]) if b)
        assert np.array_equal(got, want)


def test_a_rare_language_has_its_profile(spark):
    rows = [(k, "the cat and the dog", "en") for k in range(400)] + [(1000 + k, "der hund und die katze", "de") for k in range(5)]
    profiles = langid.fit(docs(spark, rows), F.lit(True), sample=10)
    got = {r.lang_pred for r in langid.predict(docs(spark, rows[-5:]), profiles).collect()}
    assert set(profiles) == {"en", "de"} and got == {"de"}


def test_quality_held_out(spark):
    got = {r.doc_id: r for r in queries.op5_quality_gam(spark, SF).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    test = [i for i in truth if held(i)]
    assert len(got) == 1000 and all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].predicted == truth[i] for i in test]) > 0.95


def test_quality_of_awkward_rows(spark):
    d = docs(spark, AWKWARD)
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (6, 0), (7, 1), (None, 1)], "doc_id long, quality int")
    for own in (labels, labels.where("false"), labels.where("doc_id = 6")):
        got = quality.score(d, quality.fit(d, own, F.lit(True))).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(d.where("false"), quality.train(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).collect() == []


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.train(x, y)
    assert {0, 1} in [set(p) for p in m.pairs] and ((m.score(x) > 0.5) == y).mean() > 0.9
