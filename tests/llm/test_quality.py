import fixtures_llm as fx
import numpy as np

from weftline.llm import quality as Q


def test_additive_model_learns_parts_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = Q.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0)).mean() > 0.9
    assert (0, 1) in model.pairs or (1, 0) in model.pairs


def test_constant_models():
    assert np.allclose(Q.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))), 0.5)
    assert (Q.fit(np.zeros((5, 3)), np.ones(5)).score(np.zeros((2, 3))) > 0.9).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = Q.score_texts(docs, Q.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.9


def test_cases(spark):
    docs = fx.table(spark, extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.learn(docs, labels)
    got = Q.score_texts(docs, model).collect()
    assert len(got) == len(fx.documents()) and all(0 <= r.score <= 1 for r in got)
    assert Q.keep_good(docs, model).columns == docs.columns
    assert Q.score_texts(fx.empty(spark), Q.learn(fx.empty(spark), labels)).count() == 0


def test_features_are_those_of_each_text_alone():
    texts = [b"", b"a b. C\nd", "é ü".encode(), b"x x x y"]
    offs = np.append(0, np.cumsum([len(t) for t in texts]))
    whole = Q.features(np.frombuffer(b"".join(texts), np.uint8), offs)
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], Q.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])
