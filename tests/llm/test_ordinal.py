import numpy as np

from fightlake.llm import ordinal as O

BASE = "/root/testdata/sf0.1"


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    n = 400
    x = rng.normal(size=n)
    grades = np.digitize(2 * x + rng.logistic(size=n), [-1.0, 1.5])
    rows, places = np.arange(n), np.zeros(n, np.int64)
    model = O.fit_arrays(rows, places, x, grades, bits=4, passes=3000, rate=0.02, decay=0.0)

    def loss(w, cuts):
        p = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-(np.array(cuts)[None] - w * x[:, None]))), np.ones((n, 1))], 1)
        return -np.log(p[np.arange(n), grades + 1] - p[np.arange(n), grades]).mean()

    w, cuts = float(model.weights[0]), model.thresholds
    at = loss(w, cuts)
    for d in (0.02, -0.02):
        assert at <= loss(w + d, cuts) and at <= loss(w, cuts + [d, 0]) and at <= loss(w, cuts + [0, d])
    assert abs(w - 2) < 0.5 and cuts[0] < cuts[1]


def test_tails_fall_and_sum_to_the_expected_grade():
    model = O.Model(np.zeros((1 << 4) + O.FORM), np.array([-1.0, 0.5]), 4)
    tails = model.tails(0.2)
    assert tails[0] > tails[1] and np.isclose(tails[0], 1 / (1 + np.exp(-1.2)))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{BASE}/documents.parquet"), spark.read.parquet(f"{BASE}/labels.parquet")
    grades = O.grade_of(labels)
    train = O.bounded_sample(docs, grades.where("doc_id % 5 <> 0"), 2500)
    assert train.count() == 2500
    got = O.score(docs, O.fit(train)).join(grades.where("doc_id % 5 = 0"), "doc_id").collect()
    rate = lambda grade: np.mean([r.selected for r in got if r.grade == grade])
    assert len(got) > 500 and rate(2) > 0.95 and rate(1) < 0.15 and rate(0) < 0.25
    mean = lambda grade: np.mean([r.expected_grade for r in got if r.grade == grade])
    assert mean(2) > mean(1) > 0 and mean(2) > mean(0)


def test_defined_cases(spark):
    rows = [(1, "good words here", "a"), (2, None, "b"), (None, "", None), (1, "good words here", "a"), (3, "word " * 300000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, 1, 0), (3, None, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    sample = O.bounded_sample(docs, O.grade_of(labels))
    assert sorted((r.doc_id, r.grade) for r in sample.collect()) == [(1, 2), (1, 2), (2, 1), (3, 0)]
    got = O.score(docs, O.fit(sample, passes=5)).collect()
    assert len(got) == 5 and all(0 <= r.p_good <= r.p_clean <= 1 for r in got)
    nothing = O.fit(sample.limit(0))
    assert all(r.score == 0 for r in O.score(docs, nothing).collect()) and O.score(docs.limit(0), nothing).count() == 0


def test_scores_against_a_plain_version(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"W{w}" for w in rng.zipf(1.3, rng.integers(1, 80)) % 500) + ("\n# <b>|" if k % 3 else ".\n\nend") for k in range(60)] + [None, "", "one"]
    model = O.Model(rng.normal(size=(1 << 10) + O.FORM).astype(np.float32), np.array([-0.7, 0.9]), 10)
    got = {r.doc_id: r for r in O.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, 2, 0.4).collect()}
    for i, text in enumerate(texts):
        dense = np.zeros(len(model.weights))
        places, values = O.features(text, 10)
        for place, value in zip(places.tolist(), values.tolist()):
            dense[place] += value
        s = sum(w * x for w, x in zip(model.weights.tolist(), dense.tolist()))
        tails = [1 / (1 + np.exp(cut - s)) for cut in (-0.7, 0.9)]
        chances = [1 - tails[0], tails[0] - tails[1], tails[1]]  # of each grade
        r = got[i]
        assert np.allclose([r.score, r.expected_grade, r.p_clean, r.p_good], [s, chances[1] + 2 * chances[2], tails[0], tails[1]], atol=1e-5) and r.selected == (tails[1] >= 0.4)
