"""Properties and small golden cases of the audit operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.functions import arrays as A
from cohortlens.functions import cells
from cohortlens.operators import audits, confident, contracts, neighbors, structured
from cohortlens.functions import labels
from cohortlens.operators.training import IssueCleaner, TargetCleaner, best_of, estimates_from_features, folds, out_of_fold_multilabel_probs, out_of_fold_predictions, steps_beside
from cohortlens.plans import lab, show
from cohortlens.sources import dataset
from cohortlens.streaming.inspector import StreamAudit, audit_file, quality_scores

PROBS = "id bigint, label int, pred_probs array<double>"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1e4), min_size=1, max_size=12))
def test_rounding_keeps_the_sum(values):
    got = cells.whole_with_sum(values)
    assert got.sum() == np.rint(np.sum(values)) and (np.abs(got - np.array(values)) <= 1.5).all()


def test_rounding_ties():
    assert cells.whole_with_sum([0.5, 0.5]).tolist() == [0, 1]
    assert cells.whole_with_sum([1.5, 1.5]).tolist() == [1, 2]


def test_calibration_keeps_counts():
    got = cells.calibrated(np.array([[5, 1], [2, 7]]), np.array([60, 40]))
    assert got.sum(axis=1).tolist() == [60, 40]


def test_latent_round_trip():
    py, noise, inverse = cells.latent(np.array([[40, 5], [10, 45]]))
    assert np.allclose(noise.sum(axis=0), 1) and np.allclose(inverse.sum(axis=0), 1) and np.isclose(py.sum(), 1)
    assert np.allclose(cells.latent(np.array([[40, 5], [10, 45]]), converge=True)[1].sum(axis=0), 1)
    for m in ("eqn", "marginal", "marginal_ps"):
        assert np.isclose(cells.latent(np.array([[40, 5], [10, 45]]), m)[0].sum(), 1)


def noisy(spark, n=600, k=3, seed=0):
    r = np.random.default_rng(seed)
    true = r.integers(0, k, n)
    given_ = np.where(r.random(n) < 0.1, (true + 1) % k, true)
    p = r.random((n, k)) * 0.4
    p[np.arange(n), true] += 1
    p /= p.sum(axis=1, keepdims=True)
    return spark.createDataFrame([(i, int(given_[i]), p[i].tolist()) for i in range(n)], PROBS), set(np.flatnonzero(true != given_).tolist())


def test_issues_are_found(spark):
    df, wrong = noisy(spark)
    confident.validate(df)
    for policy in ("prune_by_noise_rate", "prune_by_class", "both", "confident_learning", "predicted_neq_given", "low_self_confidence", "low_normalized_margin"):
        got = {r["id"] for r in confident.find_label_issues(df, policy).where("is_label_issue").collect()}
        # policies by confidence only report rows that reach a class threshold, the mean of that class
        least = 0.6 if policy in ("confident_learning", "low_self_confidence", "low_normalized_margin") else 0.8
        assert len(got & wrong) >= least * len(wrong) and len(got - wrong) <= 0.1 * len(wrong) + 2, policy
    some = confident.find_label_issues(df, num_to_remove_per_class=[3, 4, 5]).where("is_label_issue").count()
    assert some <= 12
    half = confident.find_label_issues(df, frac_noise=0.5).where("is_label_issue").count()
    assert 0 < half < len(wrong)
    assert confident.health_summary(df)["score"] > 0.85
    with pytest.raises(ValueError):
        confident.validate(df.withColumn("label", F.lit(9)))


def test_missing_class(spark):
    df = spark.createDataFrame([(1, 0, [0.9, 0.1, 0.0]), (2, 1, [0.2, 0.8, 0.0])], PROBS)
    assert confident.thresholds(df)[2] == confident.ABSENT
    assert confident.confident_joint(df).shape == (3, 3)


def test_arrays(spark):
    r = spark.sql("select array(0.1D, 0.9D, 0.5D) s, array(0.0D, 1.0D) z").select(
        A.softmin(F.col("s"), 0.0).alias("m"), A.softmin(F.col("s"), 0.05).alias("f"), A.moving_average(F.col("s"), 0.8).alias("e"), A.normalized_entropy(F.col("z")).alias("h"),
        structured.merged_probs(F.col("s"), [0, -1, 0]).alias("g"), structured.one_hot(F.array(F.lit(2)), 3).alias("o"), structured.label_list(F.array(F.lit(0), F.lit(1))).alias("l"),
    ).first()
    assert r.m == 0.1 and 0.1 <= r.f < 0.11 and abs(r.e - ((0.9 * 0.2 + 0.5 * 0.8) * 0.2 + 0.1 * 0.8)) < 1e-12 and r.h == 0
    assert r.g == [1.0] and r.o == [0, 0, 1] and r.l == [1]


def test_exact_copies_are_nearest(spark):
    df = spark.createDataFrame([(i, [float(i // 2), 1.0]) for i in range(8)], "id bigint, features array<double>")
    e = {(r["i"], r["rank"]): (r["j"], r["d"]) for r in neighbors.knn_edges(df, 2).collect()}
    assert e[0, 1] == (1, 0.0) and e[5, 1] == (4, 0.0) and len(e) == 16
    assert neighbors.knn_edges(df.limit(0)).count() == 0


def test_blocks_agree(spark, monkeypatch):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(i, r.normal(size=5).tolist()) for i in range(60)], "id bigint, features array<double>")
    one = sorted(map(tuple, neighbors.knn_edges(df, 3).select("i", "rank", "j").collect()))
    monkeypatch.setattr(neighbors, "BLOCK", 7)
    assert sorted(map(tuple, neighbors.knn_edges(df, 3).select("i", "rank", "j").collect())) == one


def test_approximate_neighbours(spark):
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(150, 16)), 12, axis=0) + r.normal(size=(1800, 16)) * 0.3
    x[:500] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    pairs = lambda e: {(q.i, round(q.d, 9), q.j if q.d > 1e-9 else -1) for q in e.collect()}
    exact, near = pairs(neighbors.knn_edges(df, 5)), pairs(neighbors.approximate_edges(df, 5, leaf=200))
    assert len(exact & near) >= 0.9 * len(exact)
    assert pairs(neighbors.approximate_edges(df.where("id >= 1700"), 3)) == pairs(neighbors.knn_edges(df.where("id >= 1700"), 3))


def test_noise(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(200)], "id bigint, label int")
    m = np.array([[0.9, 0.2], [0.1, 0.8]])
    got = audits.noisy_labels(df, m).where("label <> noisy").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 10, 1: 20}
    assert audits.noise_matrix_is_valid(m, np.array([0.5, 0.5])) and not audits.noise_matrix_is_valid(m[::-1], np.array([0.5, 0.5]))


def test_random_noise_matrix():
    m = audits.random_noise_matrix(4, 3.0, seed=2)
    assert np.isclose(np.trace(m), 3) and np.allclose(m.sum(axis=0), 1) and audits.noise_matrix_is_valid(m, np.full(4, 0.25))
    clean = cells.without_noise(m, 1)
    assert clean[1, 1] == 1 and np.allclose(clean.sum(axis=0), 1)


def test_vote_ties(spark):
    v = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 0), (2, "b", 0), (3, "a", 0)], "task_id bigint, annotator_id string, label int")
    got = {r["task_id"]: r["consensus"] for r in audits.majority_vote(v).collect()}
    assert got == {1: 1, 2: 0, 3: 0}  # the tie goes to the rarer class
    assert dataset.long_to_wide(v).count() == 3


def test_streaming_equals_batch(spark, tmp_path):
    df, _ = noisy(spark)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    one = StreamAudit(3)
    q = one.watch(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), checkpoint=str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert np.allclose(one.thresholds(), confident.thresholds(df))
    scores = one.score(df)
    assert one.issues == confident.batched_issue_count(df) and one.issue_ids(scores).count() == one.issues
    with pytest.raises(ValueError):
        StreamAudit(3).thresholds()
    stored = StreamAudit(3, calibrated=True)
    stored.watch(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), scores_path=str(tmp_path / "scores")).awaitTermination(120)
    assert stored.issues == confident.batched_issue_count(df, calibrated=True) and quality_scores(spark, str(tmp_path / "scores")).count() == df.count()
    found = {r["id"] for r in audit_file(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert found <= {r["id"] for r in one.issue_ids(scores).collect()} and len(found) > 10


def test_training(spark):
    r = np.random.default_rng(3)
    true = r.integers(0, 2, 240)
    x = r.normal(size=(240, 2)) + 4 * true[:, None]
    given_ = np.where(np.arange(240) % 15 == 0, 1 - true, true)
    df = spark.createDataFrame([(i, int(given_[i]), x[i].tolist()) for i in range(240)], "id bigint, label int, features array<double>")
    c = IssueCleaner(n_folds=3)
    got = {q["id"] for q in c.find_label_issues(df).where("is_label_issue").collect()}
    assert len(got & set(range(0, 240, 15))) >= 12 and len(got) <= 22
    assert c.fit(df).score(df.withColumn("label", F.lit(None).cast("int")).drop("label").join(spark.createDataFrame([(i, int(true[i])) for i in range(240)], "id bigint, label int"), "id")) > 0.97
    assert folds(df, 3).groupBy("fold").count().count() == 3
    reg = spark.createDataFrame([(i, float(2 * i), [float(i)]) for i in range(60)], "id bigint, y double, features array<double>")
    assert out_of_fold_predictions(reg, 3).agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 1e-3


def test_lab(spark, tmp_path):
    df, wrong = noisy(spark, 200)
    r = np.random.default_rng(1)
    vec = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(200)], "id bigint, features array<double>")

    @lab.register("odd_id")
    def _(d):
        return d.select("id", F.lit(0.5).alias("score"), (F.col("id") % 2 == 1).alias("is_odd_id_issue"))

    one = lab.Lab(df.join(vec, "id")).find_issues()
    assert set(one.summary) == {"null", "label", "outlier", "near_duplicate", "non_iid", "class_imbalance", "underperforming_group", "odd_id"} and not one.failed
    assert one.summary["odd_id"] == (0.5, 100) and one.get_issues("label").columns == ["id", "is_label_issue", "label_score", "given_label", "predicted_label"]
    assert "label" in one.report() and 0 <= one.health_score() <= 1 and one.get_issue_summary().count() == 8
    assert lab.Lab(df).find_issues({"near_duplicate": {}}).failed
    dataset.save(str(tmp_path / "a"), one.issues, one.get_issue_summary(), {"task": "classification"}, df)
    issues, summary, info = dataset.restore(spark, str(tmp_path / "a"), df)
    assert issues.count() == 200 and info["rows"] == 200
    with pytest.raises(ValueError):
        dataset.restore(spark, str(tmp_path / "a"), df.limit(3))
    with pytest.raises(Exception, match="(?i)exists"):
        dataset.save(str(tmp_path / "a"), one.issues, one.get_issue_summary(), {}, df)


def test_loading(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "x.json").write_text('{"a": 1}\n')
    assert dataset.load(spark, str(tmp_path / "x.csv")).count() == 2 and dataset.load(spark, str(tmp_path / "x.json")).first()["a"] == 1
    assert dataset.load(spark, {"a": [1, 2]}).count() == 2 and dataset.load(spark, [{"a": 1}]).count() == 1
    with pytest.raises(ValueError):
        dataset.load(spark, "x.unknown")
    (tmp_path / "x.txt").write_text("one\ntwo\n")
    assert [r[0] for r in dataset.load(spark, str(tmp_path / "x.txt")).collect()] == ["one", "two"]
    for kind in ("orc", "parquet"):
        spark.range(3).write.format(kind).save(str(tmp_path / f"y.{kind}"))
        assert dataset.load(spark, str(tmp_path / f"y.{kind}")).count() == 3


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_contracts(spark):
    ok = spark.createDataFrame([(0, 0, [0.6, 0.4]), (1, 1, [0.1, 0.9])], "id long, label int, pred_probs array<double>")
    assert contracts.class_probabilities(ok, 2) is ok
    for row in ((2, 2, [0.5, 0.5]), (2, 0, [0.5, 0.2]), (2, 0, [1.5, -0.5]), (2, 0, None), (2, None, [0.5, 0.5]), (2, 0, [0.5, None])):
        with pytest.raises(ValueError, match="rows by reason"):
            contracts.class_probabilities(ok.union(spark.createDataFrame([row], ok.schema)), 2)
    votes = "task_id long, annotator_id long, label int"
    contracts.crowd(spark.createDataFrame([(1, 1, 0), (1, 2, 0)], votes))
    assert contracts.some_agreement(spark.createDataFrame([(1, 1, 0), (1, 2, 0)], votes))
    for rows in ([(1, 1, 0), (2, 1, 0)], [(1, 1, 0), (2, 2, 0)], [(1, 1, 0), (1, 1, 1), (1, 2, 0)], [(1, 1, -1), (1, 2, 0)]):
        with pytest.raises(ValueError):
            contracts.crowd(spark.createDataFrame(rows, votes))
    with pytest.raises(ValueError):
        contracts.aggregation_weights(0.5, 0.6, -0.1)
    with pytest.raises(ValueError):
        contracts.class_labels(spark.createDataFrame([(0,), (2,)], "label int"), allow_missing=False)
    with pytest.raises(ValueError):
        contracts.regression(spark.createDataFrame([(1.0, float("nan"))], "y double, prediction double"))


def test_order_test_tells_sorted_from_shuffled(spark):
    r = np.random.default_rng(1)
    n = 300
    x = r.normal(size=(n, 5))
    drift = x + np.arange(n)[:, None] / 10
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "id long, features array<double>")
    found = {}
    for name, m in (("shuffled", x), ("sorted", drift)):
        e = neighbors.knn_edges(frame(m), 10, "euclidean").persist()
        found[name] = neighbors.order_test(e, n)
        # The plain statistic: positions in the sorted distances against the share of pairs up to each.
        d = np.sort(np.array([abs(a.i - a.j) for a in e.collect()]))
        background = np.cumsum((n - np.arange(1, n)) / (n * (n - 1) / 2))
        assert found[name][0] == pytest.approx(np.abs(np.arange(len(d)) / len(d) - background[d - 1]).max(), abs=1e-9)
    assert found["sorted"][1] < 0.01 < 0.05 < found["shuffled"][1]
    assert neighbors.order_test(e.limit(0), 0) == (0.0, 1.0)


def test_density_clusters_of_two_chains_and_noise(spark):
    rows = [(i, [float(i), 0.0]) for i in range(40)] + [(100 + i, [float(i), 50.0]) for i in range(30)] + [(500, [500.0, 500.0])]
    v = spark.createDataFrame(rows, "id long, features array<double>")
    got = {r.id: r.cluster for r in neighbors.density_clusters(neighbors.knn_edges(v, 4), v, 1.5, 3).collect()}
    assert {got[i] for i in range(40)} == {min(got[i] for i in range(40))} and got[500] == -1
    assert {got[100 + i] for i in range(30)} == {min(got[100 + i] for i in range(30))} and got[0] != got[100]


def test_cells_stand_for_points(spark, monkeypatch):
    r = np.random.default_rng(3)
    y = r.normal(size=3000)
    e = r.normal(size=3000) * 0.1
    e[:30] += 5
    df = spark.createDataFrame([(i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(y, e, strict=True))], "id long, y double, prediction double")
    scores = lambda: np.array([x.label_quality for x in audits.outlying_residual_scores(df).orderBy("id").collect()])
    exact = scores()
    assert set(np.argsort(exact)[:30]) == set(range(30))
    pts = np.stack([(y - y.mean()) / y.std(), 5 * (e - e.mean()) / e.std()], axis=1)
    plain = np.array([np.sort(np.hypot(*(pts - q).T))[:1500].mean() for q in pts])
    assert np.allclose(exact, np.exp(-plain / np.median(plain)))
    in_cells = np.array([x.label_quality for x in audits.outlying_residual_scores(df, cells=True).orderBy("id").collect()])
    assert np.abs(in_cells - exact).max() < 0.01
    assert audits.outlying_residual_scores(df.limit(0)).count() == 0
    monkeypatch.setattr(audits, "MOST_POINTS", 100)
    with pytest.raises(ValueError, match="cells"):
        scores()


def test_lab_with_other_inputs(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(240):
        c = i % 2
        p = 0.9 if i >= 24 else 0.02
        rows.append((i, c, [p, 1 - p] if c == 0 else [1 - p, p], [float(v) for v in r.normal(size=2) * 0.1 + (50 if i < 24 else 5 * c)]))
    df = spark.createDataFrame(rows, "id long, label int, pred_probs array<double>, features array<double>")
    one = lab.Lab(df).find_issues({"underperforming_group": {"clustering": {"eps": 1.0}}, "non_iid": {}})
    assert not one.failed
    worst = {x.id for x in one.get_issues("underperforming_group").where("is_underperforming_group_issue").collect()}
    assert worst and worst <= set(range(24)) and one.summary["underperforming_group"][0] < 0.1
    assert one.summary["non_iid"][1] == (1 if one.summary["non_iid"][0] < 0.05 else 0)
    only = lab.Lab(df.drop("pred_probs"))
    assert "label" in only.available() and "underperforming_group" not in only.available()
    assert not only.find_issues({"label": {}}).failed
    probs = lab.Lab(df.drop("features"))
    assert {"label", "outlier", "non_iid"} <= set(probs.available())
    assert not probs.find_issues({"outlier": {}}).failed


def test_regression_learning(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(400, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + r.normal(size=400) * 0.05
    wrong = set(r.choice(400, 24, replace=False).tolist())
    given = [float(v + 6) if i in wrong else float(v) for i, v in enumerate(y)]
    df = spark.createDataFrame([(i, given[i], x[i].tolist()) for i in range(400)], "id bigint, y double, features array<double>")
    one = TargetCleaner(n_folds=3, n_boot=2)
    rows = one.find_label_issues(df, (0.01, 0.06, 0.2), 1).collect()
    flagged = {a.id for a in rows if a.is_label_issue}
    assert len(rows) == 400 and len(flagged) == np.ceil(400 * one.k) > 0
    assert len(flagged & wrong) >= 0.9 * min(len(flagged), len(wrong))
    assert {a.id for a in sorted(rows, key=lambda a: a.label_quality)[:20]} <= wrong
    clean = spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(400)], df.schema)
    plain = TargetCleaner()
    plain.issues = one.issues.withColumn("is_label_issue", F.lit(False))
    assert one.fit(df).score(clean) > plain.fit(df).score(clean) and one.predict(df).count() == 400
    with pytest.raises(ValueError):
        TargetCleaner().find_label_issues(df.limit(3))


def test_crowd_labels_without_overlap_or_with_agreement(spark):
    votes = "task_id long, annotator_id long, label int"
    probs = spark.createDataFrame([(i, [0.7, 0.3]) for i in range(1, 5)], "task_id long, pred_probs array<double>")
    single = spark.createDataFrame([(1, 1, 0), (2, 2, 1)], votes)
    got = {r.task_id: r.score for r in audits.active_learning_scores(single, probs, 2).collect()}
    assert got == pytest.approx({1: (0.7 * 2 + 0.5) / 3, 2: (0.3 * 2 + 0.5) / 3, 3: (0.7 + 0.5) / 2, 4: (0.7 + 0.5) / 2})
    both = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 1, 1), (2, 2, 1), (3, 3, 0)], votes)
    crowd = audits.crowd_labels(both, probs, 2, quality="agreement")
    rows = {r.task_id: r for r in crowd.labels.collect()}
    assert rows[1].consensus == 0 and rows[1].consensus_quality == pytest.approx(2 / 3) and rows[2].consensus_quality == 1.0
    quality = {r.annotator_id: r.annotator_quality for r in audits.annotator_quality(both, crowd).collect()}
    assert quality == pytest.approx({1: 1.0, 2: 1.0, 3: 0.0})
    with pytest.raises(ValueError):
        audits.crowd_labels(both, probs, 2, consensus="none")


def test_refined_noise_matrix_is_the_plain_iteration():
    joint = np.array([[50.0, 4, 2], [6, 40, 3], [1, 9, 60]])
    py, noise, inverse = cells.latent(joint, converge=True)
    ps = joint.sum(axis=1) / joint.sum()
    clip = lambda m: (lambda x: x / x.sum(axis=0))(np.where(np.eye(3, dtype=bool), m, np.clip(m, 0, 0.9999)))
    n, v = clip(joint / joint.sum(axis=0)), clip((joint / joint.sum(axis=1, keepdims=True)).T)
    p = np.diagonal(v) / np.diagonal(n) * ps
    p /= p.sum()
    for _ in range(3):
        for _ in range(5):
            v = clip((n * p).T / ps)
            p = np.diagonal(v) / np.diagonal(n) * ps
            p /= p.sum()
        n = clip((v * ps).T / p)
    assert np.allclose(py, p) and np.allclose(noise, n) and np.allclose(inverse, v)


def test_quotas_keep_rows_of_each_class():
    joint = np.array([[5, 3, 2], [1, 50, 4], [0, 6, 70]])
    got = cells.prune_quotas(joint, 8)
    assert got[0, 0] == 8 and got[1, 1] == 50
    assert got[:, 0].sum() <= joint[0].sum() and (got >= 0).all()
    half = cells.prune_quotas(joint, 1, 0.5)
    assert (half[~np.eye(3, dtype=bool)] == np.trunc(joint.T[~np.eye(3, dtype=bool)] / 2)).all()
    wanted = np.array([2, 3, 4])
    removed = cells.quotas_for_removals(got, joint.sum(axis=1), wanted)
    assert (removed.sum(axis=1) - np.diagonal(removed)).tolist() == wanted.tolist()
    assert cells.quotas_for_removals(np.diag([3, 4]), np.array([3, 4]), np.array([1, 0])).tolist() == [[2, 0], [0, 4]]


def test_small_matrix_helpers():
    assert np.isnan(cells.pu_f1(0, 0, 3, 5)) and np.isnan(cells.pu_f1(0, 2, 0, 5)) and cells.pu_f1(2, 4, 2, 8) == 0.5
    noise = np.array([[0.9, 0.2], [0.1, 0.8]])
    ps, py, inverse = cells.prior_and_inverse(np.array([55, 45]), noise)
    assert np.allclose(noise @ py, ps) and np.allclose(inverse.sum(axis=0), 1)
    assert cells.as_text(noise).splitlines()[1].split() == ["s=0", "0.9", "0.2"]
    assert best_of([1, 2, 3], lambda x: -abs(x - 2)) == (0, 2) and best_of([1, 3], lambda x: 0.0)[1] == 1
    assert np.allclose(steps_beside([0.0, 1.0, 3.0], 1.0, 1), [0.5, 2.0]) and steps_beside([0.5], 0.5, 3) == [] and np.allclose(steps_beside([0.0, 1.0], 0.0, 3), [0.25, 0.5, 0.75])


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 8), st.floats(0, 1), st.integers(0, 50))
def test_random_shares(n, part, seed):
    total = n * 0.1 + part * n * 0.6
    x = audits.shares_of(total, n, 0.1, 0.7, seed)
    assert np.isclose(x.sum(), total) and (x >= 0.1 - 1e-9).all() and (x <= 0.7 + 1e-9).all()
    b = audits.balls_in_bins(3 * n, n, 1, 5, seed)
    assert b.sum() == 3 * n and b.min() >= 1 and b.max() <= 5
    with pytest.raises(ValueError):
        audits.balls_in_bins(6 * n, n, 1, 5)
    with pytest.raises(ValueError):
        audits.shares_of(n * 0.8, n, 0.1, 0.7)


def test_unsupported_policies(spark):
    df, _ = noisy(spark, 60)
    for policy in ("confident_learning", "predicted_neq_given", "low_self_confidence", "low_normalized_margin"):
        with pytest.raises(ValueError, match="remove"):
            confident.find_label_issues(df, policy, num_to_remove_per_class=[1, 1, 1])
    with pytest.raises(ValueError, match="unknown"):
        confident.find_label_issues(df, "none")
    assert confident.num_label_issues(df, "off_diagonal_custom", np.diag([20, 20, 20])) == 0
    for bad in ("off_diagonal_custom", "none"):
        with pytest.raises(ValueError):
            confident.num_label_issues(df, bad)


def test_first_of_equals_a_window(spark):
    r = np.random.default_rng(4)
    rows = [(i, int(i % 3), float(np.round(r.random() ** 3, 2)), int((i % 3) * 40)) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, k int, s double, q int")
    got = {x.id for x in confident.first_of(df, ["k"], [F.col("s"), F.col("id")], F.col("s"), "q").collect()}
    want = set()
    for k in range(3):
        want |= {x[0] for x in sorted((x for x in rows if x[1] == k), key=lambda x: (x[2], x[0]))[: k * 40]}
    assert got == want and confident.lowest(df, "s", 0).count() == 0 and confident.lowest(df, "s", 5000).count() == 900


def test_label_coding_keeps_nulls_and_order(spark, monkeypatch):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "c"), (5, "a")], "id int, v string")
    coded, names = dataset.encode_labels(df, "v")
    assert {x.id: x["__label"] for x in coded.collect()} == {1: 1, 2: None, 3: 0, 4: 2, 5: 0} and {x.value: x.id for x in names.collect()} == {"a": 0, "b": 1, "c": 2}
    many = spark.range(5000).selectExpr("cast(id * 7919 % 5000 as string) as v")
    assert [x.id for x in labels.numbered_values(many, "v").orderBy("value").collect()] == list(range(5000))
    lists = spark.createDataFrame([(1, ["x", "b"]), (2, []), (3, None), (4, ["a", None])], "id int, v array<string>")
    coded, _ = dataset.encode_label_lists(lists, "v")
    assert {x.id: x["__labels"] for x in coded.collect()} == {1: [2, 1], 2: [], 3: None, 4: [0, None]}


def test_more_contracts(spark):
    df = spark.createDataFrame([(1, [2.0], "3", ["x"])], "id int, a array<double>, t string, w array<string>")
    assert contracts.numeric_column(df, "a").first().a == 2.0 and contracts.numeric_column(df, "t").first().t == 3.0
    with pytest.raises(ValueError):
        contracts.numeric_column(df, "missing")
    with pytest.raises(Exception, match="(?i)invalid|cast"):
        contracts.numeric_column(df.withColumn("t", F.lit("x")), "t")
    with pytest.raises(ValueError):
        contracts.label_lists(df, "w")
    ok = spark.createDataFrame([(1, [0, 2])], "id int, labels array<int>")
    assert contracts.label_lists(ok) is ok
    p = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.1, 0.9])], "task_id int, pred_probs array<double>")
    assert contracts.crowd_probabilities(p) == 2 == contracts.crowd_probabilities(None, p)
    for bad in ((None, None), (p, p.select("task_id", F.array(F.lit(1.0)).alias("pred_probs")))):
        with pytest.raises(ValueError):
            contracts.crowd_probabilities(*bad)
    f = spark.createDataFrame([(1, [1.0], 2.0)], "id int, features array<double>, y double")
    assert contracts.features(f) is f
    with pytest.raises(ValueError):
        contracts.features(f.unionByName(f.withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))))
    assert contracts.method("a", ("a", "b")) == "a"
    with pytest.raises(ValueError):
        contracts.method("c", ("a", "b"))
    px = spark.createDataFrame([(1, 0, 0, 0, [0.5, 0.5])], "image_id int, y int, x int, label int, pred_probs array<double>")
    assert contracts.pixel_classes(px) is px
    for bad in (px.union(px), px.withColumn("label", F.lit(2))):
        with pytest.raises(ValueError):
            contracts.pixel_classes(bad)
    with pytest.raises(ValueError):
        structured.shrunk(px, 2)


def test_models_of_many_labels_and_noise(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(150, 2))
    bits = [[int(a > 0), int(b > 0)] for a, b in x]
    df = spark.createDataFrame([(i, bits[i], x[i].tolist()) for i in range(150)], "id bigint, bits array<int>, features array<double>")
    got = out_of_fold_multilabel_probs(df, 3).collect()
    assert len(got) == 150 and np.mean([(np.array(g.probs) > 0.5) == np.array(g.bits) for g in got]) > 0.9
    one = spark.createDataFrame([(i, bits[i][0], x[i].tolist()) for i in range(150)], "id bigint, label int, features array<double>")
    found = estimates_from_features(one, 3)
    assert np.allclose(found["noise_matrix"].sum(axis=0), 1) and np.allclose(found["inverse_noise_matrix"].sum(axis=0), 1) and np.isclose(found["py"].sum(), 1) and found["pred_probs"].count() == 150
    c = IssueCleaner(n_folds=3)
    c.given_issues(spark.createDataFrame([(0,), (1,)], "id bigint"))
    assert c.fit(one).get_label_issues().count() == 2 and c.score(one) > 0.9
    c.save_space()
    assert c.get_label_issues() is None and c.model is not None
    with pytest.raises(ValueError):
        c.given_issues(spark.createDataFrame([(0,)], "x int"))


def test_lab_reuses_neighbours_and_tells_more(spark):
    df, _ = noisy(spark, 120)
    r = np.random.default_rng(1)
    x = r.normal(size=(120, 4))
    x[7] = x[3]
    vec = spark.createDataFrame([(i, x[i].tolist(), float(i % 50 == 0) * 0.9, i) for i in range(120)], "id bigint, features array<double>, dark double, row int")
    data = df.join(vec, "id")
    edges = neighbors.knn_edges(vec, 12)
    one = lab.Lab(data, k=10, edges=edges, properties={"dark": 0.5})
    assert one._edges and one.statistics() == {"num_examples": 120, "num_classes": 3}
    assert not lab.Lab(data, k=20, edges=edges)._edges
    one.find_issues({"near_duplicate": {"threshold": 0.001}, "label": {}, "class_imbalance": {}, "identifier_column": {"columns": ["row"]}, "spurious_correlations": {}, "image_property": {"max_prevalence": 0.99}})
    assert not one.failed
    near = {q.id: q for q in one.get_issues("near_duplicate").collect()}
    assert near[3].near_duplicate_set == [7] and near[7].near_duplicate_set == [3] and near[3].distance_to_nearest_neighbor == 0
    assert {"given_label", "predicted_label"} <= set(one.get_issues("label").columns) and "given_label" in one.get_issues("class_imbalance").columns
    assert one.get_info("identifier_column") == {"identifier_columns": ["row"]} and one.summary["identifier_column"] == (0.0, 1)
    assert one.get_issues("image_property").where("is_image_property_issue").count() == 117 and "spurious_correlations" in one.report(verbosity=1, include_description=True)
    assert "near_duplicate: 2" in repr(one)
    bad = lab.Lab(data.withColumn("label", F.lit(9)))
    with pytest.raises(ValueError):
        bad.find_issues()

    @lab.register("too_high", description="a score that is none")
    def _(d):
        return d.select("id", F.lit(2.0).alias("score"), F.lit(True).alias("is_too_high_issue"))

    try:
        assert "between 0 and 1" in lab.Lab(data).find_issues({"too_high": {}}).failed["too_high"]
    finally:
        lab._CUSTOM.pop(("classification", "too_high"))
        lab._CUSTOM.pop(("classification", "odd_id"), None)
    with pytest.raises(ValueError):
        one.get_issues("none")
    with pytest.raises(ValueError):
        lab.Lab(data, "none")


def test_outlier_scores_of_a_table_of_copies(spark):
    """With a median distance of 0 a small distance is no outlier: the scale has a floor."""
    rows = [(i, [1.0, 1.0]) for i in range(12)] + [(20, [1.0, 1.0 + 1e-7])]
    e = neighbors.knn_edges(spark.createDataFrame(rows, "id bigint, features array<double>"), 3)
    score = {r.id: r.score for r in neighbors.outliers(e, metric="euclidean").collect()}
    assert score[0] == 1.0 and score[20] > 0.85
    with pytest.raises(ValueError):
        neighbors.OutlierDetector().score(e)
    odd = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 2.0]), (5, [None, 1.0])], "id bigint, features array<double>")
    assert {(r.i, r.j) for r in neighbors.knn_edges(odd, 3).collect()} == {(1, 4), (4, 1)}


def test_shown_results(spark):
    assert len(set(show.colours(12))) == 12 and all(len(c) == 7 and c[0] == "#" for c in show.colours(3))
    assert show.bars([("a", 1), ("bb", 4)], 8).splitlines() == ["bb ######## 4", "a  ## 1"]
    boxes = spark.createDataFrame([(1, 0, 1.0, 2.0, 5.0, 6.0, 0)], "image_id int, box_id int, x1 double, y1 double, x2 double, y2 double, label int")
    svg = show.boxes_svg(boxes, boxes.withColumn("p", F.lit(0.9)), 1, (10, 10), names=["<cat>"])
    assert svg.count("<rect") == 2 and "&lt;cat&gt; 0.90" in svg and "stroke-dasharray" in svg
    px = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 1)], "image_id int, y int, x int, label int")
    svg = show.pixels_svg(px, px.where("x = 1").select("image_id", "y", "x"), 1)
    assert svg.count("<rect") == 2 and svg.count('stroke="red"') == 1
    assert show.class_share_bars(structured.box_class_share(boxes)).startswith("0 ")


def test_random_loading_errors(spark):
    with pytest.raises(ValueError):
        dataset.load(spark, 5)
    with pytest.raises(ValueError):
        dataset.load(spark, {"a": [1], "b": [1, 2]})


def test_exact_neighbours_shuffle_rows_once_a_group(spark, monkeypatch):
    """what is shuffled grows with the rows, not with their square; the lists are those of all pairs, copies included."""
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 8)).astype(np.float32).astype(float)
    x[300:340] = x[0]
    x[340:350] = 0
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    monkeypatch.setattr(neighbors, "GROUPS", 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>").repartition(5)
    found = neighbors.knn_edges(df, 7)
    assert found._written_once
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = 1 - unit @ unit.T
    d[(x[:, None] == x[None]).all(axis=2) & (d <= 1e-9)] = 0
    np.fill_diagonal(d, np.inf)
    got = {}
    for e in found.collect():
        got.setdefault(e.i, []).append((e.rank, e.j, e.d))
    assert len(got) == 600
    for i, e in got.items():
        e.sort()
        assert [z[0] for z in e] == list(range(1, 8))
        near = np.sort(d[i])[:7]
        assert np.allclose([z[2] for z in e], near, atol=1e-12)
        assert np.allclose([d[i, z[1]] for z in e], near, atol=1e-12)
        if 300 <= i < 340:
            assert [z[1] for z in e] == [0, *[c for c in range(300, 308) if c != i]][:7]
    assert neighbors.knn_edges(df, 7, base=df).where("rank = 1 and d > 0").count() == 10


def test_boxes_are_shuffled_once_by_image(spark):
    """F2, F7, F16, F17, F22: one shuffle by image, no shuffled pairs; hits as by a plain loop over boxes, with ties and null classes."""
    r = np.random.default_rng(3)

    def box(i, b):
        x, y = (float(v) for v in r.integers(0, 6, 2))
        return i, b, x, y, x + 5, y + 5, None if r.random() < 0.1 else int(r.integers(0, 2))

    own = [box(i, b) for i in range(400) for b in range(3)]
    guessed = [(*box(i, b), float(r.integers(4, 10)) / 10) for i in range(50, 450) for b in range(4)]
    kind = "image_id bigint, box_id bigint, x1 double, y1 double, x2 double, y2 double, label int"
    labels, predictions = spark.createDataFrame(own, kind), spark.createDataFrame(guessed, kind + ", p double")
    found = structured.images_with_boxes(labels, predictions)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

    def iou(a, b):
        w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return w * h / max(25.0 + 25.0 - w * h, 1e-6)

    want = {}
    for t in structured.IOU_STEPS:
        taken = {}
        for g in guessed:
            mine = [(iou(o, g), -o[1]) for o in own if o[0] == g[0] and o[6] is not None and o[6] == g[6]] if g[0] < 400 else []
            if mine and max(mine)[0] >= t:
                key = g[0], -max(mine)[1]
                taken[key] = max(taken.get(key, (-1, 0)), (g[7], -g[1]))
        for (i, _), (_, j) in taken.items():
            want.setdefault((i, -j), set()).add(t)
    got = {(x.image_id, x.pred_id): {t for b, t in enumerate(structured.IOU_STEPS) if x.hit >> b & 1} for x in structured.hit_rows(found).collect() if x.hit}
    assert got == want
    assert found.count() == 450
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        again = {(x.image_id, x.pred_id): x.hit for x in structured.hit_rows(structured.images_with_boxes(labels, predictions)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert again == {(x.image_id, x.pred_id): x.hit for x in structured.hit_rows(found).collect()}
    ap = {(x.t, x.label): x.ap for x in structured.average_precisions(labels, predictions).collect()}
    for t in structured.IOU_STEPS:
        for c in (0, 1):
            ordered = sorted((g for g in guessed if g[6] == c), key=lambda g: (-g[7], g[0], g[1]))
            hits = np.array([t in want.get((g[0], g[1]), ()) for g in ordered])
            precision = np.cumsum(hits) / np.arange(1, len(hits) + 1)
            envelope = np.maximum.accumulate(np.where(hits, precision, 0)[::-1])[::-1]
            assert abs(ap[t, c] - envelope[hits].sum() / sum(o[6] == c for o in own)) < 1e-12


def test_outlying_scores_by_tiles_are_those_of_all_pairs(spark):
    """only points of tiles at the rim of a row's circle are compared one by one; equal, lined-up and far points included."""
    r = np.random.default_rng(8)
    for points in (np.stack([r.uniform(0, 1, 9000), r.integers(0, 40, 9000) / 8], axis=1), np.concatenate([np.zeros((3000, 2)), r.normal(size=(3000, 2)) * [1, 1e-6], [[500.0, -500.0]]]), np.ones((700, 2))):
        tiles, last = audits.Tiles(points), None
        tile = tiles.tile_of(points[:, 0], points[:, 1])
        assert tile.min() >= 0 and tile.max() < len(tiles.starts)
        order = np.argsort(tile, kind="stable")
        for need in (1, len(points) // 2, len(points)):
            for at in range(0, len(order), 640):
                q = points[order[at : at + 64]]
                got, last = tiles.means(q, need, last if need > 1 and at else None)
                want = np.sort(audits._distances_to(q[:9], points), axis=1)[:, :need].mean(axis=1)
                assert np.allclose(got[:9], want, rtol=1e-10, atol=1e-12)
    assert len(audits.Tiles(r.normal(size=(9000, 2))).nodes) > 1


def test_weights_of_models_take_one_pass(spark):
    """more models make no more jobs; a task without probabilities counts for the mean number of labels."""
    votes = spark.createDataFrame([(t, a, (t + (a == 2 and t % 3 == 0)) % 2) for t in range(12) for a in range(1 + t % 3)], "task_id int, annotator_id int, label int").localCheckpoint()
    probs = spark.createDataFrame([(t, [0.8, 0.2] if t % 4 else [0.1, 0.9]) for t in range(11)], "task_id int, pred_probs array<double>").localCheckpoint()
    consensus = spark.createDataFrame([(t, t % 2) for t in range(11)], "task_id int, consensus int").localCheckpoint()
    probs = probs.selectExpr("task_id", "pred_probs as m0", "reverse(pred_probs) as m1", "pred_probs as m2")
    jobs = {}
    for k in (1, 3):
        spark.sparkContext.setJobGroup(f"models {k}", "")
        _, models, agree = audits.ensemble_weights(votes, probs, [f"m{i}" for i in range(k)], consensus)
        jobs[k] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"models {k}"))
    spark.sparkContext.setJobGroup("others", "")
    assert jobs[1] == jobs[3]
    several = [t for t in range(11) if t % 3]
    base = 1 - max(sum(t % 2 == c for t in several) for c in (0, 1)) / len(several)
    miss = sum((0 if t % 4 else 1) != t % 2 for t in several) / len(several)
    want = [max(1 - m / base, 1e-6) * np.sqrt(2.0) for m in (miss, 1 - miss, miss)]
    assert np.allclose(models, want) and agree == 1.0


def test_search_holds_one_tile_of_similarities():
    import tracemalloc

    rng = np.random.default_rng(11)
    x = rng.standard_normal((6000, 16)).astype(np.float32)
    x[4000:4020], x[5000] = x[:20], 0
    ids = rng.permutation(6000).astype(np.int64) * 3
    order = np.argsort(ids)
    search = neighbors._Search([(ids[:700], x[:700]), (ids[4000:5300], x[4000:5300])], 5, "cosine", True)
    tracemalloc.start()
    for n, at in enumerate(range(0, 6000, 1500)):
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        search.see([(ids[order[at : at + 1500]], x[order[at : at + 1500]])])
        peak = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert n == 3 and peak < 4 * 1024 * 1500  # all that a later block needs is less than its similarities to 1,024 rows
    got = {}
    for b in search.found():
        for i, j, d in zip(*(b.column(c).to_pylist() for c in ("i", "j", "d")), strict=True):
            got.setdefault(i, []).append((j, d))
    u = x.astype(np.float64) / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-300)
    own = np.r_[:700, 4000:5300]
    d = 1 - u[own] @ u.T
    d[(x[own][:, None, :2] == x[None, :, :2]).all(axis=2)] = 0
    d[np.arange(len(own)), own] = np.inf
    d = np.round(d, 12)
    for r, at in enumerate(own):
        want = sorted(zip(d[r].tolist(), ids.tolist()))[:5]
        assert [j for j, _ in got[ids[at]]] == [j for _, j in want]
        assert np.allclose([v for _, v in got[ids[at]]], [v for v, _ in want], atol=1e-9)
