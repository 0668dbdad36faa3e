"""Named queries over the test tables, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import cells, labels
from ..operators import audits, confident, neighbors, structured
from ..sources import fixtures as X
from . import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
K = 5


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _grid(spark: SparkSession, m: np.ndarray, kind: str = "bigint") -> DataFrame:
    rows = [(i, j, int(x) if kind == "bigint" else float(x)) for i, row in enumerate(m) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, f"given int, guess int, n {kind}")


@_query("label_thresholds", O.X1C + "select k, round(t, 6) as t from thr")
def _(s, d):
    return s.createDataFrame(list(enumerate(confident.thresholds(X.class_probs(s, d)))), "k int, t double").select("k", _r("t").alias("t"))


@_query("confident_joint", O.X1C + "select given, guess, c::bigint as n from raw")
def _(s, d):
    return _grid(s, confident.confident_joint(X.class_probs(s, d), calibrate=False))


@_query("calibrated_joint", O.X1C + "select given, guess, c::bigint as n from cal")
def _(s, d):
    return _grid(s, confident.confident_joint(X.class_probs(s, d)))


@_query("joint_distribution", O.X1C + "select given, guess, round(c::double / sum(c) over (), 6) as n from cal")
def _(s, d):
    return _grid(s, confident.estimate_joint(X.class_probs(s, d)), "double").select("given", "guess", _r("n").alias("n"))


@_query("num_label_issues", O.X1C + "select count(*)::bigint as n from guess join a using (id) where g <> a.label and not near")
def _(s, d):
    return s.createDataFrame([(confident.num_label_issues(X.class_probs(s, d)),)], "n bigint")


def _filter(name: str, filter_by: str, sql: str) -> None:
    @_query(name, sql)
    def _(s, d):
        return confident.find_label_issues(X.class_probs(s, d), filter_by)


_filter("issues_prune_by_noise_rate", "prune_by_noise_rate", O.X1C + O.BY_RATE + "select id, coalesce(hit, false) and not near as is_label_issue from a left join by_rate using (id)")
_filter("issues_prune_by_class", "prune_by_class", O.X1C + O.BY_CLASS + "select id, coalesce(hit, false) and not near as is_label_issue from a left join by_class using (id)")
_filter(
    "issues_both", "both",
    O.X1C + O.BY_RATE + O.BY_CLASS + "select id, by_rate.hit is not null and by_class.hit is not null and not near as is_label_issue from a left join by_rate using (id) left join by_class using (id)",
)
_filter("confident_flags", "confident_learning", O.X1C + "select a.id, coalesce(g <> a.label, false) and not near as is_label_issue from a join guess using (id)")
_filter("issues_pred_neq_given", "predicted_neq_given", O.X1C + "select id, am <> label and not near as is_label_issue from a")
for _name, _col in (("low_self_confidence", "own"), ("low_normalized_margin", "(own - other + 1) / 2")):
    _filter(
        f"issues_{_name}", _name,
        O.X1C + f"nn as (select count(*) n from guess join a using (id) where g <> a.label and not near), rk as (select id, row_number() over (order by {_col}, id) r from a) select id, r <= n as is_label_issue from rk, nn",
    )


@_query("issues_ranked", O.X1C + O.BY_RATE + "select id, round(own, 6) as score from a join by_rate using (id) where not near")
def _(s, d):
    return confident.find_label_issues(X.class_probs(s, d), rank_by="self_confidence").select("id", _r("score").alias("score"))


@_query("argmax_confusion", O.X1C + "select g.given, g.guess, coalesce(n, 0)::bigint as n from grid g left join (select label, am, count(*) n from a group by all) c on c.label = g.given and c.am = g.guess")
def _(s, d):
    return _grid(s, confident.argmax_confusion(X.class_probs(s, d), calibrate=False))


_H = "list_aggregate(list_transform(ps, lambda x: case when x > 0 then -x * ln(x) else 0 end), 'sum') / ln(5)"
for _name, _sql in (
    ("self_confidence", "own"),
    ("normalized_margin", "(own - other + 1) / 2"),
    ("confidence_weighted_entropy", f"ln({_H} / greatest(own, 1e-6) + 1) / greatest({_H} / greatest(own, 1e-6), 1e-6)"),
):

    @_query(f"score_{_name}", O.X1C + f"select id, round({_sql}, 6) as label_quality from a")
    def _(s, d, m=_name):
        return confident.label_quality(X.class_probs(s, d), m).select("id", _r("label_quality").alias("label_quality"))


@_query("score_adjusted", O.X1C + "ad as (select p.id, p.label, k, p.p - t + max(t) over () as q from p join thr using (k)) select id, round(sum(q) filter (k = label) / sum(q), 6) as label_quality from ad group by id")
def _(s, d):
    return confident.label_quality(X.class_probs(s, d), adjust=True).select("id", _r("label_quality").alias("label_quality"))


@_query("score_ensemble_uniform", O.X1C + "p2 as (" + O.X1P2 + ") select p.id, round((p.p + p2.p) / 2, 6) as label_quality from p join p2 on p.id = p2.id and p.k = p2.k where p.k = p.label")
def _(s, d):
    other = X.class_probs(s, d, 7907, 104723, "q").select("id", "q")
    return confident.ensemble_quality(X.class_probs(s, d).join(other, "id"), ["pred_probs", "q"]).select("id", _r("label_quality").alias("label_quality"))


@_query("score_ensemble_accuracy", O.X1C + "p2 as (" + O.X1P2 + "), acc as (select (select avg((am = label)::int) from a) w1, (select avg((am2 = label)::int) from (select id, any_value(label) label, arg_max(k, p) am2 from p2 group by id)) w2) select p.id, round((p.p * w1 + p2.p * w2) / (w1 + w2), 6) as label_quality from p join p2 on p.id = p2.id and p.k = p2.k, acc where p.k = p.label")
def _(s, d):
    other = X.class_probs(s, d, 7907, 104723, "q").select("id", "q")
    return confident.ensemble_quality(X.class_probs(s, d).join(other, "id"), ["pred_probs", "q"], weight="accuracy").select("id", _r("label_quality").alias("label_quality"))


@_query("class_quality", O.X1C + "j as (select given, guess, c::double / sum(c) over () x from cal), n as (select count(*) n from a), o as (select given k, sum(x) t, sum(x) filter (given <> guess) y from j group by 1), i as (select guess k, sum(x) t, sum(x) filter (given <> guess) y from j group by 1) select o.k as class, round_even(o.y * n, 0)::bigint as label_issues, round_even(i.y * n, 0)::bigint as inverse_label_issues, round(o.y / o.t, 6) as label_noise, round(i.y / i.t, 6) as inverse_label_noise, round(1 - o.y / o.t, 6) as label_quality from o join i using (k), n")
def _(s, d):
    return s.createDataFrame(confident.class_quality(X.class_probs(s, d)), "class int, label_issues bigint, inverse_label_issues bigint, label_noise double, inverse_label_noise double, label_quality double").select(
        "class", "label_issues", "inverse_label_issues", *[_r(c).alias(c) for c in ("label_noise", "inverse_label_noise", "label_quality")]
    )


@_query("overlapping_classes", O.X1C + "j as (select given, guess, c::double / sum(c) over () x from cal), n as (select count(*) n from a) select l.given as class_a, l.guess as class_b, round_even((l.x + r.x) * n, 0)::bigint as num_overlapping, round(l.x + r.x, 6) as joint_probability from j l join j r on l.given = r.guess and l.guess = r.given, n where l.given < l.guess")
def _(s, d):
    return s.createDataFrame(confident.overlapping_classes(X.class_probs(s, d)), "class_a int, class_b int, num_overlapping bigint, p double").select("class_a", "class_b", "num_overlapping", _r("p").alias("joint_probability"))


@_query("label_health", O.X1C + "select round(1 - (select count(*) from guess join a using (id) where g <> a.label and not near)::double / (select count(*) from a), 6) as score")
def _(s, d):
    return s.createDataFrame([(round(confident.health_score(X.class_probs(s, d)), 6),)], "score double")


@_query("noise_matrix", O.X1C + "select given, guess, round(c::double / sum(c) over (partition by guess), 6) as n from cal")
def _(s, d):
    _, noise, _, _ = confident.noise_estimates(X.class_probs(s, d), converge=False)
    return _grid(s, noise, "double").select("given", "guess", _r("n").alias("n"))


@_query("true_prior", O.X1C + "j as (select given, guess, c::double c, sum(c) over (partition by guess) cs, sum(c) over (partition by given) rs, sum(c) over () n from cal), e as (select given k, (c / rs) / (c / cs) * rs / n x from j where given = guess) select k, round(x / sum(x) over (), 6) as p from e")
def _(s, d):
    py, _, _ = cells.latent(confident.confident_joint(X.class_probs(s, d)))
    return s.createDataFrame([(k, round(float(p), 6)) for k, p in enumerate(py)], "k int, p double")


@_query("batched_issue_count", O.X1C + "select count(*)::bigint as n from a join thr on thr.k = a.am where am <> label and pm >= t - 1e-6")
def _(s, d):
    return s.createDataFrame([(confident.batched_issue_count(X.class_probs(s, d)),)], "n bigint")


for _name, _sql in (
    ("entropy", f"1 - {_H}"),
    ("least_confidence", "pm"),
    ("gen", "1 - list_aggregate(list_transform(ps, lambda x: pow(exp(x) / list_aggregate(list_transform(ps, lambda y: exp(y)), 'sum'), 1e-1) * pow(1 - exp(x) / list_aggregate(list_transform(ps, lambda y: exp(y)), 'sum'), 1e-1)), 'sum') / 100"),
):

    @_query(f"ood_{_name}", O.X1C + f"select id, round({_sql}, 6) as score from a")
    def _(s, d, m=_name):
        return confident.ood_from_probs(X.class_probs(s, d), m, adjust=False).select("id", _r("score").alias("score"))


def _vectors(s, d):
    return X._t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


@_query("knn_edges", O.KNN + "select i, rank::int as rank, j, round(d, 6) as d from e")
def _(s, d):
    return neighbors.knn_edges(_vectors(s, d)).select("i", "rank", "j", _r("d").alias("d"))


@_query("outlier_scores", O.KNN + "av as (select i as id, avg(d) x from e group by i), q as (select quantile_cont(x, 25e-2) q1, median(x) q2, quantile_cont(x, 75e-2) q3 from av) select id, round(x, 6) as avg_distance, round(exp(-x / q2), 6) as score, x > q3 + (1 / 37037e-5 - 1) * (q3 - q1) as is_outlier_issue from av, q")
def _(s, d):
    return neighbors.outliers(neighbors.knn_edges(_vectors(s, d))).select("id", _r("avg_distance").alias("avg_distance"), _r("score").alias("score"), "is_outlier_issue")


@_query("near_duplicates", O.KNN + "nn as (select i as id, d from e where rank = 1), m as (select median(d) m from nn), c as (select i, j from e, m where d < 9e-1 * m), s as (select i as id from c union select j from c) select nn.id, round(d, 6) as nn_distance, round(1 - exp(-d / m), 6) as score, s.id is not null as is_near_duplicate_issue from nn left join s on s.id = nn.id, m")
def _(s, d):
    return neighbors.near_duplicates(neighbors.knn_edges(_vectors(s, d)), 0.9).select("id", _r("nn_distance").alias("nn_distance"), _r("score").alias("score"), "is_near_duplicate_issue")


@_query("knn_shapley", O.KNN + "m as (select e.i, e.j, e.rank, (a.label = b.label)::int m from e join embeddings a on a.vec_id = e.i join embeddings b on b.vec_id = e.j), lk as (select i, m mk from m where rank = 10), sv as (select j, sum(m - mk) / (10e0 * (select count(*) from embeddings)) s from m join lk using (i) group by j) select vec_id as id, round(5e-1 * (coalesce(s, 0) + 1), 6) as score from embeddings left join sv on j = vec_id")
def _(s, d):
    v = _vectors(s, d)
    return neighbors.data_value(neighbors.knn_edges(v), v).select("id", _r("score").alias("score"))


@_query("knn_vote_share", O.KNN + "select i as id, " + ", ".join(f"round(avg((label = {c})::int), 6) as p{c}" for c in range(10)) + " from e join embeddings on vec_id = j group by i")
def _(s, d):
    v = _vectors(s, d)
    return neighbors.vote_probs(neighbors.knn_edges(v), v, 10).select("id", *[_r(F.col("pred_probs")[c]).alias(f"p{c}") for c in range(10)])


@_query("non_iid_ks", O.KNN + "n as (select count(*) n from embeddings), g as (select unnest(range(1, (select n from n))) g), c as (select abs(i - j) g, count(*) c from e group by 1), cum as (select g.g, sum(coalesce(c, 0)) over (order by g.g) / (select count(*) from e) s, sum(2e0 * (n - g.g)) over (order by g.g) / (n * (n - 1e0)) b from g left join c on c.g = g.g, n) select round(max(abs(s - b)), 6) as ks from cum")
def _(s, d):
    v = _vectors(s, d)
    return neighbors.order_effect(neighbors.knn_edges(v), v.count()).select(_r("ks").alias("ks"))


@_query("class_imbalance", "with c as (select lang, count(*) c from documents group by 1), t as (select sum(c) n, count(*) k from c), r as (select lang, c from c order by c, lang limit 1) select doc_id as id, case when d.lang = r.lang and r.c / n < 9e-1 / k then round(r.c / n, 6) else 1e0 end as score, d.lang = r.lang and r.c / n < 9e-1 / k as is_class_imbalance_issue from documents d, t, r")
def _(s, d):
    return audits.class_imbalance(X._t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label")), 0.9).select("id", _r("score").alias("score"), "is_class_imbalance_issue")


@_query("null_rows", f"with x as ({O.X7}) select id, round(((a is not null)::int + (b is not null)::int + (c is not null)::int) / 3e0, 6) as score, a is null and b is null and c is null as is_null_issue from x")
def _(s, d):
    return audits.null_rows(X.partial_nulls(s, d), ["a", "b", "c"]).select("id", _r("score").alias("score"), "is_null_issue")


@_query("null_patterns", f"with x as ({O.X7}), y as (select (a is null)::int || '' || (b is null)::int || '' || (c is null)::int as pattern from x) select pattern, count(*)::bigint as n from y where pattern <> '000' group by 1")
def _(s, d):
    return audits.null_patterns(X.partial_nulls(s, d), ["a", "b", "c"])


@_query("column_impact", f"with x as ({O.X7}) select 'a' as \"column\", round(avg((a is null)::int), 6) as null_share from x union all select 'b', round(avg((b is null)::int), 6) from x union all select 'c', round(avg((c is null)::int), 6) from x")
def _(s, d):
    return audits.column_impact(X.partial_nulls(s, d), ["a", "b", "c"]).select("column", _r("null_share").alias("null_share"))


@_query("identifier_columns", "select 'c_custkey' as \"column\", count(distinct c_custkey) = max(c_custkey) - min(c_custkey) + 1 as is_identifier from customer union all select 'c_nationkey', count(distinct c_nationkey) = max(c_nationkey) - min(c_nationkey) + 1 from customer")
def _(s, d):
    return audits.identifier_columns(X._t(s, d, "customer"))


@_query("underperforming_group", O.X1C + "s as (select a.id, own, c_mktsegment as cluster from a join orders on o_orderkey = a.id join customer on c_custkey = o_custkey), m as (select avg(own) m from s), gg as (select cluster, count(*)::bigint n, avg(own) x from s group by 1 having count(*) >= 5), r as (select cluster, n, x, least(x / m, 1) ratio from gg, m) select cluster, n, round(x, 6) as mean_own_prob, round(ratio, 6) as ratio, ratio = min(ratio) over () and ratio < 1e-1 as is_worst_issue from r")
def _(s, d):
    c = X._t(s, d, "customer").select(F.col("c_custkey").alias("ck"), F.col("c_mktsegment").alias("cluster"))
    g = audits.underperforming_group(X.class_probs(s, d).join(c, "ck"))
    return g.select("cluster", "n", _r("mean_own_prob").alias("mean_own_prob"), _r("ratio").alias("ratio"), "is_worst_issue")


@_query("majority_vote", O.X2 + "select task_id, consensus from cons")
def _(s, d):
    return audits.majority_vote(X.crowd(s, d), X.task_probs(s, d))


@_query("agreement_with_consensus", O.X2 + "select task_id, round(avg((label = consensus)::int), 6) as agreement, count(*)::bigint as n_annotations from votes join cons using (task_id) group by 1")
def _(s, d):
    v = X.crowd(s, d)
    return audits.agreement_with_consensus(v, audits.majority_vote(v, X.task_probs(s, d))).select("task_id", _r("agreement").alias("agreement"), "n_annotations")


@_query("annotator_agreement", O.X2 + "select a.annotator_id, round(avg((a.label = b.label)::int), 6) as agreement from votes a join votes b on a.task_id = b.task_id and a.annotator_id <> b.annotator_id group by 1")
def _(s, d):
    return audits.annotator_agreement(X.crowd(s, d)).select("annotator_id", _r("agreement").alias("agreement"))


@_query("annotator_stats", O.X2 + "j as (select *, (label = consensus)::int h from votes join cons using (task_id)), w as (select annotator_id, label, avg(h) x, count(*) n from j group by 1, 2), b as (select *, row_number() over (partition by annotator_id order by x, n desc, label) r from w) select j.annotator_id, count(*)::bigint as n_labeled, round(avg(h), 6) as accuracy, any_value(b.label)::int as worst_class from j join b on b.annotator_id = j.annotator_id and r = 1 group by 1")
def _(s, d):
    v = X.crowd(s, d)
    return audits.annotator_stats(v, audits.majority_vote(v, X.task_probs(s, d))).select("annotator_id", "n_labeled", _r("accuracy").alias("accuracy"), "worst_class")


@_query("crowd_posterior", O.X2 + O.posterior(["tp"]) + "fin as (select task_id, k as consensus, round(q, 6) as consensus_quality from best where r = 1) select * from fin")
def _(s, d):
    got = audits.crowd_posterior(X.crowd(s, d), X.task_probs(s, d), 3)
    return got.select("task_id", "consensus", _r("consensus_quality").alias("consensus_quality"))


@_query("soft_cross_entropy", O.X2 + "c as (select task_id, label, count(*) c from votes group by 1, 2), n as (select task_id, count(*) n from votes group by 1) select task_id, round(-sum(c::double / n * ln(greatest(p, 1e-30))) / ln(3), 6) as soft_ce from c join n using (task_id) join tp on tp.task_id = c.task_id and tp.k = c.label group by 1".replace("select task_id, round", "select c.task_id, round"))
def _(s, d):
    return audits.soft_cross_entropy(X.crowd(s, d), X.task_probs(s, d)).select("task_id", _r("soft_ce").alias("soft_ce"))


@_query("multilabel_scores", O.X3 + ", sc as (select id, list_sort(list(case when bit = 1 then p else 1 - p end), 'DESC') l from ml group by id) select id, round(((l[1] * 2e-1 + l[2] * 8e-1) * 2e-1 + l[3] * 8e-1) * 2e-1 + l[4] * 8e-1, 6) as label_quality from sc")
def _(s, d):
    return structured.multilabel_quality(X.multilabel(s, d)).select("id", _r("label_quality").alias("label_quality"))


@_query("multilabel_softmin", O.X3 + ", sc as (select id, case when bit = 1 then p else 1 - p end s from ml) select id, round(sum(s * exp((1 - s) / 1e-1)) / sum(exp((1 - s) / 1e-1)), 6) as label_quality from sc group by id")
def _(s, d):
    return structured.multilabel_quality(X.multilabel(s, d), aggregate="softmin").select("id", _r("label_quality").alias("label_quality"))


@_query("multilabel_issues", O.X3 + O.X3_FLAGS + "select id, bool_or(hit) as is_label_issue from flags group by id")
def _(s, d):
    return structured.multilabel_issues(X.multilabel(s, d), "confident_learning")


@_query("multilabel_common_issues", O.X3 + O.X3_FLAGS + "select k::int as class, bit::int as given, count(*) filter (hit)::bigint as num_examples, round(count(*) filter (hit) / (select count(distinct id)::double from ml), 6) as issue_probability from flags group by 1, 2")
def _(s, d):
    return structured.common_multilabel_issues(X.multilabel(s, d), "confident_learning").select("class", "given", "num_examples", _r("issue_probability").alias("issue_probability"))


@_query("multilabel_prior", O.X3 + " select k::int as class, round(1 - avg(bit), 6) as p0, round(avg(bit), 6) as p1 from ml group by 1")
def _(s, d):
    return structured.class_prior(X.multilabel(s, d)).select("class", _r("p0").alias("p0"), _r("p1").alias("p1"))


@_query("token_issues", O.X4 + O.X4_FLAGS + "select sentence_id, token_id from hits")
def _(s, d):
    return structured.token_issues(X.tokens(s, d), "confident_learning")


@_query("sentence_scores", O.X4 + "select sentence_id, round(min(p), 6) as score from tk where k = label group by 1")
def _(s, d):
    return structured.sentence_scores(X.tokens(s, d)).select("sentence_id", _r("score").alias("score"))


@_query("sentence_softmin", O.X4 + "select sentence_id, round(sum(p * exp((1 - p) / 5e-2)) / sum(exp((1 - p) / 5e-2)), 6) as score from tk where k = label group by 1")
def _(s, d):
    return structured.sentence_scores(X.tokens(s, d), "softmin").select("sentence_id", _r("score").alias("score"))


@_query("token_common_issues", O.X4 + O.X4_FLAGS + "select token, label::int as given_label, am::int as predicted_label, count(*)::bigint as num_label_issues from hits group by 1, 2, 3")
def _(s, d):
    t = X.tokens(s, d)
    return structured.common_token_issues(t, structured.token_issues(t, "confident_learning"))


@_query("regression_scores", f"with x as ({O.X5}) select id, round(exp(-abs(prediction - y)), 6) as label_quality from x")
def _(s, d):
    return audits.residual_scores(X.regression(s, d)).select("id", _r("label_quality").alias("label_quality"))


@_query("regression_label_issues", f"with x as ({O.X5}), s as (select id, exp(-abs(prediction - y)) q from x) select id, q < 5e-2 * (select median(q) from s) as is_label_issue from s")
def _(s, d):
    return audits.regression_issues(X.regression(s, d)).select("id", "is_label_issue")


@_query("box_iou", O.X6 + "select image_id, box_id, pred_id, round(iou, 6) as iou, round(sim, 6) as sim from pairs where iou > 0")
def _(s, d):
    pairs = structured.box_pairs(X.boxes(s, d), X.predicted_boxes(s, d)).where("iou > 0")
    return pairs.select("image_id", F.col("box_id").cast("int").alias("box_id"), F.col("pred_id").cast("int").alias("pred_id"), _r("iou").alias("iou"), _r("sim").alias("sim"))


@_query("box_badloc", O.X6 + "select b.image_id, b.box_id, round(coalesce(max(sim) filter (q.label = q.pred_label and q.p > 5e-1 and iou > 0), 1), 6) as score from bx b left join pairs q on q.image_id = b.image_id and q.box_id = b.box_id group by 1, 2")
def _(s, d):
    b, p = X.boxes(s, d), X.predicted_boxes(s, d)
    return structured.badly_located_boxes(structured.box_pairs(b, p), b).select("image_id", F.col("box_id").cast("int").alias("box_id"), _r("score").alias("score"))


@_query("box_swap", O.X6 + "m as (select min(sim) m from pairs where sim > 0), g as (select image_id, box_id, max(sim) s from pairs where label <> pred_label and p > 95e-2 group by 1, 2), ov as (select l.image_id, l.box_id, greatest(least(l.x2, p.x2) - greatest(l.x1, p.x1), 0) * greatest(least(l.y2, p.y2) - greatest(l.y1, p.y1), 0) i, (l.x2 - l.x1) * (l.y2 - l.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) a from bx l join bx p on l.image_id = p.image_id and l.label <> p.label), cl as (select distinct image_id, box_id from ov where i / greatest(a - i, 1e-6) >= 95e-2) select b.image_id, b.box_id, round(case when cl.box_id is not null then m when s is null then 1 else greatest(m, 1 - s) end, 6) as score from bx b left join g on g.image_id = b.image_id and g.box_id = b.box_id left join cl on cl.image_id = b.image_id and cl.box_id = b.box_id, m")
def _(s, d):
    b, p = X.boxes(s, d), X.predicted_boxes(s, d)
    pairs = structured.box_pairs(b, p)
    return structured.swapped_boxes(pairs, b, structured.min_similarity(pairs)).select("image_id", F.col("box_id").cast("int").alias("box_id"), _r("score").alias("score"))


@_query("box_overlooked", O.X6 + "m as (select min(sim) m from pairs where sim > 0), f as (select p.image_id, p.box_id as pred_id, any_value(p.p) p, max(iou) best, max(sim) filter (q.label = q.pred_label) same from px p left join pairs q on q.image_id = p.image_id and q.pred_id = p.box_id where p.p >= 95e-2 group by 1, 2) select image_id, pred_id, round(coalesce(same, m * (1 - p)), 6) as score from f, m where coalesce(best, 0) = 0")
def _(s, d):
    b, p = X.boxes(s, d), X.predicted_boxes(s, d)
    pairs = structured.box_pairs(b, p)
    return structured.overlooked_boxes(pairs, p, structured.min_similarity(pairs)).select("image_id", F.col("pred_id").cast("int").alias("pred_id"), _r("score").alias("score"))


def _box_scores(overlooked: str, badloc: str, swap: str) -> str:
    exact = [_SQL[n].replace("round(", "(").replace(", 6) as score", ") as score") for n in ("box_overlooked", "box_badloc", "box_swap")]
    return (
        f"with ol as ({exact[0]}), bl as ({exact[1]}), sw as ({exact[2]}), im as ({O.X6} x as (select 1) select image_id from bx union select image_id from px), "
        "z as (select image_id, 0 as k, score from ol union all select image_id, 1, score from bl union all select image_id, 2, score from sw), "
        "s as (select image_id, k, sum(score * exp((1 - score) / 1e-1)) / sum(exp((1 - score) / 1e-1)) as s from z where score is not null group by 1, 2), "
        "f as (select im.image_id, coalesce(max(s) filter (k = 0), 1) as a, coalesce(max(s) filter (k = 1), 1) as b, coalesce(max(s) filter (k = 2), 1) as c from im left join s on s.image_id = im.image_id group by 1) "
        f"select image_id, round(a, 6) as overlooked, round(b, 6) as badloc, round(c, 6) as swap, round(exp({overlooked} * ln(a + 1e-100) + {badloc} * ln(b + 1e-100) + {swap} * ln(c + 1e-100)), 6) as label_quality from f"
    )


@_query("box_image_scores", _box_scores("1e0 / 3", "1e0 / 3", "1e0 / 3"))
def _(s, d):
    got = structured.box_image_scores(X.boxes(s, d), X.predicted_boxes(s, d))
    return got.select("image_id", *[_r(c).alias(c) for c in ("overlooked", "badloc", "swap", "label_quality")])


@_query("box_areas", O.X6 + "select label, count(*)::bigint as n, round(avg((x2 - x1) * (y2 - y1)), 6) as avg_area, min((x2 - x1) * (y2 - y1)) as min_area, max((x2 - x1) * (y2 - y1)) as max_area from bx group by 1")
def _(s, d):
    return structured.box_areas(X.boxes(s, d)).withColumn("avg_area", _r("avg_area"))


@_query("box_class_share", O.X6 + "select label, round(count(*) / (select count(*) + 1e-6 from bx), 2) as share from bx group by 1")
def _(s, d):
    return structured.box_class_share(X.boxes(s, d))


def _pixels(s, d):
    return X.pixels(s, d).withColumn("pred_probs", F.array(1 - F.col("p1"), F.col("p1")))


@_query("image_scores", f"with x as ({O.X8}), o as (select image_id, case when label = 1 then p1 else 1 - p1 end s from x) select image_id, round(sum(s * exp((1 - s) / 1e-1)) / sum(exp((1 - s) / 1e-1)), 6) as score from o group by 1")
def _(s, d):
    return structured.image_scores(_pixels(s, d)).select("image_id", _r("score").alias("score"))


@_query("pixel_issues", f"with x as ({O.X8}), t as (select avg(p1) filter (label = 1) t1, avg(1 - p1) filter (label = 0) t0 from x), y as (select *, case when label = 1 then p1 else 1 - p1 end own, case when p1 > 1 - p1 then 1 else 0 end am, greatest(p1, 1 - p1) pm from x), n as (select count(*) n from y, t where am <> label and pm >= case when am = 1 then t1 else t0 end - 1e-6), r as (select *, row_number() over (order by own, image_id, y, x) r from y) select image_id, y, x from r, n where r <= n and am <> label")
def _(s, d):
    return structured.pixel_issues(_pixels(s, d))


@_query("pixel_common_issues", O.PIXELS + "select label::int as given_label, am::int as predicted_label, count(*)::bigint as num_pixel_issues from hits group by 1, 2")
def _(s, d):
    p = _pixels(s, d)
    return structured.common_pixel_issues(p, structured.pixel_issues(p))


@_query("multilabel_cutoff", O.X3 + ", c as (select i::int i, round(i * 5e-2, 2) c from (select unnest(range(1, 18)) i)), f as (select i, c, 2e0 * count(*) filter (bit = 1 and p >= c) / greatest(1, 2 * count(*) filter (bit = 1 and p >= c) + count(*) filter ((bit = 1) <> (p >= c))) f1 from ml, c group by all) select c as cutoff, round(f1, 6) as f1 from f order by f1 desc, i limit 1")
def _(s, d):
    c, f1 = structured.best_cutoff(X.multilabel(s, d))
    return s.createDataFrame([(float(c), round(f1, 6))], "cutoff double, f1 double")


_TWICE = O.posterior(["tp"]) + O.again(O.posterior(["tp"]))


@_query("crowd_labels", O.X2 + _TWICE + "fin as (select con2.task_id, consensus, round(q, 6) as consensus_quality, round(avg((label = consensus)::int), 6) as agreement, count(*)::bigint as n_annotations from con2 join po2 on po2.task_id = con2.task_id and po2.k = consensus join votes on votes.task_id = con2.task_id group by con2.task_id, consensus, q) select * from fin")
def _(s, d):
    found = audits.crowd_labels(X.crowd(s, d), X.task_probs(s, d), 3).labels
    return found.select("task_id", "consensus", _r("consensus_quality").alias("consensus_quality"), _r("agreement").alias("agreement"), "n_annotations")


@_query(
    "annotator_quality",
    O.X2 + _TWICE + """v as (select votes.*, consensus, (label = consensus)::int h, a.q cq, b.q lq, count(*) over (partition by votes.task_id) n from votes join con2 using (task_id)
  join po2 a on a.task_id = votes.task_id and a.k = consensus join po2 b on b.task_id = votes.task_id and b.k = label),
sr as (select mw / (mw + (select sum(w2) from (select w as w2 from wa2)) * (select count(*) / count(distinct task_id) from votes) / (select count(*) from wa2)) s from w02),
wc as (select *, row_number() over (partition by annotator_id order by x, m desc, y desc, label) r from (select annotator_id, label, avg(h) x, count(*) m, avg(cq) y from v group by 1, 2))
select annotator_id, round(any_value(s) * avg(lq) + (1 - any_value(s)) * avg(h) filter (n > 1), 6) as annotator_quality, round(avg(h), 6) as agreement_with_consensus, any_value(wc.label) as worst_class, count(*)::bigint as n_labeled
from v join wc using (annotator_id), sr where wc.r = 1 group by 1""",
)
def _(s, d):
    v = X.crowd(s, d)
    got = audits.annotator_quality(v, audits.crowd_labels(v, X.task_probs(s, d), 3))
    return got.select("annotator_id", *[_r(c).alias(c) for c in ("annotator_quality", "agreement_with_consensus")], "worst_class", "n_labeled")


@_query("active_learning_scores", O.X2T + _TWICE + "mn as (select avg(w) m from wa2) select task_id, round((q * (ws + mw) + m / 3) / (ws + mw + m), 6) as score from best2 join con2 using (task_id), mn where k = consensus")
def _(s, d):
    return audits.active_learning_scores(X.crowd(s, d), X.task_probs(s, d), 3).select("task_id", _r("score").alias("score"))


@_query("annotation_quality", O.X2 + O.posterior(["tp"]) + "fin as (select votes.task_id, annotator_id, round(q, 6) as label_quality from votes join po on po.task_id = votes.task_id and po.k = votes.label) select * from fin")
def _(s, d):
    v, p = X.crowd(s, d), X.task_probs(s, d)
    return audits.annotation_quality(v, audits.crowd_posterior(v, p, 3)).select("task_id", "annotator_id", _r("label_quality").alias("label_quality"))


@_query("best_temperature", O.X2T + "fin as (select round(t, 6) as temperature from bt) select * from fin")
def _(s, d):
    return s.createDataFrame([(round(audits.best_temperature(X.crowd(s, d), X.task_probs(s, d)), 6),)], "temperature double")


@_query("class_counts", "select o_orderpriority as label, count(*)::bigint as n from orders group by 1")
def _(s, d):
    return labels.class_counts(X._t(s, d, "orders"), "o_orderpriority")


@_query("encoded_labels", "select o_orderkey as id, (dense_rank() over (order by o_orderpriority) - 1)::int as label from orders")
def _(s, d):
    from ..sources.dataset import encode_labels

    return encode_labels(X._t(s, d, "orders"), "o_orderpriority")[0].select(F.col("o_orderkey").alias("id"), F.col("__label").alias("label"))


@_query("adjusted_probs", O.X1C + "n as (select given, guess, c::double c, sum(c) over (partition by guess) cs, sum(c) over (partition by given) rs from cal), r as (select given k, (c / rs) / (c / cs) r from n where given = guess), q as (select id, k, least(greatest(p * r, 0), 1) q from p join r using (k)), z as (select id, k, q / sum(q) over (partition by id) z from q) select id, " + ", ".join(f"round(max(z) filter (k = {c}), 6) as p{c}" for c in range(K)) + " from z group by 1")
def _(s, d):
    x = X.class_probs(s, d)
    _, noise, inverse = cells.latent(confident.confident_joint(x))
    return confident.recalibrated_probs(x, noise, inverse).select("id", *[_r(F.col("pred_probs")[c]).alias(f"p{c}") for c in range(K)])


@_query(
    "crowd_posterior_ensemble",
    O.X2.replace("fr as", O.PROBS.format("tq", 7907, 104723) + "mp as (select task_id, k, (tp.p + tq.p) / 2 p from tp join tq using (task_id, k)), fr as").replace("join tp on tp.task_id = vt.task_id and tp.k = vt.label", "join mp on mp.task_id = vt.task_id and mp.k = vt.label")
    + O.posterior(["tp", "tq"]) + "fin as (select task_id, k as consensus, round(q, 6) as consensus_quality from best where r = 1) select * from fin",
)
def _(s, d):
    return audits.crowd_posterior_ensemble(X.crowd(s, d), X.two_models(s, d), ["m_0", "m_1"], 3).select("task_id", "consensus", _r("consensus_quality").alias("consensus_quality"))


@_query("active_learning_scores_ensemble", O.X2E + O.posterior(["tp", "tq"]) + O.again(O.posterior(["tp", "tq"])) + "mn as (select avg(w) m from wa2) select task_id, round((q * (ws + mw) + m / 3) / (ws + mw + m), 6) as score from best2 join con2 using (task_id), mn where k = consensus")
def _(s, d):
    return audits.active_learning_scores_ensemble(X.crowd(s, d), X.two_models(s, d), ["m_0", "m_1"], 3).select("task_id", _r("score").alias("score"))


@_query(
    "non_iid_scores",
    O.KNN + """n as (select count(*)::double n from embeddings),
g as (select i, abs(i - j)::double x from e union all select vec_id, n - 1 from embeddings, n),
l as (select i, x, row_number() over (partition by i order by x) - 1 as m, lag(x, 1, 0e0) over (partition by i order by x) x0, count(*) over (partition by i) - 1 as k, least(i, n - 1 - i) dd, n from g, n),
b as (select *, case when x <= dd then x * x / (n - 1) when x <= n - 1 - dd then dd * dd / (n - 1) + (x + 3 * dd) * (x - dd) / (2 * (n - 1)) else dd * dd / (n - 1) + (2 * dd / (n - 1) + 1) * (n - 1 - 2 * dd) / 2 + x - (n - 1 - dd) end a from l),
p as (select i, n, abs(m * (x - x0) / k - (a - lag(a, 1, 0e0) over (partition by i order by m))) v from b)
select i as id, round((exp(-u) - exp(u)) / (exp(-u) + exp(u)) + 1, 6) as score from (select i, sum(v) / greatest(i, any_value(n) - i) u from p group by i)""",
)
def _(s, d):
    v = _vectors(s, d)
    return neighbors.order_scores(neighbors.knn_edges(v), v.count()).select("id", _r("score").alias("score"))


@_query("non_iid_test")
def _(s, d):
    v = _vectors(s, d)
    ks, p = neighbors.order_test(neighbors.knn_edges(v), v.count())
    return s.createDataFrame([(round(ks, 6), round(p, 6))], "ks double, p_value double")


@_query(
    "density_clusters",
    "with recursive " + O.KNN.removeprefix("with ") + """c as (select i, j from e where d <= 7e-1), co as (select i from c group by i having count(*) + 1 >= 3),
reach(u, v) as (select i, i from co union select u, c.j from reach join co on co.i = reach.v join c on c.i = reach.v),
lab as (select v, min(u) u from reach group by v) select vec_id as id, coalesce(u, -1)::bigint as cluster from embeddings left join lab on v = vec_id""",
)
def _(s, d):
    v = _vectors(s, d)
    return neighbors.density_clusters(neighbors.knn_edges(v), v, 0.7, 3)


@_query(
    "regression_outlying_scores",
    """with r as (select c_custkey as id, c_acctbal / 1e3 as y, c_acctbal / 1e3 + ((c_custkey * 7919) % 201 - 100) / 1e2 + case when c_custkey % 50 = 0 then 5e0 else 0e0 end as prediction from customer),
m as (select avg(y) my, stddev_pop(y) sy, avg(prediction - y) me, stddev_pop(prediction - y) se, count(*) n from r),
p as (select id, (y - my) / sy a, 5 * (prediction - y - me) / se b from r, m),
w as (select x.id, sqrt(pow(x.a - z.a, 2) + pow(x.b - z.b, 2)) d from p x, p z),
k as (select *, row_number() over (partition by id order by d) rn from w), t as (select id, avg(d) d from k, m where rn <= ceil(n / 2e0) group by id),
sc as (select median(d) s from t) select id, round(exp(-d / s), 6) as label_quality from t, sc""",
)
def _(s, d):
    return audits.regression_scores(X.point_predictions(s, d)).select("id", _r("label_quality").alias("label_quality"))


@_query(
    "spurious_correlations",
    """with b as (select o_orderkey as id, substr(o_orderpriority, 1, 1)::int - 1 as label, o_orderkey % 5 as fold, o_totalprice from orders),
x as (select id, label, fold, 'darkness' as property, label * 3e0 + (id * 7919 % 101) / 1e2 as v from b union all select id, label, fold, 'blur', label + (id * 7907 % 401) / 1e2 from b union all select id, label, fold, 'odd_size', o_totalprice / 1e5 from b),
f as (select distinct fold as f from b), st as (select property, f, label as c, avg(v) m, var_pop(v) s, count(*) n from x, f where fold <> f group by all),
sp as (select property, var_pop(v) s from x group by 1),
sc as (select x.property, x.fold, x.id, x.label, c, ln(n) - ln(st.s + 1e-9 * sp.s) / 2 - pow(v - m, 2) / (2 * (st.s + 1e-9 * sp.s)) l from x join st on st.property = x.property and st.f = x.fold join sp on sp.property = x.property),
rk as (select *, row_number() over (partition by property, id order by l desc, c) r from sc),
er as (select property, avg(e) e from (select property, fold, avg((c <> label)::int) e from rk where r = 1 group by all) group by 1),
ba as (select 1 - (select label from b group by label order by count(*) desc, label limit 1) / count(*) as z from b) select property, round(least(e / z, 1), 6) as score from er, ba""",
)
def _(s, d):
    return audits.spurious_correlations(X.row_properties(s, d), ["darkness", "blur", "odd_size"]).select("property", _r("score").alias("score"))


_HITS = """bp as (select * from (select *, row_number() over (partition by image_id, pred_id order by iou desc, box_id) r from pairs where label = pred_label) where r = 1),
ht as (select t, image_id, box_id, label from bp, (select 5e-1 + 5e-2 * unnest(range(10)) t) where iou >= round(t, 2) group by all),
hc as (select label, count(*) tp from ht group by 1), nc as (select label, count(*) n from bx group by 1), mc as (select label, count(*) m from px group by 1),
cm as (select coalesce(nc.label, mc.label) as label, coalesce(tp, 0) / (10e0 * z) tp, (10e0 * coalesce(m, 0) - coalesce(tp, 0)) / (10e0 * z) fp, (10e0 * coalesce(n, 0) - coalesce(tp, 0)) / (10e0 * z) fn
  from nc full join mc on nc.label = mc.label left join hc on hc.label = coalesce(nc.label, mc.label), (select count(distinct label) z from (select label from bx union select label from px)))
"""


@_query("box_confusion", O.X6 + _HITS + "select label, round(tp, 6) as tp, round(fp, 6) as fp, round(fn, 6) as fn from cm")
def _(s, d):
    got = structured.box_confusion(X.boxes(s, d), X.predicted_boxes(s, d))
    return got.select("label", *[_r(c).alias(c) for c in ("tp", "fp", "fn")])


@_query("box_class_metrics", O.X6 + _HITS + "select label, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from cm")
def _(s, d):
    got = structured.box_class_metrics(X.boxes(s, d), X.predicted_boxes(s, d))
    return got.select("label", *[_r(c).alias(c) for c in ("precision", "recall", "f1")])


_AP = """bp as (select * from (select *, row_number() over (partition by image_id, pred_id order by iou desc, box_id) r from pairs where label = pred_label) where r = 1),
th as (select round(5e-1 + 5e-2 * unnest(range(10)), 2) t),
wn as (select *, row_number() over (partition by t, image_id, box_id order by p desc, pred_id) w from bp, th where iou >= t),
rk as (select image_id, box_id as pred_id, label, row_number() over (partition by label order by p desc, image_id, box_id) k from px),
tp as (select t, rk.label, k, row_number() over (partition by t, rk.label order by k) c from wn join rk on rk.image_id = wn.image_id and rk.pred_id = wn.pred_id where w = 1),
en as (select t, label, max(c / k) over (partition by t, label order by k desc rows unbounded preceding) e from tp),
ap as (select th.t, n.label, coalesce(s, 0) / n ap from (select label, count(*) n from bx group by 1) n cross join th left join (select t, label, sum(e) s from en group by all) a on a.t = th.t and a.label = n.label)
"""


@_query("box_average_precision", O.X6 + _AP + "select t, label, round(ap, 6) as ap from ap")
def _(s, d):
    return structured.average_precisions(X.boxes(s, d), X.predicted_boxes(s, d)).select("t", "label", _r("ap").alias("ap"))


@_query(
    "box_image_issues",
    f"with bl as ({_SQL['box_badloc']}), sw as ({_SQL['box_swap']}), ol as ({_SQL['box_overlooked']}), lb as ({O.X6} x as (select 1) select image_id, box_id, label from bx), pb as ({O.X6} x as (select 1) select image_id, box_id as pred_id, label from px), "
    f"bd as (select label, 2e-1 * avg(ap) z from ({O.X6 + _AP} select * from ap) group by 1), hit as (select image_id from bl join lb using (image_id, box_id) join bd using (label) where score <= z union select image_id from sw join lb using (image_id, box_id) join bd using (label) where score <= z "
    "union select image_id from ol join pb using (image_id, pred_id) left join bd using (label) where score <= coalesce(z, 0)) "
    "select i.image_id, hit.image_id is not null as is_label_issue from (select image_id from lb union select image_id from pb) i left join hit on hit.image_id = i.image_id",
)
def _(s, d):
    return structured.box_image_issues(X.boxes(s, d), X.predicted_boxes(s, d))


@_query(
    "neighbor_label_issues",
    O.KNN + "p as (select x.i as id, x.label, x.k, avg((b.label = x.k)::int) as p from (select e.i, e.j, a.label, k from e join embeddings a on a.vec_id = e.i, (select unnest(range(10))::int k)) x join embeddings b on b.vec_id = x.j group by all), "
    + O.joint_of(10) + O.BY_RATE + "select id, coalesce(hit, false) and not near as is_label_issue from a left join by_rate using (id)",
)
def _(s, d):
    v = _vectors(s, d)
    return confident.find_label_issues(neighbors.label_issue_probs(neighbors.knn_edges(v), v, int(v.agg(F.max("label")).first()[0]) + 1))


def queries() -> dict[str, Query]:
    from . import catalog_extra  # noqa: F401 (its queries add themselves)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
