"""More named queries with the SQL that each must equal: estimates, multi-label, tokens, pixels, boxes, crowds, neighbours, labels and contracts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import cells, labels
from ..operators import audits, confident, contracts, neighbors, structured
from ..sources import dataset
from ..sources import fixtures as X
from ..streaming.inspector import StreamAudit
from . import oracles as O
from . import show
from .catalog import _SQL, _box_scores, _grid, _pixels, _query, _r, _vectors

# Joint, noise matrices and priors

_N = "nm as (select given, guess, c::double / sum(c) over (partition by guess) x from cal), ps as (select given, sum(c)::double / (select sum(c) from cal) s from cal group by 1), py as (select guess, sum(c)::double / (select sum(c) from cal) q from cal group by 1), "


@_query("inverse_noise_matrix", O.X1C + _N + "select guess as given, given as guess, round(x * q / s, 6) as n from nm join ps using (given) join py using (guess)")
def _(s, d):
    m = confident.confident_joint(X.class_probs(s, d)).astype(float)
    return _grid(s, cells.inverse_of(m.sum(axis=0) / m.sum(), m / m.sum(axis=0)), "double").select("given", "guess", _r("n").alias("n"))


@_query("noise_from_inverse", O.X1C + "select given, guess, round(c::double / sum(c) over (partition by guess), 6) as n from cal")
def _(s, d):
    m = confident.confident_joint(X.class_probs(s, d)).astype(float)
    return _grid(s, cells.noise_of(m.sum(axis=1) / m.sum(), m.T / m.sum(axis=1)), "double").select("given", "guess", _r("n").alias("n"))


for _name, _sql in (("marginal", "sum(c)::double / (select sum(c) from cal)"), ("marginal_ps", "sum(c::double)::double / (select sum(c) from cal)")):

    @_query(f"prior_{_name}", O.X1C + f"select guess as k, round({_sql}, 6) as p from cal group by 1")
    def _(s, d, m=_name):
        py, _, _, _ = confident.noise_estimates(X.class_probs(s, d), converge=False, method=m)
        return s.createDataFrame([(k, round(float(p), 6)) for k, p in enumerate(py)], "k int, p double")


@_query("prior_from_noise", O.X1C + "select guess as k, round(sum(c)::double / (select sum(c) from cal), 6) as p from cal group by 1")
def _(s, d):
    """The shares of the labels and the noise matrix give the prior back that the joint has."""
    m = confident.confident_joint(X.class_probs(s, d)).astype(float)
    _, py, _ = cells.prior_and_inverse(m.sum(axis=1), m / m.sum(axis=0))
    return s.createDataFrame([(k, round(float(p), 6)) for k, p in enumerate(py)], "k int, p double")


@_query("latent_round_trip", O.X1C + "select given, guess, round(c::double / sum(c) over (partition by guess), 6) as n from cal")
def _(s, d):
    """Alternating Bayes steps leave the noise matrix of a consistent joint where it is."""
    return _grid(s, confident.noise_estimates(X.class_probs(s, d), converge=True)[1], "double").select("given", "guess", _r("n").alias("n"))


@_query("noise_without_class", O.X1C + "nm as (select given, guess, case when given = guess or given = 1 or guess = 1 then 0 else c::double / sum(c) over (partition by guess) end x from cal) select given, guess, round(case when given = guess then 1 - sum(x) over (partition by guess) else x end, 6) as n from nm")
def _(s, d):
    m = confident.confident_joint(X.class_probs(s, d)).astype(float)
    return _grid(s, cells.without_noise(m / m.sum(axis=0), 1), "double").select("given", "guess", _r("n").alias("n"))


@_query("num_examples", "select count(*)::bigint as n from orders")
def _(s, d):
    return s.createDataFrame([(confident.num_examples(confident.confident_joint(X.class_probs(s, d))),)], "n bigint")


@_query("health_of_joint", O.X1C + "select round(sum(c) filter (given = guess)::double / sum(c), 6) as score from cal")
def _(s, d):
    return s.createDataFrame([(round(confident.health_score(None, confident.confident_joint(X.class_probs(s, d))), 6),)], "score double")


@_query("health_summary", O.X1C + "j as (select given, guess, c::double / sum(c) over () x from cal), q as (select min(1 - y / t) q from (select given, sum(x) t, sum(x) filter (given <> guess) y from j group by 1)), ov as (select max(l.x + r.x) o from j l join j r on l.given = r.guess and l.guess = r.given where l.given < l.guess) select round(1 - (select count(*) from guess join a using (id) where g <> a.label and not near)::double / (select count(*) from a), 6) as score, round(q, 6) as worst_quality, round(o, 6) as largest_overlap from q, ov")
def _(s, d):
    h = confident.health_summary(X.class_probs(s, d))
    return s.createDataFrame([(round(h["score"], 6), round(h["classes"][0][5], 6), round(h["overlaps"][0][3], 6))], "score double, worst_quality double, largest_overlap double")


@_query("num_label_issues_calibrated", O.X1C + "select round_even((1 - sum(c) filter (given = guess)::double / sum(c)) * (select count(*) from a), 0)::bigint as n from cal")
def _(s, d):
    return s.createDataFrame([(confident.num_label_issues(X.class_probs(s, d), "off_diagonal_calibrated"),)], "n bigint")


_BATCH = "gb as (select a.*, case when pm >= t - 1e-6 then am end g from a join thr on thr.k = a.am), "


@_query("batched_issue_count_calibrated", O.X1C + _BATCH + "bt as (select label, count(*) n, count(g) norm, count(*) filter (g <> label) off from gb group by 1) select round_even(sum(off * n / greatest(norm, 1e-6)::double), 0)::bigint as n from bt")
def _(s, d):
    return s.createDataFrame([(confident.batched_issue_count(X.class_probs(s, d), calibrated=True),)], "n bigint")


@_query("batched_issue_count_thorough", O.X1C + "th as (select p.id, arg_max(p.k, p.p) g from p join thr using (k) where p.p >= t - 1e-6 group by 1) select count(*)::bigint as n from th join a using (id) where g <> label and am <> label")
def _(s, d):
    return s.createDataFrame([(confident.batched_issue_count(X.class_probs(s, d), thorough=True),)], "n bigint")


@_query("batched_issues", O.X1C + _BATCH + "nn as (select count(*) n from gb where g <> label), rk as (select *, row_number() over (order by own, id) r from a) select id from rk, nn where r <= n and not near")
def _(s, d):
    return confident.batched_issues(X.class_probs(s, d))


# Filters


@_query("argmax_issues", O.X1C.replace("select label, g, count(*) n from guess where g is not null group by all", "select label, am g, count(*) n from a group by all").replace("greatest(coalesce(n, 0), case when given = guess then 1 else 0 end) c", "coalesce(n, 0) c") + O.BY_RATE + "select id, coalesce(hit, false) and not near as is_label_issue from a left join by_rate using (id)")
def _(s, d):
    return confident.argmax_issues(X.class_probs(s, d))


@_query("issues_half_noise", O.X1C + O.BY_RATE.replace("where r <= c", "where r <= floor(c * 5e-1)") + "select id, coalesce(hit, false) and not near as is_label_issue from a left join by_rate using (id)")
def _(s, d):
    return confident.find_label_issues(X.class_probs(s, d), frac_noise=0.5)


@_query(
    "issues_removed_per_class",
    O.X1C + """mt as (select guess as t, given as g, c::double c from cal), rt as (select t, sum(c) s from mt group by 1), wanted as (select unnest([3, 4, 5, 6, 7]) w, unnest(range(5)) t),
by0 as (select mt.t, mt.g, case when mt.t = mt.g then 0 else c / rt.s end b from mt join rt on rt.t = mt.g),
by1 as (select t, g, b * w / sum(b) over (partition by t) v, w from by0 join wanted using (t)),
by2 as (select t, g, case when t = g then n - w else v end v from by1 join lc on lc.given = t),
by3 as (select *, round_even(v, 0) r, round_even(sum(v) over (partition by t), 0) - sum(round_even(v, 0)) over (partition by t) gap, row_number() over (partition by t order by v - round_even(v, 0) desc, g desc) up, row_number() over (partition by t order by v - round_even(v, 0), g) down from by2),
qt as (select t, g, r + case when gap > 0 and up <= gap then 1 when gap < 0 and down <= -gap then -1 else 0 end c from by3),
m as (select p.id, p.label, p.k, p.p - a.own m from p join a using (id) where p.k <> p.label), rk as (select id, label, k, row_number() over (partition by label, k order by m desc, id) r from m),
by_rate as (select distinct id, true hit from rk join qt on qt.g = rk.label and qt.t = rk.k where r <= c)
select id, coalesce(hit, false) and not near as is_label_issue from a left join by_rate using (id)""",
)
def _(s, d):
    return confident.find_label_issues(X.class_probs(s, d), num_to_remove_per_class=[3, 4, 5, 6, 7])


@_query("top_issues", O.X1C + "select id, round(own, 6) as label_quality from a order by own, id limit 10")
def _(s, d):
    return confident.find_top(confident.label_quality(X.class_probs(s, d))).select("id", _r("label_quality").alias("label_quality"))


_LL = ", ".join(f"avg(-ln(exp(-{t} * l1) / (exp(-{t} * l1) + exp(-{t} * l2)) * pa + exp(-{t} * l2) / (exp(-{t} * l1) + exp(-{t} * l2)) * pb)) as x{i}" for i, t in enumerate(("1e-4", "1e-3", "1e-2", "1e-1", "1e0", "1e1", "1e2", "2e2")))


@_query("score_ensemble_log_loss", O.X1C + "p2 as (" + O.X1P2 + f"), o as (select p.id, p.p pa, p2.p pb from p join p2 on p.id = p2.id and p.k = p2.k where p.k = p.label), lm as (select avg(-ln(pa)) l1, avg(-ln(pb)) l2 from o), gr as (select {_LL} from o, lm), tt as (select ([1e-4, 1e-3, 1e-2, 1e-1, 1e0, 1e1, 1e2, 2e2])[list_position([x0, x1, x2, x3, x4, x5, x6, x7], least(x0, x1, x2, x3, x4, x5, x6, x7))] t from gr) select id, round((exp(-t * l1) * pa + exp(-t * l2) * pb) / (exp(-t * l1) + exp(-t * l2)), 6) as label_quality from o, lm, tt")
def _(s, d):
    other = X.class_probs(s, d, 7907, 104723, "q").select("id", "q")
    return confident.ensemble_quality(X.class_probs(s, d).join(other, "id"), ["pred_probs", "q"], weight="log_loss_search").select("id", _r("label_quality").alias("label_quality"))


@_query("score_ensemble_custom", O.X1C + "p2 as (" + O.X1P2 + ") select p.id, round(p.p * 25e-2 + p2.p * 75e-2, 6) as label_quality from p join p2 on p.id = p2.id and p.k = p2.k where p.k = p.label")
def _(s, d):
    other = X.class_probs(s, d, 7907, 104723, "q").select("id", "q")
    return confident.ensemble_quality(X.class_probs(s, d).join(other, "id"), ["pred_probs", "q"], weight="custom", custom=[0.25, 0.75]).select("id", _r("label_quality").alias("label_quality"))


# Labels

_COLOURS = "['red', 'blue', 'green', 'amber']"


def _colour_lists(s, d):
    names = F.array(*[F.lit(x) for x in ("red", "blue", "green", "amber")])
    return X.multilabel(s, d).select("id", F.filter(F.transform(F.arrays_zip(F.col("bits").alias("b"), names.alias("n")), lambda x: F.when(x["b"] == 1, x["n"])), lambda x: x.isNotNull()).alias("colours"))


@_query("encoded_label_lists", O.X3 + f" select id, coalesce(string_agg(([3, 1, 2, 0])[k + 1]::varchar, ',' order by k) filter (bit = 1), '') as ids from ml group by id")
def _(s, d):
    got, _ = dataset.encode_label_lists(_colour_lists(s, d), "colours")
    return got.select("id", F.array_join(F.col("__labels").cast("array<string>"), ",").alias("ids"))


@_query("label_lists_round_trip", O.X3 + " select id, string_agg(bit::varchar, '' order by k) as bits from ml group by id")
def _(s, d):
    got = structured.one_hot(structured.label_list(F.col("bits")), 4)
    return X.multilabel(s, d).select("id", F.array_join(got.cast("array<string>"), "").alias("bits"))


@_query("encoded_votes", O.X2 + "x as (select 1) select task_id, annotator_id::varchar as annotator_id, (case label when 0 then 2 when 1 then 0 else 1 end)::int as label from votes")
def _(s, d):
    named = X.crowd(s, d).withColumn("label", F.element_at(F.array(F.lit("x"), F.lit("a"), F.lit("m")), F.col("label") + 1))
    return dataset.encode_votes(dataset.long_to_wide(named))[0].select("task_id", "annotator_id", "label")


@_query("class_counts_filled", "select k::int as label, count(l)::bigint as n from (select unnest(range(8)) k) left join (select substr(o_orderpriority, 1, 1)::int - 1 as l from orders) on l = k group by 1")
def _(s, d):
    return labels.class_counts(X.class_probs(s, d), k=8)


@_query("missing_classes", "select k::int as label from (select unnest([5, 6, 7]) k)")
def _(s, d):
    return labels.missing_classes(X.class_probs(s, d), 8)


@_query("unique_classes", "select distinct o_orderpriority as label from orders")
def _(s, d):
    return labels.unique_classes(X._t(s, d, "orders"), "o_orderpriority")


@_query("class_numbers", "select count(distinct o_orderpriority)::int as from_labels, 5::int as from_probs, 4::int as in_lists from orders")
def _(s, d):
    x = X.class_probs(s, d)
    return s.createDataFrame([(labels.num_unique_classes(X._t(s, d, "orders"), "o_orderpriority"), labels.num_classes(x), labels.num_unique_classes(_colour_lists(s, d), "colours"))], "from_labels int, from_probs int, in_lists int")


@_query("split_rows", "select count(*) filter (o_orderkey % 5 <> 0) as train, count(*) filter (o_orderkey % 5 = 0) as held_out, count(*) filter (o_orderkey % 3 = 0) as masked, count(*) filter (o_orderkey % 5 <> 0) + 1 as with_one_more from orders")
def _(s, d):
    x = X.class_probs(s, d)
    train, held = labels.split(x, F.col("id") % 5 == 0)
    some = labels.masked(x, x.select("id", (F.col("id") % 3 == 0).alias("flag")))
    first = held.agg(F.min("id")).first()[0]
    return s.createDataFrame([(train.count(), held.count(), some.count(), labels.with_row(train, held, F.col("id") == first).count())], "train bigint, held_out bigint, masked bigint, with_one_more bigint")


@_query("flat_compressed", O.X3 + " select id, string_agg((k + bit)::varchar, ',' order by k) as flat, 'smallint' as kind from ml group by id")
def _(s, d):
    pairs = F.transform("bits", lambda b, k: F.array(k + b))
    got = X.multilabel(s, d).select("id", labels.compressed(labels.flat(pairs, 2)[0], 4).alias("c"), labels.flat(pairs, 2).alias("f"))
    return got.select("id", F.array_join(F.col("f").cast("array<string>"), ",").alias("flat"), F.typeof("c").alias("kind"))


@_query("pu_f1", O.X3 + " select round(pow(count(*) filter (bit = 1 and p >= 5e-1)::double / count(*) filter (bit = 1), 2) / (2 * count(*) filter (p >= 5e-1)::double / count(*)), 6) as f1 from ml where k = 0")
def _(s, d):
    b, p = F.col("bits")[0] == 1, F.col("probs")[0] >= 0.5
    r = X.multilabel(s, d).agg(F.count_if(b & p), F.count_if(b), F.count_if(p), F.count(F.lit(1))).first()
    return s.createDataFrame([(round(cells.pu_f1(*r), 6),)], "f1 double")


@_query("noisy_label_counts", "with c as (select k, count(*) n from (select o_orderkey % 2 as k from orders) group by 1) select k::int as label, 1 - k::int as noisy, floor(n * case k when 0 then 1e-1 else 2e-1 end)::bigint as n from c")
def _(s, d):
    got = audits.noisy_labels(X._t(s, d, "orders").selectExpr("o_orderkey as id", "cast(o_orderkey % 2 as int) as label"), np.array([[0.9, 0.2], [0.1, 0.8]]))
    return got.where("label <> noisy").groupBy("label", "noisy").agg(F.count(F.lit(1)).alias("n"))


# Multi-label


@_query("multilabel_thresholds", O.X3_JOINT + "z as (select 1) select k::int as class, 0 as bit, round(t0, 6) as t from th union all select k::int, 1, round(t1, 6) from th")
def _(s, d):
    t, _ = structured.multilabel_stats(X.multilabel(s, d))
    return s.createDataFrame([(c, b, round(float(x), 6)) for c, row in enumerate(t) for b, x in enumerate(row)], "class int, bit int, t double")


def _joint_rows(s, m, kind):
    return s.createDataFrame([(c, i, j, kind(x)) for c, a in enumerate(m) for i, row in enumerate(a) for j, x in enumerate(row)], f"class int, given int, guess int, n {'bigint' if kind is int else 'double'}")


@_query("multilabel_joint", O.X3_JOINT + "z as (select 1) select k::int as class, given, guess, c::bigint as n from rw")
def _(s, d):
    return _joint_rows(s, structured.multilabel_joint(X.multilabel(s, d), calibrate=False), int)


@_query("multilabel_joint_calibrated", O.X3_JOINT + "z as (select 1) select k::int as class, given, guess, c as n from ca")
def _(s, d):
    return _joint_rows(s, structured.multilabel_joint(X.multilabel(s, d)), int)


@_query("multilabel_joint_distribution", O.X3_JOINT + "z as (select 1) select k::int as class, given, guess, round(c::double / sum(c) over (partition by k), 6) as n from ca")
def _(s, d):
    return _joint_rows(s, structured.estimate_multilabel_joint(X.multilabel(s, d)), lambda x: round(float(x), 6))


@_query("num_multilabel_issues", O.X3 + O.X3_FLAGS + "select count(distinct id) filter (hit)::bigint as n from flags")
def _(s, d):
    return s.createDataFrame([(structured.num_multilabel_issues(X.multilabel(s, d)),)], "n bigint")


@_query("multilabel_issues_by_rate", O.X3_JOINT + "z as (select 1) select id, bool_or(hit) as is_label_issue from br group by 1")
def _(s, d):
    return structured.multilabel_issues(X.multilabel(s, d))


@_query("multilabel_issues_by_class", O.X3_JOINT + "bc as (select id, not near and r <= n - c hit from o1 join ca on ca.k = o1.k and ca.given = o1.bit and ca.guess = o1.bit join lc on lc.k = o1.k and lc.given = o1.bit) select id, bool_or(hit) as is_label_issue from bc group by 1")
def _(s, d):
    return structured.multilabel_issues(X.multilabel(s, d), "prune_by_class")


@_query("multilabel_issues_both", O.X3_JOINT + "bc as (select id, not near and r <= n - c2.c and r <= c1.c hit from o1 join ca c2 on c2.k = o1.k and c2.given = o1.bit and c2.guess = o1.bit join ca c1 on c1.k = o1.k and c1.given = o1.bit and c1.guess = 1 - o1.bit join lc on lc.k = o1.k and lc.given = o1.bit) select id, bool_or(hit) as is_label_issue from bc group by 1")
def _(s, d):
    return structured.multilabel_issues(X.multilabel(s, d), "both")


@_query("multilabel_pred_neq_given", O.X3_JOINT + "z as (select 1) select id, bool_or(am <> bit and not near) as is_label_issue from gu group by 1")
def _(s, d):
    return structured.multilabel_issues(X.multilabel(s, d), "predicted_neq_given")


_EMA = "sc as (select id, list_sort(list(own), 'DESC') l from gu group by id), q as (select id, ((l[1] * 2e-1 + l[2] * 8e-1) * 2e-1 + l[3] * 8e-1) * 2e-1 + l[4] * 8e-1 q from sc), fl as (select count(distinct id) n from gu where coalesce(g <> bit, false) and not near), rk as (select id, q, row_number() over (order by q, id) r from q) "


@_query("multilabel_low_self_confidence", O.X3_JOINT + _EMA + "select id, r <= n as is_label_issue from rk, fl")
def _(s, d):
    return structured.multilabel_issues(X.multilabel(s, d), "low_self_confidence")


@_query("multilabel_low_in_class", O.X3_JOINT + "fl as (select k, count(*) filter (coalesce(g <> bit, false) and not near) n from gu group by 1), rk as (select id, k, row_number() over (partition by k order by own, id) r from gu) select id, bool_or(r <= n) as is_label_issue from rk join fl using (k) group by 1")
def _(s, d):
    return structured.multilabel_issues(X.multilabel(s, d), "low_self_confidence", low_memory=True)


@_query("multilabel_issues_ranked", O.X3_JOINT + _EMA + ", hb as (select id from br group by 1 having bool_or(hit)) select id, round(q, 6) as score from q join hb using (id)")
def _(s, d):
    return structured.multilabel_issues(X.multilabel(s, d), rank_by="self_confidence").select("id", _r("score").alias("score"))


@_query("multilabel_class_scores", O.X3_JOINT + "z as (select 1) select id, k::int as class, round(own, 6) as label_quality from gu")
def _(s, d):
    return structured.multilabel_scores_per_class(X.multilabel(s, d)).select("id", "class", _r("label_quality").alias("label_quality"))


for _name, _sql in (("mean", "avg(own)"), ("median", "median(own)"), ("max", "max(own)"), ("min", "min(own)")):

    @_query(f"multilabel_pool_{_name}", O.X3_JOINT + f"z as (select 1) select id, round({_sql}, 6) as label_quality from gu group by 1")
    def _(s, d, m=_name):
        return structured.PooledScorer("normalized_margin", structured.Pool(m))(X.multilabel(s, d)).select("id", _r("label_quality").alias("label_quality"))


@_query("multilabel_pool_python", O.X3_JOINT + "z as (select 1) select id, round(max(own) - min(own), 6) as label_quality from gu group by 1")
def _(s, d):
    return structured.PooledScorer(pool=structured.Pool(lambda x: max(x) - min(x), python=True))(X.multilabel(s, d)).select("id", _r("label_quality").alias("label_quality"))


@_query("multilabel_scores_adjusted", O.X3_JOINT + "ad as (select id, k, bit, p + greatest(t0, t1) - t1 q1, 1 - p + greatest(t0, t1) - t0 q0 from gu join th using (k)) select id, round(min(case when bit = 1 then q1 else q0 end / (q0 + q1)), 6) as label_quality from ad group by 1")
def _(s, d):
    return structured.PooledScorer(pool=structured.Pool("min"), adjust=True)(X.multilabel(s, d)).select("id", _r("label_quality").alias("label_quality"))


@_query("multilabel_class_quality", O.X3_JOINT + "z as (select k, count(*) filter (hit and bit = 1) a, count(*) filter (hit and bit = 0) b, (select count(distinct id)::double from ml) n from br group by 1) select k::int as class, a as label_issues, b as inverse_label_issues, round(a / n, 6) as label_noise, round(b / n, 6) as inverse_label_noise, round(1 - a / n, 6) as label_quality from z")
def _(s, d):
    q = structured.multilabel_class_quality(X.multilabel(s, d))
    return q.select("class", "label_issues", "inverse_label_issues", *[_r(c).alias(c) for c in ("label_noise", "inverse_label_noise", "label_quality")])


@_query("multilabel_health", O.X3_JOINT + "z as (select id, bool_or(hit) h from br group by 1) select round(1 - count(*) filter (h)::double / count(*), 6) as score from z")
def _(s, d):
    return s.createDataFrame([(round(structured.multilabel_health_summary(X.multilabel(s, d))["score"], 6),)], "score double")


@_query("multilabel_cut_predictions", O.X3 + ", c as (select i::int i, round(i * 5e-2, 2) c from (select unnest(range(1, 18)) i)), f as (select i, c, 2e0 * count(*) filter (bit = 1 and p >= c) / greatest(1, 2 * count(*) filter (bit = 1 and p >= c) + count(*) filter ((bit = 1) <> (p >= c))) f1 from ml, c group by all), b as (select c from f order by f1 desc, i limit 1) select id, string_agg((p >= c)::int::varchar, '' order by k) as bits from ml, b group by 1")
def _(s, d):
    return structured.cut_predictions(X.multilabel(s, d)).select("id", F.array_join(F.col("bits").cast("array<string>"), "").alias("bits"))


# Tokens and spans

_TOKENS = O.X4 + O.X4_FLAGS.rstrip() + "\n"


@_query("token_issues_ranked", _TOKENS + "select sentence_id, token_id, round(own, 6) as score from hits")
def _(s, d):
    return structured.token_issues(X.tokens(s, d), "confident_learning", rank_by="self_confidence").select("sentence_id", "token_id", _r("score").alias("score"))


@_query("sentence_mean_scores", O.X4 + "z as (select 1) select sentence_id, round(avg(p), 6) as score from tk where k = label group by 1")
def _(s, d):
    return structured.sentence_scores(X.tokens(s, d), "softmin", float("inf")).select("sentence_id", _r("score").alias("score"))


@_query("low_tokens", O.X4 + "z as (select 1) select sentence_id, token_id, round(p, 6) as score from tk where k = label and p < 3e-1")
def _(s, d):
    return structured.issues_from_scores(structured.token_scores(X.tokens(s, d)), 0.3).select("sentence_id", "token_id", _r("score").alias("score"))


@_query("low_sentences", O.X4 + "z as (select sentence_id, min(p) s from tk where k = label group by 1) select sentence_id, round(s, 6) as score from z where s < 2e-1")
def _(s, d):
    return structured.issues_from_scores(structured.sentence_scores(X.tokens(s, d)), 0.2).select("sentence_id", _r("score").alias("score"))


@_query("issues_of_token", _TOKENS + "select sentence_id, token_id from hits where lower(token) = 'user'")
def _(s, d):
    t = X.tokens(s, d)
    return structured.filter_by_token(t, structured.token_issues(t, "confident_learning"), "USER")


@_query("common_token_issues_excluded", _TOKENS.rstrip() + " select token, label::int as given_label, am::int as predicted_label, count(*)::bigint as num_label_issues from hits where not (label = 0 and am = 1) group by 1, 2, 3".replace(" select", "\nselect"))
def _(s, d):
    t = X.tokens(s, d)
    return structured.common_token_issues(t, structured.token_issues(t, "confident_learning"), [(0, 1)])


@_query("merged_probs", O.X4 + "z as (select 1) select sentence_id, token_id, round(sum(p) filter (k = 0), 6) as p0, round(sum(p) filter (k > 0), 6) as p1 from tk group by 1, 2")
def _(s, d):
    m = structured.merged_probs(F.col("pred_probs"), [0, 1, 1])
    return X.tokens(s, d).select("sentence_id", "token_id", _r(m[0]).alias("p0"), _r(m[1]).alias("p1"))


@_query("mapped_classes", O.X4 + "z as (select distinct sentence_id, token_id, label from tk) select sentence_id, string_agg((case label when 0 then 2 when 1 then 0 else 0 end)::varchar, ',' order by token_id) as classes from z group by 1")
def _(s, d):
    by = X.tokens(s, d).groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("token_id", "label"))).alias("x"))
    return by.select("sentence_id", F.array_join(structured.mapped(F.col("x.label"), [2, 0, 0]).cast("array<string>"), ",").alias("classes"))


_WORDS = "with w as (select o_orderkey as id, unnest(range(6)) i from orders where o_orderkey <= 300), x as (select id, i, (['a', '(', 'b', ')', '-', '.', '''s', 'c#', ','])[(id * 7 + i * 5) % 9 + 1] w from w), j as (select id, string_agg(case when instr('!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', w) > 0 and w not in ('-', '(') then w else ' ' || w end, '' order by i) t from x group by id), t as (select id, trim(replace(replace(t, ' ''', ''''), '( ', '(')) as sentence from j) "


def _sentences(s, d):
    words = F.array(*[F.lit(x) for x in ("a", "(", "b", ")", "-", ".", "'s", "c#", ",")])
    own = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.element_at(words, ((F.col("o_orderkey") * 7 + i * 5) % 9 + 1).cast("int")))
    return X._t(s, d, "orders").where("o_orderkey <= 300").select(F.col("o_orderkey").alias("id"), structured.sentence_text(own).alias("sentence"))


@_query("sentence_text", _WORDS + "select id, sentence from t")
def _(s, d):
    return _sentences(s, d)


@_query("plain_sentences", _WORDS + "select id from t where length(sentence) > 1 and not contains(sentence, '#')")
def _(s, d):
    return _sentences(s, d).where(structured.is_plain_sentence(F.col("sentence"))).select("id")


@_query("replaced_tokens", _WORDS + "select id, replace(translate(sentence, 'ab', 'ba'), '#', '') as sentence from t")
def _(s, d):
    return _sentences(s, d).select("id", structured.replaced(F.col("sentence"), (("#", ""), ("a", "b"), ("b", "a"))).alias("sentence"))


@_query("coloured_sentences", _WORDS + "select id, case when regexp_matches(sentence, '\\bb\\b') then regexp_replace(sentence, '\\bb\\b', chr(27) || '[31mb' || chr(27) || '[0m', 'g') else replace(sentence, 'b', chr(27) || '[31mb' || chr(27) || '[0m') end as sentence from t")
def _(s, d):
    return _sentences(s, d).select("id", structured.coloured(F.col("sentence"), "b").alias("sentence"))


@_query("shown_token_issues", _TOKENS + ", f as (select * from hits order by own, sentence_id, token_id limit 5), st as (select conv_id as sentence_id, trim(string_agg(' ' || role, '' order by turn)) as sentence from conversations group by 1) select f.sentence_id, f.token_id, token || ': given ' || label || ', predicted ' || am as note, sentence from f join st using (sentence_id)")
def _(s, d):
    t = X.tokens(s, d)
    return structured.show_token_issues(t, structured.token_issues(t, "confident_learning"), 5)


_SPAN = "with tk as (select conv_id as sentence_id, turn as token_id, role as token, (role = 'user')::int as label, ((conv_id * 7919 + turn * 613) % 97 + 1 + case when (role = 'user') <> ((conv_id + turn) % 9 = 0) then 300 else 0 end) / 400e0 as p from conversations), "


def _spans(s, d):
    return X._t(s, d, "conversations").selectExpr(
        "conv_id as sentence_id", "turn as token_id", "role as token", "cast(role = 'user' as int) as label",
        "((conv_id * 7919 + turn * 613) % 97 + 1 + case when (role = 'user') <> ((conv_id + turn) % 9 = 0) then 300 else 0 end) / 400e0 as p",
    )


@_query("span_scores", _SPAN + "z as (select 1) select sentence_id, round(min(case when label = 1 then p else 1 - p end), 6) as score from tk group by 1")
def _(s, d):
    return structured.span_scores(_spans(s, d)).select("sentence_id", _r("score").alias("score"))


@_query("span_issues", _SPAN + "t as (select avg(p) filter (label = 1) t1, avg(1 - p) filter (label = 0) t0 from tk), g as (select *, case when p >= t1 - 1e-6 and 1 - p >= t0 - 1e-6 then (p > 1 - p)::int when p >= t1 - 1e-6 then 1 when 1 - p >= t0 - 1e-6 then 0 end g from tk, t) select sentence_id, token_id from g where g <> label and not (case when label = 1 then p + 1e-6 > 1 - p else 1 - p + 1e-6 > p end)")
def _(s, d):
    return structured.span_issues(_spans(s, d), filter_by="confident_learning")


# Pixels


@_query("pixel_issues_downsampled", f"with x as ({O.X8}), sm as (select image_id, y // 2 y, x // 2 x, round_even(avg(label), 0)::int label, avg(p1) / (avg(p1) + avg(1 - p1)) p1 from x group by all), t as (select avg(p1) filter (label = 1) t1, avg(1 - p1) filter (label = 0) t0 from sm), y as (select *, case when label = 1 then p1 else 1 - p1 end own, (p1 > 1 - p1)::int am, greatest(p1, 1 - p1) pm from sm), n as (select count(*) n from y, t where am <> label and pm >= case when am = 1 then t1 else t0 end - 1e-6), r as (select *, row_number() over (order by round(own, 9), image_id, y, x) r from y), b as (select image_id, y, x from r, n where r <= n) select x.image_id, x.y, x.x from x join b on b.image_id = x.image_id and b.y = x.y // 2 and b.x = x.x // 2 where (p1 > 1 - p1)::int <> label")
def _(s, d):
    return structured.pixel_issues(_pixels(s, d), downsample=2)


@_query("image_issue_scores", O.PIXELS + "select image_id, round(1 - count(hits.y)::double / count(*), 6) as score from x left join hits using (image_id, y, x) group by 1")
def _(s, d):
    return structured.image_issue_scores(_pixels(s, d)).select("image_id", _r("score").alias("score"))


@_query("low_pixels", O.PIXELS + "select image_id, y, x, round(own, 6) as score from y where own < 2e-1")
def _(s, d):
    return structured.low_pixels(_pixels(s, d), 0.2).select("image_id", "y", "x", _r("score").alias("score"))


@_query("low_images", O.PIXELS + ", s as (select image_id, sum(own * exp((1 - own) / 1e-1)) / sum(exp((1 - own) / 1e-1)) s from y group by 1), k as (select *, row_number() over (order by s, image_id) r from s) select image_id, round(s, 6) as score from k where r <= (select count(*) + 1 from s where s < 2e-1)")
def _(s, d):
    return structured.low_images(structured.image_scores(_pixels(s, d)), 0.2).select("image_id", _r("score").alias("score"))


@_query("pixels_of_class", O.PIXELS + "select image_id, y, x from hits where label = 0 or am = 0")
def _(s, d):
    p = _pixels(s, d)
    return structured.pixels_of_class(p, structured.pixel_issues(p), 0)


@_query("images_by_issues", O.PIXELS + "select image_id, count(*) as num_pixel_issues from hits group by 1 order by 2 desc, 1 limit 2")
def _(s, d):
    return structured.images_by_issues(structured.pixel_issues(_pixels(s, d)), 2)


# Boxes


@_query("box_image_scores_weighted", _box_scores("5e-1", "3e-1", "2e-1"))
def _(s, d):
    got = structured.box_image_scores(X.boxes(s, d), X.predicted_boxes(s, d), {"overlooked": 0.5, "badloc": 0.3, "swap": 0.2})
    return got.select("image_id", *[_r(c).alias(c) for c in ("overlooked", "badloc", "swap", "label_quality")])


@_query("low_box_images", f"with s as ({_box_scores('1e0 / 3', '1e0 / 3', '1e0 / 3').replace('round(exp(', '(exp(').replace(', 6) as label_quality', ') as label_quality')}) select image_id, round(label_quality, 6) as label_quality from s where label_quality <= 4e-1")
def _(s, d):
    got = structured.box_image_scores(X.boxes(s, d), X.predicted_boxes(s, d)).select("image_id", "label_quality")
    return structured.issues_from_scores(got, 0.4, "label_quality", inclusive=True).select("image_id", _r("label_quality").alias("label_quality"))


@_query("likely_boxes", O.X6 + "z as (select 1) select image_id, box_id, p from px where p >= 9e-1")
def _(s, d):
    return structured.likely_boxes(X.predicted_boxes(s, d), 0.9).select("image_id", F.col("box_id").cast("int").alias("box_id"), "p")


@_query("least_box_probability", O.X6 + "z as (select 1) select min(p) as p from px")
def _(s, d):
    return s.createDataFrame([(structured.least_probability(X.predicted_boxes(s, d)),)], "p double")


@_query("flat_predictions", O.X6 + "z as (select *, row_number() over (partition by image_id order by label, box_id) - 1 as n from px) select image_id, n::int as box_id, x1, y1, x2, y2, label, p from z")
def _(s, d):
    one = X.predicted_boxes(s, d).withColumn("v", F.struct("box_id", F.array("x1", "y1", "x2", "y2", "p").alias("a")))
    by = one.groupBy("image_id", "label").agg(F.sort_array(F.collect_list("v")).alias("v")).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.col("v.a").alias("a")))).alias("m"))
    nested = by.select("image_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.coalesce(F.element_at("m", c), F.array().cast("array<array<double>>"))).alias("boxes"))
    return structured.flat_predictions(nested)


@_query("box_corner_and_size", O.X6 + "z as (select 1) select image_id, box_id, label, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h from bx")
def _(s, d):
    return structured.corner_and_size(X.boxes(s, d))


@_query("box_counts", O.X6 + "n as (select image_id, count(*) n from bx group by 1), m as (select image_id, count(*) m from px group by 1) select coalesce(n.image_id, m.image_id) as image_id, coalesce(n, 0) as n_boxes, coalesce(m, 0) as n_predicted from n full join m on n.image_id = m.image_id")
def _(s, d):
    return structured.box_counts(X.boxes(s, d), X.predicted_boxes(s, d))


@_query("box_counts_sorted", O.X6 + "m as (select image_id, count(*) m from px group by 1) select image_id, 4::bigint as n_boxes, coalesce(m, 0) as n_predicted from (select distinct image_id from bx) left join m using (image_id) order by 2 desc, 3 desc, 1 limit 20")
def _(s, d):
    return structured.box_counts(X.boxes(s, d), X.predicted_boxes(s, d)).limit(20)


@_query("each_box_area", O.X6 + "z as (select 1) select image_id, box_id, label, (x2 - x1) * (y2 - y1) as area from bx")
def _(s, d):
    return structured.each_box_area(X.boxes(s, d))


@_query("box_area_histogram", O.X6 + "ar as (select label, (x2 - x1) * (y2 - y1) a from bx), e as (select label, min(a) lo, greatest((max(a) - min(a)) / 5, 1e-12) w from ar group by 1), b as (select label, least(floor((a - lo) / w), 4)::int bin, lo, w from ar join e using (label)) select label, bin, round(lo + bin * w, 6) as low, round(lo + (bin + 1) * w, 6) as high, count(*) as n from b group by all")
def _(s, d):
    return show.area_histogram(structured.each_box_area(X.boxes(s, d)), 5).select("label", "bin", _r("low").alias("low"), _r("high").alias("high"), "n")


# Crowds


@_query(
    "crowd_labels_ensemble",
    O.X2.replace("fr as", O.PROBS.format("tq", 7907, 104723) + "mp as (select task_id, k, (tp.p + tq.p) / 2 p from tp join tq using (task_id, k)), fr as").replace("join tp on tp.task_id = vt.task_id and tp.k = vt.label", "join mp on mp.task_id = vt.task_id and mp.k = vt.label")
    + O.posterior(["tp", "tq"]) + O.again(O.posterior(["tp", "tq"])) + "fin as (select con2.task_id, consensus, round(q, 6) as consensus_quality, round(avg((label = consensus)::int), 6) as agreement, count(*)::bigint as n_annotations from con2 join po2 on po2.task_id = con2.task_id and po2.k = consensus join votes on votes.task_id = con2.task_id group by con2.task_id, consensus, q) select * from fin",
)
def _(s, d):
    found = audits.crowd_labels(X.crowd(s, d), X.two_models(s, d), 3, ("m_0", "m_1")).labels
    return found.select("task_id", "consensus", _r("consensus_quality").alias("consensus_quality"), _r("agreement").alias("agreement"), "n_annotations")


@_query("crowd_labels_by_agreement", O.X2 + "z as (select 1) select task_id, consensus, round(avg((label = consensus)::int), 6) as consensus_quality, count(*)::bigint as n_annotations from votes join cons using (task_id) group by 1, 2")
def _(s, d):
    found = audits.crowd_labels(X.crowd(s, d), X.task_probs(s, d), 3, quality="agreement").labels
    return found.select("task_id", "consensus", _r("consensus_quality").alias("consensus_quality"), "n_annotations")


@_query("lost_classes", O.X2 + "z as (select 1) select distinct label from votes where label not in (select consensus from cons)")
def _(s, d):
    v = X.crowd(s, d)
    return audits.lost_classes(v, audits.majority_vote(v, X.task_probs(s, d)))


# Regression and tables


@_query("regression_residual_scores", f"with x as ({O.X5}) select id, round(exp(-abs(prediction - y)), 6) as label_quality from x")
def _(s, d):
    return audits.regression_scores(X.regression(s, d), "residual").select("id", _r("label_quality").alias("label_quality"))


@_query("commonest_null_pattern", f"with x as ({O.X7}), y as (select id, (a is null)::int || '' || (b is null)::int || '' || (c is null)::int as pattern from x), t as (select pattern from y where pattern <> '000' group by 1 order by count(*) desc, 1 limit 1) select id, pattern from y join t using (pattern)")
def _(s, d):
    name, rows = audits.commonest_null_pattern(X.partial_nulls(s, d), ["a", "b", "c"])
    return rows.withColumn("pattern", F.lit(name))


@_query("property_issues", "with x as (select o_orderkey as id, (o_orderkey * 7919 % 1000) / 1e3 as dark, (o_orderkey * 7907 % 1000) / 1e3 as blurry from orders) select id, dark < 5e-2 as is_dark_issue from x")
def _(s, d):
    x = X._t(s, d, "orders").selectExpr("o_orderkey as id", "(o_orderkey * 7919 % 1000) / 1e3 as dark", "(o_orderkey * 7907 % 1000) / 1e3 as blurry")
    return audits.property_issues(x, {"dark": 0.05, "blurry": 0.5})[0]


# Neighbours


@_query("near_duplicate_sets", O.KNN + "nn as (select i as id, d from e where rank = 1), m as (select median(d) m from nn), c as (select i, j from e, m where d < 9e-1 * m), s as (select i, j from c union select j, i from c) select i as id, string_agg(j::varchar, ',' order by j) as near_duplicate_set from s group by 1")
def _(s, d):
    got = neighbors.near_duplicate_sets(neighbors.knn_edges(_vectors(s, d)), 0.9)
    return got.select("id", F.array_join(F.col("near_duplicate_set").cast("array<string>"), ",").alias("near_duplicate_set"))


_SPLIT = "with v as (select vec_id, embedding::double[] x from embeddings), w as (select a.vec_id i, b.vec_id j, list_cosine_distance(a.x, b.x) d from v a, v b where a.vec_id <> b.vec_id and b.vec_id % 2 = 0), r as (select *, row_number() over (partition by i order by d, j) rank from w), e as (select * from r where rank <= 10), av as (select i id, avg(d) x from e group by 1), sc as (select median(x) s from av where id % 2 = 0) "


@_query("outliers_of_new_rows", _SPLIT + "select id, round(exp(-x / s), 6) as score from av, sc where id % 2 = 1")
def _(s, d):
    v = _vectors(s, d)
    return neighbors.OutlierDetector().fit(v.where("id % 2 = 0")).score(v.where("id % 2 = 1")).select("id", _r("score").alias("score"))


@_query("outliers_of_fitted_rows", _SPLIT + "select id, round(exp(-x / s), 6) as score from av, sc where id % 2 = 0")
def _(s, d):
    return neighbors.OutlierDetector().fit_score(_vectors(s, d).where("id % 2 = 0")).select("id", _r("score").alias("score"))


@_query("doubtful_new_rows", O.X1C + "t2 as (select k, avg(p) t from p where k = label and id % 2 = 0 group by 1), ad as (select id, k, p - t + max(t) over () q from p join t2 using (k) where id % 2 = 1), nq as (select id, q / sum(q) over (partition by id) q from ad) select id, round(1 + sum(case when q > 0 then q * ln(q) else 0 end) / ln(5), 6) as score from nq group by 1")
def _(s, d):
    x = X.class_probs(s, d)
    return neighbors.OutlierDetector().fit(x.where("id % 2 = 0")).score(x.where("id % 2 = 1")).select("id", _r("score").alias("score"))


_MANHATTAN = "with v as (select vec_id, embedding::double[] x from embeddings where vec_id < 300), w as (select a.vec_id i, b.vec_id j, list_sum(list_transform(list_zip(a.x, b.x), lambda t: abs(t[1] - t[2]))) d from v a, v b where a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by i order by d, j) rank from w) select i, rank::int as rank, j, round(d, 6) as d from r where rank <= 3"


@_query("knn_minkowski", _MANHATTAN)
def _(s, d):
    return neighbors.knn_edges(_vectors(s, d).where("id < 300"), 3, ("minkowski", 1.0)).select("i", "rank", "j", _r("d").alias("d"))


@_query("knn_of_own_metric", _MANHATTAN)
def _(s, d):
    return neighbors.knn_edges(_vectors(s, d).where("id < 300"), 3, lambda a, b: np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)).select("i", "rank", "j", _r("d").alias("d"))


@_query("knn_from_index", O.KNN + "z as (select 1) select i, rank::int as rank, j, round(d, 6) as d from e where rank <= 4")
def _(s, d):
    e = neighbors.knn_edges(_vectors(s, d), 4).groupBy(F.col("i").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "j", "d"))).alias("x"))
    return neighbors.edges_of_index(e.select("id", F.col("x.j").alias("neighbors"), F.col("x.d").alias("distances"))).select("i", "rank", "j", _r("d").alias("d"))


_COPIES = "cp as (select vec_id as id, vec_id as o from embeddings union all select vec_id + 1000000, vec_id from embeddings where vec_id % 10 = 0 union all select vec_id + 2000000, vec_id from embeddings where vec_id % 20 = 0), "


def _with_copies(s, d):
    v = _vectors(s, d).select("id", "features")
    more = lambda n, by: v.where(F.col("id") % n == 0).withColumn("id", F.col("id") + by)
    return v.unionByName(more(10, 1000000)).unionByName(more(20, 2000000))


@_query("equal_rows", O.KNN.split("w as")[0] + _COPIES + "g as (select o, count(*) n from cp group by 1 having count(*) > 1) select id, o as first, n from cp join g using (o)")
def _(s, d):
    return neighbors.equal_rows(_with_copies(s, d))


@_query("knn_corrected", O.KNN + _COPIES + "z as (select i, j, d from e where rank <= 3 union all select a.id, b.id, 0e0 from cp a join cp b on a.o = b.o and a.id <> b.id), k as (select i, j, d, row_number() over (partition by i order by d, j) rank from z) select i, rank::int as rank, j, round(d, 6) as d from k where rank <= 3")
def _(s, d):
    e = neighbors.knn_edges(_vectors(s, d), 3)
    return neighbors.corrected(e, _with_copies(s, d), 3).select("i", "rank", "j", _r("d").alias("d"))


# Streams, read as two batches


@_query("stream_thresholds", O.X1C + "select k, round(t, 6) as t from thr")
def _(s, d):
    return s.createDataFrame(list(enumerate(_inspected(s, d).thresholds())), "k int, t double").select("k", _r("t").alias("t"))


def _inspected(s, d) -> StreamAudit:
    x, one = X.class_probs(s, d), StreamAudit(5)
    for part in (0, 1):
        one.update_thresholds(x.where(F.col("id") % 2 == part))
    return one


@_query("stream_issue_ids", O.X1C + _BATCH + "nn as (select count(*) n from gb where g <> label), rk as (select *, row_number() over (order by own, id) r from a) select id from rk, nn where r <= n")
def _(s, d):
    x, one = X.class_probs(s, d), _inspected(s, d)
    halves = [one.score(x.where(F.col("id") % 2 == part)) for part in (0, 1)]
    return one.issue_ids(halves[0].unionByName(halves[1]))


@_query("stream_scores", O.X1C + _BATCH + "z as (select 1) select a.id, round(a.own, 6) as label_quality, coalesce(g <> a.label, false) as is_candidate from a join gb using (id)")
def _(s, d):
    return _inspected(s, d).score(X.class_probs(s, d), count=False).select("id", _r("label_quality").alias("label_quality"), "is_candidate")


# Contracts: rows that break each rule, of tables with rows broken on purpose


def _contract(name: str, sql: str, table, rules) -> None:
    @_query(f"contract_{name}", sql)
    def _(s, d):
        return contracts.violations(table(s, d), **rules())


def _counts(source: str, **reasons: str) -> str:
    return f"with x as ({source}) " + " union all ".join(f"select '{r}' as reason, count(*) filter ({c}) as rows from x" for r, c in reasons.items())


_contract(
    "class_rows",
    _counts("select o_orderkey as id from orders", label="id % 101 = 0", size="id % 103 = 0", range="id % 107 = 0 and id % 103 <> 0", total="id % 103 = 0 or id % 107 = 0"),
    lambda s, d: X.class_probs(s, d).selectExpr("id", "if(id % 101 = 0, 7, label) as label", "case when id % 103 = 0 then slice(pred_probs, 1, 3) when id % 107 = 0 then transform(pred_probs, x -> x + 2) else pred_probs end as p")
    .withColumn("pred_probs", F.when(F.col("id") % 103 == 0, F.transform("p", lambda x: x * 0.1)).otherwise(F.col("p"))),
    lambda: contracts.class_rules(5),
)
_contract(
    "multilabel_rows",
    _counts("select o_orderkey as id from orders", size="id % 101 = 0", bits="id % 103 = 0 and id % 101 <> 0", range="id % 107 = 0"),
    lambda s, d: X.multilabel(s, d).selectExpr("id", "case when id % 101 = 0 then slice(bits, 1, 2) when id % 103 = 0 then transform(bits, b -> b + 2) else bits end as bits", "if(id % 107 = 0, transform(probs, p -> p - 3), probs) as probs"),
    lambda: contracts.multilabel_rules(4),
)
_contract(
    "regression_rows",
    _counts("select o_orderkey as id from orders", y="id % 101 = 0", prediction="id % 103 = 0"),
    lambda s, d: X.regression(s, d).selectExpr("id", "if(id % 101 = 0, null, y) as y", "if(id % 103 = 0, double('NaN'), prediction) as prediction"),
    lambda: contracts.regression_rules(),
)
_contract(
    "vote_rows",
    _counts(_SQL["annotation_quality"].replace("fin as", "fi2 as").replace("select * from fin", "select task_id, annotator_id from votes"), task_id="task_id % 101 = 0", annotator_id="annotator_id = 3", label="task_id % 103 = 0"),
    lambda s, d: X.crowd(s, d).selectExpr("if(task_id % 101 = 0, null, task_id) as task_id", "if(annotator_id = 3, null, annotator_id) as annotator_id", "if(task_id % 103 = 0, 9, label) as label"),
    lambda: contracts.crowd_rules(3),
)
_contract(
    "box_rows",
    _counts(O.X6 + "z as (select 1) select image_id as id, p from px", corners="id % 7 = 0", label="id % 11 = 0", p="id % 13 = 0"),
    lambda s, d: X.predicted_boxes(s, d).selectExpr("image_id", "if(image_id % 7 = 0, x2 + 1, x1) as x1", "y1", "x2", "y2", "if(image_id % 11 = 0, -1, label) as label", "if(image_id % 13 = 0, 1.5D, p) as p"),
    lambda: contracts.box_rules(predicted=True),
)
