"""Shared parts of the SQL that the catalog's queries are compared with."""

import re

_K5 = "(select unnest(range(5))::int k)"


def _probs(a: int, b: int) -> str:
    return f"""
b as (select o_orderkey id, o_custkey ck, cast(substr(o_orderpriority, 1, 1) as int) - 1 as label from orders),
g as (select *, (case when id % 7 = 0 then (label + 1 + ((id // 7) % 4)) % 5 else label end)::int as guess from b),
l as (select id, label, k, ((id * {a} + k * {b} + ck * 31) % 997) + 1 + case when k = guess then 900 else 0 end as raw from g, {_K5}),
p as (select id, label, k, raw::double / sum(raw) over (partition by id) as p from l)"""


X1P2 = "with " + _probs(7907, 104723).strip() + " select * from p"

def joint_of(classes: int) -> str:
    """From p(id, label, k, p) to thresholds, single rows, guesses, raw and calibrated joint."""
    grid = f"(select unnest(range({classes}))::int k)"
    return f"""thr as (select k, greatest(avg(p), 2e-6) t from p where k = label group by k),
a as (select id, any_value(label)::int label, max(p) pm, min(k) filter (p = mp)::int am, max(p) filter (k = label) own, max(p) filter (k <> label) other,
  max(p) filter (k = label) + 1e-6 > max(p) filter (k <> label) near, list(p order by k) ps
  from (select *, max(p) over (partition by id) mp from p) group by id),
conf as (select id, count(*) n, min(p.k) one from p join thr using (k) where p.p >= thr.t - 1e-6 group by id),
guess as (select a.id, a.label, case when n = 1 then one when n > 1 then am end::int g from a left join conf using (id)),
grid as (select x.k given, y.k guess from {grid} x, {grid} y),
cnt as (select label, g, count(*) n from guess where g is not null group by all),
raw as (select given, guess, greatest(coalesce(n, 0), case when given = guess then 1 else 0 end) c from grid left join cnt on label = given and g = guess),
lc as (select label given, count(*) n from a group by 1),
c1 as (select given, guess, c::double / sum(c) over (partition by given) * n v from raw join lc using (given)),
c2 as (select given, guess, v / sum(v) over () * (select count(*) from a) v from c1),
c3 as (select *, round_even(v, 0) r, round_even(sum(v) over (partition by given), 0) - sum(round_even(v, 0)) over (partition by given) gap,
  row_number() over (partition by given order by v - round_even(v, 0) desc, guess desc) up, row_number() over (partition by given order by v - round_even(v, 0), guess) down from c2),
cal as (select given, guess, r + case when gap > 0 and up <= gap then 1 when gap < 0 and down <= -gap then -1 else 0 end c from c3),
"""


X1C = f"with {_probs(7919, 104729).strip()},\n" + joint_of(5)

BY_RATE = """m as (select p.id, p.label, p.k, p.p - a.own m from p join a using (id) where p.k <> p.label),
rk as (select id, label, k, row_number() over (partition by label, k order by m desc, id) r from m),
by_rate as (select distinct id, true hit from rk join cal on cal.given = rk.label and cal.guess = rk.k where r <= c),
"""

BY_CLASS = """rc as (select id, label, row_number() over (partition by label order by own, id) r from a),
by_class as (select id, true hit from rc join cal on cal.given = rc.label and cal.guess = rc.label join lc on lc.given = rc.label where r <= n - c),
"""

KNN = """with v as (select vec_id, embedding::double[] x from embeddings),
w as (select a.vec_id i, b.vec_id j, list_cosine_distance(a.x, b.x) d from v a, v b where a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by i order by d, j) rank from w), e as (select * from r where rank <= 10),
"""

X2 = """with votes as (select distinct l_partkey as task_id, l_suppkey % 20 as annotator_id,
  (case when (l_partkey * 31 + (l_suppkey % 20) * 17) % 10 < (l_suppkey % 20) % 5 then (l_partkey + 1 + ((l_partkey + l_suppkey % 20) % 2)) % 3 else l_partkey % 3 end)::int as label
  from lineitem),
tpr as (select p_partkey as task_id, k, ((p_partkey * 7919 + k * 104729) % 997) + 1 + case when k = (case when p_partkey % 9 = 0 then p_partkey + 1 else p_partkey end) % 3 then 700 else 0 end as raw
  from part, (select unnest(range(3))::int k)),
tp as (select task_id, k, raw::double / sum(raw) over (partition by task_id) p from tpr),
vn as (select task_id, label, count(*) n from votes group by all),
vt as (select * from (select *, max(n) over (partition by task_id) b from vn) where n = b),
fr as (select label, count(*) f from votes group by 1),
un as (select task_id, any_value(label) w from vt group by 1 having count(*) = 1),
ag as (select annotator_id, avg((label = w)::int) g from votes join un using (task_id) group by 1),
su as (select task_id, label, avg(g) g from votes join ag using (annotator_id) group by all),
cr as (select vt.task_id, vt.label, row_number() over (partition by vt.task_id order by p desc, f, g desc, vt.label) r
  from vt join fr using (label) join su on su.task_id = vt.task_id and su.label = vt.label join tp on tp.task_id = vt.task_id and tp.k = vt.label),
cons as (select task_id, label as consensus from cr where r = 1),
"""

X3 = """with ml as (select o_orderkey as id, k, case when (o_orderkey * (k + 3) + o_custkey) % 5 < 2 then 1 else 0 end as bit,
  cast(((o_orderkey * 7919 + k * 104729 + o_custkey * 31) % 89) + 5 + case when ((o_orderkey * (k + 3) + o_custkey) % 5 < 2) <> ((o_orderkey + k) % 11 = 0) then 400 else 0 end as double) / 500 as p
  from orders, (select unnest(range(4))::int k))"""

X3_FLAGS = """, t as (select k, avg(p) filter (bit = 1) t1, avg(1 - p) filter (bit = 0) t0 from ml group by k),
c as (select ml.*, p >= t1 - 1e-6 c1, 1 - p >= t0 - 1e-6 c0, case when p > 1 - p then 1 else 0 end am from ml join t using (k)),
gs as (select *, case when c1 and c0 then am when c1 then 1 when c0 then 0 end g from c),
flags as (select id, k, bit, coalesce(g <> bit, false) and not (case when bit = 1 then p + 1e-6 > 1 - p else 1 - p + 1e-6 > p end) hit from gs)
"""

X4 = """with t as (select conv_id as sentence_id, turn as token_id, role as token, case role when 'system' then 0 when 'user' then 1 else 2 end as label from conversations),
l as (select t.*, k, ((sentence_id * 7919 + token_id * 613 + k * 104729) % 997) + 1 + case when k = (label + case when (sentence_id * 8 + token_id) % 7 = 0 then 1 else 0 end) % 3 then 900 else 0 end as raw
  from t, (select unnest(range(3))::int k)),
tk as (select sentence_id, token_id, token, label, k, raw::double / sum(raw) over (partition by sentence_id, token_id) as p from l),
"""

X4_FLAGS = """thr as (select k, avg(p) t from tk where k = label group by k),
ta as (select sentence_id, token_id, token, label, arg_max(k, p) am, max(p) filter (k = label) own, max(p) filter (k <> label) other from tk group by all),
tc as (select sentence_id, token_id, count(*) n, min(tk.k) one from tk join thr using (k) where p >= t - 1e-6 group by all),
hits as (select ta.* from ta join tc using (sentence_id, token_id) where (case when n = 1 then one else am end) <> label and not own + 1e-6 > other)
"""

X5 = "select o_orderkey as id, o_totalprice / 1e5 as y, o_totalprice / 1e5 * (1e0 + (((o_orderkey * 7919) % 201) - 100) / 1e3) + case when o_orderkey % 50 = 0 then 3e0 else 0e0 end as prediction from orders"

X6 = """with bx as (select o_orderkey as image_id, b as box_id, cast((o_orderkey * 37 + b * 61) % 200 as double) as x1, cast((o_orderkey * 53 + b * 29) % 200 as double) as y1,
  cast((o_orderkey * 37 + b * 61) % 200 + 20 + (o_orderkey * 7 + b * 13) % 60 as double) as x2, cast((o_orderkey * 53 + b * 29) % 200 + 20 + (o_orderkey * 5 + b * 19) % 60 as double) as y2, ((o_orderkey + b) % 4)::int as label
  from orders, (select unnest(range(4))::int b)),
px as (select image_id, box_id, x1 + (image_id + box_id) % 5 as x1, y1 + (image_id + 2 * box_id) % 4 as y1, x2 + (image_id + box_id) % 5 as x2, y2 + (image_id + 2 * box_id) % 4 as y2,
  (case when (image_id * 3 + box_id) % 10 = 0 then (label + 1) % 4 else label end)::int as label,
  case when (image_id * 3 + box_id) % 10 = 0 then 97e-2 else 6e-1 + ((image_id * 11 + box_id * 7) % 40) / 1e2 end as p from bx where (image_id + box_id) % 9 <> 0
  union all select o_orderkey, 99, 4e2, 4e2, 44e1, 44e1, (o_orderkey % 4)::int, 97e-2 from orders where o_orderkey % 6 = 0),
pr as (select l.image_id, l.box_id, l.label, p.box_id as pred_id, p.label as pred_label, p.p,
  greatest(least(l.x2, p.x2) - greatest(l.x1, p.x1), 0) * greatest(least(l.y2, p.y2) - greatest(l.y1, p.y1), 0) i,
  (l.x2 - l.x1) * (l.y2 - l.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) s, sqrt(pow((l.x1 + l.x2 - p.x1 - p.x2) / 2, 2) + pow((l.y1 + l.y2 - p.y1 - p.y2) / 2, 2)) d
  from bx l join px p on l.image_id = p.image_id),
pairs as (select *, i / greatest(s - i, 1e-6) iou, 9e-1 * i / greatest(s - i, 1e-6) + 1e-1 * exp(-1e-1 * d) sim from pr),
"""

X7 = "select c_custkey as id, case when c_custkey % 7 = 0 then null else c_acctbal end as a, case when c_custkey % 5 = 0 then null else c_nationkey end as b, case when c_custkey % 7 = 0 and c_custkey % 3 = 0 or c_custkey % 35 = 0 then null else c_mktsegment end as c from customer"

X8 = "select n_nationkey as image_id, y, x, case when (y < 8) = (n_nationkey % 8 <> 3) then 1 else 0 end as label, (cast((n_nationkey * 7919 + y * 104729 + x * 1299709) % 97 as double) + 1 + case when y < 8 then 150 else 20 end) / 300 as p1 from nation, (select unnest(range(16))::int y), (select unnest(range(16))::int x)"


PROBS = """{0}r as (select p_partkey as task_id, k, ((p_partkey * {1} + k * {2}) % 997) + 1 + case when k = (case when p_partkey % 9 = 0 then p_partkey + 1 else p_partkey end) % 3 then 700 else 0 end as raw
  from part, (select unnest(range(3))::int k)),
{0} as (select task_id, k, raw::double / sum(raw) over (partition by task_id) p from {0}r),
"""


def posterior(models: list[str]) -> str:
    """Consensus weights and the posterior after X2, for the tables (task_id, k, p) of some models."""
    each = "".join(
        f"am{i} as (select task_id, k from (select *, row_number() over (partition by task_id order by p desc, k) r from {m}) where r = 1),\n"
        f"w{i} as (select greatest(1 - avg((k <> consensus)::int) / any_value(b), 1e-6) * any_value(root) as mw from cons join multi using (task_id) join am{i} using (task_id), be, sz),\n"
        for i, m in enumerate(models)
    )
    total = " + ".join(f"(select mw from w{i})" for i in range(len(models)))
    mixed = " + ".join(f"(select mw from w{i}) * m{i}.p" for i in range(len(models)))
    joined = " ".join(f"join {m} m{i} on m{i}.task_id = g.task_id and m{i}.k = g.k" for i, m in enumerate(models))
    return f"""multi as (select task_id from votes group by 1 having count(*) > 1),
sz as (select sqrt(avg(n)) root from (select count(*) n from votes group by task_id)),
cs as (select avg(a) agree from (select task_id, avg((label = consensus)::int) a from votes join cons using (task_id) group by 1) join multi using (task_id)),
tc as (select consensus from cons join multi using (task_id) group by 1 order by count(*) desc, 1 limit 1),
be as (select greatest(avg((consensus <> (select consensus from tc))::int), 1e-6) b from cons join multi using (task_id)),
pa as (select a.annotator_id, avg((a.label = b.label)::int) g from votes a join votes b on a.task_id = b.task_id and a.annotator_id <> b.annotator_id group by 1),
wa as (select annotator_id, greatest(1 - (1 - g) / b, 1e-6) w from pa, be),
{each}g as (select task_id, k, sum(w) ws, sum(w * case when label = k then agree else (1 - agree) / 2 end) s from votes join wa using (annotator_id), cs, (select unnest(range(3))::int k) group by 1, 2),
po as (select g.task_id, g.k, ws, ({mixed} + s) / ({total} + ws) q from g {joined}),
best as (select po.task_id, po.k, q, ws, {total} as mw, row_number() over (partition by po.task_id order by q desc, (po.k = consensus) desc, po.k) r from po join cons using (task_id)),
"""


def again(sql: str) -> str:
    """posterior() once more, from the best classes of the first (con2 in place of cons), under names that end in 2."""
    sql = re.sub(r"\bcons\b", "con2", sql)
    return "con2 as (select task_id, k as consensus from best where r = 1),\n" + re.sub(r"\b(multi|sz|cs|tc|be|pa|wa|am\d|w\d|g|po|best)\b", r"\g<1>2", sql)


_LOSS = """{0}z as (select t, task_id, k, exp(ln(greatest(p, 1e-30)) / t) z from t0, {0}t), {0}s as (select t, task_id, k, z / sum(z) over (partition by t, task_id) z from {0}z),
{0}l as (select t, -sum(share * ln(greatest(z, 1e-30))) l from {0}s join sh on sh.task_id = {0}s.task_id and sh.label = {0}s.k group by t),
"""
TEMPERATURE = (
    """sh as (select task_id, label, count(*) / sum(count(*)) over (partition by task_id) share from votes group by task_id, label),
ht as (select t, row_number() over (order by t) i from (select unnest([1e-1, 2e-1, 5e-1, 8e-1, 1e0, 2e0, 3e0, 5e0, 8e0]) t)),
"""
    + _LOSS.format("h")
    + """ci as (select i from hl join ht using (t) order by l, t limit 1),
ft as (select distinct t from (select a.t + (b.t - a.t) * unnest(range(5)) / 4e0 t from ht a, ht b, ci where b.i = a.i + 1 and (a.i = ci.i or b.i = ci.i))),
"""
    + _LOSS.format("f")
    + "bt as (select t from fl order by l, t limit 1),\n"
)
#: X2 with its probabilities as t0, and what follows on them at the best temperature.
X2T = X2.replace("tp as (select task_id, k, raw", "t0 as (select task_id, k, raw").replace("vn as", TEMPERATURE + "tp as (select task_id, k, z p from fs join bt using (t)),\nvn as")


#: The classes reached by two models of the crowd's tasks, each at its best temperature.
_SECOND = re.sub(r"\bt0\b", "u0", re.sub(r"\b(hz|hs|hl|ci|ft|fz|fs|fl|bt)\b", r"\1q", TEMPERATURE[TEMPERATURE.index("hz as"):]))
X2E = X2T.replace("fr as", PROBS.format("u0", 7907, 104723) + _SECOND + "tq as (select task_id, k, z p from fsq join btq using (t)),\nmp as (select task_id, k, (tp.p + tq.p) / 2 p from tp join tq using (task_id, k)),\nfr as").replace(
    "join tp on tp.task_id = vt.task_id and tp.k = vt.label", "join mp on mp.task_id = vt.task_id and mp.k = vt.label"
)

PIXELS = f"""with x as ({X8}), t as (select avg(p1) filter (label = 1) t1, avg(1 - p1) filter (label = 0) t0 from x),
y as (select *, case when label = 1 then p1 else 1 - p1 end own, case when p1 > 1 - p1 then 1 else 0 end am, greatest(p1, 1 - p1) pm from x),
n as (select count(*) n from y, t where am <> label and pm >= case when am = 1 then t1 else t0 end - 1e-6),
r as (select *, row_number() over (order by own, image_id, y, x) r from y),
hits as (select image_id, y, x, label, am from r, n where r <= n and am <> label)
"""

#: Per class of X3 the thresholds, counts, guesses and the 2 x 2 joint, raw and calibrated.
X3_JOINT = X3 + """, th as (select k, coalesce(greatest(avg(p) filter (bit = 1), 2e-6), 2) t1, coalesce(greatest(avg(1 - p) filter (bit = 0), 2e-6), 2) t0 from ml group by k),
cf as (select ml.*, case when bit = 1 then p else 1 - p end own, p >= t1 - 1e-6 c1, 1 - p >= t0 - 1e-6 c0, case when p > 1 - p then 1 else 0 end am, case when bit = 1 then p + 1e-6 > 1 - p else 1 - p + 1e-6 > p end near from ml join th using (k)),
gu as (select *, case when c1 and c0 then am when c1 then 1 when c0 then 0 end g from cf),
cells as (select k, given, guess from (select distinct k from ml), (select unnest([0, 1])::int given), (select unnest([0, 1])::int guess)),
rw as (select cells.k, given, guess, greatest(coalesce(n, 0), case when given = guess then 1 else 0 end) c from cells left join (select k, bit, g, count(*) n from gu where g is not null group by all) z on z.k = cells.k and bit = given and g = guess),
lc as (select k, bit given, count(*) n from ml group by 1, 2),
v1 as (select rw.k, given, guess, c::double / sum(c) over (partition by rw.k, given) * n v from rw join lc using (k, given)),
v2 as (select *, round_even(v, 0) r, round_even(sum(v) over (partition by k, given), 0) - sum(round_even(v, 0)) over (partition by k, given) gap,
  row_number() over (partition by k, given order by v - round_even(v, 0) desc, guess desc) up, row_number() over (partition by k, given order by v - round_even(v, 0), guess) down from v1),
ca as (select k, given, guess, (r + case when gap > 0 and up <= gap then 1 when gap < 0 and down <= -gap then -1 else 0 end)::bigint c from v2),
o1 as (select gu.*, row_number() over (partition by k, bit order by own, id) r from gu),
br as (select id, o1.k, bit, not near and r <= c hit from o1 join ca on ca.k = o1.k and ca.given = o1.bit and ca.guess = 1 - o1.bit),
"""
