"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target share of all words.  A document of a source is to be
taken ``target / source_size`` times; the whole part is certain, the fraction is
rounded by the pivotal method: two open documents swap words (one gains exactly
what the other loses) until one of them is integral.  The words of a source are
thus preserved through every step and only the very last open document of a
source is rounded to the nearer side, so a source misses its target by half a
document at most.  Blocks are folded from long to short documents, which leaves
a short one to the end.

The pairs are taken along a reduction tree.  Documents are dealt to blocks of
about ``block`` rows by a hash of their id, a block is folded in one pass and
leaves at most one open document, and the open documents of ``block`` blocks
make a block of the next level.  No level holds more than a block in a task, so
a source with a third of all rows is spread like any other.  All of it is
DataFrame expressions.

Every row is a document of its own.  Rows that agree in doc_id (null included),
source and size are counted first and numbered from 0 (``nth``), so that the
number and not the place of a row decides: blocks and draws are by doc_id, size
and nth, reruns agree, and many rows of one doc_id are dealt like any others.

Defined cases: null text counts as no words; a document without words is taken
zero times; null is a source of its own, the last; rows that repeat a doc_id or
have none are taken one by one; equal weights and sizes (ties) are ordered by a
hash; a text is only counted, however long; an empty table gives an empty result;
other columns are ignored by the plan and kept by ``take``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, free_name, kept_columns, numbered, table, unfolded

WEIGHTS = (5, 2, 1)
CAP = 3.0
BLOCK = 256
SEED = 20240607
#: Sources up to this many are joined by broadcast (under 100 bytes each); more are joined by salted shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 32


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values only, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row a source: source_key, source_size, n, target.

    Weights repeat over the sources in code point order, null last.  Targets are
    found by raising a water level: sources whose cap lies under the level stay
    at their cap and the rest share what is left by weight.  Every round is one
    aggregate over the sources; a source that is capped stays so.
    """
    per = sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    per = cut(per.withColumn("weight", w))
    full, total_w = per.agg(F.sum("source_size"), F.sum("weight")).first()
    full, level = float(full or 0), 0.0
    if full > 0:
        level, before = full / total_w, -1
        while True:
            capped = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
            n, held, open_w = per.agg(
                F.count_if(capped), F.sum(F.when(capped, F.col("source_size") * cap)), F.sum(F.when(~capped, F.col("weight")))
            ).first()
            if n == before or not open_w:
                break
            before, level = n, (full - float(held or 0)) / open_w
    return per.withColumn("target", F.least(F.col("source_size") * F.lit(cap), F.lit(level) * F.col("weight"))).select(
        "source_key", "source_size", "n", "target"
    )


def _with_sources(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), "source_key")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", "nth"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["source_key", "salt"]).drop("salt")


def _fold(items: Column) -> Column:
    """Pivotal rounding of an array of open documents: {out: decided documents, open: the one left or null}."""
    doc = "struct<doc_id:bigint,nth:bigint,size:bigint,source_size:bigint,target:double,whole:int,p:double>"
    none = F.lit(None).cast(doc)
    start = F.struct(F.array().cast(f"array<{doc}>").alias("out"), none.alias("open"))

    def moved(d: Column, p: Column) -> Column:
        return F.struct(d.doc_id.alias("doc_id"), d.nth.alias("nth"), d["size"].alias("size"), d.source_size.alias("source_size"), d.target.alias("target"), d.whole.alias("whole"), p.alias("p"))

    def step(state: Column, x: Column) -> Column:
        a = state["open"]
        sa, sb = a["size"].cast("double"), x["size"].cast("double")
        room, has = (1 - a.p) * sa, x.p * sb  # words that a can gain and x can give
        give, space = a.p * sa, (1 - x.p) * sb  # and the other way round
        up, down = F.least(room, has), F.least(give, space)
        gains = (up + down > 0) & (_uniform(a.doc_id, a.nth, a["size"], x.doc_id, x.nth, x["size"], F.lit(SEED)) * (up + down) < down)
        done_a = F.when(gains, room <= has).otherwise(give <= space)
        p_a = F.when(gains, F.when(done_a, F.lit(1.0)).otherwise(a.p + has / sa)).otherwise(F.when(done_a, F.lit(0.0)).otherwise(a.p - space / sa))
        p_x = F.when(gains, F.when(done_a, x.p - room / sb).otherwise(F.lit(0.0))).otherwise(F.when(done_a, x.p + give / sb).otherwise(F.lit(1.0)))
        inside = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        decided = F.when(done_a, moved(a, p_a)).otherwise(moved(x, p_x))
        left = F.when(done_a, moved(x, inside(p_x))).otherwise(moved(a, inside(p_a)))
        return F.when(a.isNull(), F.struct(state.out.alias("out"), x.alias("open"))).otherwise(
            F.struct(F.concat(state.out, F.array(decided)).alias("out"), left.alias("open"))
        )

    return F.aggregate(items, start, step)


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _key(source: str) -> Column:
    """A source by a name that is never null."""
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source)))


def mix_sources(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """Plan of a mix: doc_id, nth, source, size, source_size, target, copies int, taken long; a row for each document."""
    src = kept_columns(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", _size("text").alias("size"))
    alike = src.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("alike"))
    sized = cut(unfolded(alike.withColumn("source_key", _key("source")), F.col("alike"), "nth").drop("alike"))
    sources = cut(source_targets(sized, weights, cap))
    n_sources, largest = sources.agg(F.count(F.lit(1)), F.max("n")).first()
    rate = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    near = F.when(F.abs(rate - F.rint(rate)) < 1e-9, F.rint(rate)).otherwise(rate)
    rows = _with_sources(sized, sources, n_sources).withColumn("rate", near)
    rows = rows.withColumn("whole", F.floor("rate").cast("int")).withColumn("p", F.col("rate") - F.col("whole"))
    head = ["source", "doc_id", "nth", "size", "source_size", "target", "whole"]
    parts = [rows.where(F.col("p") == 0).select(*head, F.col("p").cast("double").alias("p"))]
    n_blocks = F.ceil(F.col("n") / F.lit(float(block)))
    level = rows.where(F.col("p") > 0).select(
        "source", F.pmod(F.xxhash64("doc_id", "size", "nth", F.lit(SEED)), n_blocks).alias("block"), n_blocks.alias("blocks"), F.struct("doc_id", "nth", "size", "source_size", "target", "whole", "p").alias("d")
    )
    count = math.ceil((largest or 0) / block)
    while largest:
        items = F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("d.size")).alias("s"), F.xxhash64(F.col("d.doc_id"), F.col("d.nth"), F.lit(SEED)).alias("h"), F.col("d").alias("d")))),
            lambda s: s.d,
        )
        done = cut(level.groupBy("source", "block", "blocks").agg(items.alias("items")).select("source", "block", "blocks", _fold(F.col("items")).alias("f")))
        parts.append(done.select("source", F.explode("f.out").alias("d")).select("source", "d.*"))
        left = done.where(F.col("f.open").isNotNull()).select("source", F.col("block"), F.col("blocks"), F.col("f.open").alias("d"))
        if count <= 1:
            parts.append(left.select("source", "d.*").withColumn("p", F.rint("p")))
            break
        count = math.ceil(count / block)
        level = left.select("source", F.floor(F.col("block") / F.lit(block)).alias("block"), F.ceil(F.col("blocks") / F.lit(float(block))).alias("blocks"), "d")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    copies = (F.col("whole") + F.col("p").cast("int")).cast("int")
    return out.select("doc_id", "nth", "source", "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"))


def take(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """The documents of a mix, all columns, each repeated as often as its plan takes it.

    Rows get numbers of their own first.  Rows that agree in doc_id, source and size are put in an
    order, by a hash of their texts inside salts whose totals shift them, and so meet their nth of
    the plan; the documents are then joined by row number, a key without repeats.
    """
    rows, row = numbered(docs)
    plan = mix_sources(rows, weights, cap, block).where(F.col("copies") > 0).select("doc_id", _key("source").alias("source_key"), "size", "nth", "copies")
    own = kept_columns(rows, row, "doc_id", "source", "text").toDF("row", "doc_id", "source", "text")
    own = own.select("row", F.col("doc_id").cast("bigint").alias("doc_id"), _key("source").alias("source_key"), _size("text").alias("size"), F.xxhash64("text").alias("h"))
    own = own.where("size > 0").withColumn("salt", F.pmod("h", F.lit(SALTS)) * SALTS + F.pmod("row", F.lit(SALTS)))
    alike = ["doc_id", "source_key", "size"]
    inside = own.groupBy(*alike, "salt").agg(F.count(F.lit(1)).alias("n"))
    starts = inside.select(*alike, "salt", (F.sum("n").over(W.partitionBy(*alike).orderBy("salt")) - F.col("n")).alias("start"))
    own = own.withColumn("nth", F.row_number().over(W.partitionBy(*alike, "salt").orderBy("h", "row")) - 1)

    def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
        hit = a["doc_id"].eqNullSafe(b["doc_id"])
        for n in names:
            hit = hit & (a[n] == b[n])
        return hit

    own = own.join(starts, same(own, starts, "source_key", "size", "salt")).select("row", own["doc_id"], own["source_key"], own["size"], (F.col("nth") + F.col("start")).alias("nth"))
    times = free_name(rows, "times")
    chosen = own.join(plan, same(own, plan, "source_key", "size", "nth")).select(F.col("row").alias(row), F.col("copies").cast("bigint").alias(times))
    return unfolded(rows.join(chosen, row), F.col(times), times).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix_source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of the sources, as the plan of op1 has them, with the words that it takes of each."""
    plan = mix_sources(table(spark, sf_dir, "documents"))
    near = F.abs(F.sum("taken") - F.max("target")) <= F.max("size")
    return plan.groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 4).alias("target"), near.alias("within_a_document"))


#: Sources by the level at which they reach their cap: the first whose cap lies above what is left for it sets the level of all from it on.
TARGETS_SQL = rf"""
with d as (select source, sum(len(regexp_extract_all(coalesce(text, ''), '{WORD}')))::bigint as source_size from documents group by source),
s as (select *, ([{", ".join(f"{w:e}" for w in WEIGHTS)}])[(row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1] as w, source_size * {CAP:e} as cap from d),
o as (select *, row_number() over (order by cap / w, source nulls last) as i from s),
l as (select *, ((select sum(source_size) from s) - coalesce(sum(cap) over (order by i rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by i rows between current row and unbounded following) as level from o),
t as (select level from l where cap / w > level order by i limit 1)
select source, source_size, round(least(cap, coalesce((select level from t) * w, cap)), 4) as target, true as within_a_document from s
"""

QUERIES = {"op1_mix_sources": op1_mix_sources, "mix_source_targets": mix_source_targets}
ORACLES = {"mix_source_targets": TARGETS_SQL}
