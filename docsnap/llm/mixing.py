"""Mixing sources to target weights with hash-threshold histograms.

Words are summed by source and hash bucket. In the sorted buckets of a source the budget ends
in one bucket; only the documents of that one are summed again over finer buckets, until it
holds a single hash value. What remains is one cut per source: a document is taken once more
if its hash is below the cut. Nothing is sorted but buckets, and no text moves.

A null text has size 0. A null source is a source of its own, the last. Documents with the same
id share a hash, so they are taken together. Extra columns do not matter. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsnap.llm.common import keep

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
HASH_BITS, LEVEL_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix_hash(doc_id: Column) -> Column:
    """60 bits that depend on the id alone, so that reruns agree."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """``source``, ``source_size`` and ``target``, one row per source.

    The sum of all sizes is shared by weight; a source gets at most ``most`` times its size, and
    what it cannot use is shared among the others. Filling in the order of size per weight gives
    the common level at once: the first source that is not full fixes it. The windows without
    a partition see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fullest = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    onward = fullest.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast(
        "double"
    ) / F.sum("weight").over(onward).cast("double")
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight.cast("bigint"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("fill", F.col("cap").cast("double") / F.col("weight").cast("double"))
        .withColumn("level", level)
        .withColumn(
            "level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(everything)["level"]
        )
        .select(
            "source", "source_size",
            F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"),
        )
    )


def mix_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``base`` (whole passes) and ``cut``.

    ``sizes`` has ``source``, ``size`` and ``h``, and is read once per level, without its texts.
    """
    base = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    plan = keep(
        source_targets(sizes, weights, most)
        .withColumn("base", base)
        .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("lo", F.lit(0).cast("bigint"))
        .withColumn("cut", F.lit(None).cast("bigint")),
        "mix-plan",
    )
    of_source = Window.partitionBy("source").orderBy("bucket")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        open_sources = plan.filter("cut is null")
        if open_sources.isEmpty():
            break
        width = 1 << shift
        inside = sizes.join(
            open_sources.select(F.col("source").alias("of"), "lo", "budget"), F.col("source").eqNullSafe(F.col("of"))
        ).filter(
            (F.col("h") >= F.col("lo"))
            & (F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("lo", shift + LEVEL_BITS))
        )
        buckets = (
            inside.groupBy("source", "budget", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.min("h").alias("first"), F.max("h").alias("last"))
            .withColumn("up_to", F.sum("words").over(of_source))
            .withColumn("before", F.col("up_to") - F.col("words"))
            .filter("before <= budget and up_to > budget")
        )
        # One hash value left: it is in if that brings the source nearer to its target.
        one = F.col("first") == F.col("last")
        nearer = F.col("before") + F.col("up_to") <= 2 * F.col("budget")
        found = buckets.select(
            F.col("source").alias("of"),
            (F.col("bucket") * width).alias("next_lo"),
            F.col("before").alias("used"),
            F.when(one, F.col("first") + nearer.cast("bigint")).alias("next_cut"),
        )
        # A source in which the budget ends nowhere is taken whole.
        whole = F.when(F.col("of").isNull() & F.col("next_lo").isNull(), F.lit(1 << HASH_BITS))
        plan = keep(
            plan.join(found, F.col("source").eqNullSafe(F.col("of")) & F.col("cut").isNull(), "left").select(
                "source", "source_size", "target", "base",
                (F.col("budget") - F.coalesce(F.col("used"), F.lit(0))).alias("budget"),
                F.coalesce("next_lo", "lo").alias("lo"),
                F.coalesce("cut", "next_cut", whole).alias("cut"),
            ),
            "mix-plan",
        )
    return plan.select("source", "source_size", "target", "base", "cut")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), mix_hash(F.col("doc_id")).alias("h")
    )


def repeats() -> Column:
    """How often a document is taken, once the plan of its source is joined."""
    return F.col("base") + (F.col("h") < F.col("cut")).cast("bigint")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "plan_source")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left")


def mixed_words(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken``, one row per document."""
    sizes = keep(sized(docs), "mix-sizes")
    rows = _with_plan(sizes, mix_plan(sizes))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats()).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their columns as they were."""
    sizes = keep(sized(docs), "mix-sizes")
    plan = mix_plan(sizes).select("source", "base", "cut")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "source", mix_hash(F.col("doc_id")).alias("h"))
    taken = _with_plan(rows, plan)
    return (
        taken.withColumn("n", repeats())
        .filter("n > 0")
        .select("doc", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("pass"))
        .select("doc.*")
    )


SQL = r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from documents),
named as (
  select source, sum(size)::bigint as source_size,
    case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from sizes group by source),
filled as (
  select *, 3 * source_size as cap, (3 * source_size)::double / weight::double as fill from named),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by fill, source nulls last
      rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by fill, source nulls last rows between current row and unbounded following))::double
    as level
  from filled),
targets as (
  select source, source_size, least(cap::double, weight *
    (select arg_min(level, fill) from levels where level <= fill)) as target
  from levels),
passes as (
  select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as base from targets),
ordered as (
  select s.doc_id, s.size, p.source_size, p.target, p.base, p.target - p.base * p.source_size as budget,
    sum(s.size) over (partition by s.source order by s.h range between unbounded preceding and current row) as up_to,
    sum(s.size) over (partition by s.source, s.h) as tied
  from sizes s join passes p on s.source is not distinct from p.source)
select doc_id, size, source_size, target,
  (size * (base + case when 2 * up_to - tied <= 2 * budget then 1 else 0 end))::bigint as taken
from ordered
"""
