"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document of a source whose target is ``f`` times its size is taken
``floor(f)`` times for certain; the rest of the target is a sample of words fixed in size: documents are ranked by
their random odds divided by their inclusion odds, and the first ones are taken until the words are reached.

Nothing but a row for each source meets in one place: the cut in the ranking is found in two steps, a histogram
of ranks with ``BINS`` bins a source, and the order inside the one bin that holds the cut.

Defined results: null texts have size 0; null sources form one source, which comes last; rows that repeat are
ranked one after the other and share the decision of the ranking at their place; an empty table gives an empty
result; extra columns are kept by :func:`mix` and ignored by :func:`plan_mix`. A ``doc_id`` of null is ranked first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words

#: Weights of the sources in order of name, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BINS = 4096
SEED = 17


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) from the key alone: 48 bits of a digest, so that reruns and other engines agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each source: source, source_size, target.

    Shares over ``most`` times a source's size are cut to that; what is over goes to the others by weight, again and
    again. With sources sorted by ``most * size / weight`` the ones cut are the first of them, so that one pass of
    running sums finds the level instead of a loop.
    """
    by_source = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn("_weight", F.element_at(kinds, (place % n + 1).cast("int")))
    ranked = ranked.withColumn("_limit", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("_source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    levels = (
        ranked.withColumn("_total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("_cut", F.coalesce(F.sum("_limit").over(upto), F.lit(0.0)))
        .withColumn("_left", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(upto), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_cut")) / F.col("_left"))
        # the level holds for the first source that stays under its limit, and for all after it
        .withColumn("_level", F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"), F.struct(F.col("_limit") / F.col("_weight"), F.col("_level")))).over(everything)["_level"])
    )
    target = F.coalesce(F.least(F.col("_level") * F.col("_weight"), F.col("_limit")), F.col("_limit"))
    return levels.select(F.col("_source"), "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): the ids with their ranks, and a row for each source with its target and the cut in its ranking."""
    sizes = materialize(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("_size")).withColumn("_u", uniform(F.col("_id"))),
        "mix-sizes",
    )
    targets = materialize(source_targets(sizes, **options), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("_whole", whole.cast("long")).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    targets = targets.withColumn("_p", F.when(F.col("source_size") > 0, F.col("_rest") / F.col("source_size")).otherwise(F.lit(0.0)))
    ranked = sizes.join(targets, sizes["_source"].eqNullSafe(targets["_source"])).drop(targets["_source"]).where("_p > 0").withColumn("_rank", pareto_rank())
    # odds ranks are monotone in rank / (1 + rank), which lies between 0 and 1
    bin_of = F.least(F.floor(F.col("_rank") / (1 + F.col("_rank")) * BINS), F.lit(BINS - 1)).cast("int")
    ranked = ranked.withColumn("_bin", bin_of)
    bins = ranked.groupBy("_source", "_bin").agg(F.sum("_size").alias("_words"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("_upto", F.sum("_words").over(upto))
    cut = bins.where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_words") < F.col("_rest")))
    cut = materialize(cut.select("_source", F.col("_bin"), (F.col("_upto") - F.col("_words")).alias("_before")), "mix-bins")
    inside = ranked.join(cut, ranked["_source"].eqNullSafe(cut["_source"]) & (ranked["_bin"] == cut["_bin"])).drop(cut["_source"], cut["_bin"])
    order = Window.partitionBy("_source").orderBy("_rank", "_id", "_size")
    run = F.col("_before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the document at the cut is taken if that comes nearer
    near = inside.withColumn("_run", run).where(F.col("_run") - F.col("_size") / 2 <= F.col("_rest"))
    last = near.groupBy("_source").agg(F.max(F.struct("_rank", "_id")).alias("_last"))
    plan = targets.join(last, targets["_source"].eqNullSafe(last["_source"]), "left").drop(last["_source"])
    starts = cut.select(F.col("_source").alias("_cut_source"), F.col("_bin").alias("_cut_bin"))
    plan = plan.join(starts, plan["_source"].eqNullSafe(starts["_cut_source"]), "left").drop("_cut_source")
    return sizes, materialize(plan, "mix-plan")


def pareto_rank() -> Column:
    """Random odds divided by inclusion odds."""
    return F.try_divide(F.col("_u") / (1 - F.col("_u")), F.col("_p") / (1 - F.col("_p")))


def copies() -> Column:
    """Whole copies, and one more for what the ranking selects; on rows joined with the plan."""
    rank = pareto_rank()
    bin_of = F.least(F.floor(rank / (1 + rank) * BINS), F.lit(BINS - 1)).cast("int")
    below = F.col("_cut_bin").isNull() | (bin_of < F.col("_cut_bin"))
    at = (bin_of == F.col("_cut_bin")) & F.coalesce(F.struct(rank.alias("_rank"), F.col("_id")) <= F.col("_last"), F.lit(False))
    return F.col("_whole") + F.when((F.col("_p") > 0) & (below | at), 1).otherwise(0)


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of each document."""
    sizes, plan = plan_mix(docs, **options)
    rows = sizes.join(plan, sizes["_source"].eqNullSafe(plan["_source"])).drop(plan["_source"])
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (copies() * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, with the columns they had."""
    _, plan = plan_mix(docs, id_col=id_col, source_col=source_col, **options)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_own")).withColumn("_u", uniform(F.col("_id")))
    rows = packed.join(plan, packed["_own"].eqNullSafe(plan["_source"])).withColumn("_n", copies().cast("int")).where("_n > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")


#: The same in DuckDB.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_element([3.0, 1.0, 2.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT)::DOUBLE AS weight
  FROM sized GROUP BY source),
limits AS (
  SELECT *, 2.0 * source_size AS most, sum(source_size) OVER () * 1.5 AS total FROM sources),
steps AS (
  SELECT *, coalesce(sum(most) OVER w, 0) AS cut, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest_weight
  FROM limits WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, (total - cut) / rest_weight AS level FROM steps),
target AS (
  SELECT source, source_size,
         coalesce(least((SELECT level FROM levels WHERE level * weight <= most ORDER BY most / weight LIMIT 1) * weight, most), most)::DOUBLE AS target
  FROM levels),
ranked AS (
  SELECT d.*, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::BIGINT AS whole
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
odds AS (
  SELECT *, target - whole * source_size AS rest, coalesce((target - whole * source_size) / nullif(source_size, 0), 0) AS p FROM ranked),
run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / nullif(p / (1 - p), 0), doc_id) AS upto FROM odds)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN p > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM run
"""
