"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Each document has a vector of transformed statistics. For each (language, source), and for all documents together, the minimum
covariance determinant estimate is sought by concentration steps: the ``SHARE`` of documents nearest to the present estimate give the
next mean and covariance, whose determinant is no greater. They start from three robust estimates (absolute deviations from medians,
covariance of hyperbolic tangents, covariance of spatial signs), and of the three ends that of least determinant is taken. A
group's estimate is then drawn to that of all documents in proportion to its size and ``DRAWN``, so that a small group has a sound
one and no size changes the rule. Documents beyond a chi-square cut of Mahalanobis distance are rejected.

A step is two aggregations with partial sums (a quantile of distances, then moments), so that a large source is
no single task's work; estimates are a row for each group and start and are joined by size as Spark decides.

Defined results: null texts have 0 in all counts and fail the base rules; documents failing these do not take part in
estimates; fewer than ``FEWEST`` documents in all reject none; a null language or source is a group of its own; a very long text
is counted whole; of ties at the share's distance all are inside, at the cut all are kept; rows that repeat count as often; an empty
table gives an empty result; columns but doc_id, text, lang and source are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 8
SHARE, STEPS = 0.75, 4
#: Documents of a group that weigh as much as the estimate of all.
DRAWN = 50
FEWEST = 20
#: Tail probability of the cut, if vectors were normal; clean text has longer tails than that.
TAIL = 1e-12
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"
MARKS = "!?;:()[]{}\"'=_~^/\\+@"
#: Name and least standard deviation of each statistic: what a document may differ by though all others are equal.
STATISTICS = {"word_length": 0.08, "symbols": 0.03, "capitals": 0.03, "dup_lines": 0.083, "repeats": 0.13, "marks": 0.03}
NAMES = list(STATISTICS)


def removed(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the transformed statistics, beside the columns ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_words", F.transform(F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_lines", lines)
    n = F.size("_words")
    ends = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        removed(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("_n_lines"),
        removed(F.col("_text"), CAPITALS).alias("_capitals"),
        removed(F.col("_text"), MARKS).alias("_marks"),
        F.transform(ends, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])).alias("_windows"),
    )
    # only texts with an equal window go on: their windows are sorted with their places, and places of equal neighbours merged
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(twice, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x: bigint, i: int>>"))
    rows = rows.withColumn("_placed", placed).drop("_windows")
    equal = F.transform("_placed", lambda p, k: F.when((F.get("_placed", k - 1)["x"] == p["x"]) | (F.get("_placed", k + 1)["x"] == p["x"]), p["i"]))
    rows = rows.withColumn("_at", F.sort_array(F.filter(equal, lambda i: i.isNotNull()))).drop("_placed")
    covered = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"))
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.log(F.greatest(F.col("word_chars") / words, F.lit(0.1))).alias("word_length"),
        F.sqrt(F.col("n_symbols") / chars).alias("symbols"),
        F.sqrt(F.col("_capitals") / chars).alias("capitals"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))).alias("dup_lines"),
        F.sqrt(F.col("n_repeat_words") / words).alias("repeats"),
        F.sqrt(F.col("_marks") / chars).alias("marks"),
    )


def chi_square(x: float, freedom: int) -> float:
    """Distribution function, by the series of the incomplete gamma function."""
    a, x = freedom / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    while high - low > 1e-9 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < p else (low, middle)
    return high


#: Group of all documents.
ALL = "*"
P = range(len(NAMES))
PAIRS = [(i, j) for i in P for j in range(i + 1)]


def _with_group(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_group", F.to_json(F.struct("lang", "source")))


def _distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds _d, the squared distance under each estimate of a row's group: centre m_i, lower triangle w_ij of the inverse factor."""
    total = F.lit(0.0)
    for i in P:
        line = F.lit(0.0)
        for j in range(i + 1):
            line = line + F.col(f"w_{i}_{j}") * (F.col(NAMES[j]) - F.col(f"m_{j}"))
        total = total + line * line
    return rows.join(estimates, "_group", "left").withColumn("_d", total)


def _start(rows: DataFrame) -> DataFrame:
    """m_i and c_i_j of three first estimates (_start) of each group, all about its medians."""
    middle = materialize(rows.groupBy("_group").agg(*[F.percentile_approx(NAMES[i], 0.5, 10_000).alias(f"m_{i}") for i in P]), "mcd-medians")
    far = rows.join(middle, "_group").groupBy("_group").agg(*[F.percentile_approx(F.abs(F.col(NAMES[i]) - F.col(f"m_{i}")), 0.5, 10_000).alias(f"_a_{i}") for i in P])
    scale = [F.greatest(1.4826 * F.col(f"_a_{i}"), F.lit(STATISTICS[NAMES[i]])).alias(f"a_{i}") for i in P]
    scales = materialize(middle.join(far, "_group").select("_group", *[f"m_{i}" for i in P], *scale), "mcd-scales")
    z = rows.join(scales, "_group").select("_group", *[((F.col(NAMES[i]) - F.col(f"m_{i}")) / F.col(f"a_{i}")).alias(f"z_{i}") for i in P])
    norm = F.sqrt(F.greatest(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in P), F.lit(0.0)), F.lit(1e-12)))
    bounded = z.select("_group", *[F.tanh(f"z_{i}").alias(f"t_{i}") for i in P], *[(F.col(f"z_{i}") / norm).alias(f"s_{i}") for i in P])
    means = [F.avg(F.col(f"{k}_{i}") * F.col(f"{k}_{j}")).alias(f"{k}_{i}_{j}") for k in "ts" for i, j in PAIRS]
    known = materialize(scales.join(bounded.groupBy("_group").agg(*means), "_group"), "mcd-starts")
    out = None
    for start, kind in enumerate(("deviations", "t", "s")):
        value = lambda i, j, kind=kind: F.lit(float(i == j)) if kind == "deviations" else F.col(f"{kind}_{i}_{j}")
        one = known.select("_group", F.lit(start).alias("_start"), *[f"m_{i}" for i in P], *[(F.col(f"a_{i}") * F.col(f"a_{j}") * value(i, j)).alias(f"c_{i}_{j}") for i, j in PAIRS])
        out = one if out is None else out.unionByName(one)
    return out


def _factor(estimates: DataFrame) -> DataFrame:
    """To m_i and c_i_j adds log_det, and w_i_j of the inverse Cholesky factor; variances have the least ones added."""
    keep, out = estimates.columns, estimates
    floor = [STATISTICS[x] ** 2 for x in NAMES]
    for j in P:
        below = sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") + floor[j] - below, F.lit(floor[j] / 4))))
        column = {f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}") for i in P if i > j}
        out = out.withColumns(column) if column else out
    for i in P:
        out = out.withColumn(f"w_{i}_{i}", 1 / F.col(f"l_{i}_{i}"))
        row = {f"w_{i}_{j}": -sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l_{i}_{i}") for j in range(i)}
        out = out.withColumns(row) if row else out
    log_det = 2 * sum((F.log(f"l_{i}_{i}") for i in P), F.lit(0.0))
    return out.select(*keep, log_det.alias("log_det"), *[f"w_{i}_{j}" for i, j in PAIRS])


def least_determinants(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """_group, n, m_i, c_i_j, log_det: the minimum covariance determinant estimate of each _group."""
    consistency = share / chi_square(chi_square_quantile(share, len(NAMES)), len(NAMES) + 2)
    estimates = materialize(_factor(_start(rows)), "mcd-0")
    for step in range(1, steps + 1):
        near = _distance(rows, estimates).select("_group", "_start", *NAMES, "_d")
        limit = materialize(near.groupBy("_group", "_start").agg(F.percentile_approx("_d", share, 10_000).alias("_limit")), f"mcd-limit-{step}")
        inside = near.join(limit, ["_group", "_start"]).where(F.col("_d") <= F.col("_limit"))
        means = [F.avg(NAMES[i]).alias(f"m_{i}") for i in P] + [F.avg(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s_{i}_{j}") for i, j in PAIRS]
        moments = materialize(inside.groupBy("_group", "_start").agg(*means), f"mcd-moments-{step}")
        spread = [(consistency * (F.col(f"s_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}"))).alias(f"c_{i}_{j}") for i, j in PAIRS]
        estimates = materialize(_factor(moments.select("_group", "_start", *[f"m_{i}" for i in P], *spread)), f"mcd-{step}")
    best = Window.partitionBy("_group").orderBy("log_det", "_start")  # three rows a group
    best = estimates.withColumn("_place", F.row_number().over(best)).where("_place = 1")
    counts = rows.groupBy("_group").agg(F.count("*").alias("n"))
    return best.join(counts, "_group").select("_group", "n", *[f"m_{i}" for i in P], *[f"c_{i}_{j}" for i, j in PAIRS], "log_det")


def covariance_estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS, drawn: float = DRAWN) -> DataFrame:
    """_group, m_i, w_i_j: the estimate of each group, drawn to that of all; none if there are fewer than ``FEWEST`` documents."""
    both = rows.unionByName(rows.withColumn("_group", F.lit(ALL)))
    found = materialize(least_determinants(both.select("_group", *NAMES), share, steps), "mcd-least")
    names = [f"m_{i}" for i in P] + [f"c_{i}_{j}" for i, j in PAIRS]
    every = found.where((F.col("_group") == ALL) & (F.col("n") >= FEWEST)).select(*[F.col(x).alias(f"_{x}") for x in names])
    own = F.col("n") / (F.col("n") + drawn)
    mixed = found.where(F.col("_group") != ALL).join(F.broadcast(every))  # one row
    mixed = mixed.select("_group", *[(own * F.col(x) + (1 - own) * F.col(f"_{x}")).alias(x) for x in names])
    return materialize(_factor(mixed).select("_group", *[f"m_{i}" for i in P], *[f"w_{i}_{j}" for i, j in PAIRS]), "mcd")


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, the five counts, base_failed, distance (null without an estimate) and kept of each document."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = materialize(text_statistics(docs, ["doc_id", "lang", "source"]).withColumn("base_failed", failed), "mcd-statistics")
    rows = _with_group(rows)
    estimates = covariance_estimates(rows.where("NOT base_failed"))
    out = _distance(rows, estimates)
    kept = ~F.col("base_failed") & F.coalesce(F.col("_d") <= chi_square_quantile(1 - tail, len(NAMES)), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("_d", 6).alias("distance"), kept.alias("kept"))
