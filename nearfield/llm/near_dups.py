"""Near-duplicates by SetSketch registers.

A document's set are the hashes of its distinct word shingles. A sketch has ``REGISTERS`` registers; register i is the
truncated logarithm to base ``BASE`` of the minimum of the i-th exponential hash over the set, so that sketches merge by
maximum and equal registers are likely in proportion to similarity. ``ROWS`` registers form a band; documents that share a
band are candidates. A candidate pair's similarity is estimated jointly with the known set sizes by maximum likelihood over
the numbers of greater, lesser and equal registers; what may reach the threshold is verified on full sets.

Documents of equal sets are one class; only classes are compared. Within a band's bucket first each class is compared with
one star, the class that shares most buckets with others: where many documents were made from one, that one is the likeliest to
be near all of them, though they need not be near each other. Of a class's stars in all buckets the likeliest is verified.
Buckets whose classes are connected by then need no more. Of the others, those of ``PAIRED`` classes at most give all pairs between
components to rating and verification. In a larger one the variants of one document meet, half alike to nearly linked, whose
pairs would grow with its square. There every class is written as its difference to a common set, what most of the bucket's classes
have (:func:`by_difference`): two sets differ by at most both differences together, and can be linked beyond that only if the
differences share elements, of which the rarest are joined. No link between components is left out by either way.

A pair at similarity 0.8 shares no band with probability below 1e-7, and is estimated too low for verification with probability
below 1e-6. Sets are held as 64-bit shingle hashes, and classes as 128-bit digests of them: those are taken for equal if these are.

Defined results: documents without words, null texts among them, have an empty set and are linked with nothing; fewer words
than a shingle are one shingle; ties of equal sets go to the least doc_id; rows that repeat belong to one class; a very long
text is one large set; an empty table gives an empty result; extra columns are kept by :func:`keep_first`, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, hashed_words, materialize, mix64, texts_of, to_batch
from .components import connected_components

#: Words of a shingle: by op6's contract, and in near-duplicate stages.
SHINGLE, STAGE_SHINGLE, PERCENT = 4, 5, 80
REGISTERS, ROWS, BASE, SEED = 128, 4, 1.001, 7
#: Registers of small sets are negative: they are moved up by this much, to fit 16 bits without sign.
UP = 4096
TOP = int(64 * math.log(2) / math.log(BASE)) + 1 + UP
#: Different sets of fewer shingles are never as similar as asked.
LEAST = -(-PERCENT // (100 - PERCENT))
#: Buckets of so many classes give all their pairs.
PAIRED = 6
#: Ids that are broadcast at most; more are joined by shuffle.
IDS = 2_000_000
#: Pairs are verified if their estimate is within this many standard errors below the threshold.
ERRORS = 5.5


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end; and where each text's begin."""
    words, offsets = hashed_words(pc.ascii_lower(texts))
    n = np.diff(offsets)
    odd = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
    values, rows = [], []
    if len(words) >= width:
        sums = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for k in range(width):
            sums += mix64(words[k : len(words) - width + 1 + k] + odd[k]) * odd[-1 - k % 4]
        owner = np.repeat(np.arange(len(n)), n)[: len(sums)]
        whole = np.arange(len(sums)) + width <= offsets[owner + 1]
        values.append(mix64(sums[whole]))
        rows.append(owner[whole])
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        values.append(np.array([mix64(np.array([hash_short(words[offsets[r] : offsets[r + 1]])], dtype=np.uint64))[0] for r in short], dtype=np.uint64))
        rows.append(short)
    if not values:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[first], row[first]
    return value, np.searchsorted(row, np.arange(len(n) + 1))


def hash_short(words: np.ndarray) -> int:
    total = len(words)
    for w in words.tolist():
        total = (total * 0x100000001B3 ^ w) & (1 << 64) - 1
    return total


def registers(values: np.ndarray, starts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """(sets, m) register values; all sets non-empty."""
    draw = np.random.default_rng(SEED)
    masks, factors = draw.integers(0, 1 << 63, m, dtype=np.uint64), draw.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.empty((m, len(starts)), dtype=np.float64)
    for i in range(m):
        hashed = values ^ masks[i]
        hashed *= factors[i]
        least[i] = np.minimum.reduceat(hashed, starts)
    u = (least + 1) / 2.0**64
    exponential = -np.log1p(-np.minimum(u, 1 - 2.0**-53))
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)) + UP, 0, TOP).astype("<u2").T.copy()


SKETCHES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sketch", pa.binary())])


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    def work(batches):
        for part in chunks(batches):
            values, starts = shingle_sets(texts_of(part.column(1)), width)
            n = np.diff(starts)
            full = np.flatnonzero(n)
            k1, k2 = np.zeros((2, len(n)), dtype=np.uint64)
            out: list = [None] * len(n)
            if len(full):
                at = starts[:-1][full]
                k1[full], k2[full] = np.add.reduceat(mix64(values), at), np.bitwise_xor.reduceat(mix64(values + np.uint64(SEED)), at)
                for row, got in zip(full, registers(values, at)):
                    out[row] = got.tobytes()
            yield to_batch(SKETCHES, part.column(0), n, k1.view(np.int64), k2.view(np.int64), out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_shingles long, k1 long, k2 long, sketch binary")


def bands(classes: DataFrame) -> DataFrame:
    """band, rep: a row for each band of each class."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * width + 1, F.lit(width))))
    return classes.select(F.explode(keys).alias("band"), "rep")


def likelihood_estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair of sketches, given the sizes of their sets."""
    greater, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - greater - less
    u = (na / (na + nb))[:, None]
    v, most = 1 - u, np.minimum(na, nb)[:, None] / np.maximum(na, nb)[:, None]
    j = np.linspace(0, 1, 101)[None, :] * most
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-9
    total = greater * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(j, total.argmax(axis=1)[:, None], axis=1)[:, 0]


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and sketches allow the threshold, and their estimates."""
    left = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    threshold = PERCENT / 100
    line = threshold - ERRORS * math.sqrt(threshold * (1 - threshold) / REGISTERS)
    rows = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))

    @F.pandas_udf("double")
    def estimate(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for at in range(0, len(sa), 2000):
            x, y = (np.frombuffer(b"".join(bytes(r) for r in s.iloc[at : at + 2000]), "<u2").reshape(-1, REGISTERS) for s in (sa, sb))
            out.append(likelihood_estimates(x, y, na.to_numpy(float)[at : at + 2000], nb.to_numpy(float)[at : at + 2000]))
        return pd.Series(np.concatenate(out))

    return rows.select("a", "b", estimate("sa", "sb", "na", "nb").alias("estimate")).where(F.col("estimate") >= line)


def texts_of_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """id, text of the documents in pairs (a, b): only their texts are shuffled later."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = materialize(texts.join(F.broadcast(ids) if ids.count() <= IDS else ids, "id", "left_semi"), "texts")
    return texts if texts.count() == ids.count() else materialize(texts.dropDuplicates(["id"]), "texts-once")  # rows may repeat


def _sets(column, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of the distinct texts of a column, where they begin, and which of them each row has."""
    coded = texts_of(column).dictionary_encode()
    return *shingle_sets(coded.dictionary, width), np.asarray(coded.indices)


DIFFERENCES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("d", pa.int64()), ("diff", pa.list_(pa.int64()))])


def differences(pairs: DataFrame, docs: DataFrame, width: int, elements: bool = False) -> DataFrame:
    """a, b, both (the sum of their set sizes), d (shingles that only one of them has) and, if asked for, those as diff."""
    texts = texts_of_pairs(pairs, docs)
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def work(batches):
        for part in chunks(batches, column=3, max_bytes=2 << 20):
            (va, sa, ia), (vb, sb, ib) = (_sets(part.column(k), width) for k in (2, 3))
            both, d, diffs = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), []
            for r, (i, k) in enumerate(zip(ia.tolist(), ib.tolist())):
                x, y = va[sa[i] : sa[i + 1]], vb[sb[k] : sb[k + 1]]
                odd = np.setxor1d(x, y, assume_unique=True)
                both[r], d[r] = len(x) + len(y), len(odd)
                diffs.append(odd.view(np.int64) if elements else None)
            yield to_batch(DIFFERENCES, part.column(0), part.column(1), both, d, pa.array(diffs, pa.list_(pa.int64())))

    return rows.select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long, both long, d long, diff array<long>")


#: Sets are linked if MORE times the size of their symmetric difference is at most LESS times the sum of their sizes.
MORE, LESS = 100 + PERCENT, 100 - PERCENT


def verify(pairs: DataFrame, docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The pairs whose full sets are as similar as asked."""
    return differences(pairs, docs, width).where((F.col("both") > 0) & (MORE * F.col("d") <= LESS * F.col("both"))).select("a", "b")


def mixed_buckets(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``shared`` in buckets of more than one component, with their ``group`` and the number of classes there."""
    known = shared.join(groups, shared["rep"] == groups["id"], "left").select("band", "rep", "star", F.coalesce("component", "rep").alias("group"))
    known = materialize(known, "known")
    mixed = known.groupBy("band").agg(F.min("group").alias("g"), F.max("group").alias("h"), F.count("*").alias("size")).where("g < h").select("band", "size")
    return materialize(known.join(mixed, "band"), "open")


def ceil_div(value, by: int):
    return F.ceil(value / F.lit(float(by))).cast("long")


def by_difference(members: DataFrame, docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(links, pairs to verify) between members (star, rep, group, n) of one star that are in different groups; a row for each star and rep.

    Let D be a member's difference to a common set, d its size and s = MORE * d - LESS * n. Two members differ by at most the sum of
    their d, so that they are linked for certain where their s sum to 0 or less: it is enough to link those with the member of least s.
    For other pairs to be linked, their D must share at least t = (s + s') / (2 * MORE) elements, at least one. Elements are ordered
    from rare to frequent; among the first d - t + 1 of both there is a common one. Of a pair, that of lesser d has the shorter
    such head, since d - t is at most LESS / MORE times the mean size. The common set is the star's, changed where most members differ from it.
    """
    pairs = members.where("star <> rep").select(F.col("star").alias("a"), F.col("rep").alias("b"))
    diffs = materialize(differences(pairs, docs, width, elements=True).select(F.col("a").alias("star"), F.col("b").alias("rep"), "diff"), "diffs")
    sizes = members.groupBy("star").agg(F.count("*").alias("members"))
    often = materialize(diffs.select("star", F.explode("diff").alias("element")).groupBy("star", "element").agg(F.count("*").alias("df")).where("df > 1"), "often")
    usual = materialize(often.join(sizes, "star").where("2 * df > members").groupBy("star").agg(F.collect_list("element").alias("usual")), "usual")
    none = F.array().cast("array<long>")
    rows = members.join(diffs, ["star", "rep"], "left").join(usual, "star", "left").withColumn("diff", F.coalesce("diff", none)).withColumn("usual", F.coalesce("usual", none))
    rows = rows.withColumn("diff", F.when(F.size("usual") == 0, F.col("diff")).otherwise(F.concat(F.array_except("diff", "usual"), F.array_except("usual", "diff"))))
    d = F.size("diff").cast("long")
    rows = materialize(rows.select("star", "rep", "group", "n", d.alias("d"), (MORE * d - LESS * F.col("n")).alias("s"), "diff"), "relative")
    least = rows.groupBy("star").agg(F.min(F.struct("s", "rep", "group")).alias("least"))
    rows = materialize(rows.join(least, "star").withColumn("near", F.col("s") + F.col("least.s") <= 0), "centred")
    links = rows.where("near AND group <> least.group").select(F.col("least.rep").alias("a"), F.col("rep").alias("b"))
    # the least s of a partner: of two that are near the same member no pair is asked for
    partner = F.when(F.col("near"), 1 - F.col("least.s")).otherwise(F.col("least.s"))
    shared = ceil_div(F.col("s") + partner, 2 * MORE)
    widest = F.col("n") + F.floor(100 * F.col("n") / PERCENT)
    lesser = F.greatest(F.lit(1), shared, ceil_div(2 * MORE * F.col("d") - LESS * widest, 2 * MORE))
    greater = F.greatest(F.lit(1), shared, ceil_div(MORE * F.col("d") - LESS * widest, MORE))
    single = rows.select("star", "rep", "group", "n", "d", "near", (F.col("d") - lesser + 1).alias("lesser"), (F.col("d") - greater + 1).alias("greater"), F.explode("diff").alias("element"))
    again = single.groupBy("star", "element").agg(F.count("*").alias("df")).where("df > 1")
    single = materialize(single.join(again, ["star", "element"]), "elements")
    own = Window.partitionBy("star", "rep")
    place = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "element"))  # after those that no other has
    single = materialize(single.withColumn("place", place).where("place <= greatest(lesser, greater)"), "heads")
    x, y = (single.where(f"place <= {head}").select("star", "element", *[F.col(c).alias(f"{c}_{r}") for c in ("rep", "group", "n", "d", "near")]) for r, head in (("a", "lesser"), ("b", "greater")))
    ordered = F.struct("d_a", "rep_a") < F.struct("d_b", "rep_b")
    alike = (F.col("group_a") != F.col("group_b")) & ~(F.col("near_a") & F.col("near_b")) & (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    found = x.join(y, ["star", "element"]).where(ordered & alike)
    return links, found.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def find_components(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document."""
    sketched = materialize(sketches(docs, width), "sketches")
    full = sketched.where("n_shingles > 0")
    classes = materialize(full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    placed = materialize(bands(classes.where(F.col("n_shingles") >= LEAST)), "bands")
    sizes = placed.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    crowded = materialize(placed.join(sizes, "band").select("band", "rep", "size"), "crowded")
    central = crowded.groupBy("rep").agg(F.sum("size").alias("company"))
    shared = materialize(crowded.join(central, "rep").select("band", "rep", "company"), "shared")
    stars = shared.groupBy("band").agg(F.max_by("rep", F.struct("company", F.xxhash64("rep"))).alias("star"))
    shared = materialize(shared.join(stars, "band").select("band", "rep", "star"), "starred")
    # first round: each class against the stars of its buckets, of which the likeliest is verified
    first = likely(shared.where("rep <> star").select(F.col("star").alias("a"), F.col("rep").alias("b")).distinct(), classes)
    first = first.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a")).select("a", "b")
    links = materialize(verify(materialize(first, "pairs-1"), docs, width), "links-1")
    groups = materialize(connected_components(links), "groups-1")
    # second round: buckets of several components
    mixed = mixed_buckets(shared, groups)
    sets = classes.select("rep", F.col("n_shingles").alias("n"))
    small = materialize(mixed.where(F.col("size") <= PAIRED).select("band", "rep", "group").join(sets, "rep"), "small")
    x, y = (small.select("band", F.col("rep").alias(r), F.col("group").alias(f"g{r}"), F.col("n").alias(f"n{r}")) for r in ("a", "b"))
    alike = (F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    rest = materialize(x.join(y, "band").where(alike).select("a", "b").distinct(), "rest")
    large = mixed.where(F.col("size") > PAIRED).select("star", "rep", "group").distinct()
    members = materialize(large.join(sets, "rep").select("star", "rep", "group", "n"), "members")
    certain, maybe = by_difference(members, docs, width)
    pairs = likely(rest.unionByName(materialize(maybe, "maybe")).distinct(), classes).select("a", "b")
    more = verify(materialize(pairs, "pairs-2"), docs, width)
    groups = materialize(connected_components(links.unionByName(certain).unionByName(more)), "groups-2")
    reps = classes.join(groups, classes["rep"] == groups["id"], "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    reps = materialize(reps, "reps")
    rows = sketched.select("doc_id", "n_shingles", "k1", "k2").join(reps, ["k1", "k2", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_first(docs: DataFrame, width: int = STAGE_SHINGLE) -> DataFrame:
    """One document of each component, its first, with the columns it had."""
    gone = materialize(find_components(docs, width).where("NOT kept").select(F.col("doc_id").alias("_gone")), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
