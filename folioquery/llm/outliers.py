"""Quality rules and robust multivariate outliers, in DataFrame expressions throughout.

Two base rules reject very short texts and texts made of repeats. Every other document becomes a
vector of four transformed statistics (see ``VECTOR``). Of each language and source the centre and
covariance are estimated by regularised minimum covariance determinant: among the subsets of a share
``SUBSET`` of a cell's documents, one whose covariance has the least determinant. The search begins
at two places, the medians and median deviations and the means and covariances of all documents. Each
concentration step re-estimates from the documents that lie nearest by Mahalanobis distance. A cell
takes steps from either place until its determinant falls no more (by a share of ``SETTLED``), and the
smaller determinant of both wins. Documents beyond the chi-square quantile ``CUTOFF`` are rejected.

The covariance of a subset is made consistent for normal data and then mixed with a target, the
squared median deviations from the cells' medians over all documents: a cell of n documents has the
weight n / (n + ``PRIOR``). So every cell, however small, is estimated by the same rule, and one of
few documents leans on the spreads found elsewhere. Every statistic has a least spread besides, added
to its variance: where nearly all documents agree on a value, tiny deviations are no outliers.

A step is one aggregation: counts, sums and products by cell, place of beginning and bin of distance
(1/``BINS`` of a doubling of 1 + d**2); a subset closes at the end of a bin, so that near ties are in or
out together. Statistics are whole multiples of 1/``UNIT``, so sums are exact and reruns agree. Only
sums by cell and bin are shuffled, and medians are found by two levels of counts; no cell, however
large, meets in one task.

Repeats within a text are found by sorting 64-bit numbers: the upper bits of the hash of a 3-word
window above the window's place. Windows of like hashes are compared by their words; where some
differ, those are sorted by their words instead, so the count is exact for texts of any length.

Defined cases: a null text has no words and fails the base rules, as an empty one does; null
languages and sources are values of their own; where nothing passes the base rules nothing is
estimated; repeated rows are judged alike; an empty table gives no rows; columns other than those
named are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.llm.common import Workspace, join_checked, materialize, table
from folioquery.llm.mixing import source_key

QUERY = "op3_quality_outliers"
ORACLE_SQL = None

SUBSET = 0.75
SETTLED = 1e-3
CUTOFF = 0.9999
PRIOR = 20
UNIT = 1024
#: Bins of distance for a doubling of 1 + d**2.
BINS = 64

_SPACES = " \t\n\x0b\x0c\r"

#: The statistics, as expressions over the counts, and their least spread.
VECTOR = {
    "ln(greatest(word_chars, 1) / greatest(n_words, 1))": 0.06,  # mean length of a word
    "ln(1 + n_symbols / greatest(n_words, 1))": 0.05,
    "ln(1 + n_dup_lines)": 0.4,
    "n_repeat_words / greatest(n_words, 1)": 0.08,  # the base rule leaves at most 0.5, beyond the cut of 4.85 spreads
}
_D = len(VECTOR)
_PAIRS = [(i, j) for i in range(_D) for j in range(i + 1)]


def counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each
    row. Each step's arrays are columns of their own, so that they are computed once a row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim("_text", F.lit(_SPACES))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    rows = docs.select(*keep, text.alias("_text"))
    rows = rows.select(
        *keep,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+")).alias("_words"),
        lines.alias("_lines"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_words",
        F.length(F.bin(F.size("_words").cast("long"))).alias("_bits"),
        # the hash of each 3-word window, with the window's place in the low bits
        F.expr(
            "if(size(_words) < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, size(_words) - 3), i -> "
            "shiftleft(xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)), length(bin(size(_words)))) | i)))"
        ).alias("_windows"),
    )
    named = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    place = "cast({} & (shiftleft(1L, _bits) - 1) as int)"
    this, other = place.format("get(_windows, j)"), place.format("get(_windows, j - 1)")
    differ = " or ".join(f"get(_words, {this} + {k}) <> get(_words, {other} + {k})" for k in range(3))
    # windows whose like stands before them, in order of hashes
    rows = rows.select(
        *named, "_words", "_windows", "_bits",
        F.expr(
            "if(size(_windows) < 2, cast(array() as array<int>), "
            "filter(sequence(1, size(_windows) - 1), j -> shiftright(get(_windows, j) ^ get(_windows, j - 1), _bits) = 0))"
        ).alias("_pairs"),
    )
    hash_ = "shiftright(get(_windows, j), _bits)"
    rows = rows.select(
        *named, "_words", "_windows", "_bits", "_pairs",
        # hashes under which windows of other words stand next to each other
        F.expr(f"array_distinct(transform(filter(_pairs, j -> {differ}), j -> {hash_}))").alias("_mixed"),
    )
    words_at = "concat_ws(' ', " + ", ".join(f"get(_words, {place.format('w')} + {k})" for k in range(3)) + ")"
    rows = rows.select(
        *named, "_windows", "_mixed", "_bits",
        F.expr(f"if(size(_mixed) = 0, _pairs, filter(_pairs, j -> not array_contains(_mixed, {hash_})))").alias("_pairs"),
        F.expr(
            "if(size(_mixed) = 0, cast(array() as array<struct<words: string, place: int>>), sort_array(transform(filter(_windows, w -> "
            f"array_contains(_mixed, shiftright(w, _bits))), w -> struct({words_at} as words, {place.format('w')} as place))))"
        ).alias("_told"),
    )
    rows = rows.select(
        *named,
        F.expr(
            f"sort_array(array_distinct(concat(transform(_pairs, j -> {this}), transform(_pairs, j -> {other}), "
            "if(size(_told) < 2, cast(array() as array<int>), transform(filter(sequence(0, size(_told) - 1), j -> "
            "coalesce(_told[j].words = get(_told, j - 1).words, false) or coalesce(_told[j].words = get(_told, j + 1).words, false)), "
            "j -> _told[j].place)))))"
        ).alias("_places"),
    )
    covered = (
        "if(size(_places) = 0, 0L, aggregate(sequence(0, size(_places) - 1), 0L, (n, j) -> "
        "n + least(3L, coalesce(get(_places, j + 1) - _places[j], 3L))))"
    )
    return rows.select(*named, F.expr(covered).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _chi_square_cdf(x: float, d: int) -> float:
    """For an even number of degrees."""
    term = total = 1.0
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def _chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square_cdf(mid, d) < p else (low, mid)
    return low


def _vector() -> list[Column]:
    """The statistics in units; of rows that pass the base rules."""
    return [F.round(F.expr(e) * UNIT).cast("long").alias(f"q{i}") for i, e in enumerate(VECTOR)]


def _factor(rows: DataFrame, keep: list[str], means: list[Column], cov: dict[tuple[int, int], Column]) -> DataFrame:
    """The columns in keep, m0.., the Cholesky factor l00, l10, .. of cov and det, the logarithm of
    its determinant. Step by step, so that no expression holds another more than once."""
    out = rows.select(*keep, *[m.alias(f"m{i}") for i, m in enumerate(means)], *[cov[i, j].alias(f"c{i}{j}") for i, j in _PAIRS])
    for i, j in _PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(_LEAST[i] * 1e-6))) if i == j else rest / F.col(f"l{j}{j}"))
    det = reduce(Column.__add__, [F.ln(f"l{i}{i}") for i in range(_D)])
    return out.withColumn("det", 2 * det).drop(*[f"c{i}{j}" for i, j in _PAIRS])


_LEAST = [(v * UNIT) ** 2 for v in VECTOR.values()]
_CELL = ["lang_key", "source_key"]
_ESTIMATE = [f"m{i}" for i in range(_D)] + [f"l{i}{j}" for i, j in _PAIRS] + ["det"]


def _distance() -> Column:
    """Squared Mahalanobis distance of q0.. under the joined estimate."""
    z: list[Column] = []
    for i in range(_D):
        rest = F.col(f"q{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    total = z[0] * z[0]
    for x in z[1:]:
        total = total + x * x
    return total


def _middle(tally: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mid): the lower median of q under counts n of each group, by counts of spans of 64
    values and then inside the one span that holds it."""
    span = F.shiftright("q", 6)
    run = W.partitionBy(*keys).orderBy("span")
    edge = (
        tally.groupBy(*keys, span.alias("span")).agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
        .filter((2 * F.col("upto") >= F.col("all")) & (2 * (F.col("upto") - F.col("n")) < F.col("all")))
        .select(*keys, "span", (F.col("upto") - F.col("n")).alias("before"), "all")
    )
    inside = tally.withColumn("span", span).join(edge, [*keys, "span"])
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy("q")) + F.col("before")
    return inside.withColumn("upto", upto).filter(2 * F.col("upto") >= F.col("all")).groupBy(*keys).agg(F.min("q").alias("mid"))


def _regularised(cov: dict[tuple[int, int], Column], target: list[float]) -> dict[tuple[int, int], Column]:
    """cov of a cell of `all` documents mixed with the target, and the least spreads added."""
    own = F.col("all") / (F.col("all") + PRIOR)
    return {(i, j): own * cov[i, j] + ((1 - own) * target[i] + _LEAST[i] if i == j else 0.0) for i, j in _PAIRS}


def _starts(points: DataFrame, work: Workspace) -> tuple[DataFrame, list[float]]:
    """The estimates that the search begins with, as (cell, start, m.., l.., det), and the target."""
    long = points.select(*_CELL, F.posexplode(F.array(*[f"q{i}" for i in range(_D)])).alias("dim", "q"))
    tally = work.table(long.groupBy(*_CELL, "dim", "q").agg(F.count("*").alias("n")), "values")
    mids = work.table(_middle(tally, [*_CELL, "dim"]), "mids")
    off = tally.join(mids, [*_CELL, "dim"]).groupBy(*_CELL, "dim", F.abs(F.col("q") - F.col("mid")).alias("q")).agg(F.sum("n").alias("n"))
    off = work.table(off, "offs")
    offs = _middle(off, [*_CELL, "dim"]).withColumnRenamed("mid", "off")
    everywhere = {r["dim"]: r["mid"] for r in _middle(off.groupBy("dim", "q").agg(F.sum("n").alias("n")), ["dim"]).collect()}
    target = [(1.4826 * everywhere.get(i, 0)) ** 2 for i in range(_D)]
    pick = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c))).cast("double").alias(f"{c}{i}")
    wide = mids.join(offs, [*_CELL, "dim"]).groupBy(*_CELL).agg(*[pick(c, i) for c in ("mid", "off") for i in range(_D)])
    sums = points.groupBy(*_CELL).agg(F.count("*").alias("all"), *_sums())
    both = work.table(wide.join(sums, _CELL), "moments")
    robust = {(i, j): (F.col(f"off{i}") * 1.4826) ** 2 if i == j else F.lit(0.0) for i, j in _PAIRS}
    median = _factor(both.withColumn("start", F.lit(0)), [*_CELL, "start"], [F.col(f"mid{i}") for i in range(_D)], _regularised(robust, target))
    mean, cov = _moments(F.col("all"))
    classic = _factor(both.withColumn("start", F.lit(1)), [*_CELL, "start"], mean, _regularised(cov, target))
    return work.table(median.unionByName(classic), "starts"), target


def _sums() -> list[Column]:
    return [F.sum(f"q{i}").alias(f"s{i}") for i in range(_D)] + [F.sum(F.col(f"q{i}") * F.col(f"q{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]


def _moments(n: Column) -> tuple[list[Column], dict[tuple[int, int], Column]]:
    mean = [F.col(f"s{i}") / n for i in range(_D)]
    return mean, {(i, j): F.col(f"p{i}{j}") / n - mean[i] * mean[j] for i, j in _PAIRS}


def _concentrate(points: DataFrame, estimate: DataFrame, target: list[float]) -> DataFrame:
    """The estimates from the nearest documents under those given, and the determinants before (was)."""
    bin_ = F.floor(F.log2(1 + _distance()) * BINS)
    group = [*_CELL, "start"]
    sums = join_checked(points, estimate, _CELL).groupBy(*group, bin_.alias("bin")).agg(F.count("*").alias("n"), F.max("det").alias("was"), *_sums())
    before = F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = sums.withColumn("before", before).withColumn("all", F.sum("n").over(W.partitionBy(*group))).filter(F.col("before") < SUBSET * F.col("all"))
    names = ["n", *[f"s{i}" for i in range(_D)], *[f"p{i}{j}" for i, j in _PAIRS]]
    total = near.groupBy(*group).agg(F.max("all").alias("all"), F.max("was").alias("was"), *[F.sum(x).alias(x) for x in names])
    mean, cov = _moments(F.col("n"))
    # a subset of the nearest has less spread than the whole; for normal data by this factor
    scale = SUBSET / _chi_square_cdf(_chi_square_quantile(SUBSET, _D), _D + 2)
    return _factor(total, [*group, "was"], mean, _regularised({p: c * scale for p, c in cov.items()}, target))


def estimates(points: DataFrame) -> DataFrame:
    """m0.., l00.. and det of each cell of points (lang_key, source_key, q0..). Materialised."""
    with Workspace(points.sparkSession, "mcd") as work:
        going, target = _starts(points, work)
        steps = [work.table(_concentrate(points, going, target), "steps")]
        going = steps[0]
        while not going.isEmpty():
            steps.append(work.table(_concentrate(points, going, target), "steps"))
            going = steps[-1].filter(F.col("det") < F.col("was") + math.log(1 - SETTLED))
        every = reduce(DataFrame.unionByName, steps)
        best = F.struct("det", "start", *_ESTIMATE[:-1])
        return materialize(every.groupBy(*_CELL).agg(F.min(best).alias("best")).select(*_CELL, "best.*").drop("start"), "mcd")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance (null if base_failed) and kept of each row."""
    keyed = docs.select("doc_id", "text", source_key("lang").alias("lang_key"), source_key("source").alias("source_key"))
    rows = counts(keyed, ("doc_id", *_CELL)).withColumn("base_failed", base_failed())
    rows = materialize(rows.withColumns({f"q{i}": c for i, c in enumerate(_vector())}), "mcd-counts")
    points = rows.filter(~F.col("base_failed")).select(*_CELL, *[f"q{i}" for i in range(_D)])
    out = join_checked(rows, estimates(points), _CELL, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    far = F.coalesce(F.col("distance") > _chi_square_quantile(CUTOFF, _D), F.lit(False))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *names, "base_failed", "distance", (~F.col("base_failed") & ~far).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict on every document."""
    return judge(table(spark, sf_dir, "documents")).drop("distance")
