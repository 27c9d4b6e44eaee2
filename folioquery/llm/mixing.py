"""Mixing sources to target weights by nested hash thresholds.

Every document draws a 30-bit number from a hash of its id and text. A source's target is met by taking all
of its documents some whole number of times and once more those whose draw is below the source's
threshold. Thresholds are found without sorting: words are summed by source and by the upper
``LEVEL_BITS`` bits of the draw, the running sums name the one bucket in which the budget runs out,
and only that bucket is split by the next bits, until every bit is used. A smaller budget gives a
lower threshold, so mixes of the same documents are nested. The documents that share the last draw
are in or out together, whichever lies nearer to the target.

Only sums by source and bucket leave the executors' partial aggregation, so a source with any share
of the rows costs as much as another. The table of sources has one row for each source; where it
needs an order, sources are sorted by ranges, so many sources do not meet in one task either.

Defined cases: a null text has size 0; null is a source of its own and the last in order; a null id
draws like the empty text; rows that agree in id and text are taken together, others are not, however
frequent an id or a text is; sources of size 0 get the target 0; an empty table gives no rows; other
columns are not read, and apply() leaves them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.llm.common import Workspace, free_names, join_checked, materialize, running_sums, table

QUERY = "op2_source_mix"

DRAW_BITS = 30
LEVEL_BITS = 10
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix is to hold, as a fraction, and the most repeats of a source.
SHARE = (3, 2)
MOST = 2

_SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column | str) -> Column:
    """Number of runs of characters other than blank and U+0009 to U+000D; 0 for null."""
    t = F.col(text) if isinstance(text, str) else text
    is_space = lambda c: c.isin(*[chr(x) for x in (32, 9, 10, 11, 12, 13)]).cast("long")
    parts = F.size(F.split(t, _SPACE, -1)).cast("long")
    count = parts - is_space(F.substring(t, 1, 1)) - is_space(F.substring(t, -1, 1))
    return F.when(t.isNull() | (t == ""), F.lit(0).cast("long")).otherwise(count)


def source_key(source: Column | str) -> Column:
    s = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("s"), s), F.lit("n"))


def draw(doc_id: Column | str, text: Column | str, seed: str = "mix") -> Column:
    d, t = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    key = F.concat(F.coalesce(d.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(F.coalesce(t, F.lit("")).cast("binary")))
    return F.shiftright(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), 32 - DRAW_BITS)


def targets(totals: DataFrame, work: Workspace, weights=WEIGHTS, share=SHARE, most: int = MOST) -> DataFrame:
    """source_key, source_size, target, whole (repeats of every document) and budget (words still
    to take) from (source_key, source_size). Weights go around in the order of the sources; what a
    source cannot take at most times its size is shared among the others by weight."""
    up, down = share
    placed = running_sums(totals.withColumn("one", F.lit(1).cast("long")), [F.col("source_key").startswith("n"), "source_key"], {"one": "ordinal"}, work)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))
    t = placed.drop("one").withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    scale = 1
    for w in set(weights):
        scale *= w
    # sources in the order in which a rising level fills them
    t = t.withColumn("level", F.expr(f"{scale * most} * source_size div weight"))
    t = running_sums(t, ["level", "source_key"], {"cap": "below", "weight": "lighter"}, work)
    words, weighing = (x or 0 for x in t.agg(F.sum("source_size"), F.sum("weight")).first())
    rest = F.lit(weighing) - F.col("lighter")
    t = t.withColumn("full", (words * up - down * F.col("below")) * F.col("weight") > down * rest * F.col("cap"))
    held, free = (x or 0 for x in t.agg(F.sum(F.when(F.col("full"), F.col("cap"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first())
    shared = (F.lit(words * up - down * held) * F.col("weight")).cast("double") / F.lit(float(down * max(free, 1)))
    t = t.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared))
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    return (
        t.withColumn("whole", F.least(whole.cast("long"), F.lit(most).cast("long")))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source_key", "source_size", "target", "whole", "budget")
    )


def _buckets(rows: DataFrame, level: int) -> DataFrame:
    shift = DRAW_BITS - LEVEL_BITS * (level + 1)
    return rows.groupBy("source_key", F.shiftright("draw", shift).alias("bucket")).agg(F.sum("size").alias("words"))


def _boundary(sums: DataFrame, state: DataFrame) -> DataFrame:
    """Of each source the bucket in which its budget runs out, with the words taken before it."""
    run = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return (
        join_checked(sums, state.select("source_key", "budget", "taken"), "source_key")
        .withColumn("through", F.col("taken") + F.sum("words").over(run))
        .filter((F.col("through") > F.col("budget")) & (F.col("through") - F.col("words") <= F.col("budget")) & (F.col("words") > 0))
        .select("source_key", "budget", (F.col("through") - F.col("words")).alias("taken"), "words", "bucket")
    )


def plan(rows: DataFrame, **how) -> DataFrame:
    """One row for each source: source_key, source_size, target, whole, threshold. rows:
    (source_key, size, draw), materialised. The documents of a source are taken whole times, and
    once more where draw < threshold."""
    with Workspace(rows.sparkSession, "mix") as work:
        first = work.table(_buckets(rows, 0), "sums")
        totals = first.groupBy("source_key").agg(F.sum("words").alias("source_size"))
        aims = work.table(targets(totals, work, **how), "targets")
        state = aims.withColumn("taken", F.lit(0).cast("long"))
        sums = first
        for level in range(DRAW_BITS // LEVEL_BITS):
            if level:
                shift = DRAW_BITS - LEVEL_BITS * level
                edge = state.select("source_key", F.col("bucket").alias("edge"))
                inside = join_checked(rows, edge, "source_key").filter(F.shiftright("draw", shift) == F.col("edge"))
                sums = _buckets(inside, level)
            state = work.table(_boundary(sums, state), "edges")
        nearer = F.col("taken") + F.col("words") - F.col("budget") < F.col("budget") - F.col("taken")
        cuts = state.select("source_key", (F.col("bucket") + nearer.cast("long")).alias("threshold"))
        found = aims.join(cuts, "source_key", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("long")))
        return materialize(found.drop("budget"), "mix-plan")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source_key, size and draw of each row, materialised."""
    rows = docs.select("doc_id", source_key("source").alias("source_key"), n_words("text").alias("size"), draw("doc_id", "text").alias("draw"))
    return materialize(rows, "mix-sizes")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of each row."""
    rows = sized(docs)
    times = F.col("whole") + (F.col("draw") < F.col("threshold")).cast("long")
    return join_checked(rows, plan(rows, **how), "source_key").select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def apply(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as the mix takes them: a row taken twice stands twice, one not taken is
    gone. Rows without words are kept once; they weigh nothing."""
    key, whole, cut, times, copy = free_names(docs, "mix_key", "mix_whole", "mix_threshold", "mix_times", "mix_copy")
    sources = plan(sized(docs), **how).select(F.col("source_key").alias(key), F.col("whole").alias(whole), F.col("threshold").alias(cut))
    taken = join_checked(docs.withColumn(key, source_key("source")), sources, key)
    once = F.when(n_words("text") == 0, F.lit(1)).otherwise((F.col(whole) + (draw("doc_id", "text") < F.col(cut)).cast("long")).cast("int"))
    taken = taken.withColumn(times, once).filter(F.col(times) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to 150 % of their words by the weights 3, 1, 2."""
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix:' || md5(coalesce(text, ''))), 1, 8))::BIGINT) >> 2 AS draw
  FROM documents),
t AS (SELECT k, min(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         3 * sum(source_size) OVER () AS everything FROM t),
o AS (
  SELECT *,
    coalesce(sum(2 * source_size) OVER (ORDER BY 12 * source_size // weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY 12 * source_size // weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
c AS (SELECT *, (everything - 2 * below) * weight > 4 * rest * source_size AS is_full FROM o),
l AS (
  SELECT *, sum(CASE WHEN is_full THEN 2 * source_size ELSE 0 END) OVER () AS held,
         sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS free FROM c),
g AS (
  SELECT k, source_size,
    CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE ((everything - 2 * held) * weight)::DOUBLE / (2 * free)::DOUBLE END AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, floor(target / source_size)::BIGINT) END AS whole FROM g),
h AS (SELECT k, draw, sum(size) AS words FROM d GROUP BY k, draw),
r AS (
  SELECT h.k, draw, words, sum(words) OVER (PARTITION BY h.k ORDER BY draw) AS through,
         target - whole * source_size AS budget FROM h JOIN b ON h.k = b.k),
x AS (
  SELECT k, min(draw + CASE WHEN through - budget < budget - (through - words) THEN 1 ELSE 0 END) AS threshold
  FROM r WHERE through > budget AND through - words <= budget AND words > 0 GROUP BY k)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN draw < coalesce(threshold, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.k = b.k LEFT JOIN x ON d.k = x.k
"""
