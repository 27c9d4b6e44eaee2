"""Importance resampling towards a target distribution, by hashed n-grams over a position table.

A text's words are exploded with their positions; for every order up to ``ORDER`` the words that follow
are brought next to each position by lead() within the document and joined to it. Each run of words
falls into a bucket by hash. From the counts by bucket of the corpus and of the target follows a gain
for each bucket, a document's weight is the sum of its features' gains, and with Gumbel noise from a
hash of its id the highest scores are a draw without replacement by importance.

Counts leave a task as one row for each bucket and weights as one for each document; gains are a table of
``BUCKETS`` rows and broadcast. Words of a document are cut into blocks of positions that share the few
words in which runs overlap, so a long text's window is not one task's work; with runs of one word
nothing follows a word, and neither window nor shuffle of positions is planned. Ranks are counted by
ranges of the scores.

Defined cases: a null text has no words; a document without words has weight 0; a null id draws like the
empty text; equal scores go by id, nulls first, then by the rows' order; rows that agree in everything
are drawn separately; an empty target only smooths; of an empty table nothing is drawn; select() gives
the rows with all their columns, whatever their names. A text's words are held at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.llm.common import Workspace, free_names, materialize, running_sums, table

QUERY = "op11_importance_resampling"

ORDER = 1
BUCKETS = 10_000
SEED = "2024"
#: Words from which a document may be drawn, and the percentage of such documents that is.
LEAST_WORDS = 20
PERCENT = 10
#: Positions of a block.
BLOCK = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def positions(rows: DataFrame, order: int, block: int = BLOCK) -> DataFrame:
    """The columns of rows but text, with pos and word of each word (null of a text without any) and,
    as next_1 and so on, the order - 1 words that follow it."""
    own = [c for c in rows.columns if c != "text"]
    placed = rows.select(*own, F.posexplode_outer(words("text")).alias("pos", "word"))
    if order == 1:
        return placed
    at = F.expr(f"pos div {block}")
    # the first words of a block also end the block before
    blocks = F.when((F.col("pos") >= block) & (F.col("pos") % block < order - 1), F.array(at, at - 1)).otherwise(F.array(at))
    parted = placed.withColumn("part", F.explode(blocks))
    along = W.partitionBy(*own, "part").orderBy("pos")
    after = {f"next_{k}": F.lead("word", k).over(along) for k in range(1, order)}
    return parted.withColumns(after).filter(F.col("pos").isNull() | (at == F.col("part"))).drop("part")


def features(rows: DataFrame, order: int = ORDER, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """The columns of rows but text, with n (words) and bucket of every run of up to order words; both
    null once for a text without words."""
    own = [c for c in rows.columns if c != "text"]
    placed = positions(rows, order, block)
    bucket = lambda gram: (F.crc32(gram.cast("binary")) % buckets).cast("int")
    if order == 1:
        return placed.select(*own, F.when(F.col("word").isNotNull(), F.lit(1)).alias("n"), bucket(F.col("word")).alias("bucket"))
    runs = [F.col("word")]
    for k in range(1, order):
        runs.append(F.concat(runs[-1], F.lit(" "), F.col(f"next_{k}")))  # null where the text ends
    runs = F.filter(F.transform(F.array(*runs), lambda gram, i: F.struct((i + 1).alias("n"), bucket(gram).alias("bucket"))), lambda run: run["bucket"].isNotNull())
    return placed.select(*own, F.explode_outer(runs).alias("run")).select(*own, "run.n", "run.bucket")


def _counts(texts: DataFrame, name: str, order: int, buckets: int, block: int) -> DataFrame:
    rows = texts.select("text", F.monotonically_increasing_id().alias("row"))
    return features(rows, order, buckets, block).filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """(bucket, gain) of every bucket, materialised."""
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_counts(docs, "s", order, buckets, block), "bucket", "left").join(_counts(target, "t", order, buckets, block), "bucket", "left")
    counted = materialize(both.fillna(0, ["s", "t"]), "dsir-counts")
    s_all, t_all = counted.agg(F.sum("s"), F.sum("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1.0) * F.lit(float(s_all + buckets))) / ((s + 1.0) * F.lit(float(t_all + buckets)))
    return materialize(counted.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")), "dsir-gains")


def noise(doc_id: Column | str, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(d.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weigh(rows: DataFrame, gain: DataFrame, order: int = ORDER, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """row, doc_id, n_words, n_features and weight of rows (row, doc_id, text); row tells them apart."""
    found = features(rows.select("row", "doc_id", "text"), order, buckets, block).join(F.broadcast(gain), "bucket", "left")
    return found.groupBy("row", "doc_id").agg(
        F.count(F.when(F.col("n") == 1, 1)).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight")
    )


def resample(
    docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, block: int = BLOCK
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of docs (doc_id, text,
    and row where it is given), drawn towards the texts of target."""
    if "row" not in docs.columns:
        docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    weighed = weigh(docs, gains(docs, target, order, buckets, block), order, buckets, block)
    may = (F.col("n_words") >= least_words).cast("long").alias("may")
    spark = docs.sparkSession
    with Workspace(spark, "dsir") as work:
        scored = work.table(weighed.select("row", "doc_id", "n_features", "weight", (F.col("weight") + noise("doc_id", seed)).alias("score"), may), "scored")
        most = percent * (scored.agg(F.sum("may")).first()[0] or 0) // 100
        ranked = running_sums(scored, [F.desc("score"), F.asc_nulls_first("doc_id"), "row"], {"may": "ahead"}, work)
        rank = F.when((F.col("may") == 1) & (F.col("ahead") < most), F.col("ahead") + 1)
        return materialize(ranked.select("row", "doc_id", "n_features", "weight", "score", rank.alias("rank")), "dsir")


def select(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn."""
    (row,) = free_names(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "dsir-rows")
    drawn = resample(numbered.select("doc_id", "text", F.col(row).alias("row")), target, **how).filter("rank is not null")
    return numbered.join(drawn.select(F.col("row").alias(row)), row, "left_semi").drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the benchmark texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = r"""
WITH eight AS (SELECT [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS z),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents),
f AS (SELECT r, unnest(words) AS w FROM d),
g AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT DISTINCT w FROM f UNION SELECT DISTINCT w FROM g),
c AS (
  SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)),
    lambda a, x: list_reduce(list_concat([xor(a, x)], z), lambda b, y: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384::BIGINT) ELSE b >> 1 END)), 4294967295::BIGINT) % 10000 AS bucket
  FROM v, eight),
s AS (SELECT bucket, count(*) AS s FROM f JOIN c USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN c USING (w) GROUP BY bucket),
gains AS (
  SELECT b.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) b(bucket) LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket),
weighed AS (SELECT r, sum(gain)::BIGINT AS weight FROM f JOIN c USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (r)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, score, n_features FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score,
  CASE WHEN place <= 10 * (SELECT count(*) FROM ranked) // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id AND s.score = r.score AND s.n_features = r.n_features
"""
