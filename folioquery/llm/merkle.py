"""Merkle manifest of a dataset: one tree for each value of a column, and a crown over their subroots.

A row's leaf is H of its fields, H being the lower-case hex sha256 of the concatenated inputs and
digests entering as hex text. Leaves are numbered within their tree, and level by level the index is
divided by the fanout: the nodes that share a quotient are gathered as a short sorted array and hashed
into their parent, a run of one like any other, until a tree is down to one node, its subroot. The
subroots, in order of their keys, are the leaves of the crown, whose last node is the root.

Proofs are made from the top down: a subroot begins with its path through the crown, and at each level
parents pass theirs on to their children behind the siblings of each. So a path is moved once for every
two nodes of its level, half as many at each level up, and not once a level for each row.

Leaves are numbered by ranges over all trees together, so that a tree that holds most rows is spread
like any other; no task holds more than a run of nodes at a time. Every level is a written table, and of
the way down one in ``STRIDE``.

Defined cases: a null field enters as ``-``; a null key is a tree of its own and the first; null ids come
first; equal ids are ordered by leaf, and of rows that agree in all fields any order gives the same
digests; a lone leaf is its tree's subroot, a lone subroot the root; an empty table has no root and no
rows; columns other than the fields are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import Workspace, join_checked, materialize, running_sums, table

QUERY = "op12_merkle_manifest"

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Levels of proofs between two written tables.
STRIDE = 6

PATH = "array<struct<left:binary,right:binary>>"


def hashed(text: Column) -> Column:
    """The digest of H, as bytes."""
    return F.unhex(F.sha2(text, 256))


def _nothing() -> Column:
    return F.lit(b"")


def as_text(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """How a field enters its leaf: ``-`` for null, else its bytes of UTF-8, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return hashed(F.concat(*map(field, values)))


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, digest, lambda at, s: hashed(as_text(F.concat(s["left"], at, s["right"]))))


def siblings(path: Column) -> Column:
    """All siblings of a path as hex text, from the leaf up, left to right."""
    return as_text(F.aggregate(path, _nothing(), lambda at, s: F.concat(at, s["left"], s["right"])))


class Manifest(NamedTuple):
    """levels[k]: (tree, idx, n, hash[, kids]), the nodes k steps above the leaves, n being the nodes of
    their tree there; levels[0] holds the leaves with the columns that were kept. subroots: (tree, hash,
    height). crown: the levels above the subroots. root: hex, None of an empty table."""

    levels: list[DataFrame]
    subroots: DataFrame
    crown: list[DataFrame]
    root: str | None


def grow(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """All levels above leaves (tree, idx, n, hash, ..), which have to be materialised. A node's kids
    hold all columns of theirs but tree and n."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = levels[-1].drop("kids")
        own = [c for c in below.columns if c not in ("tree", "idx", "n")]
        runs = (
            below.filter("n > 1")
            .groupBy("tree", "n", F.expr(f"idx div {fanout}").alias("parent"))
            .agg(F.array_sort(F.collect_list(F.struct("idx", *own))).alias("kids"))
        )
        joined = F.aggregate("kids", _nothing(), lambda at, kid: F.concat(at, kid["hash"]))
        fewer = F.ceil(F.col("n") / fanout).cast("long")
        levels.append(materialize(runs.select("tree", F.col("parent").alias("idx"), fewer.alias("n"), hashed(as_text(joined)).alias("hash"), "kids"), "merkle-level"))
        most = -(-most // fanout)
    return levels


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The columns of levels[0] but n, and path, of every leaf; tops: (tree, height, path) of the
    trees' last nodes, materialised."""
    own = [c for c in levels[0].columns if c != "n"]
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        ends = tops.filter(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("idx"), "path")  # trees that end here
        if k == 0:
            ends = levels[0].filter("n = 1").select(*own).join(ends, ["tree", "idx"])
        if paths is not None:
            around = F.transform("kids", lambda kid, i: F.struct(
                kid.alias("kid"),
                F.aggregate(F.slice("kids", F.lit(1), i), _nothing(), lambda at, x: F.concat(at, x["hash"])).alias("left"),
                F.aggregate(F.slice("kids", i + 2, F.size("kids")), _nothing(), lambda at, x: F.concat(at, x["hash"])).alias("right"),
            ))
            below = levels[k + 1].join(paths, ["tree", "idx"]).select("tree", "path", F.explode(around).alias("s"))
            kept = [F.col(f"s.kid.{c}").alias(c) for c in (["idx"] if k else own) if c != "tree"]
            path = F.concat(F.array(F.struct(F.col("s.left").alias("left"), F.col("s.right").alias("right"))), "path").cast(PATH).alias("path")
            ends = ends.unionByName(below.select("tree", *kept, path))
        paths = materialize(ends, "merkle-paths") if k and k % STRIDE == 0 else ends
    return paths


def build(rows: DataFrame, keep: dict[str, Column] | None = None, tree: str = "lang", order: str = "doc_id", fields=FIELDS, fanout: int = FANOUT) -> Manifest:
    """The manifest of rows; levels[0] also has the columns in keep."""
    spark, keep = rows.sparkSession, keep or {}
    key = F.coalesce(F.concat(F.lit("s"), F.col(tree).cast("string")), F.lit("n"))
    one = F.lit(1).cast("long").alias("one")
    made = rows.select(key.alias("tree"), F.col(order).alias("ordered"), leaf(*map(F.col, fields)).alias("hash"), F.monotonically_increasing_id().alias("row"), one, *[c.alias(n) for n, c in keep.items()])
    with Workspace(spark, "merkle") as work:
        made = work.table(made, "leaves")
        placed = work.table(running_sums(made, ["tree", F.asc_nulls_first("ordered"), "hash", "row"], {"one": "place"}, work), "placed")
        trees = work.table(placed.groupBy("tree").agg(F.min("place").alias("first"), F.count("*").alias("n")), "trees")
        numbered = join_checked(placed, trees, "tree").select("tree", (F.col("place") - F.col("first")).alias("idx"), "n", "hash", *keep)
        levels = grow(materialize(numbered, "merkle-level"), fanout)
        ends = [level.filter("n = 1").select("tree", "hash", F.lit(k).alias("height"), one) for k, level in enumerate(levels)]
        subroots = ends[0]
        for more in ends[1:]:
            subroots = subroots.unionByName(more)
        subroots = materialize(subroots, "merkle-subroots")
        ranked = running_sums(subroots, ["tree"], {"one": "idx"}, work)
        whole = ranked.select(F.lit("").alias("tree"), "idx", F.lit(subroots.count()).alias("n"), "hash", F.col("tree").alias("key"), "height")
        crown = grow(materialize(whole, "merkle-level"), fanout)
    top = crown[-1].select("hash").first()  # one node, or none
    return Manifest(levels, subroots.drop("one"), crown, None if top is None else bytes(top[0]).hex())


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf (tree, idx, hash, kept columns) with the siblings on its way to the root as path."""
    spark = manifest.subroots.sparkSession
    top = spark.range(1).select(F.lit("").alias("tree"), F.lit(len(manifest.crown) - 1).alias("height"), F.array().cast(PATH).alias("path"))
    crowned = descend(manifest.crown, materialize(top, "merkle-tops"))
    tops = materialize(crowned.select(F.col("key").alias("tree"), "height", "path"), "merkle-tops")
    return descend(manifest.levels, tops)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root, and whether the root still follows after tampering with
    the lengths of a seventh of them."""
    docs = table(spark, sf_dir, "documents")
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    manifest = build(docs, {"doc_id": F.col("doc_id"), "tampered": F.when(chosen, leaf(*more))})
    root = F.lit(manifest.root)
    subroots = manifest.subroots.select("tree", as_text("hash").alias("subroot"))
    proved = join_checked(proofs(manifest), materialize(subroots, "merkle-subroots"), "tree")
    folded = as_text(fold(F.coalesce("tampered", "hash"), F.col("path")))
    return proved.select(
        "doc_id", as_text("hash").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (SELECT [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS eight),
docs AS (
  SELECT *, coalesce('s' || lang, 'n') AS k,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS codes
  FROM documents),
summed AS (
  SELECT * EXCLUDE (codes), xor(list_reduce(list_concat([4294967295::BIGINT], codes), lambda a, x:
    list_reduce(list_concat([xor(a, x)], eight), lambda b, z: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384::BIGINT) ELSE b >> 1 END)), 4294967295::BIGINT) AS crc
  FROM docs, bits),
leaves AS (
  SELECT doc_id, k, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS tampered
  FROM summed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM leaves),
nodes AS (
  SELECT 0 AS lvl, k, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, k, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lvl, k, i // 2, n),
tops AS (SELECT k, lvl, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
crown AS (
  SELECT 0 AS lvl, i, n, h FROM tops
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY lvl, i // 2, n),
steps AS (
  SELECT p.k AS k, p.i AS i, s.lvl AS lvl, CASE WHEN o.h IS NULL THEN 'N' WHEN o.i % 2 = 0 THEN 'L' || o.h ELSE 'R' || o.h END AS step
  FROM placed p JOIN nodes s ON s.k = p.k AND s.n > 1 AND s.i = p.i >> s.lvl
  LEFT JOIN nodes o ON o.k = s.k AND o.lvl = s.lvl AND o.i = xor(s.i, 1)
  UNION ALL
  SELECT p.k, p.i, t.lvl + s.lvl, CASE WHEN o.h IS NULL THEN 'N' WHEN o.i % 2 = 0 THEN 'L' || o.h ELSE 'R' || o.h END
  FROM placed p JOIN tops t ON t.k = p.k JOIN crown s ON s.n > 1 AND s.i = t.i >> s.lvl
  LEFT JOIN crown o ON o.lvl = s.lvl AND o.i = xor(s.i, 1)),
paths AS (SELECT k, i, list(step ORDER BY lvl) AS path FROM steps GROUP BY k, i),
proofs AS (
  SELECT doc_id, leaf, t.h AS subroot, (SELECT h FROM crown WHERE n = 1) AS root, coalesce(path, []) AS path, coalesce(tampered, leaf) AS now
  FROM placed p JOIN tops t ON t.k = p.k LEFT JOIN paths q ON q.k = p.k AND q.i = p.i),
folded AS (
  SELECT *, list_reduce(list_concat([now], path), lambda a, s: CASE s[1] WHEN 'N' THEN sha256(a) WHEN 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(path, lambda s: s[2:])), 'string_agg', '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""
