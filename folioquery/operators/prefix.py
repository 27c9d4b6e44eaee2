"""Autocompletion over a word list (ordinal, word)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.scratch import Workspace, materialize

# How many words are suggested.
TREE_LIMIT = 3
LIST_LIMIT = 5


def complete_from_list(words: DataFrame, prefix: str, limit: int = LIST_LIMIT) -> DataFrame:
    """The first words in list order that start with the lower-cased prefix; the filter reaches the
    scan."""
    return words.filter(F.col("word").startswith(prefix.lower())).orderBy("ordinal").limit(limit)


def as_json(found: DataFrame) -> DataFrame:
    """One row with the words of a completion (ordinal, word) as a JSON list, in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "word")))
    return found.agg(F.to_json(F.transform(ordered, lambda w: w["word"])).alias("words"))


def complete_from_tree(words: DataFrame, prefix: str, limit: int = TREE_LIMIT) -> DataFrame:
    """(rank, word): the first distinct words below the prefix in the order in which a prefix tree,
    filled in list order, is walked: a word before its continuations, continuations by when their
    branch was first made.

    No tree is built. The branch at depth d was made by the least ordinal among the words that
    share their first d characters, so a word's place in the walk is the array of these ordinals.
    Words that share characters beyond the prefix all have the prefix, so filtering first is exact,
    and the prefix itself is the same branch for all. Least ordinals are partial aggregates: no
    branch, however many words it holds, meets in one task.
    """
    found = words.filter(F.col("word").startswith(prefix)).groupBy("word").agg(F.min("ordinal").alias("ordinal"))
    head = F.left("word", F.col("depth"))
    deep = found.filter(F.length("word") > len(prefix)).withColumn("depth", F.explode(F.sequence(F.lit(len(prefix) + 1), F.length("word")))).withColumn("head", head)
    made = deep.groupBy("head").agg(F.min("ordinal").alias("made"))
    keys = deep.join(made, "head").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("depth", "made"))).alias("key"))
    keys = keys.select("word", F.transform("key", lambda k: k["made"]).alias("key"))
    own = found.filter(F.length("word") == len(prefix)).select("word", F.array().cast(keys.schema["key"].dataType).alias("key"))
    top = keys.unionByName(own).orderBy("key").limit(limit)
    return top.select(F.row_number().over(W.orderBy("key")).alias("rank"), "word")


def _first(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(by).orderBy(order))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def completion_table(words: DataFrame, depth: int, tree_limit: int = TREE_LIMIT, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(prefix, tree, listed) of every prefix of up to depth characters, the empty one included: the
    words that complete_from_tree() and complete_from_list() give for it, as arrays.

    Made bottom-up: a node holds when its branch was first made and short lists, and takes its own word
    and its children's lists in the order of their branches. Only the longest prefixes look at all of
    their words, by the limits of a window; above them a node sees one row for each next character."""
    spark = words.sparkSession
    pair = "struct<ordinal:bigint,word:string>"
    named = words.filter(F.col("word").isNotNull()).select(F.col("ordinal").cast("long").alias("ordinal"), "word")
    with Workspace(spark, "prefix") as work:
        named = work.table(named, "words")
        once = work.table(named.groupBy("word").agg(F.min("ordinal").alias("ordinal")), "once")

        def gathered(listed: DataFrame, branches: DataFrame) -> DataFrame:
            """prefix, made, tree, listed from (prefix, ordinal, word) and (prefix, made, rank, word)."""
            l = listed.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("ordinal", "word"))).cast(f"array<{pair}>").alias("listed"))  # noqa: E741
            t = branches.groupBy("prefix").agg(F.min("made").alias("made"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda w: w["word"]).alias("tree"))
            return t.join(l, "prefix")

        # the longest prefixes: their words in order of the branches below
        below = once.filter(F.length("word") >= depth).withColumn("prefix", F.left("word", F.lit(depth)))
        deep = below.filter(F.length("word") > depth).withColumn("depth", F.explode(F.sequence(F.lit(depth + 1), F.length("word")))).withColumn("head", F.left("word", F.col("depth")))
        made = deep.groupBy("head").agg(F.min("ordinal").alias("made"))
        keys = deep.join(made, "head").groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "made"))), lambda k: k["made"]).alias("key"))
        ordered = below.join(keys, "word", "left").withColumn("key", F.coalesce("key", F.array().cast("array<bigint>")))
        first = ordered.groupBy("prefix").agg(F.min("ordinal").alias("made"))
        ranked = _first(ordered, "prefix", "key", tree_limit).withColumnRenamed("place", "rank").join(first, "prefix")
        listed = _first(named.filter(F.length("word") >= depth).withColumn("prefix", F.left("word", F.lit(depth))), "prefix", "ordinal", list_limit)
        level = work.table(gathered(listed, ranked), "level")
        levels = [level]
        for d in range(depth - 1, -1, -1):
            own = once.filter(F.length("word") == d).select(F.col("word").alias("prefix"), F.lit(0).alias("kind"), F.col("ordinal").alias("made"), F.array("word").alias("tree"))
            again = _first(named.filter(F.length("word") == d), "word", "ordinal", list_limit).groupBy(F.col("word").alias("prefix"))
            own = own.join(again.agg(F.collect_list(F.struct("ordinal", "word")).cast(f"array<{pair}>").alias("listed")), "prefix")
            kids = level.select(F.left("prefix", F.lit(d)).alias("prefix"), F.lit(1).alias("kind"), "made", "tree", "listed")
            nodes = own.unionByName(kids).groupBy("prefix").agg(F.min("made").alias("made"), F.array_sort(F.collect_list(F.struct("kind", "made", "tree"))).alias("t"), F.flatten(F.collect_list("listed")).alias("l"))
            tree = F.slice(F.flatten(F.transform("t", lambda n: n["tree"])), 1, tree_limit).alias("tree")
            level = work.table(nodes.select("prefix", "made", tree, F.slice(F.array_sort("l"), 1, list_limit).alias("listed")), "level")
            levels.append(level)
        found = levels[0]
        for more in levels[1:]:
            found = found.unionByName(more)
        return materialize(found.select("prefix", "tree", F.transform("listed", lambda w: w["word"]).alias("listed")), "completions")


def complete_many(table: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefixes with tree and listed, the completions of its column prefix by a completion_table() that
    is deep enough; empty where no word goes on. The list takes the prefix in lower case."""
    none = F.array().cast("array<string>")
    lower = table.select(F.col("prefix").alias("low"), F.col("listed").alias("found"))
    asked = prefixes.join(table.select("prefix", "tree"), "prefix", "left").withColumn("low", F.lower("prefix")).join(lower, "low", "left")
    return asked.select(*prefixes.columns, F.coalesce("tree", none).alias("tree"), F.coalesce("found", none).alias("listed"))
