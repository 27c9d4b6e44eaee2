"""An index of a changing set of files, kept in immutable versions.

    store = VersionedIndex(spark, root)
    store.commit(files)         pages of files (signature, source, page, text): the set as it is now
    index = store.read()        the latest version, or read(version)
    store.compact()             one part of what is left, in the order of its files

A version is a manifest: one row for each file with its name, its content's signature and the part that
holds its chunks. A part is a set of tables (chunks, vectors, tokens, postings' source) that one commit
wrote and no one writes again. A commit indexes only contents that no part holds: a new name of known
content and a file that is gone change the manifest alone, and a file that comes back is found again. The
parts come first and the manifest last, by one rename, so a reader has the old version or the new one and
a commit that fails leaves parts that no manifest names; two commits of one version cannot both succeed.

Chunk ids rise from version to version and are never used twice; within a version they have gaps where
files are gone, until compact() numbers what is left anew, by source, page and chunk.

Defined cases: files of equal content share their chunks, which carry the least of their names, as a file
in an index once; an empty set of files is a version without chunks; a root without a version reads as
version 0, which is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.plans.assistant import Index, build_index
from folioquery.scratch import Workspace, exists, join_checked, materialize, remove, running_sums, store_of

TABLES = ("chunks", "vectors", "tokens")
_MANIFEST = "source string, signature string, part string"


class Conflict(RuntimeError):
    """Another commit made the version first."""


class VersionedIndex:
    def __init__(self, spark: SparkSession, root: str, build=build_index):
        self.spark, self.root, self.build = spark, root.rstrip("/"), build

    # versions

    def versions(self) -> list[int]:
        """The complete versions, in order."""
        store, at = store_of(self.spark, f"{self.root}/versions")
        if not store.exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in store.listStatus(at) if f.getPath().getName().isdigit())

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(source, signature, part) of a version's files."""
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/versions/{version:012d}/files")

    def _next_id(self, version: int) -> int:
        return self.spark.read.parquet(f"{self.root}/versions/{version:012d}/next").first()[0] if version else 1

    def _publish(self, version: int, files: DataFrame, next_id: int) -> int:
        passing = f"{self.root}/passing/{uuid.uuid4().hex}"
        files.write.parquet(f"{passing}/files")
        self.spark.createDataFrame([(next_id,)], "next_id long").coalesce(1).write.parquet(f"{passing}/next")
        store, at = store_of(self.spark, f"{self.root}/versions/{version:012d}")
        store.mkdirs(at.getParent())
        if store.exists(at) or not store.rename(store_of(self.spark, passing)[1], at):
            remove(self.spark, passing)
            raise Conflict(f"version {version} is there already")
        return version

    # parts

    def _write_part(self, pages: DataFrame, first_id: int) -> tuple[str, int]:
        """The name of a new part over pages (signature, source, page, text), and the next free id."""
        name = uuid.uuid4().hex
        path = f"{self.root}/parts/{name}"
        # while they are in a part, chunks are known by their content
        built = self.build(pages.select(F.col("signature").alias("source"), "page", "text"))
        move = lambda df: df.withColumn("chunk_id", F.col("chunk_id") + F.lit(first_id - 1))
        for table in TABLES:
            move(getattr(built, table)).write.parquet(f"{path}/{table}")
        most = self.spark.read.parquet(f"{path}/chunks").agg(F.max("chunk_id")).first()[0]
        return name, max(first_id, (most or 0) + 1)

    def _parts(self, table: str, files: DataFrame) -> DataFrame | None:
        """A table's rows of all parts that files name."""
        found = None
        for (name,) in files.select("part").distinct().orderBy("part").collect():  # one row a commit
            rows = self.spark.read.parquet(f"{self.root}/parts/{name}/{table}").withColumn("part", F.lit(name))
            found = rows if found is None else found.unionByName(rows)
        return found

    # what users call

    def commit(self, files: DataFrame) -> int:
        """Make pages (signature, source, page, text) of all files the next version; its number. A version
        on which nothing changed is not made again."""
        version = self.latest()
        pages = materialize(files.select("signature", "source", "page", "text"), "pages")
        now = materialize(pages.select("source", "signature").distinct(), "files")
        before = self.manifest(version)
        known = self._everything(version).select("signature", "part").groupBy("signature").agg(F.max("part").alias("part"))
        known = materialize(known, "known")
        fresh = now.join(known, "signature", "left_anti").groupBy("signature").agg(F.min("source").alias("source"))
        fresh = materialize(fresh, "fresh")
        first_id = self._next_id(version)
        if fresh.isEmpty():
            part, next_id = None, first_id
        else:
            part, next_id = self._write_part(join_checked(pages, fresh, ["signature", "source"], "left_semi"), first_id)
        listed = now.join(known, "signature", "left").select("source", "signature", F.coalesce("part", F.lit(part)).alias("part"))
        listed = materialize(listed, "manifest")
        if version and listed.exceptAll(before).isEmpty() and before.exceptAll(listed).isEmpty():
            return version
        return self._publish(version + 1, listed, next_id)

    def _everything(self, version: int) -> DataFrame:
        """Files of all versions since the last compact(), whose parts are still there."""
        found = self.manifest(version)
        for v in self.versions():
            if v < version:
                found = found.unionByName(self.manifest(v))
        held = [n for (n,) in found.select("part").distinct().collect() if exists(self.spark, f"{self.root}/parts/{n}")]
        return found.filter(F.col("part").isin(held)) if held else found.limit(0)

    def read(self, version: int | None = None) -> Index:
        """A version's index; its postings are made when they are first asked for."""
        files = materialize(self.manifest(version), "manifest")
        chunks = self._parts("chunks", files)
        if chunks is None:
            return self.build(self.spark.createDataFrame([], "source string, page int, text string"))
        names = materialize(files.groupBy("signature", "part").agg(F.min("source").alias("name")), "names")
        live = join_checked(chunks.withColumnRenamed("source", "signature"), names, ["signature", "part"])
        live = live.withColumnRenamed("name", "source").drop("signature", "part")
        gone = self._parts("chunks", files).join(names.withColumnRenamed("signature", "source"), ["source", "part"], "left_anti").select("chunk_id")
        gone = materialize(gone, "gone")
        some = not gone.isEmpty()
        others = (join_checked(df, gone, "chunk_id", "left_anti") if some else df for df in (self._parts(t, files).drop("part") for t in TABLES[1:]))
        order = [c for c in ("chunk_id", "source", "page", "chunk_seq", "text") if c in live.columns]
        return Index(live.select(*order), *others)

    def compact(self) -> int:
        """A version of the same files in one part, without what is gone; older parts are removed, so
        readers of older versions have to be done."""
        version = self.latest()
        files = materialize(self.manifest(version), "manifest")
        old = self._parts("chunks", files)
        if old is None:
            return version
        names = materialize(files.groupBy("signature", "part").agg(F.min("source").alias("name")), "names")
        live = join_checked(old.withColumnRenamed("source", "signature"), names, ["signature", "part"])
        place = live.select("chunk_id", "name", "signature", "page", "chunk_seq")
        part = uuid.uuid4().hex
        first_id = self._next_id(version)
        with Workspace(self.spark, "compact") as work:
            one = F.lit(1).cast("long").alias("one")
            counted = running_sums(place.select("*", one), ["name", "signature", "page", "chunk_seq", "chunk_id"], {"one": "before"}, work)
            moved = work.table(counted.select("chunk_id", (F.col("before") + first_id).alias("new_id")), "moved")
            for table in TABLES:
                rows = self._parts(table, files).drop("part")
                renumbered = join_checked(rows, moved, "chunk_id").withColumn("chunk_id", F.col("new_id")).drop("new_id")
                renumbered.write.parquet(f"{self.root}/parts/{part}/{table}")
            next_id = first_id + moved.count()
        done = self._publish(version + 1, files.withColumn("part", F.lit(part)), next_id)
        store, at = store_of(self.spark, f"{self.root}/parts")
        for f in store.listStatus(at):
            if f.getPath().getName() != part:
                store.delete(f.getPath(), True)
        return done
