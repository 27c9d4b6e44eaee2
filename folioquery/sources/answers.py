"""Answers that were paid for, kept by prompt.

    store = AnswerStore(spark, path, model="some-model")
    store.complete(prompts, load, most_tokens)      qid, answer of every prompt; asks for new ones alone

An answer's key is the hash of the model's name, both prompts and the most tokens. Prompts with a known key
are not asked, equal prompts once. Tasks write what they were given in files of their own, every ``flush``
answers and before an error leaves them, each by one rename, so an answer is kept as soon as its file is
there: a task that is tried again reads the files of its partition first, and another run finds them all.
Within a task up to concurrency calls are under way at a time.

The folder has to be one that workers reach through pyarrow's file systems, as in sources.folder. Answers
of two tries of one task at a time may both be kept; the least counts, so every reader sees the same.

Defined cases: a null prompt is asked like the empty one; a null answer is kept as the empty one; without
prompts nothing is asked or written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.scratch import exists, materialize, remove
from folioquery.sources.folder import store_at

_SCHEMA = "key string, answer string"


def _write(store: pafs.FileSystem, folder: str, name: str, rows: list[tuple[str, str]]) -> None:
    passing = f"{folder}/.{uuid.uuid4().hex}"
    table = pa.table({"key": [k for k, _ in rows], "answer": [a for _, a in rows]}, pa.schema([("key", pa.string()), ("answer", pa.string())]))
    pq.write_table(table, passing, filesystem=store)
    store.move(passing, f"{folder}/{name}")


def _asker(load: Callable, most_tokens: int, path: str, run_name: str, concurrency: int, flush: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = load()
        store, folder = store_at(path)
        store.create_dir(folder, recursive=True)
        own = f"{run_name}-{TaskContext.get().partitionId():06d}-"
        done: set[str] = set()
        for f in store.get_file_info(pafs.FileSelector(folder)):
            if f.base_name.startswith(own):  # of an earlier try
                done.update(pq.read_table(f.path, columns=["key"], filesystem=store)["key"].to_pylist())
        with ThreadPoolExecutor(concurrency) as pool:
            for p in batches:
                rows = [r for r in zip(p.key, p.system_prompt, p.user_prompt) if r[0] not in done]
                for at in range(0, len(rows), flush):
                    asked = [(key, pool.submit(generate, system, user, most_tokens)) for key, system, user in rows[at : at + flush]]
                    got, failed = [], None
                    for key, answer in asked:
                        try:
                            got.append((key, answer.result() or ""))
                        except Exception as e:  # the others' answers are kept before it goes on
                            failed = failed or e
                    if got:
                        _write(store, folder, f"{own}{uuid.uuid4().hex}.parquet", got)
                    if failed is not None:
                        raise failed
                yield p[["key"]]

    return run


class AnswerStore:
    def __init__(self, spark: SparkSession, path: str, model: str, concurrency: int = 8, flush: int = 64):
        self.spark, self.path, self.model, self.concurrency, self.flush = spark, path.rstrip("/"), model, concurrency, flush

    def known(self) -> DataFrame:
        """(key, answer) of every answer that is kept."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(self.path).groupBy("key").agg(F.min("answer").alias("answer"))

    def keyed(self, prompts: DataFrame, most_tokens: int) -> DataFrame:
        """qid, key, system_prompt and user_prompt of each prompt."""
        said = [F.coalesce(c, F.lit("")) for c in ("system_prompt", "user_prompt")]
        parts = [F.lit(self.model), F.lit(str(most_tokens)), *said]
        key = F.sha2(F.concat(*[F.sha2(p, 256) for p in parts]), 256)
        return prompts.select("qid", key.alias("key"), *[s.alias(n) for s, n in zip(said, ("system_prompt", "user_prompt"))])

    def complete(self, prompts: DataFrame, load: Callable, most_tokens: int) -> DataFrame:
        """qid and answer for each row (qid, system_prompt, user_prompt) by a model that is opened in
        each task; load() gives a function that may be called from several threads."""
        asked = materialize(self.keyed(prompts, most_tokens), "prompts")
        fresh = asked.dropDuplicates(["key"]).join(self.known(), "key", "left_anti")
        fresh = materialize(fresh.repartition("key").select("key", "system_prompt", "user_prompt"), "fresh")
        if not fresh.isEmpty():
            ask = _asker(load, most_tokens, self.path, uuid.uuid4().hex, self.concurrency, self.flush)
            fresh.mapInPandas(ask, "key string").agg(F.count("*")).first()
        return asked.join(self.known(), "key").select("qid", "answer")

    def compact(self) -> None:
        """Bring the many small files of earlier runs together; not while another run writes."""
        before = [r[0] for r in self.spark.read.schema(_SCHEMA).parquet(self.path).select("_metadata.file_path").distinct().collect()] if exists(self.spark, self.path) else []
        if before:
            materialize(self.known(), "answers").write.mode("append").parquet(self.path)
            for path in before:
                remove(self.spark, path)
