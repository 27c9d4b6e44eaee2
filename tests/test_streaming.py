import datetime
import json
import os
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquery.functions.providers import plain_text_pages
from folioquery.operators import conversation
from folioquery.plans import queries as plans
from folioquery.streaming import conversations
from folioquery.streaming.ingest import chunk_stream, write_chunks
from folioquery.streaming.topics import topic_stream

BODY = "Rivers carry water to the sea. " * 60


def test_files_become_chunks_once(spark, tmp_path):
    inbox, out, mark = (tmp_path / x for x in ("inbox", "out", "mark"))
    inbox.mkdir()
    seen = []
    for name in ("a.txt", "b.txt"):
        (inbox / name).write_text(BODY)
        write_chunks(chunk_stream(spark, str(inbox), plain_text_pages, ".txt"), str(out), str(mark)).awaitTermination(120)
        seen.append(spark.read.parquet(str(out)).count())
    assert seen[0] > 1 and seen[1] == 2 * seen[0]


def test_topics_over_batches_match_the_batch_engine(spark, tmp_path):
    turns = ["What is ml?", "How does it work?", "Compare a and b", "are they fast", "why"]
    inbox = tmp_path / "in"
    inbox.mkdir()
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "user", text) for c in (1, 2) for t, text in enumerate(turns)]
    for part in (rows[:2] + rows[5:6], rows[2:5] + rows[6:]):
        (inbox / f"{len(part)}.json").write_text("\n".join(json.dumps(dict(zip(("conv_id", "turn", "role", "text"), r))) for r in part))
        stream = topic_stream(spark.readStream.schema(schema).json(str(inbox)))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r["conv_id"], r["turn"]): r["rewritten"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["conv_id"], r["turn"]): r["rewritten"] for r in conversation.rewritten(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len(got) == 10


START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "conv_id long, document string, turn long, role string, text string, at timestamp"


def streamed(spark, tmp_path, batches, delay, idle):
    """What leaves the stream when each list of (conv_id, document, turn, role, text, minute) is a
    micro-batch, and how many rows of state the last one left."""
    inbox = tmp_path / "in"
    inbox.mkdir(parents=True)
    for k, rows in enumerate(batches):
        lines = [json.dumps(dict(zip(("conv_id", "document", "turn", "role", "text", "at"), (*r[:5], (START + datetime.timedelta(minutes=r[5])).isoformat())))) for r in rows]
        (inbox / f"{k:03d}.json").write_text("\n".join(lines))
        os.utime(inbox / f"{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken in order of time
    conversations.use_rocksdb(spark)
    stream = conversations.conversation_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(inbox)), delay, idle)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")), q.recentProgress[-1].stateOperators[0].numRowsTotal


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_the_batch_result(spark, sf_dir, tmp_path, seed):
    turns = plans._turns(spark, sf_dir).withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, F.lit(" Quit ")).otherwise(F.col("text")))
    rows = [(r.conv_id, None, r.turn, r.role, r.text, r.turn) for r in turns.collect()]
    random.Random(seed).shuffle(rows)
    batches = [rows[k::4] for k in range(4)]
    # every message is in time; the last ones move the watermark past all others
    out, _ = streamed(spark, tmp_path, [*batches, [(-1, None, 0, "user", "late", 2000)], [(-1, None, 1, "user", "later", 2001)]], "1 day", "10 days")
    kept = conversation.until_exit(turns)
    want = {(r.conv_id, r.turn): r.rewritten for r in conversation.rewritten(kept).collect()}
    said = out.filter("conv_id >= 0").collect()
    assert {(r.conv_id, r.turn): r.rewritten for r in said if r.role == "user"} == want
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-conversation.RECENT, -1)
    history = {(r.conv_id, r.turn): r.h for r in kept.select("conv_id", "turn", F.collect_list(F.struct("role", "text")).over(before).alias("h")).collect()}
    assert {(r.conv_id, r.turn): r.history for r in said} == history and len(said) == len(history)


def test_exit_clear_documents_and_forgetting(spark, tmp_path):
    first = [
        (1, "a", 2, "user", "why", 3), (1, "a", 0, "user", "What is snow?", 1), (1, "b", 1, "user", "How does it melt?", 2), (1, "a", 3, "clear", None, 4),
        (1, "a", 4, "user", "Is it cold", 5), (2, None, 0, "user", "What is ice?", 1), (2, None, 1, "user", "EXIT", 2), (2, None, 2, "user", "Is it cold", 3),
        (None, None, 0, "user", None, 1), (3, None, 5, "user", "Define fog", 1), (3, None, 5, "user", "Define dew", 1),
    ]
    later = [(2, None, 3, "user", "and now", 20), (1, "a", 5, "assistant", "Yes.", 21)]
    much_later = [(2, None, 4, "user", "What is it?", 500), (4, None, 0, "user", "x", 520)]
    out, left = streamed(spark, tmp_path, [first, later, [(4, None, 1, "user", "y", 300)], much_later, [(5, None, 0, "user", "z", 2000)], [(5, None, 1, "user", "z", 2001)]], "10 minutes", "2 hours")
    got = sorted(((r.conv_id, r.document, r.turn, r.rewritten, r.topics, [h.text for h in r.history]) for r in out.filter("conv_id is null or conv_id < 4").collect()), key=repr)
    assert got == sorted(
        [
            (1, "a", 0, "What is snow?", None, []), (1, "a", 2, "why of snow", ["snow"], ["What is snow?"]), (1, "b", 1, "How does it melt?", None, []),
            (1, "a", 4, "Is it cold", None, []), (1, "a", 5, None, None, ["Is it cold"]), (2, None, 0, "What is ice?", None, []),
            (2, None, 4, "What is it?", None, []),  # behind two hours of silence a new conversation
            (None, None, 0, "", None, []), (3, None, 5, "Define dew", None, []), (3, None, 5, "Define fog", ["dew"], ["Define dew"]),
        ],
        key=repr,
    )
    assert left < 12  # of conversation 5 alone
