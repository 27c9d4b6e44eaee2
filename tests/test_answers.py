"""Answers that are paid for once."""

import collections
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from folioquery.operators import answering as A
from folioquery.sources.answers import AnswerStore


def logged(log, broken=""):
    """A model that notes every call in a file and fails on a prompt that names broken."""

    def load():
        def generate(system, user, most):
            if broken and broken in user:
                raise RuntimeError("the service is down")
            with open(log, "a") as out:
                out.write(user + "\n")
            return f"{system}:{user}:{most}" if user != "none" else None

        return generate

    return load


def calls(log):
    return collections.Counter(open(log).read().split("\n")[:-1]) if os.path.exists(log) else collections.Counter()


def prompts(spark, texts):
    return spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "qid long, system_prompt string, user_prompt string")


def test_equal_and_known_prompts_are_asked_once(spark, tmp_path):
    log = f"{tmp_path}/log"
    store = AnswerStore(spark, f"{tmp_path}/answers", "m", flush=3)
    texts = [f"q{i % 10}" for i in range(40)] + ["none", None]
    got = {r.qid: r.answer for r in store.complete(prompts(spark, texts), logged(log), 9).collect()}
    assert got == {i: "" if t == "none" else f"s:{t or ''}:9" for i, t in enumerate(texts)}
    assert calls(log) == {**{f"q{i}": 1 for i in range(10)}, "none": 1, "": 1}
    more = store.complete(prompts(spark, ["q3", "new", "none"]), logged(log), 9)
    assert {r.qid: r.answer for r in more.collect()} == {0: "s:q3:9", 1: "s:new:9", 2: ""} and calls(log)["q3"] == 1
    store.complete(prompts(spark, ["q3"]), logged(log), 10).count()
    AnswerStore(spark, f"{tmp_path}/answers", "other").complete(prompts(spark, ["q3"]), logged(log), 9).count()
    assert calls(log)["q3"] == 3  # another length, another model
    kept = {tuple(r) for r in store.known().collect()}
    store.compact()
    assert {tuple(r) for r in store.known().collect()} == kept and store.complete(prompts(spark, texts), logged(log), 9).count() == 42
    assert calls(log).total() == 15 and store.complete(prompts(spark, texts).limit(0), logged(log), 9).count() == 0


def test_what_was_answered_before_an_error_is_kept(spark, tmp_path):
    log = f"{tmp_path}/log"
    store = AnswerStore(spark, f"{tmp_path}/answers", "m", concurrency=4, flush=5)
    texts = [f"q{i}" for i in range(30)]
    with pytest.raises(Exception, match="the service is down"):
        store.complete(prompts(spark, texts), logged(log, "q17"), 9).collect()
    before = calls(log)
    assert 0 < before.total() < 30 and store.known().count() == before.total()
    assert store.complete(prompts(spark, texts), logged(log), 9).count() == 30
    assert calls(log) == {t: 1 for t in texts}


TASK_FAILURE = """
import os, sys
from pyspark.sql import SparkSession
from folioquery.sources.answers import AnswerStore
folder = sys.argv[1]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", folder + "/check").getOrCreate()

def load():
    def generate(system, user, most):
        if user == "q25" and not os.path.exists(folder + "/failed"):
            open(folder + "/failed", "w").close()
            os._exit(3)  # the worker is gone
        with open(folder + "/log", "a") as out:
            out.write(user + "\\n")
        return user.upper()
    return generate

prompts = spark.createDataFrame([(i, "s", f"q{i}") for i in range(60)], "qid long, system_prompt string, user_prompt string")
got = AnswerStore(spark, folder + "/answers", "m", concurrency=1, flush=1).complete(prompts, load, 5).collect()
assert {r.qid: r.answer for r in got} == {i: f"Q{i}" for i in range(60)}
"""


def test_a_task_that_is_tried_again_asks_for_the_rest(tmp_path):
    subprocess.run([sys.executable, "-c", TASK_FAILURE, str(tmp_path)], check=True, capture_output=True, timeout=300)
    asked = calls(f"{tmp_path}/log")
    assert os.path.exists(f"{tmp_path}/failed") and asked == {f"q{i}": 1 for i in range(60)}


def test_answers_of_questions_come_from_the_store(spark, tmp_path):
    rows = [(1, 1, "Alpha beta.", 0.9), (2, 1, "Alpha beta.", 0.1)]
    results = spark.createDataFrame([(q, k, k, "s", 1, t, s, s, 0.0, s) for q, k, t, s in rows], "qid long, rank int, chunk_id long, source string, page int, text string, score double, dense_score double, sparse_score double, rerank_score double")
    questions = spark.createDataFrame([(1, "alpha?"), (2, "alpha?")], "qid long, question string")
    store, log = AnswerStore(spark, f"{tmp_path}/answers", "m"), f"{tmp_path}/log"
    for _ in range(2):
        got = {r.qid: r.confidence for r in A.answer(questions, results, logged(log), store=store).select("qid", "confidence", F.length("answer")).collect()}
        assert got == {1: "High", 2: "Low"}
    assert store.known().count() == 1
