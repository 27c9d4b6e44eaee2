import pytest

from folioquery.functions import topics as Q
from folioquery.operators import conversation as C
from folioquery.plans import queries as plans

CASES = [
    ([], "What is machine learning?", "What is machine learning?"),
    (["ml"], "How does it work?", "How does ml work?"),
    (["ml"], "What are its advantages?", "What are its advantages?"),
    ([], "Compare CNN and RNN", "Compare CNN and RNN"),
    (["cnn", "rnn"], "Which one is faster?", "which is faster: cnn or rnn?"),
    (["cnn", "rnn"], "Tell me more on the former", "Tell me more on the cnn"),
    (["cnn", "rnn"], "Are they fast?", "Are cnn and rnn fast?"),
    (["cnn", "rnn"], "explain", "explain of cnn and rnn"),
    (["cnn"], "why", "why of cnn"),
    (["cnn"], "why?", "why?"),
    (["cnn"], "explain more", "explain more"),
    (["cnn"], "what is it?", "what is cnn?"),
    ([], "How does it work?", "How does it work?"),
    (None, "How does it work?", "How does it work?"),
    (["US$5 \\1"], "is it ok", "is US$5 \\1 ok"),
    (["x"], "  ", ""),
]


def test_rewriting(spark):
    df = spark.createDataFrame([(i, t, q) for i, (t, q, _) in enumerate(CASES)], "i int, t array<string>, q string")
    got = [r["r"] for r in df.select("i", Q.rewrite("q", "t").alias("r")).orderBy("i").collect()]
    assert got == [w for _, _, w in CASES]


def test_replacement_may_be_replaced_again(spark):
    df = spark.createDataFrame([(["this net"], "is it good")], "t array<string>, q string")
    assert df.select(Q.rewrite("q", "t")).first()[0] == "is this net net good"


@pytest.mark.parametrize(
    "question, topics",
    [
        ("What is the difference between SVM and the KNN?", ["svm", "knn"]),
        ("cats vs dogs", ["cats", "dogs"]),
        ("explain more", ["more"]),
        ("what is it?", None),
        ("hello", None),
        ("Tell me about  Deep   Nets!", ["deep nets"]),
    ],
)
def test_topics(spark, question, topics):
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(Q.explicit_topics("q")).first()[0] == topics


def test_state_and_history(spark):
    rows = [
        (1, 0, "system", "What is ignored?"), (1, 1, "user", "What is ml?"), (1, 2, "assistant", "What is noise?"),
        (1, 3, "user", "How does it work?"), (1, 4, "user", "Compare a and b"), (1, 5, "user", "are they fast"), (2, 1, "user", "why"),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["rewritten"] for r in C.rewritten(m).collect()}
    assert got == {(1, 1): "What is ml?", (1, 3): "How does ml work?", (1, 4): "Compare a and b", (1, 5): "are a and b fast", (2, 1): "why"}
    assert sorted(r["turn"] for r in C.recent_history(m).filter("conv_id = 1").collect()) == [2, 3, 4, 5]
    gone = spark.createDataFrame([(1,)], "conv_id long")
    assert C.cleared(m, gone).count() == 1
    docs = m.withColumn("doc", m["role"])
    assert C.by_document(docs, "doc").select("conv_id").distinct().count() == 4
    apart = spark.createDataFrame([(None, "a"), ("a", None), (None, None), ("", ""), ("a", "")], "conv_id string, doc string")
    assert C.by_document(apart, "doc").select("conv_id").distinct().count() == 5


def test_long_conversations_have_the_same_topics(spark, sf_dir, monkeypatch):
    turns = plans._turns(spark, sf_dir)
    shown = lambda: sorted((r.conv_id, r.turn, r.topics, r.rewritten) for r in C.rewritten(turns).collect())
    whole = shown()
    monkeypatch.setattr(C, "LONG_TURNS", 3)
    assert shown() == whole and any(t for _, _, t, _ in whole)


def test_kinds_of_questions(spark):
    df = spark.createDataFrame([("So, ITS speed?",), ("which is faster",), ("why?",), ("bitter",)], "q string")
    got = df.select(Q.has_pronoun("q"), Q.is_comparison("q"), Q.is_short_question("q")).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, True, False), (False, False, True), (False, False, False)]
