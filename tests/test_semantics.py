"""The learned embedder against numpy, and what it finds that shared words do not."""

import random

import numpy as np
from pyspark.sql import functions as F

from folioquery.functions.providers import hashed_embedding
from folioquery.operators import retrieval as R
from folioquery.operators import semantics as S
from folioquery.plans.assistant import ask, build_index

BUCKETS = 256


def rows_of(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def dense(spark, texts, model):
    found = [r.f for r in rows_of(spark, texts).select(S.features("text", BUCKETS).alias("f")).collect()]
    a = np.zeros((len(texts), BUCKETS))
    for first, rows, columns, values in S.entries(found, model.idf):
        a[rows + first, columns] = values
    return a


def test_singular_values_are_numpys(spark, monkeypatch):
    rng = random.Random(2)
    # leading directions that stand apart
    texts = [" ".join(rng.choices([f"t{k}w{i}" for i in range(6)] + ["the"], k=20)) for k in range(8) for _ in range(30 - 3 * k)] + [None, "", "é !"]
    for entries in (20_000, 40):
        monkeypatch.setattr(S, "ENTRIES", entries)
        model = S.fit(rows_of(spark, texts).repartition(5), rank=6, buckets=BUCKETS, passes=6)
        a = dense(spark, texts, model)
        _, values, turned = np.linalg.svd(a, full_matrices=False)
        assert np.allclose(model.singular, values[:6], rtol=1e-3)
        overlap = np.abs(np.sum(model.directions.T * turned[:6], axis=1))
        assert (overlap[:4] > 0.98).all()
        got = np.array([r.v for r in rows_of(spark, texts).select(S.learned_embedding(model)("text").alias("v")).collect()])
        y = a @ model.directions
        size = np.linalg.norm(y, axis=1, keepdims=True)
        assert np.allclose(got, np.divide(y, size, out=np.zeros_like(y), where=size > 0), atol=1e-6) and not got[-3:].any()
    df = sum(1 for t in texts if t and "the" in t.split())
    assert np.isclose(model.idf[__import__("zlib").crc32(b"the") % BUCKETS], np.log((1 + 156) / (1 + df)) + 1)


def test_few_texts_and_none(spark):
    model = S.fit(rows_of(spark, ["a b", "a b", None]), rank=5, buckets=BUCKETS)
    assert np.count_nonzero(model.singular > 1e-6) == 1 and model.directions.shape == (BUCKETS, 5)
    vectors = [r.v for r in rows_of(spark, ["a", "zzz", None]).select(S.learned_embedding(model)("text").alias("v")).collect()]
    assert np.isclose(np.linalg.norm(vectors[0]), 1) and not any(vectors[1]) and not any(vectors[2])
    none = S.fit(rows_of(spark, [None, "!"]), rank=5, buckets=BUCKETS)
    assert not none.singular.any() and not none.directions.any()


def test_the_two_sentences_have_vectors_of_one_length(spark):
    texts = ["AI is transforming healthcare.", "Machine learning improves medical diagnosis."]
    model = S.fit(rows_of(spark, texts))
    vectors = [r.v for r in rows_of(spark, texts).select(S.learned_embedding(model)("text").alias("v")).collect()]
    assert len(vectors) == 2 and {len(v) for v in vectors} == {S.RANK} and not any(x is None for v in vectors for x in v)


def planted(seed=1, topics=30):
    """Texts of topics that each have two sets of words; most texts mix them, some are of one alone.
    Questions use the other set."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("bcdfglmnprst", k=2)) + "".join(rng.choices("aeiou", k=2)) + "".join(rng.choices("bdgklmnrt", k=3))
    texts, questions, right = [], [], {}
    for k in range(topics):
        a, b = [[word() for _ in range(8)] for _ in range(2)]
        texts += [" ".join(rng.choices(a, k=12) + rng.choices(b, k=12) + ["the", "of"]) for _ in range(15)]
        right[k] = set(range(len(texts), len(texts) + 5))
        texts += [" ".join(rng.choices(b, k=20) + ["the", "of"]) for _ in range(5)]
        questions.append("the " + " ".join(rng.choices(a, k=6)))
    return texts, questions, right


def test_paraphrases_without_shared_words_are_found(spark):
    texts, questions, right = planted()
    corpus = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = spark.createDataFrame(list(enumerate(questions)), "qid long, text string")

    def recall(embed):
        vectors = corpus.select("chunk_id", embed("text").alias("vector"))
        found = R.dense_search(vectors, asked.select("qid", embed("text").alias("vector")), 20).collect()
        return sum(r.chunk_id in right[r.qid] for r in found) / sum(map(len, right.values()))

    learned, hashed = recall(S.learned_embedding(S.fit(corpus, rank=40))), recall(hashed_embedding)
    assert learned > 0.9 and hashed < 0.3, (learned, hashed)


def test_the_assistant_answers_a_paraphrase(spark):
    texts, questions, _ = planted(3, 8)
    pages = spark.createDataFrame([("a.pdf", i, f"{t}. ") for i, t in enumerate(texts)], "source string, page int, text string")
    embed = S.learned_embedding(S.fit(pages, rank=16))
    messages = spark.createDataFrame([(k, 0, "user", q) for k, q in enumerate(questions)], "conv_id long, turn long, role string, text string")
    learned = ask(messages, build_index(pages, embed), embed)
    hashed = ask(messages, build_index(pages))
    opened = lambda df: df.filter(F.col("confidence") == "High").count()
    assert opened(learned) == 8 > opened(hashed)
