"""The four pluggable models: page parser, embedder, reranker, answer generator.

Each has a deterministic default that runs offline. A provider is always an explicit argument; none
is replaced silently.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.functions import text as T

#: bytes of a file -> (physical page number, text), pages in order.
PageParser = Callable[[bytes], Iterable[tuple[int, str]]]
#: texts -> one vector for each.
EncodeBatch = Callable[[list[str]], Iterable]
#: (question, text) pairs -> one score for each.
ScoreBatch = Callable[[list[tuple[str, str]]], Iterable[float]]
#: (system prompt, user prompt, most tokens) -> answer.
Generate = Callable[[str, str, int], str]


def plain_text_pages(content: bytes) -> Iterator[tuple[int, str]]:
    """Pages of a plain text file, parted by form feeds."""
    return enumerate(content.decode("utf-8", "replace").split("\f"), start=1)


def hashed_embedding(text: Column | str, dim: int = 64) -> Column:
    """Counts of a text's tokens by hash bucket, normalised: an embedding without a model."""
    from folioquery.functions.vectors import normalized

    @F.arrow_udf("array<double>")
    def counts(tokens: pa.Array) -> pa.Array:
        words = tokens.flatten().dictionary_encode()
        digests = (hashlib.md5(w.encode()).hexdigest() for w in words.dictionary.to_pylist())
        bucket = np.array([int(d[:8], 16) % dim for d in digests], np.int64)[words.indices.to_numpy(zero_copy_only=False)]
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        found = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * dim + bucket, minlength=len(sizes) * dim).astype(np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dim), pa.array(found), mask=tokens.is_null())

    # a text that is not there has a vector without values
    return T.let(F.coalesce(counts(T.tokens(text)), F.array_repeat(F.lit(None).cast("double"), dim)), normalized)


def model_embedding(load: Callable[[], EncodeBatch]):
    """A column function from a model that load() opens once in each worker."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(texts.fillna("").tolist())])

    return encode


def lexical_boost(question: Column | str, text: Column | str, base: Column | str) -> Column:
    """base + 0.15 times the share of the question's distinct tokens that the text has."""
    q, c = F.array_distinct(T.tokens(question)), F.array_distinct(T.tokens(text))
    share = F.size(F.array_intersect(q, c)) / F.size(q)
    return F.when((F.size(q) == 0) | (F.size(c) == 0), T.col(base)).otherwise(T.col(base) + 0.15 * share)


def model_scores(load: Callable[[], ScoreBatch]):
    """A reranker (question, text, base) -> score from a model that load() opens once in a worker."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, texts in batches:
            yield pd.Series([float(s) for s in model(list(zip(questions, texts)))])

    return lambda question, text, base: score(T.col(question), T.col(text))


def extractive_answer(question: Column | str, top_text: Column | str) -> Column:
    """The sentence of the best chunk that shares most tokens with the question; the earliest of
    equals."""
    q = F.array_distinct(T.tokens(question))
    scored = F.transform(
        T.sentences(top_text),
        lambda s, i: F.struct((-F.size(F.array_intersect(q, F.array_distinct(T.tokens(s))))).alias("minus"), i.alias("i"), s.alias("s")),
    )
    return F.get(F.array_sort(scored), F.lit(0))["s"]


def chat_completions(url: str, model: str, key_variable: str | None = None, timeout: float = 60, tries: int = 3) -> Callable[[], Generate]:
    """A load() for generated_answers(): a service that takes chat requests as JSON over HTTP.

    Requests ask for temperature 0. key_variable: the environment variable on the workers that holds
    the key. An overloaded or failing service is asked again, tries times in all; other errors and
    the last failure end the task."""

    def load() -> Generate:
        headers = {"Content-Type": "application/json"}
        if key_variable:
            headers["Authorization"] = f"Bearer {os.environ[key_variable]}"

        def generate(system: str, user: str, most_tokens: int) -> str:
            said = [{"role": "system", "content": system}, {"role": "user", "content": user}]
            body = json.dumps({"model": model, "messages": said, "temperature": 0.0, "max_tokens": most_tokens}).encode()
            for left in range(tries - 1, -1, -1):
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as reply:
                        return json.load(reply)["choices"][0]["message"]["content"] or ""
                except urllib.error.HTTPError as e:
                    if not left or (e.code != 429 and e.code < 500):
                        raise
                    time.sleep(2.0 ** (tries - 1 - left))
            raise ValueError("tries must be positive")

        return generate

    return load


def generated_answers(prompts: DataFrame, load: Callable[[], Generate], most_tokens: int) -> DataFrame:
    """qid and answer for each row (qid, system_prompt, user_prompt) by a model opened in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = load()
        for p in batches:
            answers = [generate(s, u, most_tokens) for s, u in zip(p.system_prompt, p.user_prompt)]
            yield pd.DataFrame({"qid": p.qid, "answer": answers})

    return prompts.select("qid", "system_prompt", "user_prompt").mapInPandas(run, "qid long, answer string")
