"""Topics in force, kept per conversation over a stream of messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.functions import topics as Q


def topic_stream(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with topics and the rewritten question, as a stream.

    The state of a conversation is its latest explicit topics. Turns of one micro-batch are taken in
    order of turn; a turn that comes in a later batch than a later turn sees that one's topics.
    """
    named = messages.withColumn("explicit", F.when(F.col("role") == "user", Q.explicit_topics("text")))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        topics = list(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        before = []
        for explicit in rows.explicit:
            before.append(topics)
            if explicit is not None:
                topics = list(explicit)
        if topics is not None:
            state.update((topics,))
        yield rows.assign(topics=before)[["conv_id", "turn", "role", "text", "explicit", "topics"]]

    out = "conv_id long, turn long, role string, text string, explicit array<string>, topics array<string>"
    kept = named.groupBy("conv_id").applyInPandasWithState(step, out, "topics array<string>", "append", "NoTimeout")
    return kept.withColumn("rewritten", F.when(F.col("role") == "user", Q.rewrite("text", "topics", "explicit")))
