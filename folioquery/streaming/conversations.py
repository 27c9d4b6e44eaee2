"""Conversations over a stream of messages, in order of turn however the messages arrive.

    conversation_stream(messages, delay="10 minutes", idle="1 day")

messages: (conv_id, turn, role, text, at) and, if there is one, document; at is the time at which a message
was said, and rises with the turns of a conversation. A message is held back until the watermark, which
follows the latest time by delay, has passed it; then all that are due are taken in order of turn, so what
comes out does not depend on how messages were dealt over micro-batches. A message that comes later than
that is dropped, as every late row of a stream.

Each message leaves with the topics in force before it, the question that is searched for (rewritten, of a
user) and the last messages before it (history). A user turn that says exit or quit ends the conversation:
it and all that follows do not leave. A message of the role ``clear`` empties history and topics and does
not leave either. Another document is a conversation of its own. After idle without a message the state of
a conversation goes, that it has ended included; a message that comes still later begins anew.

State, of each conversation apart and kept by Spark's RocksDB store: held messages by turn (a map), history
(a list), topics and whether it has ended (values). Needs ``spark.sql.streaming.stateStore.providerClass``
for RocksDB, which use_rocksdb() sets.

Defined cases: a null text is empty; null ids and documents are conversations like others; of repeated turns
all are taken, in order of time, then role, null first, then text; messages without a time or turn are
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioquery.functions import text as T
from folioquery.functions import topics as Q
from folioquery.operators.conversation import EXIT_WORDS, RECENT

CLEAR = "clear"
_NULL = "\x02"  # a null id or document as a key
_MESSAGE = "turn bigint, role string, text string, at bigint, explicit array<string>, leaves boolean"
_OUT = "conv string, document string, turn bigint, role string, text string, at bigint, explicit array<string>, topics array<string>, history array<struct<role:string,text:string>>"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _order(message: tuple) -> tuple:
    turn, role, text, at, *_ = message
    return turn, at, role is not None, role or "", text


class _Conversation(StatefulProcessor):
    def __init__(self, idle_ms: int, recent: int):
        self.idle_ms, self.recent = idle_ms, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "turn bigint, n int", _MESSAGE)
        self.history = handle.getListState("history", "role string, text string")
        self.topics = handle.getValueState("topics", "topics array<string>")
        self.ended = handle.getValueState("ended", "ended boolean")
        self.last = handle.getValueState("last", "at bigint")  # time of the latest message
        self.spoken = handle.getValueState("spoken", "at bigint")  # time of the latest that was taken
        self.through = handle.getValueState("through", "at bigint")  # time up to which messages were taken

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for p in rows:
            for turn, role, text, at, explicit, leaves in zip(p.turn, p.role, p.text, p["at"], p.explicit, p.leaves):
                n = 0
                while self.held.containsKey((turn, n)):  # a repeated turn
                    n += 1
                self.held.updateValue((turn, n), (turn, role, text, at, None if explicit is None else list(explicit), leaves))
                times.add(at)
        if times:
            latest = max(times)
            if not self.last.exists() or self.last.get()[0] < latest:
                self.last.update((latest,))
                times.add(latest + self.idle_ms)
            for at in times:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.through.exists() and self.through.get()[0] >= now:
            return  # another timer of this batch was here
        self.through.update((now,))
        due = sorted(((tuple(k), tuple(v)) for k, v in self.held.iterator() if v[3] <= now), key=lambda kv: _order(kv[1]))
        for k, _ in due:
            self.held.removeKey(k)
        out = self._taken([v for _, v in due])
        if out:
            found = pd.DataFrame(out, columns=["turn", "role", "text", "at", "explicit", "topics", "history"])
            found.insert(0, "conv", [key[0]] * len(out))
            found.insert(1, "document", [key[1]] * len(out))
            yield found
        if self.last.exists() and self.last.get()[0] + self.idle_ms <= now:
            for state in (self.held, self.history, self.topics, self.ended, self.last, self.spoken, self.through):
                state.clear()

    def _taken(self, due: list) -> list[tuple]:
        """Messages as they leave, in order; the state behind them."""
        topics = list(self.topics.get()[0]) if self.topics.exists() else None
        history = [tuple(h) for h in self.history.get()] if self.history.exists() else []
        ended, spoken = self.ended.exists(), self.spoken.get()[0] if self.spoken.exists() else None
        out = []
        for turn, role, text, at, explicit, leaves in due:
            if spoken is not None and at - spoken > self.idle_ms:
                ended, topics, history = False, None, []
            spoken = at if spoken is None else max(spoken, at)
            if leaves or role == CLEAR:
                ended, topics, history = ended or leaves, None, []
            elif not ended:
                out.append((turn, role, text, at, explicit, topics, [{"role": r, "text": t} for r, t in history]))
                history = [*history, (role, text)][-self.recent :]
                topics = list(explicit) if explicit is not None else topics
        for state, value in ((self.topics, (topics,) if topics is not None else None), (self.ended, (True,) if ended else None), (self.spoken, (spoken,) if due else None)):
            if value is not None:
                state.update(value)
            elif state is not self.spoken:
                state.clear()
        if history:
            self.history.put(history)
        else:
            self.history.clear()
        return out


def _milliseconds(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def conversation_stream(messages: DataFrame, delay: str = "10 minutes", idle: str = "1 day", recent: int = RECENT) -> DataFrame:
    """conv_id, document, turn, role, text, at, topics, rewritten and history of each message, in
    order within a conversation, once the watermark has passed it."""
    kinds = [messages.schema[c].dataType if c in messages.columns else "string" for c in ("conv_id", "document")]
    named = messages if "document" in messages.columns else messages.withColumn("document", F.lit(None).cast("string"))
    user = F.col("role") == "user"
    said = named.filter(F.col("at").isNotNull() & F.col("turn").isNotNull()).withColumn("text", F.coalesce("text", F.lit("")))
    key = [F.coalesce(F.col(c).cast("string"), F.lit(_NULL)).alias(n) for c, n in (("conv_id", "conv"), ("document", "document"))]
    marked = said.withWatermark("at", delay).select(
        *key, F.col("turn").cast("long").alias("turn"), "role", "text", F.col("at").alias("time"), F.unix_millis("at").alias("at"),
        F.when(user, Q.explicit_topics("text")).alias("explicit"), F.coalesce(user & F.lower(T.strip("text")).isin(EXIT_WORDS), F.lit(False)).alias("leaves"),
    )
    out = marked.groupBy("conv", "document").transformWithStateInPandas(_Conversation(_milliseconds(idle), recent), _OUT, "append", "eventTime")
    rewritten = F.when(F.col("role") == "user", Q.rewrite("text", "topics", "explicit"))
    back = [F.when(F.col(n) != _NULL, F.col(n)).cast(kind).alias(c) for n, kind, c in zip(("conv", "document"), kinds, ("conv_id", "document"))]
    return out.select(*back, "turn", "role", "text", F.timestamp_millis("at").alias("at"), "topics", rewritten.alias("rewritten"), "history")
