"""Gate, confidence, source cards, context and answers from ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.functions import providers
from folioquery.functions import text as T

# Thresholds on the fused score of the first row after reranking.
STRONG, MODERATE, SUPPORTING, SUPPORT_ROWS, SUPPORT_NEEDED = 0.55, 0.42, 0.38, 5, 2
HIGH, MEDIUM = 0.72, 0.52
MOST_TOKENS = 160
CONFIDENCE_CLASS = {"High": "conf-high", "Medium": "conf-medium", "Low": "conf-low"}

SYSTEM_PROMPT = f"""Answer from the context alone, in a few plain sentences.
Where the context holds no answer, your whole reply is: {T.REFUSAL_TEXT}"""


def confidence_label(best: Column | str) -> Column:
    b = T.col(best)
    return F.when(b >= HIGH, F.lit("High")).when(b >= MEDIUM, F.lit("Medium")).otherwise(F.lit("Low"))


def confidence_class(label: Column | str) -> Column:
    """The style name of a label; that of Low for any other."""
    found = F.create_map(*[F.lit(x) for pair in CONFIDENCE_CLASS.items() for x in pair])
    return F.coalesce(found[T.col(label)], F.lit(CONFIDENCE_CLASS["Low"]))


def decide(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, best_score, support, label, should_answer, answered, confidence) of every question.

    label and should_answer are the two rules by themselves; a question is answered if its label
    is not Low and it should be, and confidence is Low where it is not."""
    best = F.max(F.when(F.col("rank") == 1, F.col("score")))
    support = F.count_if((F.col("rank") <= SUPPORT_ROWS) & (F.col("score") >= SUPPORTING))
    stats = results.groupBy("qid").agg(best.alias("best_score"), support.alias("support"))
    s, b = F.coalesce("support", F.lit(0).cast("long")), F.col("best_score")
    should = F.coalesce((b >= STRONG) | ((b >= MODERATE) & (s >= SUPPORT_NEEDED)), F.lit(False))
    rows = questions.select("qid").join(stats, "qid", "left").select("qid", "best_score", s.alias("support"), confidence_label(b).alias("label"), should.alias("should_answer"))
    answered = F.col("should_answer") & (F.col("label") != "Low")
    return rows.withColumn("answered", answered).withColumn("confidence", F.when(answered, F.col("label")).otherwise(F.lit("Low")))


def source_cards(results: DataFrame, debug: bool = False) -> DataFrame:
    """(qid, rank, label, page, preview) and, for debugging, the scores to four places."""
    cards = [F.col("source").alias("label"), "page", T.preview("text").alias("preview")]
    if debug:
        names = {"score": "score", "dense": "dense_score", "sparse": "sparse_score", "rerank": "rerank_score"}
        cards += [T.four_places(c).alias(name) for name, c in names.items() if c in results.columns]
    return results.select("qid", "rank", *cards)


def console_lines(results: DataFrame) -> DataFrame:
    """(qid, rank, line): results as lines for a terminal, scores to four places."""
    scores = {"score": "score", "dense": "dense_score", "sparse": "sparse_score", "rerank": "rerank_score"}
    parts = [F.concat(F.lit(f" | {name} "), T.four_places(c)) for name, c in scores.items() if c in results.columns]
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "source", F.lit(" | Page: "), F.col("page").cast("string"), *parts)
    return results.select("qid", "rank", line.alias("line"))


def build_context(results: DataFrame) -> DataFrame:
    """(qid, context): the results of a question as numbered blocks, in order of rank."""
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), "source", F.lit(" | Page: "), F.col("page").cast("string"), F.lit("\n"), "text")
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.groupBy("qid").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"))


def prompts(questions: DataFrame, contexts: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """(qid, system_prompt, user_prompt) of the questions that have a context."""
    user = F.concat(F.lit("Context:\n"), "context", F.lit("\n\nQuestion:\n"), "question", F.lit("\n\nAnswer:"))
    return questions.join(contexts, "qid").select("qid", F.lit(system_prompt).alias("system_prompt"), T.strip(user).alias("user_prompt"))


def answer(questions: DataFrame, results: DataFrame, load_generator=None, most_tokens: int = MOST_TOKENS, store=None) -> DataFrame:
    """(qid, answer, confidence) of every question. store: an AnswerStore, from which prompts that were
    asked before are answered.

    The gate is a filter before the generator, so that a question that is refused costs no call;
    a generator's own refusal leaves the confidence as it is. Without a generator the best chunk's
    closest sentence is the answer."""
    decided = decide(questions, results)
    open_ = questions.join(decided.filter("answered").select("qid"), "qid", "left_semi")
    if load_generator is None:
        top = results.filter("rank = 1").select("qid", "text")
        given = open_.join(top, "qid").select("qid", providers.extractive_answer("question", "text").alias("answer"))
    else:
        asked = prompts(open_, build_context(results.join(open_.select("qid"), "qid", "left_semi")))
        given = providers.generated_answers(asked, load_generator, most_tokens) if store is None else store.complete(asked, load_generator, most_tokens)
    said = F.when(F.col("answered"), T.normalize_refusal("answer")).otherwise(F.lit(T.REFUSAL_TEXT))
    return decided.join(given, "qid", "left").select("qid", said.alias("answer"), "confidence")
