"""Topics of questions and the rewriting of follow-up questions, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioquery.functions.text import WORD, col, collapse, let, normalize, replace_word, strip, without_end_marks

# Word lists and patterns, tried in this order.
PRONOUNS = ["it", "this", "that", "they", "them", "its", "their", "these", "those", "former", "latter"]
TOPIC_OPENINGS = [
    "what is", "what are", "who is", "who are", "define", "explain", "types of", "applications of",
    "advantages of", "disadvantages of", "tell me about", "give me",
]
COMPARE_OPENINGS = [
    "compare", "difference between", "what is the difference between", "what's the difference between",
    "tell me the difference between",
]
SHORT_QUESTIONS = [
    "why", "how", "how so", "explain", "explain more", "advantages", "disadvantages", "applications",
    "uses", "limitations", "example", "examples",
]
COMPARISON_HINTS = [
    "which one", "which of them", "which is better", "which one is better", "which is best",
    "which works better", "which performs better", "which is faster", "which is more suitable",
    "these two", "among them", "between them", "former", "latter",
]
CHOICE_HINTS = [
    "which one", "which of them", "which works better", "which is better", "which is best",
    "which is used", "among them", "between them", "these two",
]
BARE_FOLLOW_UPS = [
    "explain more", "explain", "why", "how", "advantages", "what are advantages",
    "what are the advantages", "disadvantages", "what are disadvantages",
    "what are the disadvantages", "applications", "uses", "limitations", "examples", "give examples",
]
PLAIN_PRONOUNS = ["it", "this", "that", "they", "them"]
POSSESSIVES = ["its", "their"]
LATE_PRONOUNS = ["these", "those"]


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"\A[ ?.!,;:]+|[ ?.!,;:]+\z", "")


def has_pronoun(question: Column | str) -> Column:
    words = F.regexp_extract_all(normalize(question), F.lit(f"{WORD}+"), F.lit(0))
    return F.arrays_overlap(words, F.array(*[F.lit(p) for p in PRONOUNS]))


def is_short_question(question: Column | str) -> Column:
    """A bare follow-up; marks around it do not matter."""
    return F.regexp_replace(normalize(question), r"\A[?.!,;:]+|[?.!,;:]+\z", "").isin(SHORT_QUESTIONS)


def _mentions(text: Column, hints: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(h) for h in hints])


def is_comparison(question: Column | str) -> Column:
    return _mentions(normalize(question), COMPARISON_HINTS)


def single_topic(question: Column | str) -> Column:
    """What the first opening that fits asks about; null without one or if it is but a pronoun."""

    def asked(q: Column, opening: str) -> Column:
        topic = _bare(F.regexp_extract(q, rf"\A{opening} +(.+)\z", 1))
        return let(topic, lambda t: F.when((t != "") & ~t.isin(PRONOUNS), t))

    return let(without_end_marks(normalize(question)), lambda q: F.coalesce(*[asked(q, o) for o in TOPIC_OPENINGS]))


def comparison_topics(question: Column | str) -> Column:
    """The two things that are compared, or null."""
    patterns = [rf"\A{o} +(.+?) +(?:and|vs|versus) +(.+)\z" for o in COMPARE_OPENINGS]
    patterns.append(r"\A(.+?) +(?:vs|versus) +(.+)\z")

    def side(q: Column, pattern: str, group: int) -> Column:
        return F.btrim(F.regexp_replace(_bare(F.regexp_extract(q, pattern, group)), r"\Athe +", ""))

    def both(q: Column, pattern: str) -> Column:
        return let(F.array(side(q, pattern, 1), side(q, pattern, 2)), lambda t: F.when(~F.array_contains(t, ""), t))

    return let(without_end_marks(normalize(question)), lambda q: F.coalesce(*[both(q, p) for p in patterns]))


def explicit_topics(question: Column | str) -> Column:
    """One or two topics that a question names, a comparison before a single topic; else null."""
    one = let(single_topic(question), lambda t: F.when(t.isNotNull(), F.array(t)))
    return F.coalesce(comparison_topics(question), one)


def rewrite(question: Column | str, topics: Column | str, explicit: Column | str | None = None) -> Column:
    """The question with what it leaves open filled in from the topics (null or an array of up to
    two). explicit: explicit_topics(question), if it is at hand."""
    t = col(topics)
    named = explicit_topics(question) if explicit is None else col(explicit)
    two = F.size(t) >= 2
    first, second = F.get(t, F.lit(0)), F.get(t, F.lit(1))
    every = F.when(two, F.concat(first, F.lit(" and "), second)).otherwise(first)

    def filled(cur: Column, by: Column) -> Column:
        for word in PLAIN_PRONOUNS:
            cur = replace_word(cur, word, by)
        for word in POSSESSIVES:
            cur = replace_word(cur, word, F.concat(by, F.lit("'s")))
        for word in LATE_PRONOUNS:
            cur = replace_word(cur, word, by)
        return strip(collapse(cur))

    def followed(cur: Column, low: Column) -> Column:
        """A question that names no topics, under those in force."""
        by_place = replace_word(replace_word(cur, "former", first), "latter", second)
        asked = without_end_marks(cur)
        choice = replace_word(replace_word(asked, "which one", "which"), "which of them", "which")
        choice = F.concat(choice, F.lit(": "), first, F.lit(" or "), second, F.lit("?"))
        rest = (
            F.when(two & _mentions(low, CHOICE_HINTS), choice)
            .when(low.isin(BARE_FOLLOW_UPS), F.concat(asked, F.lit(" of "), every))
            .when(has_pronoun(cur), let(every, lambda by: filled(cur, by)))
            .otherwise(cur)
        )
        return F.when(two, let(by_place, lambda p: F.when(p != cur, p).otherwise(rest))).otherwise(rest)

    def answer(cur: Column) -> Column:
        plain = (cur == "") | named.isNotNull() | t.isNull() | (F.size(t) == 0)
        return F.when(plain, cur).otherwise(let(normalize(cur), lambda low: followed(cur, low)))

    return let(strip(question), answer)
