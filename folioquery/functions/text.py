"""Text expressions: cleaning, sentences, pieces, tokens, names and labels.

All take and return Columns and stay within JVM expressions. White space is Python's set of 29
characters, spelled out, because no engine's ``\\s`` means the same.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as one character class, for Java and RE2 alike.
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same for Java alone, which looks single letters up in a table: without the blank, and the wide ones.
_NARROW = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f"
_WIDE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE = rf"[{_NARROW}\x20[\x{{85}}-\x{{3000}}&&[{_WIDE}]]]"
#: Runs that cleaning replaces by a blank; a blank by itself is none of them.
_UNCLEAN = rf"[\x{{80}}-\x{{10ffff}}&&[^{_WIDE}]]+|(?: {_SPACE}|[{_NARROW}[\x{{85}}-\x{{3000}}&&[{_WIDE}]]]){_SPACE}*"
#: What counts as part of a word for word boundaries.
WORD = r"[\p{L}\p{N}_]"

# Limits and texts that answers and chunks depend on.
MAX_PIECE = 300
PREVIEW_CHARS = 240
ELLIPSIS = "…"
REFUSAL_TEXT = "I could not find the answer in the indexed document context."
DEFAULT_NAME = "Document"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it; keeps expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(text), rf"\A{WHITESPACE}+|{WHITESPACE}+\z", "")


def is_blank(text: Column | str) -> Column:
    return F.coalesce(~col(text).rlike(rf"[^{WHITESPACE[1:]}"), F.lit(True))


def collapse(text: Column | str) -> Column:
    return F.regexp_replace(col(text), rf"{WHITESPACE}+", " ")


def clean_text(text: Column | str) -> Column:
    """White space runs become one blank, then runs of non-ASCII characters one blank each; blanks
    that meet this way stay. One pass does both, as no run of one kind reaches into one of the other."""
    return F.btrim(F.regexp_replace(col(text), _UNCLEAN, " "))


def sentences(text: Column | str) -> Column:
    """Non-empty sentences of the cleaned text, cut after . ! or ? before blanks."""
    parts = F.transform(F.split(clean_text(text), r"(?<=[.!?]) +"), lambda s: F.btrim(s))
    return F.coalesce(F.filter(parts, lambda s: s != ""), F.array().cast("array<string>"))


def pieces_of(sentence: Column, limit: int = MAX_PIECE) -> Column:
    """Consecutive slices of at most limit characters, stripped, without blank ones."""
    cut = F.transform(F.regexp_extract_all(sentence, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0)), lambda s: F.btrim(s))
    return F.when(F.length(sentence) <= limit, F.array(sentence)).otherwise(F.filter(cut, lambda s: s != ""))


def pieces(text: Column | str, limit: int = MAX_PIECE) -> Column:
    """The pieces of all sentences of a text, in order."""
    return F.flatten(F.transform(sentences(text), lambda s: pieces_of(s, limit)))


def tokens(text: Column | str) -> Column:
    """Lower-case ASCII alphanumeric words between Unicode word boundaries."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"  # of a lower-case text, and single, so that Java looks them up
    word = rf"[{letters}_[\x{{80}}-\x{{10ffff}}&&[\p{{L}}\p{{N}}]]]"
    return F.regexp_extract_all(F.lower(col(text)), F.lit(rf"(?=[{letters}])(?<!{word})[{letters}]++(?!{word})"), F.lit(0))


def word_bytes(text: Column | str) -> Column:
    """The bytes of a text in lower case, every letter or digit beyond ASCII as one _: what tokens() finds
    in the text are then the runs of letters, digits and _ that hold no _."""
    t = col(text)
    marked = F.regexp_replace(F.lower(t), r"[\x{80}-\x{10ffff}&&[\p{L}\p{N}]]", "_")
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(marked).cast("binary")


def normalize(text: Column | str) -> Column:
    return collapse(F.lower(strip(text)))


def without_end_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"[?.!,;:]+\z", "")


def replace_word(text: Column, word: str, by: Column | str) -> Column:
    """Every case-insensitive occurrence of a word or phrase by a literal text."""
    by = F.lit(by) if isinstance(by, str) else by
    literal = F.regexp_replace(by, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, F.lit(rf"(?iu)(?<!{WORD}){word}(?!{WORD})"), literal)


def title_case(text: Column) -> Column:
    """First letter of every run of letters upper, the others lower."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def document_name(filename: Column | str) -> Column:
    """A file name as a title: no extension, no parentheses, no _ or -; all capitals become title
    case; nothing left gives the default."""
    f = col(filename)
    name = F.regexp_replace(f, r"(?s)\.[^.]*\z", "")
    name = F.regexp_replace(name, r"\([^)]*\)", "")
    name = strip(collapse(F.translate(name, "_-", "  ")))
    name = let(name, lambda n: F.when((F.upper(n) == n) & (F.lower(n) != n), title_case(n)).otherwise(n))
    return F.when(F.coalesce(f, F.lit("")) == "", F.lit(DEFAULT_NAME)).otherwise(let(name, lambda n: F.when(n == "", F.lit(DEFAULT_NAME)).otherwise(n)))


def truncate(text: Column | str, most: int = 26) -> Column:
    t = col(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most - 1)), F.lit(ELLIPSIS)))


def suggestions(filename: Column | str) -> Column:
    """Four starter questions about a document; the wording is fixed."""
    return F.array(
        F.concat(F.lit("What is the main topic of "), document_name(filename), F.lit("?")),
        F.lit("Summarize the key concepts in this document."),
        F.lit("Explain an important concept from this PDF."),
        F.lit("Compare two related topics mentioned here."),
    )


def preview(text: Column | str) -> Column:
    t = col(text)
    return F.concat(strip(F.left(t, F.lit(PREVIEW_CHARS))), F.when(F.length(t) > PREVIEW_CHARS, F.lit(ELLIPSIS)).otherwise(F.lit("")))


def normalize_refusal(answer: Column | str) -> Column:
    """An empty answer, or one that says it found nothing in the context, is the refusal text."""
    says_so = lambda a: F.lower(a).contains("could not find") & F.lower(a).contains("context")
    return let(strip(F.coalesce(col(answer), F.lit(""))), lambda a: F.when((a == "") | says_so(a), F.lit(REFUSAL_TEXT)).otherwise(a))


def signature(content: Column | str) -> Column:
    """First half of the hexadecimal SHA-256 of the bytes; the file's name plays no part."""
    return F.substring(F.sha2(col(content).cast("binary"), 256), 1, 32)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def four_places(score: Column | str) -> Column:
    """A number to four places, halves of the binary value going to the even digit, as printf() in C and
    format() in Python have it; the JVM's own formatter rounds the shortest decimal form upwards."""

    def digits(a: Column) -> Column:
        """Ten-thousands of a in [0, 1024), rounded."""
        low = F.floor(a * 10000.0).cast("long")
        half = (low * 2 + 1).cast("double") / 20000.0
        # where a is the double next to a half, integers tell on which side of the half it lies
        bits = F.when(a >= 1, F.lit(52)).when(a >= 2.0**-9, F.lit(62)).otherwise(F.lit(72))
        power = F.element_at(F.array(*[F.lit(Decimal(2**k)).cast("decimal(23,0)") for k in (52, 62, 72)]), F.when(a >= 1, 1).when(a >= 2.0**-9, 2).otherwise(3))
        scaled = (a * F.pow(F.lit(2.0), bits)).cast("long").cast("decimal(20,0)") * F.lit(20000).cast("decimal(5,0)")
        exact = (low * 2 + 1).cast("decimal(10,0)") * power
        at_half = F.when(scaled > exact, low + 1).when(scaled < exact, low).otherwise(low + low % 2)
        return F.when(a > half, low + 1).when(a < half, low).otherwise(at_half)

    def shown(x: Column) -> Column:
        sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
        text = let(digits(F.abs(x)), lambda n: F.concat(F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0")))
        return F.when(F.abs(x) < 1024, F.concat(sign, text)).when(x.isNotNull(), F.format_string("%.4f", x))

    return let(col(score).cast("double"), shown)
