import random

from pyspark.sql import functions as F

from folioquery.functions import text as T

WHITE = [chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def apply(spark, values, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", fn("v").alias("r"))
    return [r["r"] for r in df.orderBy("i").collect()]


def test_white_space_is_pythons(spark):
    assert len(WHITE) == 29
    assert apply(spark, [f"a{w}b" for w in WHITE], T.collapse) == ["a b"] * 29
    assert apply(spark, [f"{w}a b{w}{w}" for w in WHITE], T.strip) == ["a b"] * 29


def test_clean_text_keeps_blanks_around_removed_characters(spark):
    assert apply(spark, ["  a \n\n b", "élan vital", "a é b", "漢字", ""], T.clean_text) == ["a b", "lan vital", "a   b", "", ""]


def test_sentences_and_pieces(spark):
    assert apply(spark, ["One. Two!  Three? four", "", "v1.2 is out"], T.sentences) == [["One.", "Two!", "Three?", "four"], [], ["v1.2 is out"]]
    sizes = [[len(p) for p in r] for r in apply(spark, ["x" * n for n in (299, 300, 301, 950)], T.pieces)]
    assert sizes == [[299], [300], [300, 1], [300, 300, 300, 50]]


def test_tokens_need_unicode_boundaries(spark):
    found = apply(spark, ["élan vital", "foo_bar baz", "a²b c2", "It's A-1"], T.tokens)
    assert found == [["vital"], ["baz"], ["c2"], ["it", "s", "a", "1"]]


def test_document_names(spark):
    names = ["MY_PAPER-(v2).pdf", ".pdf", "a.b.pdf", "", None, "3D MODEL AI'S X-RAY.pdf"]
    assert apply(spark, names, T.document_name) == ["My Paper", "Document", "a.b", "Document", "Document", "3D Model Ai'S X Ray"]
    assert apply(spark, ["short", "x" * 30], lambda c: T.truncate(c, 22)) == ["short", "x" * 21 + "…"]


def test_refusals(spark):
    said = ["", "  ", T.REFUSAL_TEXT, "Sorry, I Could Not Find it in the CONTEXT", "could not find it", " yes ", None]
    assert apply(spark, said, T.normalize_refusal) == [T.REFUSAL_TEXT] * 4 + ["could not find it", "yes", T.REFUSAL_TEXT]


def test_signature_and_preview(spark):
    import hashlib

    assert apply(spark, ["abc"], T.signature) == [hashlib.sha256(b"abc").hexdigest()[:32]]
    assert apply(spark, ["x" * 241, " y "], T.preview) == ["x" * 240 + "…", "y"]
    assert apply(spark, [0.5], T.four_places, "double") == ["0.5000"]


def test_four_places_are_those_of_the_language(spark):
    rng = random.Random(5)
    values = [k / n for n in (32, 160, 2000, 20000, 10000, 3) for k in range(0, 4 * n, max(1, n // 150))] + [rng.uniform(-3, 3) for _ in range(500)]
    values += [(2 * rng.randint(0, 30000) + 1) / 20000 for _ in range(2000)] + [0.0, -0.0, -1e-9, 0.00005, 0.000049999, 1e-300, 999.99995, 1023.99995, -0.03125]
    values += [v * (1 + e) for v in values[:400] for e in (2**-52, -(2**-52))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(T.four_places("v")).collect()] == [f"{v:.4f}" for v in values]
    assert spark.createDataFrame([(None,)], "v double").select(T.four_places("v")).first()[0] is None


def test_cleaning_in_one_pass_is_that_of_two(spark):
    rng = random.Random(7)
    letters = ["a", ".", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x7f", "\x84", "\x85", "\xa0", "é", "\u1680", "\u180e", "\u2000", "\u200a", "\u200b", "\u2028", "\u202f", "\u205f", "\u3000", "\u3001", "😀"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, ""]
    two = F.btrim(F.regexp_replace(T.collapse("t"), r"[^\x00-\x7F]+", " "))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean_text("t").alias("one"), two.alias("two")).collect()
    assert [r for r in rows if r["one"] != r["two"]] == []
