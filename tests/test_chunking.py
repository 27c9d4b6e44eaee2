import random
import time

from pyspark.sql import functions as F

from folioquery.operators import chunking as C


def fold(pieces, size=700, overlap=120, least=80):
    """The chunks of one page's pieces, piece by piece."""
    out, cur = [], ""
    for p in pieces:
        if (len(cur) + 1 if cur else 0) + len(p) + 1 <= size:
            cur = f"{cur} {p}" if cur else p
        else:
            if len(cur) >= least:
                out.append(cur)
            tail = cur[-overlap:].strip() if overlap > 0 else ""
            cur = f"{tail} {p}" if tail else p
    return out + ([cur] if cur and len(cur) >= least else [])


def pages(spark, texts):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source string, page int, text string")


def test_fold_matches_piece_by_piece(spark):
    rng = random.Random(5)
    texts, want = [], []
    for _ in range(30):
        sentences = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 40))) + "." for _ in range(rng.randint(0, 20))]
        texts.append(" ".join(sentences))
        pieces = [s[k : k + 300].strip() for s in sentences for k in range(0, len(s), 300)]
        want.append(pieces)
    for size, overlap, least in ((700, 120, 80), (200, 0, 0), (250, 50, 10)):
        got = pages(spark, texts).select("page", C.chunk_texts("text", size, overlap, least).alias("c")).orderBy("page").collect()
        assert [r["c"] for r in got] == [fold([p for p in w if p], size, overlap, least) for w in want]


def test_lengths_and_short_pages(spark):
    got = C.chunk_pages(pages(spark, ["x" * 79, "x" * 80, "", None, "a b. " * 900]))
    assert {r["page"] for r in got.collect()} == {1, 4}
    low, high = got.agg(F.min(F.length("text")), F.max(F.length("text"))).first()
    assert low >= 80 and high <= 699


def test_numbers_have_no_gaps(spark):
    docs = spark.createDataFrame([(s, p, "y" * 90 + ". " + "z" * 290 + ". " + "q" * 290 + ". " + "r" * 290) for s in "ba" for p in (3, 1, 20_001, 3)], "source string, page int, text string")
    docs = docs.unionByName(pages(spark, ["short", None, ""]))
    rows = C.numbered_chunks(docs).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) > 8
    places = [(r["source"], r["page"]) for r in rows]
    assert places == sorted(places) and {r["chunk_seq"] for r in rows} >= {1, 2}
    plain = sorted((r["source"], r["page"], r["chunk_seq"], r["text"]) for r in C.chunk_pages(docs).collect())
    assert plain == sorted((r["source"], r["page"], r["chunk_seq"], r["text"]) for r in rows)
    assert C.numbered_chunks(docs.limit(0)).count() == 0


def test_pages_are_read_and_folded_once(spark, tmp_path, monkeypatch):
    docs = pages(spark, ["Some words here. " * 30] * 50)
    docs.write.parquet(str(tmp_path / "pages"))
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        reads.add(1)
        return text

    read = spark.read.parquet(str(tmp_path / "pages")).withColumn("text", seen("text"))
    assert C.numbered_chunks(read).count() == 50 and reads.value == 50


def test_windows(spark):
    text = "".join(chr(97 + i % 26) for i in range(1030))
    got = pages(spark, [text, "short", ""]).select("page", C.window_texts("text").alias("c")).orderBy("page").collect()
    assert [r["c"] for r in got] == [[text[0:500], text[400:900], text[800:1300]], [], []]


def test_windows_of_a_huge_page_take_one_pass(spark):
    text = "".join(f"w{i} " for i in range(200_000)).strip()
    start = time.time()
    ((cut,),) = pages(spark, [text]).select(C.window_texts("text")).collect()
    assert time.time() - start < 20
    want = [text[i : i + 500] for i in range(0, len(text), 400)]
    assert cut == [w for w in want if len(w.strip(" ")) >= 50]


def test_blocks_of_pieces_give_the_chunks_of_the_fold(spark, monkeypatch):
    rng = random.Random(4)
    page = lambda n: "".join(rng.choice(["word ", "a", ". ", "? ", "é", "  ", "\n", "longer words here ", "x" * 310]) for _ in range(n))
    rows = [(i, page(rng.choice([0, 1, 30, 300, 900]))) for i in range(60)] + [(60, None), (61, " . ")]
    df = spark.createDataFrame(rows, "page int, text string")
    for size, overlap, least in ((700, 120, 80), (400, 0, 1), (350, 200, 0), (20, 15, 3)):
        found = []
        for block in (1 << 20, 1, 7):
            monkeypatch.setattr(C, "FOLD_BLOCK", block)
            found.append(sorted((r.page, r.c or []) for r in df.select("page", C.chunk_texts("text", size, overlap, least).alias("c")).collect()))
        assert found[0] == found[1] == found[2] and sum(len(c) for _, c in found[0]) > 100


def test_one_huge_page_takes_time_like_many_small_ones(spark):
    sentence = "Rivers carry water to the sea and back again. "
    small = spark.range(1000).select(F.lit("s").alias("source"), F.col("id").cast("int").alias("page"), F.lit(sentence * 55).alias("text"))
    huge = lambda text, n: spark.createDataFrame([("s", 1)], "source string, page int").withColumn("text", F.repeat(F.lit(text), n))

    def seconds(pages):
        began = time.time()
        size = C.chunk_pages(pages).agg(F.sum(F.length("text"))).first()[0]
        return (time.time() - began) / size

    seconds(small)
    usual = seconds(small.coalesce(1))
    for text in (sentence, sentence.replace(".", ",")):  # many sentences, and one
        assert (took := seconds(huge(text, 220_000))) < 10 * usual, (usual, took)
