import http.server
import json
import threading
import urllib.error
from collections import Counter

import numpy as np
import pytest

from folioquery.functions import text as T
from folioquery.functions.providers import chat_completions
from folioquery.functions.text import REFUSAL_TEXT
from folioquery.functions.vectors import inner_product, norm, normalized
from folioquery.operators import answering as A
from folioquery.operators import postings as P
from folioquery.operators import retrieval as R
from folioquery.plans.assistant import Index, ask, build_index
from folioquery.scratch import materialize

QUESTIONS = [(1, "the the cat"), (2, ""), (3, "zebra!"), (4, "Alpha beta")]
CHUNKS = [
    (10, "s", 1, "the cat sat"), (11, "s", 1, "the cat sat"), (12, "s", 2, "The alpha THE"), (13, "t", 1, "!!"), (14, "t", 2, "beta alpha alpha"),
]


@pytest.fixture()
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "qid long, question string")


@pytest.fixture()
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, source string, page int, text string")


def test_keyword_overlap_is_of_multisets(questions, chunks):
    got = {(r[0], r[1]): r[2] for r in R.keyword_search(questions, R.token_table(chunks, "chunk_id", "text")).collect()}
    want = {}
    for qid, q in QUESTIONS:
        q = Counter(q.lower().replace("!", "").split())
        for cid, _, _, t in CHUNKS:
            shared = sum((q & Counter(t.lower().replace("!", "").split())).values())
            if shared:
                want[qid, cid] = shared / sum(q.values())
    assert got == pytest.approx(want) and got[1, 10] == pytest.approx(2 / 3) and got[1, 12] == pytest.approx(2 / 3)


def test_dense_search_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(90, 8)), 2)
    v[5] = v[6] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, 2.0])]
    held = spark.createDataFrame(rows, "chunk_id long, vector array<double>").repartition(5)
    asked = spark.createDataFrame(rows, "qid long, vector array<double>")
    for block in (4096, 20):
        monkeypatch.setattr(R, "QUESTION_BLOCK", block)
        got = sorted((r["qid"], r["rank"], r["chunk_id"]) for r in R.dense_search(held, asked, 7).collect())
        want = []
        for q, x in enumerate(v):
            s = np.round(v @ x, 9)
            want += [(q, k + 1, c) for k, c in enumerate(sorted(range(90), key=lambda c: (-s[c], c))[:7])]
        assert got == sorted([*want, (901, 1, 901)])


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [tuple(r) for r in df.select(norm("v"), inner_product("v", "v")).collect()] == [(5.0, 25.0), (1.0, 0.0)]
    assert [np.round(r[0], 6).tolist() for r in df.select(normalized("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_fusion_defaults_and_dedup(spark, chunks):
    dense = spark.createDataFrame([(1, 10, 0.6), (1, 11, 0.6), (1, 12, -0.5)], "qid long, chunk_id long, dense_score double")
    sparse = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.5), (1, 14, 0.5)], "qid long, chunk_id long, sparse_score double")
    scored = R.fuse(dense, sparse)
    got = {r["chunk_id"]: r["score"] for r in scored.collect()}
    assert got == pytest.approx({10: 0.575, 11: 0.575, 12: -0.375, 14: 0.125})
    pool = R.best_pool(scored, chunks).orderBy("pool_rank").collect()
    assert [(r["pool_rank"], r["chunk_id"]) for r in pool] == [(1, 10), (2, 14), (3, 12)]
    assert R.dense_k(7) == 28 and R.dense_k(3) == 20


def test_pool_is_that_of_all_hits(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["the", "cat", "sat", "alpha", "beta", "gamma", "river", "sea"]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, f"s{i % 2}", i % 5, text(3) if i % 4 else "the same words the") for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, page int, text string").repartition(6)
    questions = spark.createDataFrame([(q, text(6)) for q in range(9)] + [(20, ""), (21, "nothing shared")], "qid long, question string")
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "id long, vector array<double>")
    asked, held = vectors.filter("id < 9 or id = 20").withColumnRenamed("id", "qid"), vectors.filter("id % 3 = 0").withColumnRenamed("id", "chunk_id")
    tokens = R.token_table(chunks, "chunk_id", "text")
    shown = lambda pool: sorted((r["qid"], r["pool_rank"], r["chunk_id"], round(r["score"], 9)) for r in pool.collect())
    every = shown(R.best_pool(R.fuse(R.dense_search(held, asked, R.dense_k()), R.keyword_search(questions, tokens)), chunks))
    assert len({q for q, *_ in every}) == 10
    for shard, block, questions_at_once in ((1 << 16, 128, 4096), (64, 8, 3), (50, 7, 4096), (1, 1, 4096)):
        monkeypatch.setattr(P, "QUESTION_BLOCK", questions_at_once)
        index = P.build_postings(tokens, chunks, shard=shard, block=block, buckets=5)
        assert shown(R.hybrid_pool(questions, chunks, index, asked, held)) == every


def test_blocks_are_passed_over_only_where_no_hit_can_enter(monkeypatch):
    rng = np.random.default_rng(9)
    for n, pool in ((400, 3), (400, 20), (30, 20)):
        for _ in range(40):
            tfs = rng.integers(0, 3, (12, n)) * (rng.random((12, n)) < rng.random((12, 1)) ** 3)
            keys = rng.integers(0, n // 2, n)
            asks, near = rng.integers(1, 3, 12), rng.choice(n, 4, replace=False)
            cell, counted = P._Cell(16, -(-n // 16), pool), []
            cell.take(0, {}, [(7, int(p)) for p in near])
            cell.take(1, {"places": np.arange(n), "keys": keys}, None)
            for tf, ask in zip(tfs, asks):
                at = np.flatnonzero(tf)
                if len(at):
                    blocks, first = np.unique(at // 16, return_index=True)
                    row = {"blocks": blocks, "most": np.maximum.reduceat(tf[at], first), "ends": np.append(first[1:], len(at)), "places": at, "tfs": tf[at]}
                    cell.take(2, row, [(7, int(ask))])
            count = cell._count
            monkeypatch.setattr(cell, "_count", lambda own, wanted, shared: (counted.append(int(wanted.sum())), count(own, wanted, shared)))
            got = {place: shared for _, place, shared in cell.hits()}
            shared = np.minimum(tfs, asks[:, None]).sum(0)
            best, seen = [], set()
            for place in sorted(set(range(n)) - set(near.tolist()), key=lambda p: (-shared[p], p)):
                if shared[place] and keys[place] not in seen and len(best) < pool:
                    seen.add(keys[place])
                    best.append(place)
            assert got == {int(p): int(shared[p]) for p in {*best, *near.tolist()} if shared[p]}
            assert sum(counted) <= -(-n // 16)


def bytes_read(spark, work):
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: store.executorSummary("driver").totalInputBytes()
    before = total()
    out = work()
    return total() - before, out


def test_a_search_reads_the_buckets_of_its_tokens(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, "s", i, " ".join(["the", *rng.choice(words, 60)]) if i % 50 else None) for i in range(3000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, page int, text string")
    built = P.build_postings(R.token_table(chunks, "chunk_id", "text"), chunks, f"{tmp_path}/postings", buckets=64)
    index = P.open_postings(spark, f"{tmp_path}/postings")
    assert (index.shard, index.block, index.buckets) == (built.shard, built.block, built.buckets)
    none = spark.createDataFrame([], "qid long, chunk_id long")

    def searched(texts):
        asked = materialize(R._asked(spark.createDataFrame(list(enumerate(texts)), "qid long, question string")), "asked")
        return lambda: P.best_hits(index, asked, none, 20).count()

    whole, _ = bytes_read(spark, lambda: index.rows.select(*index.rows.columns).foreach(lambda r: None))
    few, found = bytes_read(spark, searched(["w1 w2", None, "", "?"]))
    assert found == 20 and few < whole / 5
    forty, found = bytes_read(spark, searched([f"w{3 * i % 10} and w{i % 4}" for i in range(40)]))
    assert found >= 40 * 20 and forty < whole / 2
    stop, found = bytes_read(spark, searched(["the the the"]))
    assert found == 20 and stop < whole / 5
    assert P.rows_of(index, spark.createDataFrame([], "token string")).count() == 0


def test_an_index_is_written_and_read(spark, tmp_path):
    pages = spark.createDataFrame([("a.pdf", 1, "Snow falls in winter. " * 20), ("a.pdf", 2, None), ("b.pdf", 1, "Rivers carry water. " * 20)], "source string, page int, text string")
    kept = build_index(pages).write(f"{tmp_path}/index").write(f"{tmp_path}/copy")
    read = Index.read(spark, f"{tmp_path}/copy")
    messages = spark.createDataFrame([(1, 0, "user", "When does snow fall?")], "conv_id long, turn long, role string, text string")
    first = [r.answer for r in ask(messages, kept).collect()]
    assert first == [r.answer for r in ask(messages, read).collect()] and len(first) == 1


def test_tokens_counted_by_row_are_those_of_the_table(spark):
    rows = spark.createDataFrame([(1, "a b a É caf\u00e9x _b b_c 12"), (2, None), (3, ""), (4, "B b ab1 \u212a")], "chunk_id long, text string")
    own = R.row_tokens(rows, "chunk_id", "text")
    assert sorted(own.collect()) == sorted(R.token_table(rows, "chunk_id", "text").collect())
    assert own.schema["chunk_id"].dataType == rows.schema["chunk_id"].dataType
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()


def test_tokens_that_no_question_has_are_not_shuffled(spark, chunks):
    tokens = R.token_table(chunks, "chunk_id", "text")
    word = tokens.agg({"token": "min"}).first()[0]
    questions = spark.createDataFrame([(1, f"nowhere {word}"), (2, None)], "qid long, question string")
    kept = R.only_asked(tokens, questions)
    assert sorted(kept.collect()) == sorted(r for r in tokens.collect() if r["token"] == word)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [chunk_id") < plan.index("Join LeftSemi")  # a plan is printed from its end


def test_no_pair_of_the_keyword_search_is_shuffled(spark, questions, chunks):
    found = R.keyword_search(questions, R.token_table(chunks, "chunk_id", "text"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan


def test_rerank_keeps_order_of_ties(spark, questions, chunks):
    scored = spark.createDataFrame([(1, c, 0.5, 0.0, 0.0) for c in (10, 12, 13, 14)], "qid long, chunk_id long, score double, dense_score double, sparse_score double")
    got = R.rerank(R.best_pool(scored, chunks), questions, top_k=3).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["rerank_score"], 6)) for r in got] == [(10, 0.65), (12, 0.575), (13, 0.5)]


@pytest.mark.parametrize(
    "scores, label, should, confidence",
    [
        ([], "Low", False, "Low"), ([0.72], "High", True, "High"), ([0.55], "Medium", True, "Medium"), ([0.54, 0.30], "Medium", False, "Low"),
        ([0.54, 0.38], "Medium", True, "Medium"), ([0.51, 0.90, 0.90], "Low", True, "Low"), ([0.45, 0.45], "Low", True, "Low"),
        ([0.54, 0, 0, 0, 0, 0.50], "Medium", False, "Low"),
    ],
)
def test_gate(spark, scores, label, should, confidence):
    q = spark.createDataFrame([(1,)], "qid long")
    r = spark.createDataFrame([(1, k + 1, float(s)) for k, s in enumerate(scores)], "qid long, rank int, score double")
    got = A.decide(q, r).first()
    assert (got["label"], got["should_answer"], got["confidence"]) == (label, should, confidence)


def test_answers_call_the_model_only_when_open(spark, questions):
    rows = [(1, 1, "The cat sat. A dog ran.", 0.9), (1, 2, "More cats.", 0.5), (3, 1, "Nothing", 0.1), (4, 1, "Alpha beta", 0.8)]
    results = spark.createDataFrame([(q, k, k, "s", 1, t, s, s, 0.0, s) for q, k, t, s in rows], "qid long, rank int, chunk_id long, source string, page int, text string, score double, dense_score double, sparse_score double, rerank_score double")
    got = {r["qid"]: (r["answer"], r["confidence"]) for r in A.answer(questions, results).collect()}
    assert got[1] == ("The cat sat.", "High") and got[2] == got[3] == (REFUSAL_TEXT, "Low")
    calls = spark.sparkContext.accumulator(0)

    def load():
        def generate(system, user, most):
            calls.add(1)
            assert user.startswith("Context:\n[Source 1] s | Page: 1\n") and REFUSAL_TEXT in system and most == 160
            return "could not find this in the context" if "Alpha" in user else " yes "

        return generate

    got = {r["qid"]: (r["answer"], r["confidence"]) for r in A.answer(questions, results, load).collect()}
    assert got == {1: ("yes", "High"), 2: (REFUSAL_TEXT, "Low"), 3: (REFUSAL_TEXT, "Low"), 4: (REFUSAL_TEXT, "High")} and calls.value == 2
    cards = A.source_cards(results, debug=True).orderBy("qid", "rank").first()
    assert (cards["label"], cards["preview"], cards["score"], cards["rerank"]) == ("s", "The cat sat. A dog ran.", "0.9000", "0.9000")


def test_answers_of_a_chat_service(monkeypatch):
    asked, codes = [], [503, 200, 401]

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            code = codes[len(asked) - 1]
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "Snow."}}]}).encode() if code == 200 else b"")

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("A_KEY", "abc")
    generate = chat_completions(f"http://127.0.0.1:{server.server_port}/chat", "some-model", "A_KEY")()
    assert generate("s", "u", 7) == "Snow."
    with pytest.raises(urllib.error.HTTPError):
        generate("s", "u", 7)
    server.shutdown()
    assert len(asked) == 3 and asked[1][0] == "Bearer abc"
    assert asked[1][1] == {"model": "some-model", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}], "temperature": 0.0, "max_tokens": 7}


def test_confidence_class(spark):
    df = spark.createDataFrame([("High",), ("other",), (None,)], "l string")
    assert [r[0] for r in df.select(A.confidence_class("l")).collect()] == ["conf-high", "conf-low", "conf-low"]


def test_words_of_bytes_are_the_tokens(spark):
    texts = ["a b a É caféx _b b_c 12", None, "", "B b ab1 K", "end", "start", "xİy z", "é", "a b c \U0001d7d9 d\U0001d7d9", "_", "tab\tNEW\nline-1", "ΣΣ s"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = rows.select("i", T.word_bytes("text").alias("w"), T.tokens("text").alias("t")).toArrow()
    for table in (got, got.slice(2, 7)):
        owner, words = P.word_runs(table["w"].combine_chunks())
        found = [[] for _ in range(len(table))]
        for i, word in zip(owner.tolist(), words.to_pylist()):
            if "_" not in word:
                found[i].append(word)
        assert found == [t or [] for t in table["t"].to_pylist()]
    assert [len(x) for x in P.word_runs(got["w"].combine_chunks().slice(0, 0))] == [0, 0]


def test_a_scan_finds_the_pool_of_all_hits_and_shuffles_no_token(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["the", "cat", "sat", "alpha", "beta", "gamma", "river", "sea"]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, f"s{i % 2}", i % 5, text(5) if i % 4 else "the same words the" if i % 8 else None) for i in range(400)]
    chunks = spark.createDataFrame([*rows, (None, "s0", 1, "the cat")], "chunk_id long, source string, page int, text string").repartition(6)
    questions = spark.createDataFrame([(q, text(6)) for q in range(9)] + [(20, ""), (21, "nothing shared"), (22, None)], "qid long, question string")
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "id long, vector array<double>")
    asked, held = vectors.filter("id < 9 or id = 20").withColumnRenamed("id", "qid"), vectors.filter("id % 3 = 0").withColumnRenamed("id", "chunk_id")
    shown = lambda pool: sorted((r["qid"], r["pool_rank"], r["chunk_id"], round(r["score"], 9)) for r in pool.collect())
    tokens = R.token_table(chunks.filter("chunk_id IS NOT NULL"), "chunk_id", "text")
    every = shown(R.best_pool(R.fuse(R.dense_search(held, asked, R.dense_k()), R.keyword_search(questions, tokens)), chunks))
    built = []
    monkeypatch.setattr(R, "build_postings", lambda *a: built.append(1) or P.build_postings(*a))
    for at_once, pairs in ((1 << 16, 1 << 21), (7, 1 << 21), (1 << 16, 20)):
        monkeypatch.setattr(P, "SCAN_ROWS", at_once)
        monkeypatch.setattr(P, "SCAN_PAIRS", pairs)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        try:
            assert shown(R.hybrid_pool(questions, chunks, None, asked, held)) == every
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not built
    near = materialize(R.dense_search(held, asked, 3).select("qid", "chunk_id"), "near")
    plan = P.scan_hits(chunks, materialize(R._asked(questions), "asked"), near, 20)._jdf.queryExecution().executedPlan().toString()
    assert "token" not in plan and "Generate" not in plan
    monkeypatch.setattr(R, "SCAN_BYTES", 0)
    assert shown(R.hybrid_pool(questions, chunks.filter("chunk_id IS NOT NULL"), None, asked, held)) == every and built


def test_texts_are_not_shuffled_for_a_small_pool(spark, chunks):
    scored = spark.createDataFrame([(1, 10, 0.6), (1, 11, 0.6), (2, 14, 0.1)], "qid long, chunk_id long, score double")
    kept = materialize(chunks, "chunks")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pool = R.best_pool(scored, kept)
        rows = sorted((r["qid"], r["pool_rank"], r["chunk_id"], r["text"]) for r in pool.collect())
        plan = pool._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == [(1, 1, 10, "the cat sat"), (2, 1, 14, "beta alpha alpha")]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
