"""Mixing, outliers, top-k search, the Jaccard join, the pipeline and the registered queries."""

import collections
import hashlib
import itertools
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from folioquery.llm import bpe, langid, mixing, outliers, registry, secrets, topk
from folioquery.llm import jaccard_join as J
from folioquery.llm.common import Workspace, id_fold
from folioquery.llm.components import connected_components
from folioquery.llm.licenses import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_registry_has_every_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert "pipeline" in entry.queries() and set(registry.queries()) <= set(entry.queries())


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(registry.oracle_sql()[name])
    at = [c[0] for c in found.description]
    assert sorted(at) == sorted(df.columns)
    assert in_order(map(tuple, df.select(*at).collect())) == in_order(found.fetchall())


def test_shingles_of_long_texts_come_in_portions():
    rng = random.Random(6)
    for k in range(300):
        text = "".join(rng.choices(["a", "B", "é", " ", "\n", "x1", "-", "漢", "word "], k=rng.choice([0, 1, 5, 40, 400])))
        (whole,) = J.shingle_sets([text])
        for most in (1, 7, 100):
            assert J.shingle_sets(["q w e r t y", text, None], most=most)[1].tolist() == whole.tolist()
    assert [len(x) for x in J.shingle_sets(["a " * 900 + "b c", "", "a b c d"], most=50)] == [3, 0, 1]


# mixing


def target_by_rounds(sizes, weights=(3, 1, 2)):
    """Targets by handing out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(2 * sizes[s] for s in full)
        share = {s: rest * w[s] / sum(w[t] for t in free) for s in free} if free else {}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else share[s] for s in order}
        full |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice(["a"] * 8 + ["b", "c", "", None, "zz"]), 0) for i in range(4000)]
    rows += [(None, "x y", "en", "only", 0), (7, None, "en", "empty", 0), (8, " \t\n", "en", "empty", 0), (9, "é\x0bz ", "en", "only", 0)]
    docs = frame(spark, rows).withColumn("target", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for i, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = target_by_rounds(sizes)
    by_size = collections.defaultdict(set)
    for r in got:
        by_size[r["source_size"]].add(round(r["target"], 6))
        taken[r["source_size"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for s, n in sizes.items():
        assert round(want[s], 6) in by_size[n]
        if list(sizes.values()).count(n) == 1:
            assert abs(taken[n] - want[s]) <= 60
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.apply(docs)
    assert mixed.columns == docs.columns
    words = sum(r["n"] for r in mixed.select(mixing.n_words("text").alias("n")).collect())
    assert words == sum(taken.values()) and mixed.filter("source = 'empty'").count() == 2
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.apply(docs.limit(0)).count() == 0


def test_mix_leaves_other_columns_and_splits_hot_ids(spark):
    names = ["mix_key", "mix_whole", "mix_threshold", "mix_times", "mix_copy", "source_key", "size", "draw", "whole", "threshold", "range_no", "_key", "a.b"]
    rows = [(None if i % 3 else i, f"w{i} b c", "en", "s" if i % 2 else "t", 0) for i in range(1200)]
    docs = frame(spark, rows)
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    kept = mixing.apply(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert got and all(r[n] == f"own {n}" for r in got for n in names)
    for r in mixing.mix(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= 9  # though two thirds of the ids are null
    many = frame(spark, [(i, "a b", "en", f"s{i % 700:04d}", 0) for i in range(2100)])
    sizes = {f"s{i:04d}": 6 for i in range(700)}
    want = target_by_rounds(sizes)
    assert {round(r["target"], 6) for r in mixing.mix(many).collect()} == {round(x, 6) for x in want.values()}


def test_one_hot_source(spark):
    rows = [(i, "a b c", "en", "hot" if i % 3 else f"s{i}", 0) for i in range(900)]
    got = mixing.mix(frame(spark, rows)).groupBy("source_size").agg(F.sum("taken"), F.first("target"), F.countDistinct("target")).collect()
    hot = next(r for r in got if r["source_size"] == 1800)
    assert abs(hot[1] - hot[2]) <= 3 and len(got) == 2


# outliers


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_counts_against_brute_force(spark, sf_dir):
    odd = [None, "", " \n\t", "a", "a b", "a b c a b c", "x x x x x", "#<b> é|\n\n#<b> é|\n#<b> é| ", "\x0b\x0ca\x1cb c", "one two " * 30_000]
    docs = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(odd)])
    docs = docs.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000).select(*docs.columns))
    rows = outliers.judge(docs.withColumn("kept", F.lit(1))).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base_counts(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_repeats_where_hashes_are_cut_short(spark):
    # so long that the upper bits of the hashes agree by chance: 300,000 distinct words and a few repeats
    rng = random.Random(6)
    words = [f"{rng.getrandbits(60):x}" for _ in range(300_000)]
    words[1000:1004] = words[5:9]
    long = " ".join(words)
    rows = [(1, long), (2, "x y z w " * 50_000)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in outliers.counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: base_counts(t)[4] for i, t in rows}


def brute_mcd(x, target, least):
    """The least determinant over all subsets of the share, by the operator's own regularisation."""
    n, d = x.shape
    h = int(np.ceil(outliers.SUBSET * n))
    scale = outliers.SUBSET / outliers._chi_square_cdf(outliers._chi_square_quantile(outliers.SUBSET, d), d + 2)
    own = n / (n + outliers.PRIOR)
    dets = [np.linalg.slogdet(own * scale * np.cov(x[list(s)].T, bias=True) + np.diag((1 - own) * target + least))[1] for s in itertools.combinations(range(n), h)]
    return min(dets)


def test_estimates_against_every_subset(spark):
    rng = np.random.default_rng(12)
    rows, clouds = [], {}
    for cell, n in (("a", 12), ("b", 14), ("c", 5), ("d", 1)):
        q = np.rint(rng.normal(size=(n, 4)) * [400, 300, 900, 300] + [1500, 200, 0, 100]).astype(int)
        q[: n // 6] += 6000
        clouds[cell] = q
        rows += [("s" + cell, "n", *map(int, r)) for r in q]
    points = spark.createDataFrame(rows, "lang_key string, source_key string, q0 long, q1 long, q2 long, q3 long")
    got = {r["lang_key"][1]: r for r in outliers.estimates(points).collect()}
    middle = lambda v: np.sort(v)[(len(v) + 1) // 2 - 1]
    off = np.concatenate([abs(q - [middle(c) for c in q.T]) for q in clouds.values()])
    target = np.array([(1.4826 * middle(c)) ** 2 for c in off.T])
    assert set(got) == set(clouds)
    for cell, q in clouds.items():
        assert got[cell]["det"] <= brute_mcd(q.astype(float), target, np.array(outliers._LEAST)) + 0.35, cell


def test_repeats_alone_can_reject(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows = [(i, " ".join(words[i % 100 : i % 100 + 100]), "en", "s") for i in range(200)]
    rows.append((200, " ".join(words[:65] + words[:25] + words[100:110]), "en", "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in outliers.judge(docs).collect()}
    assert not got[200]["base_failed"] and got[200]["n_repeat_words"] >= 0.4 * got[200]["n_words"]
    assert [i for i, r in got.items() if not r["kept"]] == [200]


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    rows = []
    for i in range(1200):
        text = " ".join(word() for _ in range(rng.randint(60, 300)))
        if i % 10 == 0:
            text = re.sub(" ", " ### ", text)
        elif i % 10 == 1:
            text = re.sub("[a-h]{4}", "bcdefghaabcdefgh", text)
        rows.append((i, text, ["en", "de", None][i % 3], "hot" if i % 2 else f"s{i % 8}", 0))
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(frame(spark, rows)).collect()}
    assert {i for i, k in got.items() if not k} == {i for i in got if i % 10 in (0, 1)}
    again = {r["doc_id"]: r["kept"] for r in outliers.judge(frame(spark, rows).repartition(5)).collect()}
    assert again == got
    assert outliers.judge(frame(spark, [])).count() == 0
    few = frame(spark, rows[2:4] + rows[2:3])
    assert [r["kept"] for r in outliers.judge(few).collect()] == [True] * 3


# top-k


def brute_topk(rows, k=5):
    vectors = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    long = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q, v in {(i, tuple(v)) for i, v in vectors if i % 50 == 0}:
        best = sorted((-long(sum(a * b for a, b in zip(v, w))), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, leaf", [(8192, 128), (40, 4)])
def test_topk_against_brute_force(spark, monkeypatch, shard_rows, leaf):
    monkeypatch.setattr(topk.BallTree.__init__, "__defaults__", (leaf,))
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # one very common vector, with ties
    rows += [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (2150, [float("nan")] * 6), (None, rows[0][1])]
    rows += [(2200, [1.0, 2.0]), (2201, [3.0, -1.0]), (2250, [5.0]), (2300, []), (2301, []), (2350, [1e8, 1e8, 1.0, 0.0, 0.0, 0.0])]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    ints = topk.as_integers(docs)
    got = sorted(tuple(r) for r in topk.search(ints, ints.filter("id % 50 = 0"), shard_rows=shard_rows).collect())
    assert got == brute_topk(rows)
    assert topk.search(ints.limit(0), ints.limit(0)).count() == 0


def test_topk_of_huge_components(spark):
    rows = [(i, [float(i), 1e300 if i % 3 else -2.0, 1e12]) for i in range(1, 60)] + [(100, [1e300, -1e300, 0.5]), (150, [3e9, 3e9, 3e9]), (200, [0.0, 0.0, 1.0])]
    ints = topk.as_integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in topk.search(ints, ints.filter("id % 50 = 0")).collect()) == brute_topk(rows)


def test_topk_skips_shards(spark):
    rng = np.random.default_rng(5)
    homes = rng.normal(size=(40, 16)) * 4
    rows = [(i, [float(x) for x in homes[i % 40] + rng.normal(size=16) * 0.1]) for i in range(4000)]
    ints = topk.as_integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    visits = []
    got = sorted(tuple(r) for r in topk.search(ints, ints.filter("id % 50 = 0"), shard_rows=100, visits=visits).collect())
    assert got == brute_topk(rows)
    assert sum(visits[:-1]) < 0.5 * visits[-1], visits


# joins


def brute_join(rows, in_order=False):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    n = len(rows)
    links = [[b for b in range(n) if a != b and (both := len(sets[a] & sets[b])) and 5 * both >= 4 * len(sets[a] | sets[b])] for a in range(n)]
    group = list(range(n))
    for a in range(n):
        todo = [a] if group[a] == a else []
        while todo:
            for b in links[todo.pop()]:
                if group[b] != a and group[b] == b and b != a:
                    group[b] = a
                    todo.append(b)
    ids = collections.defaultdict(list)
    for a in range(n):
        ids[group[a]].append(rows[a][0])
    least = {g: min((i for i in own if i is not None), default=None) for g, own in ids.items()}
    if in_order:  # classes by their first row, as ids may be null
        return [(rows[a][0], group[a], len(links[a])) for a in range(n)]
    return sorted(((rows[a][0], least[group[a]], len(links[a])) for a in range(n)), key=repr)


def near_copies():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [[rng.choice(vocabulary) for _ in range(150)] for _ in range(5)]
    rows = []
    for k in range(260):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((k, " ".join(w)))
    rows += [(5000, ""), (5001, None), (None, "a b"), (None, "a b"), (5002, "one two three"), (5003, "One, two three!"), (7, rows[7][1]), (5004, "... ---")]
    return rows + [(5005, " ".join(vocabulary[:60] * 400)), (5006, rows[9][1].upper())]


@pytest.mark.parametrize("block", [None, 24])
def test_join_against_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(J, "BUCKET_BLOCK", block)
        monkeypatch.setattr(J, "GROUP_BLOCK", block)
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, key string, n_links int").repartition(4)
    for n in ("join_id", "join_hash", "join_no_id", "_id", "_hash", "stays", "first", "text_hash"):
        docs = docs.withColumn(n, F.lit("own"))
    want = brute_join(rows)
    assert sorted((tuple(r) for r in J.jaccard_join(docs).collect()), key=repr) == want
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    alone = [r for r in want if r[1] == r[0] and r[0] is not None]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(r[0]) for r in alone} | {"None"})
    assert all(r[n] == "own" for r in kept.collect() for n in ("join_id", "_hash", "first"))


def test_null_ids_are_no_numbers(spark):
    text = "one two three four five six"
    rows = [(None, text), (-1, text), (None, text), (0, "seven eight"), (None, "seven eight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in J.keep_one(docs).collect()) == [-1, 0]
    assert sorted((tuple(r) for r in J.jaccard_join(docs).collect()), key=repr) == brute_join(rows)


def test_join_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert J.jaccard_join(none).count() == 0 and J.keep_one(none).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    least = J.least_matches()
    assert least[16] < 16 * 0.8 and all(least[n] <= 0.8 * n for n in least)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    kept = 0
    for k in range(200):
        extra = rng.integers(0, 1 << 63, 250, dtype=np.uint64)
        one, two = np.unique(a), np.unique(np.concatenate((a[:-250], extra)))  # similarity 0.78
        i, _ = J.surviving(J.signature(one)[None], J.signature(two)[None])
        kept += len(i)
        far = J.signature(np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64)))
        assert not len(J.surviving(J.signature(one)[None], far[None])[0])
    assert kept >= 195


def test_no_pair_of_a_dense_group_is_pruned():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = []
    for _ in range(1200):
        own = base.copy()
        at = rng.choice(300, 15, replace=False)
        own[at] = rng.integers(0, 1 << 63, 15, dtype=np.uint64)  # at least 270 of 330 agree with any other
        sets.append(np.unique(own))
    kept = J.survivors(np.array([J.signature(s) for s in sets]))
    assert kept.sum() == 1200 * 1199 and (J.exact_links(sets[:100], kept[:100, :100]) == J.exact_links(sets[:100])).all()


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(90)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    with Workspace(spark, "t") as work:
        got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), work).collect()}
    assert got == {x: find(x) for x in up if any(find(y) == find(x) for y in up if y != x)}


# pipeline


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "secret_scan", "source_mix", "byte_bpe"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, sf_dir)
        docs = corpus_pipeline.materialize(docs, "t")
        seen[name] = docs.count()
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "secret_scan":
            assert docs.filter(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0 and docs.filter("n_chars <> length(text)").count() == 0
    assert seen["ngram_jaccard_join"] < seen["language_id"] and seen["secret_scan"] == seen["ngram_jaccard_join"] and seen["byte_bpe"] == seen["source_mix"]
    assert corpus_pipeline.run(spark, sf_dir).count() == seen["byte_bpe"]


def test_pipeline_against_brute_force(spark, sf_dir):
    """Every stage against a plain computation over its own input."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = frame(spark, [(None, "the and of with " * 4, "en", None, 64), (900_001, None, "en", "src1", None), (900_002, "", None, "src1", 0), (0, given.first()["text"], "en", "src1", 9)])
    docs = given.unionByName(odd.select(given.columns))
    model = langid.fit(docs, F.coalesce(id_fold("doc_id", 4) != 2, F.lit(False)))
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = [tuple(r) for r in docs.collect()]
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "t")
    out = {n: inputs[m] for n, m in zip(inputs, list(inputs)[1:])}
    same = lambda a, b: sorted(map(repr, a)) == sorted(map(repr, b))

    def rejected(text):
        """Window by window in plain Python."""
        if not any(c.isalpha() for c in text or ""):
            return True
        raw = langid.spaced_bytes(text) + b"   "
        rows = []
        for k in range(len(raw) - 3):
            for window in (raw[k : k + 3], raw[k : k + 4]):
                if 32 not in window[1:-1] and not (len(window) == 3 and window[1] == 32):
                    rows.append(model.rows[langid.window_buckets(np.frombuffer(raw[k : k + 4], np.uint8))[len(window) - 3][0]])
        z = (np.mean(rows, axis=0, dtype=float) + model.bias) / model.temperature
        return np.exp(z - z.max()).max() / np.exp(z - z.max()).sum() < model.reject_below

    assert same(out["language_id"], [r for r in inputs["language_id"] if not rejected(r[1])])
    at = {c: k for k, c in enumerate(given.columns)}
    rows = inputs["ngram_jaccard_join"]
    pairs = [(r[at["doc_id"]], r[at["text"]]) for r in rows]
    first = collections.defaultdict(list)
    for r, (_, root, _) in zip(rows, brute_join(pairs, in_order=True)):
        alone = not words_of(r[at["text"]])
        first[("alone", len(first)) if alone else ("class", root)].append(r)
    kept = [min(own, key=lambda r: (r[at["doc_id"]] is None, r[at["doc_id"]] or 0)) for own in first.values()]
    assert same([(r[0], r[1]) for r in out["ngram_jaccard_join"]], [(r[0], r[1]) for r in kept])
    masked = []
    for r in inputs["secret_scan"]:
        text = r[at["text"]]
        new = secrets.mask(text, secrets.scan(text)) if text is not None and secrets.scan(text) else text
        masked.append(tuple(new if c == "text" else len(new) if c == "n_chars" and new is not text else r[k] for c, k in at.items()))
    assert same(out["secret_scan"], masked)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(inputs["source_mix"], columns=given.columns).astype({"doc_id": "Int64"}))
    times = {(r[0], r[1]): r[3] for r in con.execute(f"SELECT doc_id, any_value(size), count(*), any_value(CASE WHEN size = 0 THEN 1 ELSE taken // size END) FROM ({mixing.ORACLE_SQL}) GROUP BY doc_id, size").fetchall()}
    n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert same(out["source_mix"], [r for r in inputs["source_mix"] for _ in range(times[r[at["doc_id"]], n_words(r[at["text"]])])])
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for r in inputs["byte_bpe"]:
        ids = np.array(library.encode_ordinary(r[at["text"]] or ""), "<u4").tobytes()
        want.append((r[at["doc_id"]], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[at["text"]] or "").encode()).hexdigest(), ids))
    assert same([(*r[:4], bytes(r[4])) for r in docs.collect()], want)


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "t")
    assert docs.count() == 0
