"""Importance resampling, the Merkle manifest and chat formatting against plain computations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioquery.llm import chat, dsir, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MESSAGES = "conv_id long, turn long, role string, text string"


# importance resampling


def plain_draw(docs, target, order, buckets, least, percent):
    """[(doc_id, n_features, weight, score, rank)] by dictionaries."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    runs = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(runs(words(text)))
    for text in target:
        t.update(runs(words(text)))
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s_all + buckets)) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for d, text in docs:
        w = words(text)
        found = runs(w)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    eligible = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = {id(r): i + 1 for i, r in enumerate(eligible[: percent * len(eligible) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = ["Ab", "a9", "élan", "Étude", "x", "the", "漢字", "of", "n0n", "zz-y"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(n)]
    return [*rows, (None, "the of x " * 9), (None, None), (n, ""), (n + 1, "?!"), (7, rows[7][1]), (n + 2, "x y " * 3000)]


@pytest.mark.parametrize("order, block", [(1, 4096), (2, 7), (3, 50)])
def test_draw_equals_plain_computation(spark, order, block):
    rows, aim = corpus(), ["the élan of x", None, "漢字 x x"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash")).repartition(5)
    target = spark.createDataFrame([(t,) for t in aim], "text string")
    got = dsir.resample(docs, target, order=order, buckets=97, least_words=5, percent=30, block=block).drop("row").collect()
    want = plain_draw(rows, aim, order, 97, 5, 30)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got), key=key) == sorted(want, key=key)


def test_select_keeps_columns_and_draws_the_ranked(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("own"), "rank": F.col("doc_id") + 1})
    target = spark.createDataFrame([("the of x",)], "text string")
    got = dsir.select(docs, target, buckets=97, least_words=5, percent=30)
    assert got.columns == docs.columns
    want = Counter(d for d, *_, rank in plain_draw(rows, ["the of x"], 1, 97, 5, 30) if rank)
    assert Counter(r.doc_id for r in got.collect()) == want


def test_draw_from_and_towards_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(corpus(6), "doc_id long, text string")
    assert dsir.resample(none, some).count() == 0
    ranks = sorted(r.rank for r in dsir.resample(some, none, least_words=5).collect() if r.rank)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_repeated_rows_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(5, "the of x y z")] * 100, "doc_id long, text string")
    got = dsir.resample(docs, docs, least_words=5, percent=30).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 31)) and len(got) == 100


# the Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, fanout):
    """The last node, and of each leaf its runs (place in the run, run) level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    ways = []
    for i in range(len(nodes)):
        way = []
        for level in levels[:-1]:
            start = i // fanout * fanout
            way.append((i - start, level[start : start + fanout]))
            i //= fanout
        ways.append(way)
    return levels[-1][0], ways


def plain_manifest(rows, fanout):
    """Sorted [(doc_id, leaf, subroot, root, siblings)]."""
    trees = {}
    for r in rows:
        trees.setdefault("n" if r[2] is None else "s" + r[2], []).append(r)
    keys = sorted(trees, key=lambda k: k.encode())
    tops = {}
    for k in keys:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf((r[0], r[3], r[2], r[4], r[1]))))
        tops[k] = plain_tree([plain_leaf((r[0], r[3], r[2], r[4], r[1])) for r in trees[k]], fanout)
    root, above = plain_tree([tops[k][0] for k in keys], fanout)
    out = []
    for k, crown in zip(keys, above):
        for r, way in zip(trees[k], tops[k][1]):
            beside = [h for place, run in way + crown for j, h in enumerate(run) if j != place]
            out.append((r[0], plain_leaf((r[0], r[3], r[2], r[4], r[1])), tops[k][0], root, "".join(beside)))
    return sorted(out, key=repr)


def documents(n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randint(-5, n * 2), rng.choice(["é" * 3, "", None, "a:b"]), rng.choice(["en"] * 6 + ["de", "", None, "É", "zz"]), rng.choice(["s", None]), rng.choice([None, 3, i])) for i in range(n)]
    return rows + [rows[0]] * 5 + [(None, "x", "en", None, 1), (None, None, None, None, None), (1, "lone", "fr", "s", 4)]


@pytest.mark.parametrize("n, fanout", [(90, 2), (70, 3), (1, 5)])
def test_manifest_equals_plain_trees(spark, n, fanout):
    rows = documents(n)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"hash": F.lit("clash"), "idx": F.lit(1), "tree": F.lit("x")}).repartition(4)
    manifest = merkle.build(docs, {"doc_id": F.col("doc_id")}, fanout=fanout)
    subroots = {r.tree: bytes(r.hash).hex() for r in manifest.subroots.collect()}
    path = F.col("path")
    found = merkle.proofs(manifest).select("tree", "doc_id", merkle.as_text("hash").alias("leaf"), merkle.siblings(path).alias("beside"), merkle.as_text(merkle.fold(F.col("hash"), path)).alias("up")).collect()
    got = sorted(((r.doc_id, r.leaf, subroots[r.tree], r.up, r.beside) for r in found), key=repr)
    assert got == plain_manifest(rows, fanout)
    assert {r.up for r in found} == {manifest.root}


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, "t", "en", "s", 1)], DOCS)
    manifest = merkle.build(one)
    assert manifest.root == plain_leaf((1, "s", "en", 1, "t"))
    assert [tuple(r.path) for r in merkle.proofs(manifest).collect()] == [()]
    none = merkle.build(one.limit(0))
    assert none.root is None and merkle.proofs(none).count() == 0


def test_any_change_of_a_row_changes_the_root(spark):
    rows = documents(40, 2)
    root = merkle.build(spark.createDataFrame(rows, DOCS)).root
    assert merkle.build(spark.createDataFrame(rows[::-1], DOCS)).root == root
    for at in range(5):
        changed = [list(r) for r in rows]
        changed[3][at] = {0: 999, 1: "é!", 2: "en2", 3: "t", 4: 77}[at]
        assert merkle.build(spark.createDataFrame(changed, DOCS)).root != root


def test_fields_cannot_run_into_each_other(spark):
    docs = spark.createDataFrame([(1, "b", "x", "a1:", 1), (1, "b", "x", "a", 1), (1, "-", "x", None, 1), (1, None, "x", "-", 1)], DOCS)
    assert merkle.build(docs).levels[0].select("hash").distinct().count() == 4


# chat formatting


@pytest.fixture(scope="module")
def coder():
    return chat._coder(public_tokenizers.path("byte_bpe_50k.json"))


SCRAPS = [*chat.CONTROLS, *chat.RESERVED, "\\", "[", "<", "\n", " ", "  ", "é", "é", "漢", "🙂", "ok", "[\\INST]", "[\\\\INST]", " ", "\t", "'s", "</", "s>", "\x00", "<s>", "\x1c"]


def said(rng, most=9):
    return "".join(rng.choices(SCRAPS, k=rng.randint(0, most)))


def test_escape_is_reversible_and_leaves_plain_texts(coder):
    rng = random.Random(1)
    for _ in range(3000):
        t = said(rng)
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROLS + chat.RESERVED)
    assert chat.escape("a [INS T] <b> \\n </ s>") == "a [INS T] <b> \\n </ s>"


def test_tokens_and_offsets_are_the_librarys(coder):
    rng = random.Random(8)
    for k in range(400):
        text = chat.render([(rng.choice(["user", "assistant"]), said(rng, 30) if k % 2 else "don't  stop\n\n2nd élan, Straße! " * rng.randint(0, 3)) for _ in range(4)]).text
        ids, firsts, lasts = coder.encode(text)
        want = coder.library.encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids and list(zip(firsts.tolist(), lasts.tolist())) == want.offsets
        assert coder.decode(ids) == text


@pytest.mark.parametrize("portion", [1 << 18, 3])
def test_mask_covers_exactly_the_assistants_texts(coder, monkeypatch, portion):
    monkeypatch.setattr(chat, "ENCODE_CHARS", portion)
    rng = random.Random(2)
    for _ in range(1500):
        turns = [(rng.choice(["user", "assistant", "assistant", "system", None, "", "tool", said(rng, 3)]), said(rng)) for _ in range(rng.randint(0, 6))]
        r = chat.render(turns)
        ids, firsts, lasts = chat.encode(coder, r.text)
        first, last = chat.token_spans(firsts, lasts, r.starts, r.ends)
        loss = [{"first": a, "last": b} for a, b in zip(first.tolist(), last.tolist()) if b > a]
        got, learned = chat.read_back(coder, ids, loss)
        assert got == [(role or "", t) for role, t in turns]
        assert learned == [t for role, t in turns if role == "assistant" and t]
        if portion == 3:
            monkeypatch.setattr(chat, "ENCODE_CHARS", 1 << 18)
            assert ids.tolist() == chat.encode(coder, r.text)[0].tolist()
            monkeypatch.setattr(chat, "ENCODE_CHARS", portion)


def test_spans_meet_tokens_as_by_comparing_all(coder):
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        edges = sorted(rng.sample(range(60), 12))
        starts, ends = edges[::2], edges[1::2]
        cuts = [0, *sorted(rng.sample(range(1, 60), 20)), 60]
        firsts, lasts = np.array(cuts[:-1]), np.array(cuts[1:])
        got = chat.token_spans(firsts, lasts, starts, ends)
        for s, e, a, b in zip(starts, ends, *got):
            assert list(range(a, b)) == [i for i in range(len(firsts)) if lasts[i] > s and firsts[i] < e]


def test_a_broken_string_is_refused():
    for text in ("x", "[INST] a", "[INST]a</s>", "[/INST]", "[TURN]a[/TURN]", "[INST]a[INST]b[/INST]"):
        with pytest.raises(ValueError):
            chat.parse(text)


def plain_digests(rows):
    found = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())
    for c, _, role, text in sorted(rows, key=key):
        found.setdefault(c, []).append((role or "", text or ""))
    out = []
    for c, turns in found.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        out.append((c, len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(learned), sha(learned)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [chat.PART_BYTES, 4000, 40])
def test_digests_equal_plain_computation(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "PART_BYTES", most)
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 5, 9, None, -2, rng.randint(10, 40)]), rng.choice([None, rng.randint(0, 400)]), rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice([None, said(rng, 12)])) for _ in range(600)]
    rows += [(77, 1, "assistant", "long word " * 60_000), (77, 2, "user", None), (78, 0, "assistant", ""), *[(79, 1, "assistant", "again")] * 3]
    messages = spark.createDataFrame(rows, MESSAGES).withColumns({"part": F.lit("clash"), "tie": F.lit(0), "lost": F.lit(1)}).repartition(6)
    got = chat.digests(messages).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain_digests(rows)
    formatted = chat.format_conversations(messages)
    parts = formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n"), F.count("*").alias("parts")).collect()
    assert {r.conv_id: r.n for r in parts} == {r.conv_id: r.formatted_chars for r in got}
    assert (max(r.parts for r in parts) > 1) == (most < chat.PART_BYTES or most < 1 << 20)


def test_no_messages_give_no_rows(spark):
    none = spark.createDataFrame([], MESSAGES)
    assert chat.digests(none).count() == 0 and chat.format_conversations(none).count() == 0


def test_query_formats_its_own_conversation(spark, sf_dir):
    got = {r.conv_id: r for r in chat.query(spark, sf_dir).collect()}
    text = "</s>[INST] ok [/INST]"
    assert (got[-1].n_turns, got[-1].turns_sha256, got[-1].loss_chars, got[-1].loss_sha256) == (2, sha(f"user\n{text}\nassistant\n{text}\n"), len(text), sha(text))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r)[:5] for c, r in got.items() if c != -1), key=repr) == plain_digests(rows)
