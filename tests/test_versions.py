"""The versioned index: what changes, what is shared, what fails."""

import pytest
from pyspark.sql import functions as F

from folioquery.plans.assistant import Index, ask, build_index
from folioquery.sources import versions as V

BODY = {"snow": "Snow falls in winter and covers the hills. ", "river": "Rivers carry water down to the sea. ", "fog": "Fog hides the road in the morning. "}


def files(spark, **named):
    """Pages of files by name, each of some pages about a topic."""
    rows = [(f"sig-{topic}", f"{name}.pdf", page, BODY[topic] * 40) for name, topic in named.items() for page in (1, 2)]
    return spark.createDataFrame(rows, "signature string, source string, page int, text string")


def shown(index):
    """Chunks by name, and whether every chunk has its vector and tokens."""
    rows = index.chunks.collect()
    ids = {r.chunk_id for r in rows}
    assert len(ids) == len(rows) and {r.chunk_id for r in index.vectors.collect()} == ids == {r.chunk_id for r in index.tokens.select("chunk_id").distinct().collect()}
    out = {}
    for r in rows:
        out.setdefault(r.source, []).append((r.page, r.chunk_seq, r.text))
    return {k: sorted(v) for k, v in out.items()}


def rebuilt(pages):
    return {k: v for k, v in shown(build_index(pages.drop("signature"))).items()}


def parts(root):
    return sorted(p.name for p in (root / "parts").iterdir()) if (root / "parts").exists() else []


def test_a_set_of_files_that_changes(spark, tmp_path):
    store = V.VersionedIndex(spark, str(tmp_path))
    assert store.latest() == 0 and store.read().chunks.count() == 0
    sets = [files(spark, a="snow", b="river"), files(spark, a="snow", renamed="river", c="fog"), files(spark, renamed="river"), files(spark, a="snow", renamed="river")]
    for k, now in enumerate(sets, start=1):
        assert store.commit(now) == k
        assert shown(store.read()) == rebuilt(now)
    assert len(parts(tmp_path)) == 2  # a name, a file that goes and one that comes back write no part
    assert store.commit(sets[-1]) == 4  # nothing changed
    for k, then in enumerate(sets, start=1):
        assert shown(store.read(k)) == rebuilt(then)
    before = shown(store.read())
    assert store.compact() == 5 and shown(store.read()) == before and len(parts(tmp_path)) == 1
    ids = sorted(r.chunk_id for r in store.read().chunks.collect())
    assert ids == list(range(ids[0], ids[0] + len(ids)))
    assert store.commit(files(spark, c="fog", a="snow")) == 6 and shown(store.read()) == rebuilt(files(spark, c="fog", a="snow"))
    messages = spark.createDataFrame([(1, 0, "user", "What hides the road?")], "conv_id long, turn long, role string, text string")
    assert ask(messages, store.read()).first().sources[0].label.startswith("c")
    assert store.commit(files(spark, a="snow").limit(0)) == 7 and store.read().chunks.count() == 0


def test_equal_contents_are_indexed_once(spark, tmp_path):
    store = V.VersionedIndex(spark, str(tmp_path))
    store.commit(files(spark, b="snow", a="snow"))
    assert shown(store.read()) == rebuilt(files(spark, a="snow"))
    store.commit(files(spark, b="snow"))
    assert shown(store.read()) == rebuilt(files(spark, b="snow"))


def test_a_commit_that_fails_leaves_the_old_version(spark, tmp_path):
    def broken(pages):
        built = build_index(pages)
        return Index(built.chunks, built.vectors.withColumn("vector", F.raise_error(F.lit("no more disk")).cast(built.vectors.schema["vector"].dataType)), built.tokens)

    store = V.VersionedIndex(spark, str(tmp_path))
    store.commit(files(spark, a="snow"))
    old = shown(store.read())
    failing = V.VersionedIndex(spark, str(tmp_path), broken)
    with pytest.raises(Exception, match="no more disk"):
        failing.commit(files(spark, a="snow", b="river"))
    assert len(parts(tmp_path)) == 2  # the chunks of b were written, but no manifest names them
    assert store.versions() == [1] and shown(store.read()) == old
    assert store.commit(files(spark, a="snow", b="river")) == 2 and shown(store.read()) == rebuilt(files(spark, a="snow", b="river"))
    store.compact()
    assert len(parts(tmp_path)) == 1


def test_of_two_commits_of_a_version_one_succeeds(spark, tmp_path, monkeypatch):
    first, second = V.VersionedIndex(spark, str(tmp_path)), V.VersionedIndex(spark, str(tmp_path))
    first.commit(files(spark, a="snow"))
    monkeypatch.setattr(second, "latest", lambda: 0)  # it looked before the first was done
    with pytest.raises(V.Conflict):
        second.commit(files(spark, b="river"))
    assert shown(first.read()) == rebuilt(files(spark, a="snow"))


def test_a_cache_entry_that_is_being_rewritten_is_not_complete(spark, tmp_path):
    from folioquery.sources.cache import IndexCache

    index = build_index(files(spark, a="snow").drop("signature"))
    cache = IndexCache(spark, str(tmp_path))
    cache.write("s", 2, 5, chunks=index.chunks, vectors=index.vectors, tokens=index.tokens)
    cache.write("other", 1, 1, chunks=index.chunks, vectors=index.vectors, tokens=index.tokens)
    assert cache.meta("s") == (2, 5)
    with pytest.raises(Exception):
        cache.write("s", 3, 6, chunks=index.chunks, vectors=index.vectors.select(F.raise_error(F.lit("stop")).alias("v")))
    assert cache.meta("s") is None and cache.meta("other") == (1, 1)
