import os
import sys
import types

import pytest
from pyspark.sql.utils import AnalysisException

from folioquery.functions.providers import plain_text_pages
from folioquery.operators.answering import console_lines
from folioquery.plans import assistant
from folioquery.scratch import BATCH_BYTES
from folioquery.sources import files
from folioquery.sources.cache import IndexCache

BODY = "Rivers carry water to the sea. Mountains hold snow in winter. " * 8


def test_folder_scan_is_flat_and_case_sensitive(spark, tmp_path):
    for name in ("b.txt", "a.txt", "UPPER.TXT", "c.md"):
        (tmp_path / name).write_text(f" page one of {name}\f \n\f third page ")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_text("x")
    found = files.scan_folder(spark, str(tmp_path), ".txt")
    pages = files.extract_pages(found, plain_text_pages).orderBy("source", "page").collect()
    assert [(r["source"], r["page"], r["text"]) for r in pages] == [
        ("a.txt", 1, "page one of a.txt"), ("a.txt", 3, "third page"), ("b.txt", 1, "page one of b.txt"), ("b.txt", 3, "third page"),
    ]


def test_word_list_file(spark, tmp_path):
    (tmp_path / "w.txt").write_text("one\n\ntwo\r\n")
    assert [(r[0], r[1]) for r in files.number_lines(spark, str(tmp_path / "w.txt")).orderBy("ordinal").collect()] == [(0, "one"), (2, "two")]


def test_upload_is_indexed_once(spark, tmp_path):
    cache = IndexCache(spark, str(tmp_path / "cache"))
    calls = tmp_path / "calls"
    calls.mkdir()

    def parser(content):
        open(os.path.join(str(calls), str(os.urandom(8).hex())), "w").close()
        return plain_text_pages(content)

    first = assistant.index_upload(spark, "one.txt", BODY.encode(), cache, parser)
    n = len(list(calls.iterdir()))
    again = assistant.index_upload(spark, "two.txt", BODY.encode(), cache, parser)
    assert n and len(list(calls.iterdir())) == n
    assert (again.page_count, again.chunk_count) == (first.page_count, first.chunk_count) == (1, first.chunks.count())
    assert {r["source"] for r in again.chunks.collect()} == {"two.txt"}
    other = assistant.index_upload(spark, "three.txt", (BODY * 3).encode(), cache, parser)
    assert other.chunk_count > first.chunk_count and first.chunks.count() == first.chunk_count


def test_asking(spark):
    pages = spark.createDataFrame([("s", 1, BODY), ("t", 1, "Cooking needs heat and salt. " * 20)], "source string, page int, text string")
    index = assistant.build_index(pages).persist()
    rows = [(1, 0, "user", "What is water in rivers to the sea?"), (1, 1, "assistant", "quit"), (1, 3, "user", "why"), (1, 4, "user", " QUIT"), (1, 5, "user", "what is snow"), (2, 1, "user", "exit")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in assistant.ask(messages, index).collect()}
    assert set(got) == {0, 3} and got[0]["answer"] == "Rivers carry water to the sea." and got[0]["confidence"] != "Low"
    assert got[3]["rewritten"] == "why of water in rivers to the sea" and got[0]["sources"][0]["label"] == "s"
    empty = spark.createDataFrame([], pages.schema)
    nothing = assistant.ask(messages, assistant.build_index(empty)).collect()
    assert {r["confidence"] for r in nothing} == {"Low"} and len(nothing) == 2
    twice = messages.filter("turn = 0").unionByName(messages.filter("turn = 0"))
    assert assistant.ask(twice, index).count() == 2


def test_pdf_pages_by_the_installed_parser(monkeypatch):
    class Page:
        def __init__(self, text):
            self.get_text = lambda: text

    class Opened(list):
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None

    def opened(stream, filetype):
        assert (stream, filetype) == (b"%PDF", "pdf")
        return Opened([Page(" one "), Page("\n"), Page("three")])

    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=opened))
    assert list(files.mupdf_pages(b"%PDF")) == [(1, " one "), (2, "\n"), (3, "three")]


def test_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.scan_folder(spark, str(tmp_path / "nowhere"))


def test_console_view(spark):
    shown = spark.createDataFrame([(1, 1, "s", 3, 0.5, 0.25, 0.123456, 0.65)], "qid long, rank int, source string, page int, score double, dense_score double, sparse_score double, rerank_score double")
    assert console_lines(shown).first()["line"] == "1. s | Page: 3 | score 0.5000 | dense 0.2500 | sparse 0.1235 | rerank 0.6500"


def test_files_reach_the_parser_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    rows = spark.createDataFrame([("a", ["x"])], "source string, pages array<string>")
    assert files.extract_pages(files.pdf_files(rows), files.pdf_pages).count() == 1
    assert int(spark.conf.get(name)) <= BATCH_BYTES
