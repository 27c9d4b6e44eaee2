"""The folder data source: order, filters, errors, memory."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains, StringEndsWith, StringStartsWith

from folioquery.sources import folder as S
from folioquery.sources.pdf import write_pdf


@pytest.fixture
def folder(tmp_path):
    made = {"b.pdf": write_pdf(["one\ntwo", " \n", "three"]), "B.pdf": write_pdf(["upper"]), "a.txt": b"no pdf", "é.pdf": write_pdf([""]), "a.PDF": b"other case", "10.pdf": write_pdf(["ten"]), "9.pdf": write_pdf(["nine", "last"])}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "d.pdf").mkdir()
    (tmp_path / "d.pdf" / "inner.pdf").write_bytes(write_pdf(["not direct"]))
    return str(tmp_path)


def shown(df):
    return sorted((r.file_no, r.source, r.page, r.text) for r in df.collect())


EVERY = [(0, "10.pdf", 1, "ten"), (1, "9.pdf", 1, "nine"), (1, "9.pdf", 2, "last"), (2, "B.pdf", 1, "upper"), (3, "b.pdf", 1, "one\ntwo"), (3, "b.pdf", 3, "three")]


@pytest.mark.parametrize("most", [1, 2000, 1 << 30])
def test_pages_in_order_of_names(spark, folder, most):
    df = S.read_folder(spark, folder, partitionBytes=most)
    assert shown(df) == EVERY
    assert df.rdd.getNumPartitions() == {1: 5, 1 << 30: 1}.get(most, df.rdd.getNumPartitions())
    assert shown(S.read_folder(spark, f"file://{folder}")) == EVERY
    assert {r.signature for r in df.filter("source = '10.pdf'").collect()} == {__import__("hashlib").sha256(write_pdf(["ten"])).hexdigest()[:32]}


def test_filters_on_names_reach_the_list_of_files(spark, folder):
    reader = S.FolderReader({"path": folder})
    filters = [StringEndsWith(("source",), ".pdf"), EqualTo(("page",), 1), GreaterThan(("source",), "a"), In(("source",), ("b.pdf", "B.pdf", "9.pdf"))]
    assert list(reader.pushFilters(filters)) == filters[1:3]
    assert [n for n, *_ in reader.files()] == [1, 2, 3]
    for f, names in ((StringStartsWith(("source",), "b"), ["b.pdf"]), (StringContains(("source",), "0"), ["10.pdf"]), (EqualTo(("source",), "9.pdf"), ["9.pdf"])):
        reader = S.FolderReader({"path": folder})
        assert not list(reader.pushFilters([f])) and [p.rsplit("/", 1)[-1] for _, p, _ in reader.files()] == names
    df = S.read_folder(spark, folder, suffix="", onerror="report").filter(F.col("source").endswith("9.pdf") & (F.col("page") > 1))
    assert shown(df) == [(1, "9.pdf", 2, "last")]  # the others' files would have been errors


def test_files_that_cannot_be_read(spark, folder):
    (open(f"{folder}/c.pdf", "wb")).write(b"junk")
    rows = S.read_folder(spark, folder, onerror="report").filter("error is not null").collect()
    assert [(r.source, r.page, r.text, r.error.split(":")[0]) for r in rows] == [("c.pdf", None, None, "BrokenPdf")]
    with pytest.raises(Exception, match="c.pdf"):
        S.read_folder(spark, folder).collect()
    with pytest.raises(Exception):
        S.read_folder(spark, f"{folder}/nowhere").collect()


def test_texts_empty_folders_and_own_parsers(spark, folder, tmp_path):
    assert shown(S.read_folder(spark, folder, ".txt", parser="text")) == [(0, "a.txt", 1, "no pdf")]
    assert shown(S.read_folder(spark, folder, ".none")) == []
    (tmp_path / "x.txt").write_bytes("a\f \fé\xa0\f".encode() + b"\xff")
    (tmp_path / "y.txt").write_bytes(b"")
    got = shown(S.read_folder(spark, folder, ".txt", parser="folioquery.sources.folder:text_pages"))
    assert got == [(0, "a.txt", 1, "no pdf"), (1, "x.txt", 1, "a"), (1, "x.txt", 3, "é"), (1, "x.txt", 4, "�")]


def test_written_files_are_whole_and_read_back(spark, tmp_path):
    files = spark.createDataFrame([(f"{i}.pdf", bytearray(write_pdf([f"text {i}"]))) for i in range(20)], "source string, content binary").repartition(4)
    for _ in range(2):  # the second write replaces
        assert S.write_files(files, f"{tmp_path}/out").agg(F.count("*")).first()[0] == 20
    assert sorted(os.listdir(f"{tmp_path}/out")) == sorted(f"{i}.pdf" for i in range(20))
    assert {r.text for r in S.read_folder(spark, f"{tmp_path}/out").collect()} == {f"text {i}" for i in range(20)}


def test_a_large_file_is_not_held(tmp_path):
    with open(tmp_path / "large.txt", "wb") as out:
        page = b"some words of a page " * 5000 + b"\f"
        for _ in range(200 * (1 << 20) // len(page)):
            out.write(page)
    assert os.path.getsize(tmp_path / "large.txt") > 199 << 20
    code = f"""
import resource, sys
from folioquery.sources import folder as S
reader = S.FolderReader({{"path": {str(tmp_path)!r}, "suffix": ".txt", "parser": "text"}})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
(part,) = reader.partitions()
rows = 0
for b in reader.read(part):
    rows += b.num_rows
    assert b.nbytes < 4 << 20
private = [int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")][0]
print(rows, private)
"""
    rows, private = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert rows == 200 * (1 << 20) // len(page) and private < 400_000  # kB; mapped pages belong to the system
