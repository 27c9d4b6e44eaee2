"""A folder of files as a Spark data source of pages.

    read_folder(spark, folder, suffix=".pdf")       file_no, source, page, text, signature, error

or, once registered, ``spark.read.format("folder_pages").option("path", folder)``. Files lie directly in
the folder; they are numbered from 0 in the order of their names, and the number and the page order a
folder's pages. Options: path, suffix (case matters), parser (``pdf``, ``text``, or ``module:function`` of
one's own, called with a file's bytes or a map of them), onerror (``raise``, or ``report``: a file that cannot be read gives
one more row, with the error and no page) and partitionBytes.

Files are dealt to partitions by their bytes and are not cut, as a file is parsed by one reader; pages
come out one at a time, in small batches, and a local file is mapped into memory instead of being read,
so neither a large file nor a batch of files is held. Filters on source (equal to, one of, starts or ends
with, contains) are applied to the list of files before any is opened. Workers open the files themselves,
so the folder has to be one that pyarrow's file systems reach (a shared mount, HDFS, an object store); for
others there is files.scan_folder(), which reads through Spark.

Defined cases: a folder without such files gives no rows, one that is not there an error; a page without
text keeps its number and is left out; an empty text file has one page, without text.
"""

from __future__ import annotations

import contextlib
import hashlib
import importlib
import mmap
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from folioquery.scratch import map_batches
from folioquery.sources.pdf import PdfError, read_pages

SCHEMA = "file_no long, source string, page int, text string, signature string, error string"
PARTITION_BYTES = 64 << 20
#: Characters of text in a batch that goes to Spark.
BATCH_CHARS = 1 << 20

# Fixed value: white space that is stripped from pages, the set of functions.text.WHITESPACE.
_BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def text_pages(content) -> Iterator[tuple[int, str]]:
    """Pages of a plain text file, parted by form feeds, decoded one at a time."""
    start, page = 0, 1
    while True:
        end = content.find(b"\f", start)
        yield page, bytes(content[start : end if end >= 0 else len(content)]).decode("utf-8", "replace")
        if end < 0:
            return
        start, page = end + 1, page + 1


_PARSERS = {"pdf": read_pages, "text": text_pages}


def parser_named(name: str) -> Callable[[bytes], Iterable[tuple[int, str]]]:
    if name in _PARSERS:
        return _PARSERS[name]
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def store_at(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


@contextlib.contextmanager
def _opened(store: pafs.FileSystem, path: str):
    """A file's bytes: mapped if it is local, read otherwise."""
    if isinstance(store, pafs.LocalFileSystem):
        with open(path, "rb") as file:
            if file.seek(0, 2) == 0:
                yield b""
                return
            yield mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)  # goes with its last reader
    else:
        with store.open_input_file(path) as file:
            yield file.read()


def _signature(content) -> str:
    digest = hashlib.sha256()
    for at in range(0, len(content), 1 << 20):
        digest.update(content[at : at + (1 << 20)])
    return digest.hexdigest()[:32]


class Files(InputPartition):
    """(number, path) of each file of a partition."""

    def __init__(self, files: list[tuple[int, str]]):
        super().__init__(files)


def dealt(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """Files (number, path, bytes) in runs of about most bytes; a larger file stands alone."""
    out, run, held = [], [], 0
    for number, path, size in files:
        if run and held + size > most:
            out.append(Files(run))
            run, held = [], 0
        run.append((number, path))
        held += size
    return [*out, Files(run)] if run else out


_TESTS = {
    EqualTo: lambda name, value: name == value,
    In: lambda name, value: name in value,
    StringStartsWith: lambda name, value: name.startswith(value),
    StringEndsWith: lambda name, value: name.endswith(value),
    StringContains: lambda name, value: value in name,
}


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.suffix = options.get("suffix", ".pdf")
        self.parser = options.get("parser", "pdf")
        self.report = {"raise": False, "report": True}[options.get("onerror", "raise").lower()]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.wanted: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.__class__ in _TESTS and f.attribute == ("source",):
                self.wanted.append((f.__class__, f.value))
            else:
                yield f

    def files(self) -> list[tuple[int, str, int]]:
        """(number, path, bytes) of the files that are read."""
        store, folder = store_at(self.path)
        found = (f for f in store.get_file_info(pafs.FileSelector(folder)) if f.is_file and f.base_name.endswith(self.suffix))
        named = enumerate(sorted(found, key=lambda f: f.base_name))
        return [(n, f.path, f.size) for n, f in named if all(_TESTS[kind](f.base_name, value) for kind, value in self.wanted)]

    def partitions(self) -> list[InputPartition]:
        return dealt(self.files(), self.most) or [Files([])]

    def _rows(self, partition: Files) -> Iterator[tuple]:
        store, _ = store_at(self.path)
        parse = parser_named(self.parser)
        for number, path in partition.value:
            source = path.rsplit("/", 1)[-1]
            with _opened(store, path) as content:
                signature = _signature(content)
                try:
                    for page, text in parse(content):
                        if text := text.strip(_BLANKS):
                            yield number, source, page, text, signature, None
                except ValueError as e:
                    if not self.report:
                        raise (type(e) if isinstance(e, PdfError) else ValueError)(f"{source}: {e}") from e
                    yield number, source, None, None, signature, f"{type(e).__name__}: {e}"

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        rows, held = [], 0
        for row in self._rows(partition):
            rows.append(row)
            held += len(row[3] or "")
            if held >= BATCH_CHARS or len(rows) >= 4096:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


class FolderPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options)


def read_folder(spark: SparkSession, folder: str, suffix: str = ".pdf", **options) -> DataFrame:
    """The pages of a folder's files; options as above. Filters on source reach the list of files, for
    which spark.sql.python.filterPushdown.enabled is set in the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderPages)
    return spark.read.format("folder_pages").options(path=folder, suffix=suffix, **options).load()


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (source, content) as files of a folder; source and bytes of each. The write happens when
    the result is computed, and once more when it is computed again. A file appears whole: a task
    that is retried replaces what another try wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, at = store_at(folder)
        store.create_dir(at, recursive=True)
        for b in batches:
            sizes = []
            for source, content in zip(b.column("source"), b.column("content")):
                path = f"{at}/{source.as_py()}"
                passing = f"{at}/.{uuid.uuid4().hex}"
                with store.open_output_stream(passing) as out:
                    out.write(content.as_buffer())
                store.move(passing, path)
                sizes.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([b.column("source"), pa.array(sizes, pa.int64())], ["source", "bytes"])

    return map_batches(files.select("source", "content"), run, "source string, bytes long")
