"""Document folders: discovery, loaders by suffix, and their text with metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import html_text, markdown_text, suffix

# A loader turns the decoded content column into a struct of text and title.
Loader = Callable[[Column], Column]


def _struct(text: Column, title: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (title if title is not None else F.lit(None).cast("string")).alias("title"))


def _html(content: Column) -> Column:
    page = html_text(content)
    return _struct(page["text"], page["title"])


LOADERS: dict[str, Loader] = {
    ".txt": lambda c: _struct(c),
    ".md": lambda c: _struct(markdown_text(c)),
    ".html": _html,
    ".htm": _html,
}


def register_loader(extension: str, loader: Loader) -> None:
    """Add a loader for a suffix, or replace one."""
    LOADERS[extension.lower()] = loader


FILES_PER_FOLDER = 200


def write_documents(df: DataFrame, folder: str, group: str, text: str = "text") -> int:
    """One text file per row, in folders per ``group`` below ``folder``; returns their number.

    Tasks write their files themselves, without a commit per file on the driver. A file is named by
    its task and place, so a task that runs again replaces its own. Folders stay small, so
    that Spark lists them side by side.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder) if ":/" in folder else (pyarrow.fs.LocalFileSystem(), folder)
        part, places = TaskContext.get().partitionId(), {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = places[name] = places.get(name, -1) + 1
                below = f"{root}/group={'' if name is None else '=' + quote(name, safe='')}/{part:06d}-{n // FILES_PER_FOLDER:06d}"
                if n % FILES_PER_FOLDER == 0:
                    store.create_dir(below)
                with store.open_output_stream(f"{below}/{n:09d}.txt", compression=None) as out:
                    out.write(body.as_buffer())
                    out.write(b"\n")
        yield pa.RecordBatch.from_pydict({"files": pa.array([sum(n + 1 for n in places.values())], pa.int64())})

    rows = df.where(F.col(text).isNotNull()).select(F.col(group).cast("string"), F.col(text).cast("string"))
    return rows.mapInArrow(write, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


FOLDER_ROWS = 10_000
CONTENT_BYTES = 4 << 20


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's readers pass over."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


class _Folder:
    """Files below a folder, listed and read by the tasks: the driver holds only the folder's own name.

    Spark's reader keeps a list of all files on the driver, with an object and a share of a task for
    each. The rules are the reader's: names that begin with a dot or underscore, and empty files,
    are passed over, links are followed, and ``path`` has the same form.
    """

    def __init__(self, spark: SparkSession, uri: str, prefix: str, roots: list[tuple[str, int | None]]) -> None:
        self.spark, self.uri, self.prefix, self.roots = spark, uri, prefix, roots

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> _Folder | None:
        """None for what has no file, and for stores that only Spark opens."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        roots, uri, prefix = [], "", ""
        for status in found or ():
            uri = status.getPath().toUri().toString()
            try:
                below = pyarrow.fs.FileSystem.from_uri(uri)[1]
            except (pa.ArrowException, OSError, ValueError):
                return None
            if not status.getPath().toString().endswith(below):
                return None
            prefix = status.getPath().toString().removesuffix(below)
            if status.isDirectory():
                roots.append((below, None))
            elif not _hidden(status.getPath().getName(), False):
                roots.append((below, status.getLen()))
        # of overlapping patterns each file is listed once
        upper = {p.rstrip("/") + "/" for p, n in roots if n is None}
        roots = [(p, n) for p, n in dict(roots).items() if not any(p.startswith(u) for u in upper)]
        return cls(spark, uri, prefix, roots) if roots else None

    def files(self) -> DataFrame:
        """``(path, length)`` of every file. Folders are dealt anew on each of the upper levels."""
        uri, prefix = self.uri, self.prefix

        def listing(deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
            def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                store = pyarrow.fs.FileSystem.from_uri(uri)[0]
                rows: list[tuple[str, int | None]] = []
                for batch in batches:
                    for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        if length is not None:
                            rows.append((path, length))
                        folders = [path] if length is None else []
                        while folders:
                            for info in store.get_file_info(pyarrow.fs.FileSelector(folders.pop())):
                                folder = info.type == pyarrow.fs.FileType.Directory
                                if _hidden(info.base_name, folder):
                                    continue
                                if folder and deep:
                                    folders.append(info.path)
                                elif folder:
                                    rows.append((info.path, None))
                                elif info.type == pyarrow.fs.FileType.File and info.size:
                                    rows.append((info.path, info.size))
                            if len(rows) >= FOLDER_ROWS:
                                yield table(rows)
                                rows = []
                yield table(rows)

            return step

        def table(rows: list[tuple[str, int | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["path", "length"])

        out = self.spark.createDataFrame(self.roots, "path string, length long").coalesce(1)
        for _ in range(2):
            out = self._dealt(out.mapInArrow(listing(False), out.schema))
        out = out.mapInArrow(listing(True), out.schema).where("length > 0")
        return out.select(F.concat(F.lit(prefix), "path").alias("path"), "length")

    def contents(self, files: DataFrame) -> DataFrame:
        """``(path, length, content)`` of some of the files; a task holds a few megabytes, or one file."""
        uri, skip = self.uri, len(self.prefix)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store = pyarrow.fs.FileSystem.from_uri(uri)[0]
            for batch in batches:
                held, size, first = [], 0, 0
                for place, path in enumerate(batch.column(0).to_pylist()):
                    with store.open_input_file(path[skip:]) as file:
                        held.append(file.read())
                    size += len(held[-1])
                    if size >= CONTENT_BYTES or place == batch.num_rows - 1:
                        yield batch.slice(first, len(held)).append_column("content", pa.array(held, pa.binary()))
                        held, size, first = [], 0, place + 1

        return self._dealt(files.select("path", "length")).mapInArrow(read, "path string, length long, content binary")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        return rows.repartition(parts, "path")


def discover(spark: SparkSession, folder: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """Files below ``folder`` by suffix: path, type and size. Contents are not read.

    The folder is listed when the rows are read, by the tasks. Where only Spark opens the store, its own
    reader lists it, and the driver holds the list.
    """
    wanted = [e.lower() for e in (extensions or LOADERS)]
    below = _Folder.open(spark, folder)
    files = below.files() if below else spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", suffix(F.col("path")).alias("file_type"), F.col("length").alias("file_size_bytes")).where(
        F.col("file_type").isin(*wanted)
    )


def discovery_report(found: DataFrame) -> DataFrame:
    return found.groupBy("file_type").agg(F.count("*").alias("files"), F.sum("file_size_bytes").alias("bytes"))


def load_documents(spark: SparkSession, folder: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """Text of every file with a loader: ``(path, file_type, file_size_bytes, title, text)``.

    Bytes that are not UTF-8 are replaced. Each loader sees only its own files. Listed and read like ``discover``.
    """
    wanted = [e.lower() for e in (extensions or LOADERS)]
    unknown = [e for e in wanted if e not in LOADERS]
    if unknown:
        raise ValueError(f"No loader registered for extension {unknown[0]!r}. Supported: {list(LOADERS)}")
    below = _Folder.open(spark, folder)
    parts = []
    for e in wanted:
        if below:
            files = below.contents(below.files().where(suffix(F.col("path")) == e))
        else:
            # the glob keeps other loaders' files from being opened, whatever their case
            glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
        decoded = files.select(
            "path",
            suffix(F.col("path")).alias("file_type"),
            F.col("length").alias("file_size_bytes"),
            F.make_valid_utf8(F.col("content").cast("string")).alias("_content"),
        )
        mine = decoded.where(F.col("file_type") == e).withColumn("_doc", LOADERS[e](F.col("_content")))
        parts.append(mine.select("path", "file_type", "file_size_bytes", F.col("_doc.title").alias("title"), F.col("_doc.text").alias("text")))
    return reduce(DataFrame.unionByName, parts)
