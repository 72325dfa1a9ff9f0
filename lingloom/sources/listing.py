"""What a folder holds, as rows that tasks make: the driver sees no file's name, and a file costs no plan of its own."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch of names; bytes after which a batch of contents is handed on.
NAMES, CONTENT = 10_000, 8 * 1024 * 1024


def store_of(path: str):
    """(file system, path in it) of a path or URI that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))


def entries(store, folder: str) -> Iterator:
    """What a folder holds itself: name, path, is_dir() and size() of each, in no order."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                yield _Entry(e.name, e.path, e.is_dir, lambda e=e: e.stat().st_size)
    else:
        for i in store.get_file_info(fs.FileSelector(folder)):
            yield _Entry(i.base_name, i.path, lambda i=i: i.type == fs.FileType.Directory, lambda i=i: i.size)


class _Entry:
    __slots__ = ("is_dir", "name", "path", "size")

    def __init__(self, name, path, is_dir, size):
        self.name, self.path, self.is_dir, self.size = name, path, is_dir, size


def hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def below(path: str) -> Iterator[tuple[str, int]]:
    """(path as Spark's readers write it, length) of each file below a path, whatever its depth."""
    from pyarrow import fs

    store, root = store_of(path)
    local = isinstance(store, fs.LocalFileSystem)
    base = f"file:{root}" if local else path
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        yield base, info.size
        return
    open_folders = [root.rstrip("/")]
    while open_folders:
        for e in entries(store, open_folders.pop()):
            if hidden(e.name):
                continue
            if e.is_dir():
                open_folders.append(e.path)
            else:
                yield base.rstrip("/") + e.path[len(root.rstrip("/")) :], e.size()


def as_pattern(glob: str) -> str:
    """A file name's glob, with classes and alternatives in braces, as a regular expression."""
    out, depth, k = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if c == "[" and (end := glob.find("]", k + 2)) > 0:
            out += "[" + re.sub(r"^!", "^", glob[k + 1 : end]).replace("\\", r"\\") + "]"
            k = end
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out += re.escape(glob[k])
        else:
            depth += (c == "{") - (c == "}")
            out += {"*": ".*", "?": ".", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
        k += 1
    return out


def reached(path: str) -> bool:
    """Whether a path can be listed by tasks: no glob, and of a store that pyarrow knows."""
    try:
        return not re.search(r"[*?\[{]", path) and bool(store_of(path))
    except (ImportError, OSError, ValueError):
        return False


def list_files(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """(path, length) of every file below a path whose name fits, as it is when the rows are made. One task walks the folders,
    and hands on names as it finds them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fits = re.compile(as_pattern(names), re.S).fullmatch
        for _ in batches:
            rows: list[tuple[str, int]] = []
            for name, length in below(path):
                if fits(name.rpartition("/")[2]):
                    rows.append((name, length))
                if len(rows) == NAMES:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["path", "length"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["path", "length"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "path string, length long")


def open_files(listed: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(path, length, content) of listed(path, length), opened in tasks; of files over max_bytes no content is read."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, held = [], 0
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                content = None
                if max_bytes is None or length <= max_bytes:
                    store, at = store_of(name)
                    with store.open_input_stream(at, compression=None) as file:
                        content = file.read()
                    held += len(content)
                rows.append((name, length, content))
                if held >= CONTENT:
                    yield _batch(pa, rows)
                    rows, held = [], 0
            if rows:
                yield _batch(pa, rows)

    tasks = 4 * listed.sparkSession.sparkContext.defaultParallelism
    return listed.select("path", "length").repartition(tasks, F.col("path")).mapInArrow(run, "path string, length long, content binary")


def _batch(pa, rows: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["path", "length", "content"])
