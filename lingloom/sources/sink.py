"""Files as the output of a job: each row's bytes under its own name, all of them or none.

A Python data source: tasks write into a staging folder, one for each attempt, and the driver moves what the successful
attempts wrote to its place when all have ended. A failed job, or a name that comes twice, leaves nothing but what was
there before. The folder is one that pyarrow's file systems reach (a path, file:, hdfs:, s3: or gs:) and that all machines
share. The driver moves the files in a few threads; it holds a number of eight bytes for each of them, not their names or bytes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import blake2b
from itertools import islice

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.dimensions import output_name
from .listing import entries, store_of

FORMAT = "lingloom_files"
#: Threads and moves of each at once: the names of so many are held.
MOVERS, AT_ONCE = 16, 256


@dataclass
class Written(WriterCommitMessage):
    folder: str
    rows: int


class FileWriter(DataSourceArrowWriter):
    """The staging folder is made once, before any task. Tasks only make folders in it, so what still runs when a failed job's
    folder is deleted can't bring it back."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root.rstrip('/')}/_staging-{self.run}"

    def begin(self) -> FileWriter:
        store, root = store_of(self.path)
        store.create_dir(self._staging(root))
        return self

    def write(self, iterator: Iterator) -> Written:
        store, root = store_of(self.path)
        task = TaskContext.get()
        folder = f"{self._staging(root)}/{task.partitionId()}-{task.taskAttemptId()}"
        rows = 0
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                if not name or "/" in name or name.startswith(("_", ".")):
                    raise ValueError(f"no name for a file: {name!r}")
                if not rows:
                    store.create_dir(folder, recursive=False)
                with store.open_output_stream(f"{folder}/{name}") as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                rows += 1
        return Written(folder, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        written = [m for m in messages if m and m.rows]
        if _repeated(store, written):
            self.abort(messages)
            raise ValueError("two rows of one name")

        def move(names: list[str], folder: str) -> None:
            for n in names:
                store.move(f"{folder}/{n}", f"{root.rstrip('/')}/{n}")

        with ThreadPoolExecutor(MOVERS) as pool:
            for m in written:
                names = (e.name for e in entries(store, m.folder))
                while some := list(islice(names, MOVERS * AT_ONCE)):
                    list(pool.map(move, (some[k::MOVERS] for k in range(MOVERS)), [m.folder] * MOVERS))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        for k in range(50):  # tasks of a failed job may still write into it for a moment
            if store.get_file_info(self._staging(root)).type == fs.FileType.NotFound:
                return
            try:
                store.delete_dir(self._staging(root))
            except OSError:
                time.sleep(0.1 * min(k, 10))
        store.delete_dir(self._staging(root))


def _repeated(store, written: list[Written]) -> bool:
    """Whether a name comes twice: in one task, which then has fewer files than rows, or in two."""
    import numpy as np

    number = lambda name: int.from_bytes(blake2b(name.encode(), digest_size=8).digest())
    parts = []
    for m in written:
        parts.append(np.fromiter((number(e.name) for e in entries(store, m.folder)), "u8"))
        if len(parts[-1]) < m.rows:
            return True
    every = np.sort(np.concatenate(parts)) if parts else np.empty(0, "u8")
    twice = set(every[1:][every[1:] == every[:-1]].tolist())
    names = [e.name for m in written for e in entries(store, m.folder) if number(e.name) in twice] if twice else []
    return len(names) > len(set(names))


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options["path"]).begin()


def write_files(files: DataFrame, path: str) -> None:
    """files(name, content) as files in a folder; a null content is an empty file, files of other names stay."""
    files.sparkSession.dataSource.register(FileSink)
    files.select("name", F.col("content").cast("binary").alias("content")).write.format(FORMAT).mode("append").option("path", path).save()


def named_outputs(files: DataFrame, target_lang: Column, languages: DataFrame) -> DataFrame:
    """files(doc_id, file_name) with the name of their translation. Names that come again, from other folders, get a number by
    doc_id: 'a_hindi.docx', 'a_hindi (2).docx'."""
    named = output_name(files.withColumn("_lang", target_lang), "file_name", "_lang", languages, "_name").drop("_lang")
    nth = F.row_number().over(Window.partitionBy("_name").orderBy("doc_id"))
    again = F.regexp_replace("_name", r"^(.*?)(\.[^.]*)?$", F.concat(F.lit("$1 ("), nth.cast("string"), F.lit(")$2")))
    return named.withColumn("name", F.when(nth == 1, F.col("_name")).otherwise(again)).drop("_name")


def export_documents(files: DataFrame, segments: DataFrame, results: DataFrame, path: str, target_lang: Column, languages: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """Every file that the gates let through, with its translations, under its translation's name in a folder; returns
    (doc_id, name) of what was written."""
    from .rewrite import write_documents

    names = named_outputs(files.select("doc_id", "file_name"), target_lang, languages).select("doc_id", "name")
    written = write_documents(files, segments, results, gates).join(names, "doc_id")
    write_files(written, path)
    return names if gates is None else names.join(gates.where("blocked").select("doc_id"), "doc_id", "left_anti")
