"""A sink of one indented JSON file an article, and a copy of chosen files with their names and times.

Tasks write their files to a folder aside; only when all of them are done does the driver move the files
to their names, each move replacing an earlier file at once. So a failing run leaves what was there, and of several runs
the last one wins. Folders are paths, or addresses of a store that pyarrow knows, that tasks and driver share.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from foliospark.session import ship_package
from foliospark.sources.files import file_name

ASIDE = "_aside-"
MOVES_AT_ONCE = 16


def name_of(key: str) -> str:
    """A file's name for a key: the key itself, but for what can't stand in a name."""
    return urllib.parse.quote(key, safe=" !()+,;=@[]{}~'") + ".json"


def store(folder: str):
    """(file system, path in it) of a path or an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder.removeprefix("file:")))


@dataclass
class _Written(WriterCommitMessage):
    """What a task wrote: the folder of its files, and how many there are."""

    folder: str
    n: int


class _Writer(DataSourceWriter):
    def __init__(self, options, schema):
        self.folder, self.key = options["path"], options.get("key", "file_id")
        self.names, self.aside = [f.name for f in schema], f"{ASIDE}{uuid.uuid4().hex}"
        if self.key not in self.names:
            raise ValueError(f"no column {self.key!r} to name files by")

    def write(self, iterator):
        files, top = store(self.folder)
        folder, n = f"{top}/{self.aside}/{uuid.uuid4().hex}", 0
        files.create_dir(folder, recursive=True)
        for row in iterator:
            values = row.asDict(recursive=True)
            key = values.pop(self.key)
            if not key:
                continue
            text = json.dumps({k: values[k] for k in self.names if k != self.key}, ensure_ascii=False, indent=4, default=str)
            with files.open_output_stream(f"{folder}/{name_of(key)}") as out:
                out.write(text.encode())
            n += 1
        return _Written(folder, n)

    def commit(self, messages):
        from pyarrow import fs

        files, top = store(self.folder)
        with ThreadPoolExecutor(MOVES_AT_ONCE) as movers:
            for m in messages:
                if m is not None and m.n:
                    found = files.get_file_info(fs.FileSelector(m.folder))
                    list(movers.map(lambda f: files.move(f.path, f"{top}/{f.base_name}"), found))
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self) -> None:
        files, top = store(self.folder)
        if files.get_file_info(f"{top}/{self.aside}").is_file or files.get_file_info(f"{top}/{self.aside}").type.name == "Directory":
            files.delete_dir(f"{top}/{self.aside}")


class ArticleFiles(DataSource):
    @classmethod
    def name(cls):
        return "article_files"

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema)


def write_article_files(articles: DataFrame, folder: str, key: str = "file_id") -> None:
    """One file a row, named by its key, which must be distinct (operators.articles.last_written); rows without one are left out."""
    ship_package(articles.sparkSession)
    articles.sparkSession.dataSource.register(ArticleFiles)
    articles.write.format("article_files").mode("append").option("path", folder).option("key", key).save()


def copy_files(chosen: DataFrame, source: str, folder: str, name: str = "file_name") -> DataFrame:
    """(file_name, length, modified) of the files of source that chosen names, copied by the tasks with names, bytes and,
    where the store holds them, times. Spark reads them, so source may be any store that it knows. Writing the
    result runs the copy (Spark reads no empty files, so those are left out); a copied file stands under its name only when it is whole."""
    ship_package(chosen.sparkSession)
    files = chosen.sparkSession.read.format("binaryFile").load(source).select(file_name().alias("file_name"), "length", "content", F.unix_micros("modificationTime").alias("micros"))
    wanted = files.join(chosen.select(F.col(name).alias("file_name")).distinct(), "file_name", "left_semi")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        place, top = store(folder)
        place.create_dir(top, recursive=True)
        for b in batches:
            for file, content, micros in zip(b["file_name"].to_pylist(), b["content"].to_pylist(), b["micros"].to_pylist(), strict=True):
                aside = f"{top}/{ASIDE}{uuid.uuid4().hex}"
                with place.open_output_stream(aside) as out:
                    out.write(content)
                if isinstance(place, fs.LocalFileSystem):
                    os.utime(aside, ns=(micros * 1000, micros * 1000))
                place.move(aside, f"{top}/{file}")
            yield pa.RecordBatch.from_arrays([b["file_name"], b["length"], b["micros"]], names=["file_name", "length", "micros"])

    copied = wanted.mapInArrow(run, "file_name string, length long, micros long")
    return copied.select("file_name", "length", F.timestamp_micros("micros").alias("modified"))
