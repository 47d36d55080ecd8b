"""Source files and graph documents as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from fnmatch import fnmatchcase
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import glob_regex
from .shared import spool

EXCLUDED_FOLDERS = (".venv", "__pycache__")
LANGUAGES = {"py": "python", "html": "html", "css": "css"}
#: Entries that a task lists before it gives the folders that are left to the next round; bytes of files
#: that a task reads, about.
LISTED, READ_BYTES = 20_000, 64_000_000


def load_exclusions(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(folders, name patterns) of a rules file: {"scan_policy": {"exclude_dirs": [...],
    "exclude_file_patterns": [...]}}.  The folders that are always left out come first; a file that is
    missing or unreadable adds none."""
    policy = read_document(spark, path).get("scan_policy")
    listed = lambda k: [x for x in policy.get(k) or () if isinstance(x, str)] if isinstance(policy, dict) else []
    return tuple(dict.fromkeys((*EXCLUDED_FOLDERS, *listed("exclude_dirs")))), tuple(listed("exclude_file_patterns"))


def read_document(spark: SparkSession, path: str) -> dict:
    """A small JSON object, wherever Spark's file system finds it; {} if there is none that can be read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    try:
        found = json.loads(bytes(spark.sparkContext.binaryFiles(path).values().first()))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _listing(uri: str, pattern: str, folders: tuple[str, ...]):
    """For mapInArrow over (folder): (path, n_bytes, folder) of the files in it and below; of more than
    LISTED entries, folders that are still to be listed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(uri)
        for b in batches:
            rows, todo, n = [], b.column(0).to_pylist(), 0
            while todo and n < LISTED:
                for f in fs.get_file_info(FileSelector(todo.pop(), allow_not_found=True)):
                    n += 1
                    if f.type == FileType.Directory:
                        if f.base_name not in folders:
                            todo.append(f.path)
                    elif f.type == FileType.File and fnmatchcase(f.base_name, pattern):
                        rows.append((f.path, f.size, False))
            rows += [(d, None, True) for d in todo]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], ["path", "n_bytes", "folder"])

    return run


def _listed(spark: SparkSession, uri: str, pattern: str, folders: tuple[str, ...]) -> DataFrame:
    """(path, n_bytes) of the files below uri or, if it is one, of that file; listed by the executors."""
    fs, base = FileSystem.from_uri(uri)
    (top,) = fs.get_file_info([base])
    if top.type == FileType.NotFound:
        raise FileNotFoundError(uri)
    if top.type == FileType.File:
        return spark.createDataFrame([(top.path, top.size)], "path string, n_bytes long")
    todo, parts = spark.createDataFrame([(base,)], "folder string"), []
    while True:
        found = spool(todo.mapInArrow(_listing(uri, pattern, folders), "path string, n_bytes long, folder boolean"), "listing")
        parts.append(found.where("NOT folder").select("path", "n_bytes"))
        n = found.where("folder").count()
        if not n:
            return reduce(DataFrame.unionAll, parts)
        todo = found.where("folder").select(F.col("path").alias("folder")).repartition(min(n, 10_000))


def _contents(uri: str):
    """For mapInArrow over (path, n_bytes): with content and error, one of which is null."""
    schema = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("content", pa.string()), ("error", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(uri)
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = error = None
                try:
                    with fs.open_input_stream(path) as f:
                        text = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{"path": path, "n_bytes": size, "content": text, "error": error}], schema=schema)

    return run


def scan_files(spark: SparkSession, root: str, pattern: str = "*.py", folders: tuple[str, ...] = EXCLUDED_FOLDERS, names: tuple[str, ...] = (), content: bool = True) -> DataFrame:
    """(path, language, n_bytes, content, error) of the files below root, or of root itself if it is a
    file; names that begin with _ or a dot count too.  A file that can't be read or isn't UTF-8 has an
    error and no content.

    Paths are relative to root, and so are the folders that exclude: where the project lies doesn't
    matter.  Without content only the listing is read.  The executors list and read, all through the
    file system that Spark finds root in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    fs, base = FileSystem.from_uri(uri)
    (top,) = fs.get_file_info([base])
    base = (base.rpartition("/")[0] if top.type == FileType.File else base.rstrip("/")) + "/"
    found = _listed(spark, uri, pattern, folders)
    keep = F.lit(True)
    for n in names:
        keep = keep & ~F.element_at(F.split("path", "/"), -1).rlike(glob_regex(n, loose=False))
    found = found.where(keep)
    if content:
        size = found.agg(F.sum("n_bytes")).first()[0] or 0
        found = found.repartition(size // READ_BYTES + 1).mapInArrow(_contents(uri), "path string, n_bytes long, content string, error string")
    language = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[F.element_at(F.split("path", r"\."), -1)]
    return found.select(F.substring("path", F.lit(len(base) + 1), F.length("path")).alias("path"), language.alias("language"), "n_bytes", *(("content", "error") if content else ()))


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")
