"""Document folders: listing, include/exclude globs, content and what git says of them."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions.text import glob_filter, glob_regex
from pagelode.session import cut_lineage
from pagelode.sources.fs import open_folder

LISTING = "path string, mtime double, size bigint"
#: Bytes of content that a task hands on at once.
READ_BYTES = 16 << 20


def closed_folder(exclude: list[str]) -> re.Pattern[str]:
    """Matches a folder that is excluded, or all of whose content is (it matches a pattern that ends in ``/**`` once a slash is added)."""
    return re.compile("|".join(glob_regex(p) for p in exclude) or r"(?!)")


def _children(uri: str, exclude: list[str]):
    """A step of the walk: folders in, their files and subfolders out."""
    import pandas as pd
    from pyarrow.fs import FileSelector, FileType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = open_folder(uri)
        root = root.rstrip("/")
        closed = closed_folder(exclude)
        names = ["path", "is_dir", "mtime", "size"]
        for batch in batches:
            for folder in batch["path"]:
                rows = []
                for info in system.get_file_info(FileSelector(f"{root}/{folder}" if folder else root)):
                    path = info.path[len(root) :].lstrip("/")
                    if info.type == FileType.Directory:
                        if not closed.match(path) and not closed.match(path + "/"):
                            rows.append((path, True, None, None))
                    elif info.type == FileType.File:
                        rows.append((path, False, info.mtime_ns / 1e6 if info.mtime_ns is not None else None, info.size))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return run


def list_files(spark: SparkSession, root: str, include: list[str], exclude: list[str]) -> DataFrame:
    """(path, mtime, size) of the matching files, relative to ``root``; empty files are listed too.

    The walk goes down level by level, and the folders of a level are listed by as many
    tasks as there are; excluded folders are not entered. The driver holds no paths.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([("",)], "path string")
    found: list[DataFrame] = []
    while True:
        listed = cut_lineage(level.mapInPandas(_children(root, exclude), "path string, is_dir boolean, mtime double, size bigint"))
        found.append(listed.where("NOT is_dir").select("path", "mtime", "size"))
        folders = listed.where("is_dir").select("path")
        if folders.isEmpty():
            break
        level = folders.repartition(tasks, "path")
    return reduce(DataFrame.unionByName, found).where(glob_filter(F.col("path"), include, exclude))


def read_texts(listing: DataFrame, root: str) -> DataFrame:
    """The listing with ``text``, the content read as UTF-8 by the tasks that hold the rows; no content is shuffled.

    A file that is empty has text ''; one that vanished since it was listed gives no row.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(root)
        names = ["path", "mtime", "size", "text"]
        for batch in batches:
            rows, held = [], 0
            for path, mtime, size in batch[["path", "mtime", "size"]].itertuples(index=False):
                try:
                    with system.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as f:
                        text = f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    continue
                rows.append((path, mtime, size, text))
                held += len(text)
                if held > READ_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return listing.select("path", "mtime", "size").mapInPandas(run, f"{LISTING}, text string")


def read_documents(spark: SparkSession, root: str, include: list[str], exclude: list[str]) -> DataFrame:
    """(path, text, mtime, size) of the matching files."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_texts(list_files(spark, root, include, exclude).repartition(tasks, "path"), root).select("path", "text", "mtime", "size")


def is_git_root(root: str) -> bool:
    """Whether git calls the folder the top of a work tree; no where git is not there."""
    try:
        got = subprocess.run(["git", "-C", root, "rev-parse", "--show-prefix"], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.SubprocessError):
        return False
    return got.returncode == 0 and got.stdout.strip() == ""


def git_status(spark: SparkSession, root: str) -> DataFrame | None:
    """(line) of ``git status --porcelain``, or None where the folder is no git root or git fails."""
    if not is_git_root(root):
        return None
    try:
        got = subprocess.run(["git", "-C", root, "status", "--porcelain", "-uall"], capture_output=True, text=True, timeout=600)
    except (OSError, subprocess.SubprocessError):
        return None
    if got.returncode:
        return None
    return spark.createDataFrame([(x,) for x in got.stdout.splitlines()], "line string")
