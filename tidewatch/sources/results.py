"""Sets of result tables that appear together or not at all.

Every set is written into a folder of its own. When all of it is there, a small commit file that names the folder is moved into
place under the next number; a move cannot be seen half done and fails if the number is taken. Readers follow the highest
number, so they see one whole set, the earlier one while another is written or after a writer was lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..runtime import delete_path, list_names
from .tables import write_table

COMMITS = "_commits"


def _commits(spark: SparkSession, out: str) -> list[int]:
    return sorted(int(n) for n in list_names(spark, f"{out}/{COMMITS}") if n.isdigit())


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, out: str, folder: str) -> None:
    draft, files = _file_system(spark, f"{out}/{COMMITS}/draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(folder.encode()))
    stream.close()
    number = max(_commits(spark, out), default=-1) + 1
    while True:
        place, _ = _file_system(spark, f"{out}/{COMMITS}/{number:08}")
        if not files.exists(place) and files.rename(draft, place):
            return
        number += 1


def _folder(spark: SparkSession, out: str, number: int) -> str:
    text = spark.read.option("wholetext", True).text(f"{out}/{COMMITS}/{number:08}").first()[0]
    return f"{out}/{text.strip()}"


def publish(spark: SparkSession, out: str, tables: Mapping[str, DataFrame],
            more: Mapping[str, Callable[[str], None]] | None = None, keep: int = 2) -> str:
    """Writes the tables, and what the functions of ``more`` write to the paths they are given, as one set; returns its folder.

    The last ``keep`` sets stay for readers that have opened them. A set that was begun and not committed stays invisible.
    """
    folder = f"set-{uuid.uuid4().hex}"
    for name, df in tables.items():
        write_table(df, f"{out}/{folder}/{name}")
    for name, write in (more or {}).items():
        write(f"{out}/{folder}/{name}")
    _commit(spark, out, folder)
    for number in _commits(spark, out)[:-keep]:
        delete_path(spark, _folder(spark, out, number))
        delete_path(spark, f"{out}/{COMMITS}/{number:08}")
    return f"{out}/{folder}"


def current(spark: SparkSession, out: str) -> str:
    """The folder of the set published last."""
    numbers = _commits(spark, out)
    if not numbers:
        raise FileNotFoundError(f"nothing has been published in {out}")
    return _folder(spark, out, numbers[-1])
