"""Named numpy arrays in one file of the shared folder, memory-mapped by every Python worker that reads it."""

from __future__ import annotations

import json
import mmap

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from tidewatch.runtime import new_path

ALIGN = 64
_mapped: dict[str, dict[str, np.ndarray]] = {}


def publish(spark: SparkSession, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes the arrays and has Spark hand the file to each executor once. Returns the name to map it by."""
    places, body = {}, bytearray()
    for key, a in arrays.items():
        body += bytes(-len(body) % ALIGN)
        places[key] = (a.dtype.str, len(body), len(a))
        body += np.ascontiguousarray(a).tobytes()
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 8) % ALIGN)
    path = new_path(spark, name)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(len(head).to_bytes(8, "little") + head + body))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def mapped(name: str) -> dict[str, np.ndarray]:
    """The arrays of a published file, as views of its pages: nothing is read before it is touched, and the workers of
    an executor share the pages."""
    if name not in _mapped:
        with open(SparkFiles.get(name), "rb") as f:
            pages = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(pages[:8], "little")
        _mapped[name] = {key: np.frombuffer(pages, dtype, count, 8 + n + at)
                         for key, (dtype, at, count) in json.loads(pages[8:8 + n]).items()}
    return _mapped[name]
