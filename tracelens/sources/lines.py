"""Lines of text files by number: an index of byte offsets beside the files, whole reads by it, and single lines by a seek.

One pass over the files, in byte ranges, counts the lines that begin in each range and notes where every MARK-th begins. The ranges'
counts, summed, give the lines' numbers. The index is a table of marks: file, line_num and offset of a line, and how many lines
are read from there. Later reads go by marks: all of them, each file's bytes once, or those that hold wanted lines alone.

Lines end at a newline; a carriage return before it goes. Blank lines count. What is no UTF-8 is read with replacement characters.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.sources.artifacts import store_of
from tracelens.workers import ship

#: Lines between two marks, bytes of a range that one row of work counts, and bytes that are read at once.
MARK, RANGE, CHUNK = 1000, 64 << 20, 1 << 20


def _starts(path: str, begin: int, end: int) -> np.ndarray:
    """Where lines begin in the bytes from begin up to end."""
    fs, name = store_of(path)
    found = [np.zeros(1, np.int64)] if begin == 0 and end > 0 else []
    with fs.open_input_file(name) as f:
        at = max(begin - 1, 0)
        while at < end - 1:
            data = f.read_at(min(CHUNK, end - 1 - at), at)
            if not data:
                break
            found.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + at + 1)
            at += len(data)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _lines(path: str, offset: int, n: int) -> list[str]:
    """n lines from offset on."""
    fs, name = store_of(path)
    data = b""
    with fs.open_input_file(name) as f:
        f.seek(offset)
        pieces, seen = [], 0
        while seen < n and (data := f.read(CHUNK)):
            pieces.append(data)
            seen += data.count(b"\n")
    return [x.removesuffix(b"\r").decode("utf-8", "replace") for x in b"".join(pieces).split(b"\n")[:n]]


def write_index(spark: SparkSession, path: str, index: str, mark: int = MARK, span: int = RANGE) -> None:
    """The marks of the files below path, as a table in the folder index."""
    ship()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, begin, end in zip(*[batch.column(c).to_pylist() for c in ("file", "begin", "end")]):
                starts = _starts(file, begin, end)
                offsets = [int(x) for x in starts[::mark]]
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([begin], pa.int64()), pa.array([len(starts)], pa.int64()), pa.array([offsets], pa.list_(pa.int64()))], ["file", "begin", "n", "offsets"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length").filter("length > 0")
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(span).cast("long"))).alias("begin"))
    ranges = ranges.select("file", "begin", F.least("length", F.col("begin") + span).alias("end")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "begin")
    counted = ranges.mapInArrow(count, "file string, begin long, n long, offsets array<long>")
    earlier = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)  # a file's ranges
    counted = counted.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    marks = counted.select("file", "base", "n", F.posexplode("offsets").alias("k", "offset"))
    marks = marks.select("file", (F.col("base") + F.col("k") * mark + 1).alias("line_num"), "offset", F.least(F.lit(mark).cast("long"), F.col("n") - F.col("k") * mark).alias("lines"))
    marks.repartitionByRange("file", "line_num").sortWithinPartitions("file", "line_num").write.mode("overwrite").parquet(index)


def _read(marks: DataFrame) -> DataFrame:
    """file, line_num, line of all lines of the marks."""
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number, offset, n in zip(*[batch.column(c).to_pylist() for c in ("file", "line_num", "offset", "lines")]):
                some = _lines(file, offset, n)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(some)), pa.array(range(number, number + len(some)), pa.int64()), pa.array(some, pa.string())], ["file", "line_num", "line"])

    return marks.select("file", "line_num", "offset", "lines").mapInArrow(run, "file string, line_num long, line string")


def read_lines(spark: SparkSession, index: str) -> DataFrame:
    """file, line_num, line: every line of the indexed files."""
    return _read(spark.read.parquet(index).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def lookup(spark: SparkSession, index: str, wanted: DataFrame, mark: int = MARK) -> DataFrame:
    """The lines of wanted (file, line_num) that there are, each once: only the blocks that hold them are read."""
    marks, at = spark.read.parquet(index), lambda c: F.floor(c / mark)
    asked = wanted.select(F.col("file").alias("its_file"), F.col("line_num").alias("wanted")).distinct().withColumn("bucket", at(F.col("wanted")))
    # A mark's lines lie in one or two buckets of that many numbers.
    ends = F.array_distinct(F.array(at(F.col("line_num")), at(F.col("line_num") + F.col("lines") - 1)))
    held = marks.withColumn("in", F.explode(ends)).join(asked, (F.col("file") == F.col("its_file")) & (F.col("in") == F.col("bucket")))
    held = held.filter((F.col("wanted") >= F.col("line_num")) & (F.col("wanted") < F.col("line_num") + F.col("lines")))
    found = _read(held.select("file", "line_num", "offset", "lines").distinct())
    return found.join(asked, (F.col("file") == F.col("its_file")) & (F.col("line_num") == F.col("wanted")), "left_semi")


def inside(root: str, file: str) -> str:
    """The path of a file below root; one that leads out of it raises."""
    whole = posixpath.normpath(posixpath.join(root, file))
    if not whole.startswith(root.rstrip("/") + "/"):
        raise PermissionError(f"{file} is not below {root}")
    return whole


def line_at(spark: SparkSession, index: str, root: str, file: str, number: int) -> str:
    """A line of a file below root; without such a line LookupError is raised."""
    wanted = spark.createDataFrame([(inside(root, file), number)], "file string, line_num long")
    names = spark.read.parquet(index).select("file").filter(F.endswith("file", F.lit(inside(root, file)))).limit(1).collect()
    found = lookup(spark, index, wanted.withColumn("file", F.lit(names[0][0])), MARK).collect() if names else []
    if not found:
        raise LookupError(f"{file} has no line {number}")
    return found[0]["line"]
