"""The files of a judge run."""

import gzip
import json

from pyspark.sql import functions as F

from tracelens.sources import sinks


def test_judgments_take_little_space(spark, tmp_path):
    rows = spark.range(2000, numPartitions=1).select(F.col("id").alias("seq"), F.lit(None).cast("string").alias("execution_error"), F.lit("searched and found").alias("prompt"))
    assert sinks.write_judgments(rows, str(tmp_path / "o"), False, [F.count(F.lit(1)).alias("written")]) == {"written": 2000}
    sinks.write_judgments(rows.limit(1), str(tmp_path / "o"), True)
    files = list((tmp_path / "o").glob("part-*"))
    lines = [json.loads(x) for f in files for x in gzip.open(f, "rt")]
    assert sum(f.stat().st_size for f in files) < 40 * 1000
    assert sorted(x["seq"] for x in lines) == sorted([0, *range(2000)]) and lines[0] == {"seq": lines[0]["seq"], "execution_error": None, "prompt": "searched and found"}
    assert spark.read.json(str(tmp_path / "o")).count() == 2001
