"""Results kept as whole versions; one small file names the valid ones and is replaced in one step.

A reader takes the file first and then only the folders it names, so it never sees half a change. Folders that a change makes
superfluous go with the change after it, so that who read the file just before still finds them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "_valid.json"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_pointer(spark: SparkSession, path: str) -> dict:
    """What the folder's file says; empty where there is none yet."""
    fs, p = _files(spark, f"{path}/{_POINTER}")
    if not fs.exists(p):
        return {}
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_pointer(spark: SparkSession, path: str, value: dict) -> None:
    fs, target = _files(spark, f"{path}/{_POINTER}")
    _, draft = _files(spark, f"{path}/{_POINTER}.{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, how)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


# ------------------------------------------------------------------ runs that supersede each other


def commit_run(result: DataFrame, path: str, run: int) -> None:
    """Keep `result` as the given run and make it the only active one; earlier runs stay readable. A repeated run replaces itself."""
    spark = result.sparkSession
    result.write.mode("overwrite").parquet(f"{path}/run-{run}")
    runs = [r for r in read_pointer(spark, path).get("runs", []) if r != run]
    write_pointer(spark, path, {"runs": [*runs, run]})


def read_runs(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """Rows of all runs with `run` and `is_active`; with `as_of`, as things stood after that run."""
    runs = read_pointer(spark, path).get("runs", [])
    if as_of is not None:
        runs = runs[: runs.index(as_of) + 1]
    out = None
    for r in runs:
        rows = spark.read.parquet(f"{path}/run-{r}").withColumns({"run": F.lit(r).cast("long"), "is_active": F.lit(r == runs[-1])})
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no run in {path}")
    return out


def active_run(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """Rows of the run that counts, now or after run `as_of`."""
    return read_runs(spark, path, as_of).filter("is_active").drop("run", "is_active")


# ------------------------------------------------------------------ levels of merged versions


def _newest(spark: SparkSession, path: str, names: list[str], keys: list[str], schema) -> DataFrame:
    """The newest row per key of folders that are named from old to new."""
    out = None
    for n, name in enumerate(names):
        rows = spark.read.schema(schema).parquet(f"{path}/{name}").withColumn("_version", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    values = [c for c in out.columns if c not in (*keys, "_version")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*values), "_version").alias("v")).select(*keys, "v.*")


def add_version(changed: DataFrame, path: str, batch_id: int, keys: list[str], fanout: int = 8) -> None:
    """Add the changed rows of a batch; `fanout` versions of a level become one of the next, so that after n batches there are
    at most fanout * log(n) folders. A batch that runs again changes nothing once it is in the file."""
    spark = changed.sparkSession
    state = read_pointer(spark, path) or {"batch": -1, "valid": [], "gone": []}
    if batch_id <= state["batch"]:
        return
    schema, valid, gone = changed.schema, [*state["valid"], [0, f"v0-{batch_id}"]], []
    changed.write.mode("overwrite").parquet(f"{path}/v0-{batch_id}")
    level = 0
    while len(full := [name for at, name in valid if at == level]) >= fanout:
        merged = f"v{level + 1}-{batch_id}"
        _newest(spark, path, full, keys, schema).write.mode("overwrite").parquet(f"{path}/{merged}")
        # Older versions are on higher levels and before these: the order of the list stays the order of time.
        valid = [v for v in valid if v[0] != level] + [[level + 1, merged]]
        gone += full
        level += 1
    write_pointer(spark, path, {"batch": batch_id, "valid": valid, "gone": gone, "schema": schema.json()})
    for name in state["gone"]:
        remove(spark, f"{path}/{name}")


def current_version(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key."""
    from pyspark.sql.types import StructType

    state = read_pointer(spark, path)
    if not state:
        raise ValueError(f"no version in {path}")
    return _newest(spark, path, [name for _, name in state["valid"]], keys, StructType.fromJson(json.loads(state["schema"])))
