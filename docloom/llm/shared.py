"""Tables in the shared folder: lineage is cut by writing there, never locally."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when the query that wrote them ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that goes to a Python worker, at most (and one row at least).
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"
#: Small sides are merged like large ones: each broadcast costs the driver a thread, and its relation in the heap until the next collection.
MERGED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one below the warehouse, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/docloom-{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings are ``values`` inside, and as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trimmed(spark: SparkSession) -> str:
    """Return what the driver's JVM has freed outside its heap to the system; what the JVM says, or nothing where it can't do that.

    Each of a session's hundreds of threads frees memory into an arena of the C
    library, which keeps it: some 220 MB after two runs of the pipeline on sf0.01.
    """
    jvm = spark._jvm
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # by the public interface: py4j may not call the server's own class
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return invoke.invoke(beans, args)
    except Py4JError:  # not this JVM's or this system's
        return ""


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result has no lineage, so a lost executor costs a re-read and never a
    recomputation.  The query's shuffle files go with its end.  The folder stays
    until :func:`dropped` or the end of the job's shared folder.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, {CLEANUP: "true", BATCH[0]: BATCH[1]}):
        # hashes and ids hardly repeat: dictionaries would be built in vain
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    trimmed(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files behind tables made by :func:`written`; nothing may read them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def record(schema: str, **columns: object) -> pa.RecordBatch:
    """A record batch of the columns, cast to ``schema`` ("name:type ...")."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "bool": pa.bool_(), "str": pa.string(), "bin": pa.binary()}
    names = [x.split(":") for x in schema.split()]
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[n], pa.Array) else pa.array(x, kinds[k]) for n, k in names], [n for n, _ in names])
