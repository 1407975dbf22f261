"""Cutting lineage: tables in the shared folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Seconds from one trim to the next, and when the next one is due.
TRIM_S = 2.0
_DUE = {"at": 0.0}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder, removed at exit; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        made = tempfile.mkdtemp(prefix="arborql-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _OWN["dir"] = f"file://{made}"
    return _OWN["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arborql/{name}-{uuid.uuid4().hex}"


def trim(spark: SparkSession) -> None:
    """Hands the free native memory of the driver's JVM back to the system, every TRIM_S seconds at most.

    Each new plan is compiled; malloc keeps what the JVM's compilers free, by hundreds of
    megabytes over many plans, outside the heap and its limit. This is what jcmd's
    System.trim_native_heap does; a JVM without that command is left as it is.
    """
    now = time.monotonic()
    if now < _DUE["at"]:
        return
    _DUE["at"] = now + TRIM_S
    jvm, objects = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        args = objects(jvm.java.lang.Object, 4)  # the last two: no parameters, no signature
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By the interface's method: the server's own class isn't accessible.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(server, args)
    except Py4JError:
        _DUE["at"] = float("inf")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df once to a new table in the shared folder and reads it back.

    Unlike checkpoint() it computes df only once, and the copy is columnar. A lost
    executor costs nothing: the files are in the shared folder.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    trim(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._arborql_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize wrote for these tables; nothing may read them any more."""
    for df in tables:
        path = getattr(df, "_arborql_path", None)
        if path:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
