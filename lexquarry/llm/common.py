"""What the operators of this subpackage share: tables, the shared folder, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from lexquarry.sources.shared import scratch, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS = 1024
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df; Python gets its rows in batches of at most ROWS from now on (texts and pages are large; the default is 10,000)."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH)) <= ROWS:
        conf.set(BATCH, ROWS)
    return df


def saved(df: DataFrame, name: str, rows: int | None = None, few: str = "") -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again with the same schema.

    rows: about how many there are, where that is known: small tables make few files. few: for
    tables much smaller than what they are made of, an eighth of the usual files, by coalesce
    (after a shuffle) or repartition (after a scan, whose tasks stay as they are).
    """
    path = scratch(df.sparkSession, name)
    eighth = 1 + int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8
    if rows is not None:
        df = df.coalesce(1 + rows // 250_000)
    elif few:
        df = df.repartition(eighth) if few == "repartition" else df.coalesce(eighth)
    df.write.option("compression", "zstd").parquet(path)
    released(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a table made by saved() that nothing reads any more."""
    jvm, sc = spark._jvm, spark.sparkContext
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(d)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


FREE = {"MinHeapFreeRatio": "20", "MaxHeapFreeRatio": "40"}  # percent of the driver's heap that stays free after a collection
ROOM = 0.5  # of the heap's limit: the driver's garbage is collected once its heap is larger


@lru_cache(1)
def _trimmer(sc: SparkContext) -> Callable[[], object]:
    """Sets FREE, unless the command line sets those flags, and gives what returns freed native memory to the system.

    Called by reflection, since the beans' own classes aren't open. A JVM that lacks one of them goes without it.
    """
    lang, own = sc._jvm.java.lang, sc._jvm.java.lang.Class.forName

    def array(kind, *items):
        out = sc._gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    text = own("java.lang.String")
    try:
        flags = own("com.sun.management.HotSpotDiagnosticMXBean")
        bean = lang.management.ManagementFactory.getPlatformMXBean(flags)
        read, put = flags.getMethod("getVMOption", array(lang.Class, text)), flags.getMethod("setVMOption", array(lang.Class, text, text))
        if all(read.invoke(bean, array(lang.Object, k)).getOrigin().toString() == "DEFAULT" for k in FREE):
            for k, v in FREE.items():  # the least first: it may not pass the most
                put.invoke(bean, array(lang.Object, k, v))
    except Py4JError:
        pass
    try:
        of = own("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, own("javax.management.ObjectName"), text, own("[Ljava.lang.Object;"), own("[Ljava.lang.String;")))
        call = array(lang.Object, sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", array(lang.Object), array(lang.String))
        server = lang.management.ManagementFactory.getPlatformMBeanServer()
        of.invoke(server, call)
    except Py4JError:
        return lambda: None
    return lambda: of.invoke(server, call)


def released(spark: SparkSession) -> None:
    """Gives memory of finished steps back to the system, on the driver: else its process grows by plans, broadcasts and threads of steps long done.

    By default a collection leaves the heap at up to 3.3 times what is used, and malloc keeps what threads have freed.
    """
    trim, heap = _trimmer(spark.sparkContext), spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > ROOM * heap.maxMemory():
        spark._jvm.System.gc()
    trim()
