"""Session construction and small plan helpers shared by every operator.

Nothing here moves row-sized data to the driver.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "foldcraft") -> SparkSession:
    """Session with AQE + skew-join on and the UI off (tests / bench)."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.codegen.hugeMethodLimit", str(JIT_METHOD_LIMIT))
    )
    spark = builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# HotSpot does not JIT-compile methods above 8000 bytes of bytecode; a
# whole-stage generated method that large (wide feature tables, dozens of
# rounded outputs) would run interpreted, 5-10x slower.  At this limit Spark
# falls back to per-operator generated code, split into small methods.
JIT_METHOD_LIMIT = 8000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; we only set our own
    (under /tmp, local tests only) when the session has none.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = "/tmp/foldcraft-checkpoints"
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that
    functions which run there import it wherever the driver was started: an
    archive of its modules in the shared folder, which Spark adds to the
    workers' import path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, files in sorted(os.walk(os.path.join(root, "foldcraft"))):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.writestr(os.path.relpath(path, root), open(path, "rb").read())
    path = sc._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark), f"package-{sc.applicationId}/foldcraft.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    _SHIPPED.add(sc.applicationId)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint
    folder and continue from the files.

    One job (a ``checkpoint()`` of an unpersisted frame computes it twice),
    columnar compressed storage, a short plan for the optimizer, real file
    sizes for AQE, and the files survive the loss of any executor (unlike
    a local checkpoint or a cache)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table path under the shared checkpoint folder."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def release_scratch(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that this process has stored, from number ``since``
    on (see :func:`scratch_mark`).  For the end of a query's life: results
    that still read them must have been written or collected."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_SCRATCH) > since:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


def scratch_mark() -> int:
    """How many tables are stored now."""
    return len(_SCRATCH)


# |v| below 2^52: v has a fractional part to round; at or above it v is
# already an integer and rounds to itself; if v overflows, x is returned
ROUND6_SQL = (
    "CASE WHEN abs({x} * 1000000.0D) < 4.5E15D THEN signum({x} * 1000000.0D) * "
    "(CAST(floor(abs({x} * 1000000.0D)) AS DOUBLE) + CASE WHEN abs({x} * 1000000.0D) "
    "- floor(abs({x} * 1000000.0D)) >= 0.5D THEN 1.0D ELSE 0.0D END) / 1000000.0D "
    "WHEN abs({x} * 1000000.0D) = CAST('Infinity' AS DOUBLE) THEN {x} "
    "ELSE {x} * 1000000.0D / 1000000.0D END")


def round6_sql(x: str) -> str:
    """SQL text of :func:`round6` for a (quoted) column expression."""
    return ROUND6_SQL.format(x=x)


def round6(c):
    """Every computed double leaves the engine rounded to 6 decimals so
    results compare exactly with an independent SQL engine.

    round(x * 1e6) / 1e6 with halves away from zero on the scaled binary
    value and the sign of zero kept (the common C-library definition), in
    plain double arithmetic that stays inside generated code (Spark's own
    ``round`` builds a BigDecimal per value): with v = x * 1e6 and
    a = |v|, round(v) = signum(v) * (floor(a) + [a - floor(a) >= .5]);
    a - floor(a) is exact, so ties are decided exactly, and signum keeps
    the sign of a zero result.  NaN and infinities pass through, and so
    does x when x * 1e6 overflows."""
    x = c.cast("double")
    v = x * F.lit(1e6)
    a = F.abs(v)
    fl = F.floor(a).cast("double")
    r = F.signum(v) * (fl + F.when(a - fl >= F.lit(0.5), F.lit(1.0)).otherwise(F.lit(0.0)))
    return (F.when(a < F.lit(4.5e15), r / F.lit(1e6))
            .when(a == F.lit(float("inf")), x).otherwise(v / F.lit(1e6)))
