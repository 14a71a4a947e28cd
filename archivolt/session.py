"""Session defaults and lineage cutting through the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("archivolt")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Gives the package to the executors' Python workers, once per application, wherever they run from."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="archivolt-"), "archivolt.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(here):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (tests), an own one, local masters only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="archivolt-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what lies before, and several readers
    share one computation. Files stay until the Python process ends (results may be read late).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/archivolt/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df; for tables of a loop that no later result reads."""
    path = getattr(df, "_written", None)
    if path:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; looks at no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone
            return
