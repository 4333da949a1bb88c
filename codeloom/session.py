"""Session defaults and the places where jobs may write."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def session(app: str = "codeloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC times; a running one is reused as it is."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local folder of our own stands in only where it is unset and all runs on one machine, as in tests."""
    where = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT} names no folder that the executors share")
    known = getattr(spark, "_codeloom_dir", None)
    if not known:
        known = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, known, True)
        spark._codeloom_dir = known
    return "file://" + known


_written: dict[str, SparkSession] = {}


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts the lineage, and survives the loss of executors. ``clean`` removes it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean)
    _written[at] = spark
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def clean() -> None:
    """Removes what ``written`` has left in the shared folder; no result that rests on it may be read after. Runs at the end of the driver, too."""
    for at, spark in list(_written.items()):
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended
            pass
        del _written[at]


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable for Python workers, wherever they run; once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_codeloom_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="codeloom-")) / "codeloom.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("codeloom") / p.relative_to(root))
    sc.addPyFile(str(at))  # served by the driver
    atexit.register(shutil.rmtree, at.parent, True)
    sc._codeloom_shipped = True
    return spark


SMALL_SHARE = 4 << 20  # of a core; below that, files are read by fewer tasks than there are cores


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores where its tables are so small that few tasks would read them, before Python works on them; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return df.repartition(cores) if size <= cores * SMALL_SHARE else df
