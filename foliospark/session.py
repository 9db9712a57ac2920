"""Session helpers: settings for small runs, shared storage, shipping this package to executors."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def build_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the session that is there."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("foliospark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per context; needed where it isn't on their Python path."""
    sc = spark.sparkContext
    if getattr(sc, "_foliospark_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="foliospark-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "foliospark.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(archive)
    sc._foliospark_shipped = True


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, dealt to all cores if its files come in fewer pieces than there are cores, as one small file does.
    A table of more pieces isn't shuffled. Worth it ahead of Python or patterns over whole texts, which else run on one core."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset
    (local tests) a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(sc, "_foliospark_dir", None):
        sc._foliospark_dir = tempfile.mkdtemp(prefix="foliospark-shared-")
        atexit.register(shutil.rmtree, sc._foliospark_dir, True)
    return f"file://{sc._foliospark_dir}"


_OWNED: dict[str, list[str]] = {}  # tables by owner, see owned()
_OWNER: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: the lineage ends there, so a lost
    executor costs a re-read and not a recomputation. discard() deletes it once nothing reads it any
    more; else the file system does when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliospark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    if _OWNER:
        _OWNED.setdefault(_OWNER[-1], []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliospark_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for t in tables:
        if t is not None:
            _delete(t.sparkSession, t._foliospark_path)


@contextmanager
def owned(spark: SparkSession, owner: str, done: str | None, source: DataFrame) -> Iterator[None]:
    """Tables made within belong to owner. Those of `done`, the step before, whose result has been written by now, are
    deleted, but for what source reads. So the tables of a run's last step stay, as its result may be read at any time."""
    reads = {f.rpartition("/")[0].rpartition("/")[2] for f in source.inputFiles()}
    kept = []
    for path in _OWNED.pop(done, []) if done else []:
        if path.rpartition("/")[2] in reads:
            kept.append(path)
        else:
            _delete(spark, path)
    if kept:
        _OWNED[done] = kept
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def drop_dead_shuffles(spark: SparkSession) -> None:
    """Shuffle files of frames that nothing refers to go when the driver's JVM collects garbage; ask
    for that between steps that each move much."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
