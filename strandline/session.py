"""Session defaults, table access and the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", name: str = "strandline", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; for tests and the bench."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return SparkSession.builder.master(master).appName(name).config(map=settings).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once an application, unless PYTHONPATH or a local session's folder gives it them."""
    root, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    local = spark.sparkContext.master.startswith("local[") and Path.cwd() == root
    if app in _shipped or local or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline.zip"  # on the driver, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "strandline").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="strandline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_made: list[tuple] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of this run below the shared one; it goes when the driver's process ends, for results may be read from it till then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark._jvm, spark._jsc.hadoopConfiguration(), path))
    return path


def _clear() -> None:
    """Deletes what fresh_dir made; what can't be deleted stays."""
    for jvm, conf, path in _made:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001
            return


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder, which outlives executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)


class Files:
    """The Hadoop file system of a path: works alike on local, HDFS and object stores."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        """Names in a folder but those that begin with _ or a dot, sorted."""
        p = self._path(path)
        found = (s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else ()
        return sorted(n for n in found if not n.startswith(("_", ".")))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def write_new(self, path: str, text: str) -> None:
        """Makes a small file with this text; an error if there is one. It shows under its name only when it is complete."""
        p = self._path(path)
        if self._fs.exists(p):
            raise FileExistsError(path)
        self._fs.mkdirs(p.getParent())
        claim = self._path(f"{p.getParent()}/_claim-{p.getName()}-{uuid.uuid4().hex}")
        out = self._fs.create(claim, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(claim, p):
            self._fs.delete(claim, False)
            raise FileExistsError(path)

    def text(self, path: str) -> str:
        """A small file's text."""
        found = self._fs.open(self._path(path))
        try:
            return bytes(found.readAllBytes()).decode()
        finally:
            found.close()

    def delete(self, path: str) -> None:
        """Deletes a file or folder with all it holds, if it is there."""
        self._fs.delete(self._path(path), True)
