"""Session, shared scratch space and package shipping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings a session of its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("panelloom")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of an Arrow batch that goes to Python: with many idle workers per executor, their memory counts.
ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, and keep their batches small.

    The session's batch size is lowered for good, as frames are planned after this returns; a smaller one stays.
    """
    sc = spark.sparkContext
    now = spark.conf.get(_ARROW).removesuffix("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    if getattr(sc, "_panelloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    # code only, read by the driver and served to the executors by Spark
    path = os.path.join(tempfile.mkdtemp(prefix="panelloom-"), "panelloom_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("panelloom", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._panelloom_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one is made on a single machine (tests); a cluster, whose
    machines would not see each other's folders, is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = getattr(sc, "_panelloom_scratch", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="panelloom-checkpoint-")
            sc._panelloom_scratch = root
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


#: Spark drops the shuffle files of a query when it ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark trusts the order within buckets of one file each.
_BUCKET_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """Session settings for the time of one write, whose plan is made within."""
    names = {_DROP_SHUFFLES: "true", _BUCKET_ORDER: "true"} | values
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.name = f"{label}_{uuid.uuid4().hex}"
        self.root = f"{scratch_root(spark)}/{self.name}"
        self.count = 0
        self.tables: list[str] = []

    def _path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count - 1:03d}-{label}"

    def save(self, make: Callable[[], DataFrame], label: str = "t") -> DataFrame:
        """Write the frame that `make` builds and read it back.

        Nothing else holds the frame then, and its shuffle files go once it is written.
        """
        path = self._path(label)
        with _settings(self.spark):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def save_sorted(self, make: Callable[[], DataFrame], key: str, order: list[str], label: str = "sorted") -> DataFrame:
        """The same, bucketed by `key` into as many files as there are shuffle partitions, each in `order`: joins by `key`
        read it as it lies."""
        path, table = self._path(label), f"panelloom_{self.name}_{self.count}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables.append(table)
        # one file for each bucket: no partitions joined up, and none of bucketed sources kept as they are
        with _settings(self.spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.sources.bucketing.enabled": "false"}):
            dealt = make().repartition(buckets, key).sortWithinPartitions(*order)
            dealt.write.bucketBy(buckets, key).sortBy(*order).option("path", path).saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(conf).delete(path, True)


_LIVE: dict[str, list[Scratch]] = {}
_OWNER: ContextVar[str] = ContextVar("panelloom_owner", default="")


@contextmanager
def scratch_owner(name: str):
    """Scratch folders that operators ask for within belong to `name`, and go with release_scratch(name) only."""
    token = _OWNER.set(name)
    try:
        yield
    finally:
        _OWNER.reset(token)


def scratch_for(spark: SparkSession, label: str) -> Scratch:
    """A scratch folder whose tables the caller's lazy result may still read."""
    new = Scratch(spark, label)
    _LIVE.setdefault(_OWNER.get(), []).append(new)
    return new


def release_scratch(owner: str = "") -> None:
    """Drop an owner's folders (by default those without one); for callers that have written every result they need."""
    for one in _LIVE.pop(owner, []):
        one.drop()


@contextmanager
def temporary_scratch(spark: SparkSession, label: str):
    out = Scratch(spark, label)
    try:
        yield out
    finally:
        out.drop()
