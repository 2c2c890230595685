"""Written tables that cut lineage, in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset a temporary folder is made,
    on a single machine only; a cluster must name a folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before
    folder = tempfile.mkdtemp(prefix="trendscope-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


# application id -> the folders of its operator calls
_OPEN: dict[str, list[Scratch]] = {}


class Scratch:
    """A folder of one operator call. Tables stay while results still read them, and go when
    the application ends, or before that by ``close`` or ``clear``; ``drop`` removes one that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        _OPEN.setdefault(spark.sparkContext.applicationId, []).append(self)

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it back. The driver's garbage is collected after
        it, so that Spark's cleaner frees the shuffle files of the finished step."""
        path = f"{self.root}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._fs.delete(self._path(t._scratch_path), True)

    def close(self) -> None:
        """Remove the folder; nothing may read the call's result any more."""
        self._fs.delete(self._path(self.root), True)
        self._fs.cancelDeleteOnExit(self._path(self.root))
        held = _OPEN.get(self.spark.sparkContext.applicationId, [])
        if self in held:
            held.remove(self)


def clear(spark: SparkSession, keep: tuple[Scratch, ...] = ()) -> None:
    """Remove the folders of all operator calls of this application but ``keep``: for long-lived
    applications, once the results are written where they are to stay."""
    for scratch in list(_OPEN.get(spark.sparkContext.applicationId, [])):
        if scratch not in keep:
            scratch.close()
