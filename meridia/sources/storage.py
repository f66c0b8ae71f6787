"""The shared folder, checkpoints and snapshot tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local one only for a local master."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="meridia-shared-")
    if current.isEmpty():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files behind a result of ``checkpointed`` that is read no more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet, which takes a fraction of a checkpoint's disk; for tables with a row per event."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Delete the files behind a result of ``kept`` that is read no more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Snapshot:
    """A table that is replaced as a whole: every version is a folder, a pointer file names the current one.

    Readers see a complete version; a writer that dies leaves an unreferenced folder.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _pointers(self) -> list[tuple[int, str]]:
        fs, p = _fs(self.spark, f"{self.path}/_versions")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted((int(n.split("=")[0]), n.split("=")[1]) for n in names if "=" in n)

    def read(self, but: int | None = None) -> DataFrame:
        """The current version; ``but`` leaves out what a first run of that batch wrote."""
        found = [v for v in self._pointers() if but is None or not v[1].startswith(f"{but}.")]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{found[-1][1]}")

    def replace(self, df: DataFrame, keep: int = 2, batch: int | None = None) -> None:
        """Write a version and drop old ones; versions of a first run of ``batch`` go before older ones."""
        found = self._pointers()
        name = f"{'' if batch is None else batch}.{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        number = found[-1][0] + 1 if found else 1
        fs, p = _fs(self.spark, f"{self.path}/_versions/{number}={name}")
        if not fs.createNewFile(p):
            raise RuntimeError(f"version {number} of {self.path} was written by another writer")
        again = [v for v in found if batch is not None and v[1].startswith(f"{batch}.")]
        others = [v for v in found if v not in again]
        for n, old in again + others[: max(0, len(others) + 1 - keep)]:
            fs.delete(_fs(self.spark, f"{self.path}/_versions/{n}={old}")[1], False)
            fs.delete(_fs(self.spark, f"{self.path}/{old}")[1], True)


class Batches:
    """An append-only table in one folder per batch; writing a batch again overwrites its folder.

    With ``week``, the name of a timestamp column, a batch is parted by the Monday of
    its week, and ``since`` reads no older folders.  With ``keys``, it is parted in
    ``count`` buckets of the keys, and ``buckets`` reads no others.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, week: str | None = None, keys: list[str] | None = None, count: int = 64
    ):
        self.spark, self.path, self.schema, self.week = spark, path.rstrip("/"), schema, week
        self.keys, self.count = keys, count

    def numbers(self, rows: DataFrame) -> list[int]:
        """The buckets of rows, at most ``count`` numbers."""
        found = rows.select(F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).alias("b")).distinct().collect()
        return sorted(r.b for r in found)

    def write(self, batch: int, df: DataFrame) -> None:
        if self.week:
            df = df.withColumn("week", F.date_trunc("week", self.week).cast("date"))
        if self.keys:
            df = df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int")).repartition("bucket")
        parts = ["week"] * bool(self.week) + ["bucket"] * bool(self.keys)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{self.path}/batch={batch}")

    def read(
        self, only: int | None = None, but: int | None = None, since: Column | None = None, buckets: list[int] | None = None
    ) -> DataFrame:
        """All batches, one, or all but one, from a time on, of some buckets; the folders' names prune what is read."""
        fs, p = _fs(self.spark, self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.schema)
        parts = ", week date" * bool(self.week) + ", bucket int" * bool(self.keys)
        df = self.spark.read.schema(f"{self.schema}, batch long{parts}").parquet(self.path)
        if only is not None:
            df = df.filter(F.col("batch") == only)
        if but is not None:
            df = df.filter(F.col("batch") != but)
        if since is not None and self.week:
            df = df.filter((F.col("week") >= F.date_trunc("week", since).cast("date")) & (F.col(self.week) >= since))
        if buckets is not None and self.keys:
            df = df.filter(F.col("bucket").isin(buckets))
        return df.drop("batch", "week", "bucket")


class Buckets:
    """Keyed state in a fixed number of buckets, of which an update writes only those it touches.

    A version is a manifest that names the folder of every bucket; a pointer file, made
    last, names the manifest.  Readers see a complete version; a writer that dies leaves
    folders that no manifest names.  ``keys`` decide a row's bucket, so tables over the
    same keys have their rows in buckets of the same numbers.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], count: int = 64):
        self.spark, self.path, self.schema, self.keys, self.count = spark, path.rstrip("/"), schema, keys, count

    def bucket(self, *keys: Column | str) -> Column:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.count)).cast("int")

    def numbers(self, rows: DataFrame, *keys: Column | str) -> list[int]:
        """The buckets of rows, at most ``count`` numbers."""
        found = rows.select(self.bucket(*keys).alias("bucket")).distinct().collect()
        return sorted(r.bucket for r in found)

    def _versions(self) -> list[tuple[int, str]]:
        fs, p = _fs(self.spark, f"{self.path}/_versions")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted((int(n.split("=")[0]), n.split("=")[1]) for n in names if "=" in n)

    def _manifest(self, name: str) -> dict:
        fs, p = _fs(self.spark, f"{self.path}/_manifests/{name}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _base(self, but: int | None) -> dict[str, str]:
        found = [v for v in self._versions() if but is None or not v[1].startswith(f"{but}.")]
        return self._manifest(found[-1][1])["folders"] if found else {}

    def note(self, but: int | None = None) -> dict:
        """What the writer of the current version said of it."""
        found = [v for v in self._versions() if but is None or not v[1].startswith(f"{but}.")]
        return self._manifest(found[-1][1])["note"] if found else {}

    def read(self, buckets: list[int] | None = None, but: int | None = None) -> DataFrame:
        """Some buckets or all of the current version; ``but`` leaves out what a first run of that batch wrote."""
        base = self._base(but)
        wanted = base if buckets is None else {str(b): base[str(b)] for b in buckets if str(b) in base}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}/bucket={b}" for b, f in wanted.items()))

    def update(self, df: DataFrame, buckets: list[int] | None, keep: int = 2, batch: int | None = None, note: dict | None = None) -> None:
        """Replace some buckets, or all, by the rows of ``df``, which lie in them; versions of a first run of ``batch`` go first."""
        found = self._versions()
        name = f"{'' if batch is None else batch}.{uuid.uuid4().hex}"
        rows = df.withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        fs, folder = _fs(self.spark, f"{self.path}/{name}")
        written = {s.getPath().getName().split("=")[1] for s in fs.listStatus(folder) if "=" in s.getPath().getName()}
        base = {} if buckets is None else self._base(batch)
        touched = written if buckets is None else {str(b) for b in buckets}
        if not written <= touched:
            raise ValueError(f"{self.path}: rows outside of the updated buckets")
        manifest = {b: f for b, f in base.items() if b not in touched} | dict.fromkeys(written, name)
        stream = fs.create(_fs(self.spark, f"{self.path}/_manifests/{name}.json")[1], False)
        stream.write(bytearray(json.dumps({"folders": manifest, "note": note or {}}, sort_keys=True).encode()))
        stream.close()
        number = found[-1][0] + 1 if found else 1
        if not fs.createNewFile(_fs(self.spark, f"{self.path}/_versions/{number}={name}")[1]):
            raise RuntimeError(f"version {number} of {self.path} was written by another writer")
        again = [v for v in found if batch is not None and v[1].startswith(f"{batch}.")]
        others = [v for v in found if v not in again]
        old = again + others[: max(0, len(others) + 1 - keep)]
        kept = {x for v in others if v not in old for x in self._manifest(v[1])["folders"].items()} | set(manifest.items())
        for n, v in old:
            gone = set(self._manifest(v)["folders"].items()) - kept
            fs.delete(_fs(self.spark, f"{self.path}/_versions/{n}={v}")[1], False)
            fs.delete(_fs(self.spark, f"{self.path}/_manifests/{v}.json")[1], False)
            for b, f in gone:
                fs.delete(_fs(self.spark, f"{self.path}/{f}/bucket={b}")[1], True)
