"""What executors share: folders for what queries write on the way, and this package's code."""

from __future__ import annotations

import atexit
import contextvars
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The innermost scope.
_SCOPE: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)
_LOCAL = re.compile(r"local(\[[^\]]*\])?")


def root(spark: SparkSession) -> str:
    """The place that the session names for checkpoints. Where it names none: a temporary folder that goes with the process
    if executors are threads of this one, an error if they are not, as they would not see what the others write."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("eddyline.scratch.dir", None)
    if not named:
        if not _LOCAL.fullmatch(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="eddyline-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("eddyline.scratch.dir", named)
    return named.rstrip("/")


def folder(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new folder's path in the shared place. It stays until its scope ends, a lasting one or one of no scope until clear() is called."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    inner = None if lasting else _SCOPE.get()
    (inner.paths if inner else _made(spark)).append(path)
    return path


def _made(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_eddyline_folders"):
        sc._eddyline_folders = []
    return sc._eddyline_folders


class Scope:
    """Folders made inside go when it ends, also by an error. What is still read later has to be kept()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        self._outer = _SCOPE.get()
        self._token = _SCOPE.set(self)
        return self

    def keep(self, *tables: DataFrame) -> None:
        """Leaves the folders of tables that written() gave to the scope around this one."""
        kept = {t.scratch_path for t in tables}
        self.paths = [p for p in self.paths if p not in kept]
        (self._outer.paths if self._outer else _made(self.spark)).extend(kept)

    def __exit__(self, *_) -> None:
        _SCOPE.reset(self._token)
        for path in self.paths:
            delete(self.spark, path)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """The same rows from a table in the shared place: computed once, lineage cut, safe to reread."""
    path = folder(df.sparkSession, name, lasting)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def clear(spark: SparkSession) -> None:
    """Deletes all folders that queries of this session have made; for when their results are done with."""
    made = _made(spark)
    while made:
        delete(spark, made.pop())


def at(spark: SparkSession, path: str):
    """A path, and the file system that it is of."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = at(spark, path)
    return fs.exists(p)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = at(spark, path)
    return fs.delete(p, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    p, fs = at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def moved(spark: SparkSession, path: str, to: str) -> None:
    (p, fs), (q, _) = at(spark, path), at(spark, to)
    fs.mkdirs(q.getParent())
    if fs.exists(q) or not fs.rename(p, q):
        raise FileExistsError(to)


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors' Python workers, once for each context."""
    sc = spark.sparkContext
    if not getattr(sc, "_eddyline_shipped", False):
        root = Path(__file__).resolve().parents[1]
        made = tempfile.mkdtemp(prefix="eddyline-src-")  # the driver serves it from there as long as it runs
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        archive = Path(made) / "eddyline-src.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(archive))
        sc._eddyline_shipped = True
