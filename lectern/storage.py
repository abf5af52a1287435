"""Tables written to the folder all executors share, to cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's own setting; a local default only where it is unset and Spark runs in one process."""
    got = spark.conf.get(SHARED_DIR_CONF, None)
    if got:
        return got
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {SHARED_DIR_CONF} to a folder that all executors share")
    return f"file:///tmp/lectern-shared-{os.getuid()}"


#: Folders written by this process and not yet deleted.
_FOLDERS: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, label: str, *, instead_of: DataFrame | None = None) -> DataFrame:
    """The table as written to the shared folder, read back.

    ``instead_of`` is an earlier result of this function that nothing reads any more; its folder is deleted. The others go
    with :func:`sweep`, at the latest when the process ends.
    """
    if not _FOLDERS:
        atexit.register(sweep)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _FOLDERS.append((df.sparkSession, path))
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lectern_folder = path
    if instead_of is not None and (old := getattr(instead_of, "_lectern_folder", None)):
        sweep(old)
    return out


def sweep(folder: str | None = None) -> None:
    """Deletes one written folder, or all of them; tables read from them must not be needed any more."""
    for spark, path in [x for x in _FOLDERS if folder in (None, x[1])]:
        _FOLDERS.remove((spark, path))
        try:
            delete(spark, path)
        except Exception:  # the session is gone, and with it the way to reach the folder
            pass


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _place(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _place(spark, path)
    return fs.exists(where)


def replace(spark: SparkSession, new: str, target: str) -> None:
    """Puts a finished folder in the place of another: the old one is moved aside first and comes back if the move fails."""
    fs, src = _place(spark, new)
    _, dst = _place(spark, target)
    _, aside = _place(spark, f"{target}.old-{uuid.uuid4().hex}")
    had = fs.exists(dst)
    if had and not fs.rename(dst, aside):
        raise OSError(f"{target} can't be moved aside")
    if not fs.rename(src, dst):
        if had:
            fs.rename(aside, dst)
        raise OSError(f"{new} can't be moved to {target}")
    if had:
        fs.delete(aside, True)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: by its folder on this machine, as an archive on a cluster. Done once a context."""
    import shutil
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_lectern_shipped", False):
        return
    package = Path(__file__).resolve().parent
    known = sc.environment.get("PYTHONPATH", "")
    sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(package.parent), known]))
    if not sc.master.startswith("local"):
        folder = tempfile.mkdtemp()  # the driver serves the archive from here until it ends; no data is kept here
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder, "lectern.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(archive))
    sc._lectern_shipped = True
