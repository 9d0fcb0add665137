"""Path checks through Hadoop's ``FileSystem`` (works for local, HDFS, S3A
... alike), used by load-or-fit and by the versioned state tables."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_and_path(spark, path)
    return bool(fs.exists(p))


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file at ``path``."""
    fs, p = _fs_and_path(spark, path)
    fs.create(p, True).close()


def committed(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a finished Spark write (``_SUCCESS`` marker)."""
    return exists(spark, path.rstrip("/") + "/_SUCCESS")


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-directories of ``path`` (empty if it does not exist)."""
    fs, p = _fs_and_path(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly below ``path``."""
    fs, p = _fs_and_path(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isFile()]


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs_and_path(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a file or folder within one store; fails if it did not move."""
    fs, p = _fs_and_path(spark, path)
    if not fs.rename(p, _fs_and_path(spark, to)[1]):
        raise OSError(f"could not move {path} to {to}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file from the driver: written beside its place and moved there, so
    readers see all of it or none; an older file at ``path`` is replaced."""
    fs, p = _fs_and_path(spark, path)
    head, _, name = path.rpartition("/")
    part = _fs_and_path(spark, f"{head}/_{name}.part")[1]
    out = fs.create(part, True)
    out.write(text.encode("utf-8"))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file written by ``write_text`` (None: there is none)."""
    fs, p = _fs_and_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> bool:
    """Recursively delete ``path`` (used for state-version retention)."""
    fs, p = _fs_and_path(spark, path)
    return bool(fs.delete(p, True))
