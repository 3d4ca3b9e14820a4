"""Session defaults. UTC is required by the date semantics; the rest is left to
the cluster's own configuration where it has one."""

import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(name: str = "missive", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def share_code(spark: SparkSession) -> None:
    """Let Python workers on the same file system import this package, wherever the
    driver was started; a cluster gets it with --py-files as usual."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir or the context
    names it; only a session on one machine may have neither."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


class Files:
    """A few small files and moves on any store that Spark knows, done by the driver."""

    def __init__(self, spark: SparkSession):
        self._spark = spark

    def _at(self, path: str):
        found = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self._spark._jsc.hadoopConfiguration()), found

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if it is not there."""
        fs, path = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a file whole or not at all; False if one of that name is there."""
        fs, at = self._at(path)
        _, draft = self._at(f"{path}.{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            return False
        return True

    def move(self, path: str, folder: str) -> str | None:
        """Move a file into a folder, with the time in its name if there is one of that name
        already; None if it is gone."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return None
        home, name = self._at(folder)[1], at.getName()
        fs.mkdirs(home)
        _, to = self._at(f"{folder}/{name}")
        if fs.exists(to):
            stem, dot, ending = name.rpartition(".")
            _, to = self._at(f"{folder}/{stem if dot else name}_{time.time_ns()}{dot + ending if dot else ''}")
        return str(to) if fs.rename(at, to) else None

    def remove(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)
