"""Tables of a day that readers see whole: staged runs and a commit manifest.

A run writes each of its parts (a report table, a check's findings) to a folder
of its own, ``<root>/<part>/as_of_date=<day>/run=<id>``, which nobody reads yet.
``commit`` then names, in one new file under ``<root>/_commits``, the run of
every part of that day: the parts just written, and for all others the run they
had before. Readers take the newest manifest of a day and read the folders it
names. So a run that stops half-way changes nothing, a re-run replaces a day at
one moment, and a reader that has begun keeps its files until ``vacuum``.

Manifests are numbered, and a number is taken by renaming a file to a name that
must be free: of two runs that started from the same manifest, the second to
commit fails and changes nothing. They are one small file a commit; nothing in
them grows with the data. All file work goes through the session's Hadoop
FileSystem.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opslens.session import delete_path

COMMITS = "_commits"


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def manifest(spark: SparkSession, root: str, day: str) -> tuple[int, dict[str, str]]:
    """Number and content (part -> run) of a day's newest manifest; (0, {}) before the first."""
    folder = f"{root}/{COMMITS}/as_of_date={day}"
    numbers = [n for n in _names(spark, folder) if n.endswith(".json")]
    if not numbers:
        return 0, {}
    fs, p = _file(spark, f"{folder}/{numbers[-1]}")
    stream = fs.open(p)
    try:
        return int(numbers[-1].split(".")[0]), json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


class Run:
    """One run over one day. Starts from the day's manifest as it is now."""

    def __init__(self, spark: SparkSession, root: str, day: str):
        self.spark, self.root, self.day, self.id = spark, root.rstrip("/"), day, uuid.uuid4().hex
        self.number, self.before = manifest(spark, self.root, day)
        self.written: dict[str, str] = {}

    def write(self, df: DataFrame, part: str) -> str:
        """Stage ``df`` as ``part`` of the day; a part written twice is replaced."""
        path = f"{self.root}/{part}/as_of_date={self.day}/run={self.id}"
        df.write.mode("overwrite").parquet(path)
        self.written[part] = self.id
        return path

    def commit(self) -> int:
        """Make the parts written the day's, all at once. Returns the manifest's number."""
        folder, number = f"{self.root}/{COMMITS}/as_of_date={self.day}", self.number + 1
        fs, draft = _file(self.spark, f"{folder}/.{self.id}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps({**self.before, **self.written}, sort_keys=True).encode()))
        finally:
            out.close()
        _, final = _file(self.spark, f"{folder}/{number:010d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another run has committed {self.day} under {self.root} since this one began: run again")
        return number


def committed_days(spark: SparkSession, root: str) -> list[str]:
    return [n.split("=", 1)[1] for n in _names(spark, f"{root.rstrip('/')}/{COMMITS}") if n.startswith("as_of_date=")]


def read(spark: SparkSession, root: str, part: str, schema: StructType | None = None, days: Sequence[str] | None = None) -> DataFrame | None:
    """The committed rows of a part, with ``as_of_date``; None where no day has
    it. With ``schema`` (without ``as_of_date``) no file is opened to infer it."""
    root = root.rstrip("/")
    out = None
    for day in days if days is not None else committed_days(spark, root):
        run = manifest(spark, root, day)[1].get(part)
        if run is not None:
            reader = spark.read if schema is None else spark.read.schema(schema)
            rows = reader.parquet(f"{root}/{part}/as_of_date={day}/run={run}").withColumn("as_of_date", F.lit(day).cast("date"))
            out = rows if out is None else out.unionByName(rows)
    return out


def vacuum(spark: SparkSession, root: str, days: Iterable[str] | None = None) -> int:
    """Delete the runs of the days' parts that no newest manifest names, and older
    manifests; for a time at which nothing writes and old readers are done.
    Returns the number of runs deleted."""
    root, gone = root.rstrip("/"), 0
    for day in list(days if days is not None else committed_days(spark, root)):
        number, live = manifest(spark, root, day)
        for part in _parts(spark, root):
            for name in _names(spark, f"{root}/{part}/as_of_date={day}"):
                if name.startswith("run=") and name != f"run={live.get(part)}":
                    delete_path(spark, f"{root}/{part}/as_of_date={day}/{name}")
                    gone += 1
        for name in _names(spark, f"{root}/{COMMITS}/as_of_date={day}"):
            if name.endswith(".json") and int(name.split(".")[0]) < number:
                delete_path(spark, f"{root}/{COMMITS}/as_of_date={day}/{name}")
    return gone


def _parts(spark: SparkSession, root: str) -> list[str]:
    """Names of parts, which may be one folder deep or two (``findings/<check>``)."""
    out = []
    for name in _names(spark, root):
        if name != COMMITS:
            below = [b for b in _names(spark, f"{root}/{name}") if not b.startswith("as_of_date=")]
            out += [f"{name}/{b}" for b in below] or [name]
    return out
