"""Keeping an index as Parquet, and telling whether it still fits its dump."""

from __future__ import annotations

import json
import tempfile
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

if TYPE_CHECKING:
    from quarry.plans.subset import Index

VERSION = "2"
#: Frames that hold texts are not kept.
LEFT_OUT = ("named",)


def save(index: Index, path: str, size: int, modified: int) -> None:
    """All frames and then info, which marks the whole as complete. An index at `path` is replaced."""
    spark = index.rows.sparkSession
    for name, frame in index.frames.items():
        if name not in LEFT_OUT:
            frame.write.mode("overwrite").parquet(f"{path}/{name}")
    sites = ";".join(f"{k}={v}" for k, v in index.sites.items())
    info = [("version", VERSION), ("size", str(size)), ("modified", str(modified)), ("sites", sites)]
    spark.createDataFrame(info, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/info")


def info(spark: SparkSession, path: str) -> dict[str, str]:
    """What info says. Raises ValueError for another version."""
    found = {r.key: r.value for r in spark.read.parquet(f"{path}/info").collect()}
    if found.get("version") != VERSION:
        raise ValueError(f"an index of version {found.get('version')}; this is {VERSION}")
    return found


def load(spark: SparkSession, path: str, names: tuple[str, ...]) -> Index:
    """The index's frames of these names, without the dump's rows."""
    found = info(spark, path)
    sites = {int(k): v for k, v in (x.split("=", 1) for x in found["sites"].split(";") if x)}
    from quarry.plans.subset import Index

    nothing = spark.createDataFrame([], "ord long")
    return Index(nothing, nothing, sites, {n: spark.read.parquet(f"{path}/{n}") for n in names})


def is_fresh(spark: SparkSession, path: str, size: int, modified: int) -> bool:
    """Whether the index is of a dump of this size and time, to the second."""
    try:
        found = info(spark, path)
    except Exception:  # no index, or one of another version
        return False
    return (found["size"], found["modified"]) == (str(size), str(modified))


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only with a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark has them."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), own


def stamp(spark: SparkSession, path: str, columns: tuple[str, ...], exact: bool) -> dict[str, str]:
    """What tells whether an index is one of this dump as it is now, with these columns."""
    system, own = _place(spark, path)
    found = [s for s in system.listStatus(own) if s.getPath().getName()[0] not in "_."]
    size, modified = sum(s.getLen() for s in found), max((s.getModificationTime() for s in found), default=0)
    return {"version": VERSION, "size": str(size), "modified": str(modified // 1000), "columns": json.dumps(sorted(set(columns))), "exact": str(exact)}


def put(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def get(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    return (reader.schema(schema) if schema else reader).parquet(path)


def commit(spark: SparkSession, path: str, stamp_: dict[str, str], sites_: dict[int, str], schema: StructType, layout: str) -> None:
    """Mark an index as complete: the last thing that is written of it."""
    held = stamp_ | {"sites": ";".join(f"{k}={v}" for k, v in sites_.items()), "rows": schema.json(), "layout": layout}
    put(spark.createDataFrame(list(held.items()), "key string, value string").coalesce(1), f"{path}/info")


def complete(spark: SparkSession, path: str, stamp_: dict[str, str]) -> bool:
    """Whether a whole index of this stamp is there."""
    system, own = _place(spark, f"{path}/info/_SUCCESS")
    return system.exists(own) and {k: v for k, v in _info(spark, path).items() if k in stamp_} == stamp_


def _info(spark: SparkSession, path: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.read.parquet(f"{path}/info").collect()}  # a few rows


def known(spark: SparkSession, path: str) -> tuple[dict[int, str], StructType, str]:
    """A complete index's sites, the schema of its rows, and the layout of its dump, if it was read by one."""
    found = _info(spark, path)
    return {int(k): v for k, v in (x.split("=", 1) for x in found["sites"].split(";") if x)}, StructType.fromJson(json.loads(found["rows"])), found["layout"]


def drop(spark: SparkSession, path: str) -> None:
    """Delete an index with all its rows: first its mark, so that what is left of it counts as none."""
    for part in ("info", "rows", "statements", "tables", "meta_refs", "menu", "content_refs", "fields", "user_roles"):
        system, own = _place(spark, f"{path}/{part}")
        system.delete(own, True)
