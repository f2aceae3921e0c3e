"""Several stored tables that change together: readers see all of them as of one version.

Every publication writes new tables into a folder of its own and, last of all, one manifest: a small file put in place by a rename. Readers resolve all tables
through the newest manifest, so a crash at any step leaves them the old state as a whole, and files of an unfinished publication are in nobody's way. Tables that
do not change keep their files. Taking a collection out writes no table at all: tables lie in folders by collection, and the manifest says which to leave out.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BY = "document_collection"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    root, fs = _fs(spark, f"{folder}/manifests")
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """What a version (the newest) consists of: {table: {path, schema, without}}."""
    known = versions(spark, folder)
    if not known:
        return {}
    path, fs = _fs(spark, f"{folder}/manifests/{version if version is not None else known[-1]:09d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write_manifest(spark: SparkSession, folder: str, version: int, content: dict) -> None:
    target, fs = _fs(spark, f"{folder}/manifests/{version:09d}.json")
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        raise RuntimeError(f"version {version} has been published by another writer")
    draft, _ = _fs(spark, f"{folder}/manifests/draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    if not fs.rename(draft, target):
        raise RuntimeError(f"version {version} could not be published")


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> int:
    """Make a new version with these tables, each replaced as a whole, and all others as they are. Its number."""
    known = versions(spark, folder)
    content = dict(manifest(spark, folder))
    version = known[-1] + 1 if known else 1
    own = f"{folder}/tables/{version:09d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.partitionBy(BY).parquet(f"{own}/{name}")
        content[name] = {"path": f"{own}/{name}", "schema": df.schema.json(), "without": []}
    _write_manifest(spark, folder, version, content)
    return version


def read(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of a version, the newest if none is given."""
    from pyspark.sql.types import StructType

    out = {}
    for name, t in manifest(spark, folder, version).items():
        schema = StructType.fromJson(json.loads(t["schema"]))
        df = spark.read.schema(schema).parquet(t["path"]).select(*[f"`{c}`" for c in schema.names])
        out[name] = df.where(~F.col(BY).isin(t["without"]) | F.col(BY).isNull()) if t["without"] else df
    return out


def delete_collection(spark: SparkSession, folder: str, collection: str) -> int:
    """Take a collection out of every table at once."""
    known = versions(spark, folder)
    if not known:
        raise ValueError(f"nothing is published in {folder}")
    content = {name: t | {"without": sorted({*t["without"], collection})} for name, t in manifest(spark, folder).items()}
    _write_manifest(spark, folder, known[-1] + 1, content)
    return known[-1] + 1


def clean(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete the files that none of the last versions needs, and older manifests. How many folders of tables went. Not to be run beside a publication."""
    known = versions(spark, folder)
    needed = {t["path"] for v in known[-keep:] for t in manifest(spark, folder, v).values()}
    for v in known[:-keep]:
        path, fs = _fs(spark, f"{folder}/manifests/{v:09d}.json")
        fs.delete(path, False)
    gone = 0
    root, fs = _fs(spark, f"{folder}/tables")
    for publication in fs.listStatus(root) if fs.exists(root) else []:
        for table in fs.listStatus(publication.getPath()):
            if not any(p.rstrip("/").endswith(f"{publication.getPath().getName()}/{table.getPath().getName()}") for p in needed):
                fs.delete(table.getPath(), True)
                gone += 1
    return gone
