"""Tables that become visible together. Each is staged as files, read back, counted and summed up; a manifest names them, one row a table.

The manifest of a commit is one file, which Spark moves into place when its job ends: readers see all tables of a commit or none of them. A
commit that fails at any table leaves the snapshot before it as it was; what it staged is named by no manifest (`leftovers`). There is one writer
at a time: two that commit the same version are told apart and refused by readers."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, commit string, name string, place string, n_rows long, checksum string"
#: Tables that are staged at the same time.
AT_ONCE = 8


class Conflict(RuntimeError):
    """Two commits of one version."""


def checksum(df: DataFrame) -> tuple[int, str]:
    """The count of the rows and a sum over their hashes, whatever their order; repeated rows count. Maps are hashed as sorted entries."""
    plain = [F.array_sort(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in df.schema]
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*plain).cast("decimal(38,0)")).alias("s")).first()
    return row["n"], str(row["s"] or 0)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The manifest rows of all commits; none where nothing was committed."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> list:
    """The rows of one snapshot, the last one unless a version is given: as many as it has tables."""
    every = commits(spark, path)
    rows = every.where(F.col("version") == (F.lit(version) if version is not None else every.agg(F.max("version")).first()[0])).collect()
    if len({r["commit"] for r in rows}) > 1:
        raise Conflict(f"version {rows[0]['version']} was committed twice")
    return rows


def committed(tables: dict[str, DataFrame], path: str) -> int:
    """Writes the tables as the next snapshot; tables of the one before that aren't given stay in it. Returns the version."""
    spark = next(iter(tables.values())).sparkSession
    before = manifest(spark, path)
    version, commit = (before[0]["version"] + 1 if before else 1), uuid.uuid4().hex
    rows = [(version, commit, r["name"], r["place"], r["n_rows"], r["checksum"]) for r in before if r["name"] not in tables]

    def staged(name: str) -> tuple:
        place = f"data/{name}-{commit}"
        tables[name].write.parquet(f"{path}/{place}")
        return (version, commit, name, place, *checksum(spark.read.schema(tables[name].schema).parquet(f"{path}/{place}")))

    with ThreadPoolExecutor(AT_ONCE) as pool:  # small tables don't wait for one another; the first failure ends the commit
        rows += pool.map(staged, tables)
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    manifest(spark, path, version)  # refuses a version that another writer has committed meanwhile
    return version


def opened(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one snapshot by name; none where nothing was committed."""
    return {r["name"]: spark.read.parquet(f"{path}/{r['place']}") for r in manifest(spark, path, version)}


def damaged(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """The names of the tables whose rows aren't those that were committed, or can't be read."""
    found = []
    for row in manifest(spark, path, version):
        try:
            same = checksum(spark.read.parquet(f"{path}/{row['place']}")) == (row["n_rows"], row["checksum"])
        except AnalysisException:
            same = False
        if not same:
            found.append(row["name"])
    return sorted(found)


def leftovers(spark: SparkSession, path: str) -> DataFrame:
    """The files under data that no commit names: (path, length). What failed commits staged, to be removed by whoever owns the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/data").select("path", "length")
    place = F.concat(F.lit("data/"), F.element_at(F.split("path", "/"), -2))
    return files.withColumn("place", place).join(commits(spark, path).select("place").distinct(), "place", "left_anti").drop("place")
