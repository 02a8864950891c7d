"""Shared pieces: scratch space in the shared folder, and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

#: The white space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: The same set as a Java regex class body.
SPACE_CLASS = r"\x20\x09-\x0D"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a temporary one only on a local master where that is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="cueforge-")
    return _own[app]


class Scratch:
    """A fresh folder below the shared folder, for tables that cut lineage or pass data between steps."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cueforge-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back: lost executors then cost nothing that came before."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tables(self) -> list[str]:
        """The names of the tables there are."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def drop(self, name: str = "") -> None:
        """Delete one table or the whole folder, through Hadoop, so that any file system will do."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """df as it is, if it is a bare scan of files, which numbers its rows alike each time it is read; else a stored copy of it."""
    lines = [x.strip("+-: ") for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if x.strip()]
    bare = lines[-1].startswith("Relation [") and all(x.startswith("Project [") for x in lines[:-1]) and not any(f in x for x in lines for f in ("rand(", "randn(", "uuid(", "shuffle("))
    return df if bare else scratch.save(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


#: Rows that a broadcast table may have at most.
BROADCAST_ROWS = 50_000
#: Groups that hold more than one in so many of all rows are hot: there are fewer than that.
HOT_GROUPS = 1000


def _is_narrow(df: DataFrame) -> bool:
    """Whether all columns are of fixed width, so that a number of rows bounds the bytes."""
    fixed = lambda t: all(fixed(f.dataType) for f in t.fields) if isinstance(t, StructType) else not isinstance(t, (StringType, BinaryType, ArrayType, MapType, VariantType))
    return fixed(df.schema)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = 8 << 20) -> DataFrame:
    """A stored table as the small side of a join: broadcast if it has at most so many rows, and so many bytes where columns vary in width; else by sort-merge."""
    few = df.limit(most + 1)
    if few.count() > most:
        return df.hint("merge")
    if not _is_narrow(df) and (few.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0) > most_bytes:
        return df.hint("merge")
    return F.broadcast(df)


def hot_bound(sizes: DataFrame, size: str) -> int | None:
    """Beyond how many rows a group is hot, if any of the groups is: more than one in HOT_GROUPS of all rows, and a thousand."""
    total, most = sizes.agg(F.sum(size), F.max(size)).first()
    bound = max((total or 0) // HOT_GROUPS, 1000)
    return bound if (most or 0) > bound else None


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined to groups (a stored row per key, with the number of rows of that key in column size, which goes).

    Hot groups (hot_bound) meet their rows by broadcast: there are fewer than HOT_GROUPS of them whatever the
    size, and no key's rows gather in one task. The others join by sort-merge. Keys must not be null, and with
    how="left" no hot key is without a group.
    """
    bound = hot_bound(groups, size)
    if bound is None:
        return rows.join(groups.drop(size).hint("merge"), on, how)
    hot, rest = groups.where(F.col(size) > bound).drop(size), groups.where(F.col(size) <= bound).drop(size)
    met = rows.join(F.broadcast(hot), on)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest.hint("merge"), on, how)
    return met.unionByName(others)


def unused(df: DataFrame, name: str) -> str:
    """The name, behind as many underscores as make it new to df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(df: DataFrame) -> int | None:
    """The number of df's partitions; None for frames with an exchange, which has to run to tell."""
    return None if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df.rdd.getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as the cluster runs tasks at once: small tables come in few files.

    Frames with an exchange have their partitions from there.
    """
    n, now = df.sparkSession.sparkContext.defaultParallelism, partitions(df)
    return df if now is None or now >= n else df.repartition(n)
