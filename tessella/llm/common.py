"""What the text operators share: scratch tables, row identities and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow scratch table that one task writes to one file.
ROWS_PER_FILE = 100_000

_LOCAL: dict[str, str] = {}
_MADE: set[tuple[str, str]] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below the cluster's shared `spark.checkpoint.dir`.

    Where that setting is missing, a local master gets a temporary folder; any other master gets a
    folder below the warehouse, which all executors share.
    """
    conf = spark.sparkContext.getConf()
    app = spark.sparkContext.applicationId
    root = conf.get("spark.checkpoint.dir")
    if not root:
        if conf.get("spark.master", "").startswith("local") and "cluster" not in conf.get("spark.master", ""):
            if app not in _LOCAL:
                _LOCAL[app] = tempfile.mkdtemp(prefix="tessella-")
            root = _LOCAL[app]
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{root.rstrip('/')}/tessella-{app}"
    if (app, path) not in _MADE:
        _MADE.add((app, path))
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder when the program ends, if the session is still there."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the folder belongs to the cluster's own clean-up
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared scratch folder and read it back.

    Cuts the lineage, survives lost executors, and lets later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of at most `rows` narrow rows, in no more partitions than ROWS_PER_FILE asks for."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))


def row_id(*cols: str):
    """A 64-bit identity of a row from its id and text; rows that agree in both are one document."""
    return F.xxhash64(*[F.col(c) for c in cols])


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    `edges` has long columns `a` and `b`; the result has one row (`node`, `component`) per node that
    has an edge to another node, where `component` is the smallest node id that it reaches. Every round
    is two grouped minima joined back to the edges and written to the shared folder, so nothing is
    collected, and a star's hot centre is split by the skew-join rule. Without edges: no rows.
    """
    pairs = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    mark, rows = None, pairs.count()
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        pairs = materialize(few_files(small, rows), name)  # a round never makes more edges than there were
        seen = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
