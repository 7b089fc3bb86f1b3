"""Near-duplicate vectors by sorted projection passes.

In every pass a vector gets the signs of random projections as one long number; vectors of a label are ordered
by that number, and each is compared with the WINDOW vectors behind it. The order is a range partitioning; row
numbers over it cut it into blocks of equal length with a halo of one window, so the work is even however
many vectors share a number or a label. Verified pairs of all passes are united. What a window misses inside a
found component is made up for exactly: all pairs of a component's members are compared in the cells of a triangular
grid, which give counts, not pairs. Equal vectors are collapsed at the start and counted with their copies. The
number of passes follows from the number of vectors of the largest label, so that a pair just at the threshold is missed
by all windows with probability MISS at most, whatever the size, where vectors are spread evenly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialize, table

LEAST_PASSES, MISS, BITS, WINDOW, BLOCK, CELL, SEED = 6, 0.002, 62, 96, 2048, 1024, 5
MEMBERS_PER_HOME = 4096
ROWS_PER_PARTITION = 50_000


def _matrix(column, n: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64).reshape(n, -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def passes_for(n: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes that miss a pair at the threshold with probability `miss` among n vectors of one label.

    A window holds the vectors that agree in about log2(n / window) leading signs; a sign of a random projection
    agrees with probability 1 - angle / pi.
    """
    agree = 1 - math.acos(threshold) / math.pi
    found = agree ** max(0.0, math.log2(max(1, n) / window))
    return LEAST_PASSES if found >= 1 else max(LEAST_PASSES, math.ceil(math.log(miss) / math.log(1 - found)))


def usable(embedding: str):
    """Whether a vector is not null, not zero, and holds finite numbers only."""
    c = F.col(embedding)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~bad & F.exists(c, lambda x: x != 0)


def _codes(vectors: DataFrame, passes: int) -> DataFrame:
    """One row per vector and pass with the sign bits of the pass's projections as a long."""

    def project(batches):
        planes = {}
        for batch in batches:
            for dim in set(batch.column("dim").to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                v = _matrix(part.column("v"), len(part))
                for p in range(passes):
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.default_rng([SEED, p, dim]).standard_normal((dim, BITS))
                    bits = v @ planes[p, dim] > 0
                    code = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), p, np.int32)), pa.array(code), *[part.column(c) for c in ("label", "dim", "gid", "v")]], ["pass", "code", "label", "dim", "gid", "v"])

    kind = dict(vectors.dtypes)["label"]
    return vectors.mapInArrow(project, f"pass int, code long, label {kind}, dim int, gid long, v array<double>")


def window_links(vectors: DataFrame, threshold: float, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """Edges (`a`, `b`) between vectors of a label whose cosine reaches the threshold, found in any pass's windows.

    Of each block a spanning forest of its links is returned.
    """
    sizes = vectors.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    passes = passes or passes_for(sizes[1] or 0, threshold, window)
    coded = _codes(vectors, passes)
    parts = max(1, -(-(sizes[0] or 0) * passes // ROWS_PER_PARTITION))
    order = ["pass", "label", "dim", "code", "gid"]
    rows = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "sorted-codes")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = rows.join(F.broadcast(starts), "part").withColumn("at", F.col("at") + F.col("start"))  # one row per partition
    block = F.floor(F.col("at") / BLOCK)
    blocks = placed.withColumn("block", F.explode(F.when((F.col("at") % BLOCK < window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))))

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        key = np.unique(np.array([group.column(c).to_numpy() for c in ("pass", "dim", "label")]).T, axis=0, return_inverse=True)[1].ravel()
        gid = group.column("gid").to_numpy()
        root, a, b = np.arange(len(gid)), [], []
        for k in np.unique(key):
            at = np.flatnonzero(key == k)
            u = _unit(_matrix(group.column("v").take(pa.array(at)), len(at)))
            for i in range(0, len(at), 256):
                near = u[i : i + 256] @ u[i : i + 256 + window].T >= threshold
                x, y = np.nonzero(np.triu(near, 1) & ~np.triu(near, window + 1))
                for x, y in zip(at[i + x], at[i + y], strict=True):
                    if root[x] != root[y]:
                        a.append(gid[x]), b.append(gid[y])
                        low, high = sorted((root[x], root[y]))
                        root[root == high] = low
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.select("block", "at", "pass", "dim", "label", "gid", "v").groupBy("block").applyInArrow(compare, "a long, b long")


def links_within(members: DataFrame, threshold: float) -> DataFrame:
    """gid and links: how many vectors, copies counted, reach the threshold within the same component.

    Components of more than CELL members are cut into blocks, and every two blocks meet in one cell of a triangular
    grid, which counts for both sides; small components share homes, whose number follows the number of members.
    """
    homes = max(1, -(-members.count() // MEMBERS_PER_HOME))
    sized = members.join(members.groupBy("component").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cuts")), "component")
    cut = F.pmod(F.xxhash64("gid", F.lit(3)), F.col("cuts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda t: F.struct(F.least(cut, t).cast("int").alias("i"), F.greatest(cut, t).cast("int").alias("j"), cut.alias("block")))
    home = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("component"), F.lit(homes))).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(1 << 40)))
    rows = sized.select(home.alias("home"), "component", "gid", "copies", "v", F.explode(cells).alias("c")).select("home", "c.*", "component", "gid", "copies", "v")

    def count(group: pa.Table) -> pa.Table:
        component, block = group.column("component").to_numpy(), group.column("block").to_numpy()
        gid, copies = group.column("gid").to_numpy(), group.column("copies").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        out = np.zeros(len(gid), np.int64)
        order = np.argsort(component, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            u = _unit(_matrix(group.column("v").take(pa.array(at)), len(at)))
            left, right = np.flatnonzero(block[at] == i), np.flatnonzero(block[at] == j)
            for k in range(0, len(left), 512):
                x = left[k : k + 512]
                near = u[x] @ u[right].T >= threshold
                if i == j:
                    near &= gid[at[x]][:, None] != gid[at[right]][None, :]
                else:
                    out[at[right]] += near.T @ copies[at[x]]
                out[at[x]] += near @ copies[at[right]]
        return pa.table({"gid": pa.array(gid), "links": pa.array(out)})

    return rows.groupBy("home", "i", "j").applyInArrow(count, "gid long, links long").groupBy("gid").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per row of `rows`: vec_id, n_links, component_id and kept.

    Vectors are compared only within equal labels and equal lengths. A null, zero or empty vector, one with null or
    non-finite components, and one without a label link with nothing: n_links 0, component_id their own id,
    kept. Equal vectors of a label are links of each other. Repeated ids are separate vectors; the smallest id of
    a component is kept on every row that bears it. A null id never becomes a component's id unless all are
    null. An empty table gives an empty result; extra columns are not read.
    """
    base = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.when(usable(embedding) & F.col(label).isNotNull(), F.col(embedding).cast("array<double>")).alias("v"))
    # Two hashes tell vectors apart; distinct ones are numbered when they are written.
    hashes = [F.when(F.col("v").isNotNull(), F.xxhash64(*seed, "label", "v")).alias(c) for c, seed in (("h", ()), ("g", (F.lit(1),)))]
    base = base.select("vec_id", "label", "v", *hashes)
    groups = base.where("v is not null").groupBy("h", "g").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("v").alias("v"))
    vectors = materialize(groups.withColumn("dim", F.size("v")).withColumn("gid", F.monotonically_increasing_id()), "vectors")
    parts = connected_components(window_links(vectors.select("label", "dim", "gid", "v"), threshold), "vector-links").withColumnRenamed("node", "gid")
    members = materialize(parts.join(vectors.select("gid", "copies", "low", "v"), "gid"), "vector-members")
    counts = links_within(members.select("component", "gid", "copies", "v"), threshold)
    lowest = members.groupBy("component").agg(F.min("low").alias("component_low"))
    named = members.select("gid", "component").join(lowest, "component").join(counts, "gid", "left").select("gid", "component_low", "links")
    result = vectors.select("h", "g", "gid", "copies", "low").join(named, "gid", "left").select("h", "g", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_low", "low").alias("component_id"))
    return (
        base.select("vec_id", "h", "g").join(result, ["h", "g"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def op10(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `embeddings`."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL_OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), n AS (SELECT a, count(*) AS n FROM p GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

QUERIES = {"op10_embedding_near_dedup": op10}
SQL = {"op10_embedding_near_dedup": SQL_OP10}
