"""SimHash near-duplicates by anchor-point covering.

Every document gets a 64-bit fingerprint of its word shingles. Equal fingerprints are collapsed first.
The anchors are the words of a covering code: the direct product of repetition codes of odd lengths
that fill the 64 bits. A repetition code of length n covers every n-bit pattern within (n - 1) / 2 bits,
so each fingerprint has one anchor within the covering radius in every block: the pattern of block
majorities, its *home*. If x and y differ in at most t bits, then in each block y lies within the block's
covering radius plus its share of t from x's home. So every fingerprint is replicated to all anchors
that exceed the blocks' covering radii by at most t bits in total, and each home member is compared
with the fingerprints that reach its anchor: no link can be missed. The blocks are as many as the number
of distinct fingerprints asks for, so that the homes of an anchor stay few; anchors with many homes are cut
into a grid of cells. A cell returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, few_files, materialize, table

SEED = 42
HOMES_PER_ANCHOR = 256
HOMES_PER_CELL = 4096
FINGERPRINTS_PER_TASK = 20_000


def shingles_of(text: bytes | None, ngram: int) -> list[bytes]:
    """All runs of `ngram` words of one UTF-8 text; fewer words are one run, no words none."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    joined = b" ".join(words)
    if len(words) < ngram:
        return [joined]
    starts = [0, *(e + 1 for e in ends)]
    return [joined[s:e] for s, e in zip(starts, ends[ngram - 1 :], strict=False)]


def fingerprint(text: bytes | None, ngram: int = 3) -> int:
    """The SimHash of one UTF-8 text as a signed 64-bit number; 0 for a text without words."""
    shingles = shingles_of(text, ngram)
    if not shingles:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def simhash(docs: DataFrame, text: str = "text", out: str = "fingerprint", ngram: int = 3) -> DataFrame:
    """`docs` with a long column `out`: the fingerprint of the whole text (null text: like an empty one)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, ngram) for t in texts], dtype="int64")

    return docs.withColumn(out, of(F.col(text).cast("binary")))


def block_lengths(blocks: int) -> list[int]:
    """Odd lengths that add up to 64 or, for an odd number of blocks, to 63; as even as can be."""
    total = 64 if blocks % 2 == 0 else 63
    base = total // blocks
    base -= base % 2 == 0
    return [base + 2 * (k < (total - base * blocks) // 2) for k in range(blocks)]


def blocks_for(n: int) -> int:
    """How many blocks the code has for n distinct fingerprints: at least 12, at most 21."""
    for blocks in (12, 16, 20):
        if n <= HOMES_PER_ANCHOR << blocks:
            return blocks
    return 21


def anchors(fps: np.ndarray, lengths: list[int], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, anchor and whether it is the home, for all anchors that each fingerprint reaches."""
    n, at, home, cost = len(fps), 0, np.zeros(len(fps), np.int64), []
    for k, length in enumerate(lengths):
        ones = np.bitwise_count(fps >> np.uint64(at) & np.uint64((1 << length) - 1)).astype(np.int64)
        home |= (ones > length // 2).astype(np.int64) << k
        cost.append(np.where(ones > length // 2, ones - length // 2, length // 2 + 1 - ones))  # bits that turn the majority
        at += length
    rows, found = [np.arange(n)], [home]
    for size in range(1, threshold + 1):
        for ks in combinations(range(len(lengths)), size):
            hit = np.flatnonzero(sum(cost[k] for k in ks) <= threshold)
            rows.append(hit)
            found.append(home[hit] ^ sum(1 << k for k in ks))
    is_home = np.zeros(sum(map(len, rows)), bool)
    is_home[:n] = True
    return np.concatenate(rows), np.concatenate(found), is_home


def forest(homes: np.ndarray, guests: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes and the smaller of the guests."""
    a, b = [], []
    guests = np.unique(guests)
    homes = np.unique(homes)
    root = np.arange(len(guests))
    step = max(1, 4_000_000 // max(1, len(guests)))
    for i in range(0, len(homes), step):
        near = np.bitwise_count(homes[i : i + step, None] ^ guests[None, :]) <= threshold
        near &= guests[None, :] < homes[i : i + step, None]
        for k in np.flatnonzero(near.any(1)):
            hit = np.flatnonzero(near[k])
            roots, one = np.unique(root[hit], return_index=True)  # one linked guest of each tree so far
            a.append(np.full(len(roots), homes[i + k]))
            b.append(guests[hit[one]])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def link_fingerprints(fps: DataFrame, threshold: int = 3, column: str = "fingerprint") -> DataFrame:
    """Edges (`a`, `b`) that connect all distinct fingerprints that differ in `threshold` bits or fewer."""
    rows = fps.count()
    fps = materialize(few_files(fps.select(F.col(column).alias("fp")).where("fp is not null").distinct(), rows), "fingerprints")
    n = fps.count()
    lengths = block_lengths(blocks_for(n))
    fps = fps.repartition(max(1, n // FINGERPRINTS_PER_TASK))  # a small table, of which every row becomes hundreds

    def reach(batches):
        for batch in batches:
            all_fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(all_fps), 2048):
                part = all_fps[i : i + 2048]
                rows, anchor, home = anchors(part.view(np.uint64), lengths, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[rows]), pa.array(home)], ["anchor", "fp", "home"])

    reached = fps.mapInArrow(reach, "anchor long, fp long, home boolean")

    def own(batches):
        for batch in batches:
            all_fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            _, anchor, home = anchors(all_fps.view(np.uint64), lengths, 0)
            yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])

    # At most one row per HOMES_PER_CELL distinct fingerprints, and never more than there are anchors.
    hot = (
        fps.mapInArrow(own, "anchor long").groupBy("anchor").count().where(F.col("count") > HOMES_PER_CELL)
        .select("anchor", F.ceil(F.col("count") / HOMES_PER_CELL).cast("int").alias("cuts"))
    )
    side = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    cells = reached.join(F.broadcast(hot), "anchor", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    as_home = F.transform(every, lambda t: F.struct((side * F.col("cuts") + t).alias("cell"), F.lit(1).alias("role")))
    as_guest = F.transform(every, lambda s: F.struct((s * F.col("cuts") + side).alias("cell"), F.lit(0).alias("role")))
    whole = F.array(F.struct(F.lit(0).alias("cell"), F.when(F.col("home"), 2).otherwise(0).alias("role")))
    cells = cells.select(
        "anchor", "fp",
        F.explode(F.when(F.col("cuts") == 1, whole).when(F.col("home"), F.concat(as_home, as_guest)).otherwise(as_guest)).alias("at"),
    ).select("anchor", "at.cell", "fp", "at.role")

    def compare(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        role = group.column("role").to_numpy()  # 0 guest, 1 home of a cut anchor, 2 both
        a, b = forest(fp[role > 0], fp[role != 1], threshold)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cells.groupBy("anchor", "cell").applyInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 3, ngram: int = 3) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `fp` (long fingerprint) and `component_id`.

    `component_id` is the smallest id among all documents reached through links of `threshold` bits or
    fewer, the document itself included. Null and empty texts have fingerprint 0 and link like any other.
    Repeated rows give repeated results; a null id is kept and never becomes a component's id unless the
    whole component has null ids. An empty table gives an empty result. Extra columns are not looked at.
    """
    prints = materialize(simhash(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text", "fp", ngram).select("doc_id", "fp"), "simhash")
    parts = connected_components(link_fingerprints(prints, threshold, "fp"), "simhash-links")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    placed = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op4(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of `documents`."""
    parts = simhash_components(table(spark, sf_dir, "documents"))
    return parts.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_near_dedup": op4}
SQL: dict[str, str] = {}
