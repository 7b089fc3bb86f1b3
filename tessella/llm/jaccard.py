"""Near-duplicates by SimHash anchors, checked by the Jaccard similarity of word shingles.

Two documents link if their sets of five-word shingles have a Jaccard similarity of MIN_JACCARD or more. Documents
with the same words are collapsed first. Candidates come from SimHash fingerprints of the shingle sets by anchor-point
covering. At 0.8 about 15 of 100 bits differ, so the radius that would cover them in one code sends each fingerprint to
most anchors. Instead the fingerprint has many short parts, each with a code of its own: a part's bits are its home
anchor, and it reaches all anchors that agree with it outside its WEAK weakest bits, those whose sums are nearest to
zero. Homes are compared with all fingerprints that reach their anchor, on FILTER_BITS bits; what lies within NEAR
bits, directly or over each other, at anchors that one task compares is a bucket. `layout` takes as many parts as keep the chance that a pair at 0.8
reaches no common anchor below MISSED. Anchors with many homes are cut into a grid of cells.

Two near texts meet at many anchors, so buckets that share a text are joined into one group, in which each text stands
once; a text's buckets are tied to each other before that, so joins get few rows per text however many texts it meets.
Every link is checked on the whole shingle sets. In a group of more than MEMBERS_PER_CELL each member is first compared
with the lowest LEADERS of its buckets' leaders, their lowest keys. Then groups whose members are still apart are compared in
full, in cells: the members of a group's largest component need no comparison with each other, so cells hold slices of
them against slices of the others. A cell returns a spanning forest of its links, never all pairs. A group of more than
MEMBERS_PER_CELL that would be more work than its buckets, such as a long chain, is compared by its buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from .common import connected_components, materialize, row_id
from .simhash import shingles_of

SEED = 7
NGRAM, MIN_JACCARD = 5, 0.8
WEAK, MISSED = 2, 1e-5
FILTER_BITS, NEAR = 192, 60
HOMES_PER_ANCHOR, HOMES_PER_CELL = 512, 1024
ROWS_PER_GROUP = 8192
LEADERS = 2
MEMBERS_PER_CELL = 1024
PAIRS_PER_MEMBER = 100
GRAMS_PER_INDEX = 2_000_000

#: Bits of a part -> share of pairs at 0.8 that meet in one part, by simulation: the least over sets of 5 to 400 shingles.
MEETING = {12: 0.43, 14: 0.31, 16: 0.22, 18: 0.15}


def layout(rows: int) -> tuple[int, int]:
    """Bits of a part and number of parts for this many documents."""
    bits = next((b for b in MEETING if rows <= HOMES_PER_ANCHOR << b), max(MEETING))
    return bits, math.ceil(math.log(MISSED) / math.log(1 - MEETING[bits]))


def gram_hashes(text: bytes | None, ngram: int = NGRAM) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; fewer words than `ngram` are one shingle."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles_of(text, ngram)], dtype=np.uint64))


def sign_sums(grams: np.ndarray, bits: int) -> np.ndarray:
    """For each of `bits` positions (a multiple of 64): shingles whose bit is set, less those whose bit is not."""
    ones = np.zeros(bits, np.int64)
    for i in range(0, len(grams), 4096):
        z = grams[i : i + 4096, None] + np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return 2 * ones - len(grams)


def anchors_of(grams: np.ndarray, bits: int, parts: int) -> tuple[list[int], list[int]]:
    """The first FILTER_BITS of the fingerprint as longs, and each part's home and weak bits: home << 10 | weak << 5 | weak."""
    if not len(grams):
        return [], []
    sums = sign_sums(grams, -(-max(bits * parts, FILTER_BITS) // 64) * 64)
    ones = sums > 0
    fp = np.packbits(ones[:FILTER_BITS], bitorder="little").view("<i8")
    part = ones[: bits * parts].reshape(parts, bits)
    home = part @ (1 << np.arange(bits))
    margin = 2 * np.abs(sums[: bits * parts].reshape(parts, bits)) - part
    weak = np.argpartition(margin, WEAK, axis=1)[:, :WEAK]
    return fp.tolist(), (home << 10 | weak[:, 0] << 5 | weak[:, 1]).tolist()


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of one non-empty sorted set with others, none of them empty."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    common = np.add.reduceat(one[at] == flat, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
    return common / (len(one) + sizes - common)


def forest(keys: np.ndarray, trees: np.ndarray, sets: list[np.ndarray], least: float = MIN_JACCARD) -> tuple[list[int], list[int]]:
    """Links that connect all members of different trees at `least` or more, directly or over each other."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    keys, sets = keys[order], [sets[k] for k in order]
    root = np.unique(trees[order], return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    lows = np.searchsorted(sizes, least * sizes - 1e-9)  # smaller sets can't reach `least`
    ends = np.cumsum(sizes)
    a, b, start = [], [], 0
    while start < len(sets):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + GRAMS_PER_INDEX, "right")))
        flat = np.concatenate(sets[start:stop])
        by_gram = np.argsort(flat, kind="stable")
        holders = np.repeat(np.arange(stop - start), sizes[start:stop])[by_gram]
        grams, first = np.unique(flat[by_gram], return_index=True)
        first = np.r_[first, len(flat)]
        for i in range(start + 1, len(sets)):
            if lows[i] >= stop:
                break
            lo, hi = max(start, lows[i]), min(i, stop)
            if (root[lo:hi] == root[i]).all():
                continue
            at = np.minimum(np.searchsorted(grams, sets[i]), len(grams) - 1)
            at = at[grams[at] == sets[i]]
            many = first[at + 1] - first[at]
            held = holders[np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            common = np.bincount(held, minlength=stop - start)[lo - start : hi - start]
            for j in lo + np.flatnonzero(common / (sizes[i] + sizes[lo:hi] - common) >= least):
                if root[j] != root[i]:
                    a.append(int(keys[i])), b.append(int(keys[j]))
                    root[root == root[j]] = root[i]
        start = stop
    return a, b


def _prints(docs: DataFrame, bits: int, parts: int) -> DataFrame:
    """doc_id, rid, key (hash of the words), fp and parts of every row; the last two are empty for a text without words."""

    def sketch(batches):
        for batch in batches:
            keys, fps, homes = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                keys.append(xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split()), SEED) - (1 << 63))
                fp, home = anchors_of(gram_hashes(text), bits, parts)
                fps.append(fp), homes.append(home)
            columns = [batch.column("doc_id"), batch.column("rid"), pa.array(keys, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(homes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rid", "key", "fp", "parts"])

    return docs.mapInArrow(sketch, docs.select("doc_id", "rid").schema.add("key", "long").add("fp", ArrayType(LongType())).add("parts", ArrayType(IntegerType())))


def near_groups(keys: np.ndarray, fps: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members (lowest key of the group, key) of all groups of keys that links between homes and guests within NEAR bits connect.

    `fps` has a row of 64-bit numbers per key; `role` is 0 for a guest, 1 for a home, 2 for both.
    """
    names, at = np.unique(keys, return_inverse=True)
    root = np.arange(len(names))
    homes, guests = np.flatnonzero(role > 0), np.flatnonzero(role != 1)
    step = max(1, 2_000_000 // max(1, len(guests)))
    for i in range(0, len(homes), step):
        some = homes[i : i + step]
        apart = np.zeros((len(some), len(guests)), np.uint8)
        for k in range(fps.shape[1]):
            apart += np.bitwise_count(fps[some, k][:, None] ^ fps[guests, k])
        near = apart <= NEAR
        for k in np.flatnonzero(near.sum(1) > (role[some] == 2)):  # a home that is a guest too finds itself
            hit = root[np.append(at[guests[near[k]]], at[some[k]])]
            low = hit.min()
            if (hit != low).any():
                root[np.isin(root, hit)] = low
    held = np.bincount(root, minlength=len(names))[root] > 1
    return names[root[held]], names[held]


def tied(low: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members (lowest key of the bucket, key) of the buckets that the pairs of `low` and `key` connect; a key stands in one bucket."""
    names, at = np.unique(np.r_[low, key], return_inverse=True)
    a, b = at[: len(low)], at[len(low) :]
    root = np.arange(len(names))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)  # roots, too, so that a step joins whole buckets
        np.minimum.at(root, root[b], least)
        while (root != root[root]).any():
            root = root[root]
    return names[root], names


def link_anchors(prints: DataFrame, bits: int, rows: int) -> DataFrame:
    """Members (`bucket`, `key`) of all buckets of near fingerprints, one for all anchors of a `place` that share keys, with the bucket's lowest key as `leader`; `prints` has one row per key."""
    flip = lambda bit, shift: F.when(F.col("turn").bitwiseAND(bit) > 0, F.expr(f"shiftleft(1, cast(shiftright(at, {shift}) & 31 as int))")).otherwise(0)
    words = [F.col("fp")[k].alias(f"f{k}") for k in range(FILTER_BITS // 64)]
    held = prints.select("key", *words, F.posexplode("parts").alias("part", "at"))
    held = held.withColumn("turn", F.explode(F.array(*map(F.lit, range(1 << WEAK)))))
    home = F.expr(f"cast(part as long) * {1 << max(MEETING)} + shiftright(at, 10)")
    reached = held.withColumn("anchor", home.bitwiseXOR(flip(1, 0).cast("long")).bitwiseXOR(flip(2, 5).cast("long")))
    # At most one row per HOMES_PER_CELL homes.
    hot = prints.select(F.posexplode("parts").alias("part", "at")).groupBy(home.alias("anchor")).count().where(F.col("count") > HOMES_PER_CELL)
    hot = hot.select("anchor", F.ceil(F.col("count") / HOMES_PER_CELL).cast("int").alias("cuts"))
    side = F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    cells = reached.join(F.broadcast(hot), "anchor", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    as_home = F.transform(every, lambda t: F.struct((side * F.col("cuts") + t).alias("cell"), F.lit(1).alias("role")))
    as_guest = F.transform(every, lambda s: F.struct((s * F.col("cuts") + side).alias("cell"), F.lit(0).alias("role")))
    whole = F.array(F.struct(F.lit(0).alias("cell"), F.when(F.col("turn") == 0, 2).otherwise(0).alias("role")))
    names = [f"f{k}" for k in range(len(words))]
    cells = cells.select(
        "anchor", "key", *names,
        F.explode(F.when(F.col("cuts") == 1, whole).when(F.col("turn") == 0, F.concat(as_home, as_guest)).otherwise(as_guest)).alias("to"),
    )
    # Anchors with few fingerprints share a group.
    shared = max(0, math.floor(math.log2(ROWS_PER_GROUP * 2**bits / (max(1, rows) << WEAK))))
    place = F.shiftrightunsigned("anchor", min(shared, bits))

    def compare(group: pa.Table) -> pa.Table:
        anchor, key, role = (group.column(c).to_numpy() for c in ("anchor", "key", "role"))
        order = np.argsort(anchor, kind="stable")
        anchor, key, role = anchor[order], key[order], role[order]
        fps = np.stack([group.column(c).to_numpy().view(np.uint64) for c in names], 1)[order]
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        found = [near_groups(key[lo:hi], fps[lo:hi], role[lo:hi]) for lo, hi in zip(starts, np.r_[starts[1:], len(anchor)], strict=True) if hi - lo > 1]
        low, key = tied(*map(np.concatenate, zip(*found, strict=True))) if found else [np.zeros(0, np.int64)] * 2
        at = {c: np.full(len(key), group.column(c)[0].as_py()) for c in ("place", "cell")}
        return pa.table({"place": pa.array(at["place"], pa.int64()), "low": pa.array(low), "key": pa.array(key), "cell": pa.array(at["cell"], pa.int32())})

    cells = cells.select("anchor", "key", *names, "to.cell", "to.role", place.alias("place"))
    near = cells.groupBy("place", "cell").applyInArrow(compare, "place long, low long, key long, cell int")
    return near.select(F.xxhash64("place", "cell", "low").alias("bucket"), "key", F.col("low").alias("leader"))


def _sets(docs: DataFrame) -> DataFrame:
    """key and grams (the sorted hashes as bytes) of every row."""

    def cut(batches):
        for batch in batches:
            grams = [gram_hashes(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(grams, pa.binary())], ["key", "grams"])

    return docs.mapInArrow(cut, "key long, grams binary")


def spokes(stars: DataFrame) -> DataFrame:
    """Edges (`a`, `b`) that connect what `key` and its `leaders`, in ascending order, connect: all go to the key's lowest leader.

    Keys of a large bucket have the same leaders, so distinct edges are about one per key; a join of keys and leaders would have a row for
    each meeting.
    """
    to_lowest = F.transform(F.slice("leaders", 2, F.greatest(F.size("leaders"), F.lit(1))), lambda x: F.struct(x.alias("a"), F.col("leaders")[0].alias("b")))
    own = F.array(F.struct(F.col("key").alias("a"), F.col("leaders")[0].alias("b")))
    return stars.select(F.explode(F.concat(own, to_lowest)).alias("e")).select("e.a", "e.b").distinct()


def link_leaders(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links among `pairs` (`a`, `b`) of members and leaders, at most LEADERS pairs per member."""

    @F.pandas_udf("double")
    def similarity(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([overlaps(np.frombuffer(x, np.uint64), [np.frombuffer(y, np.uint64)])[0] for x, y in zip(one, other, strict=True)], dtype="float64")

    one, other = sets.select(F.col("key").alias("a"), F.col("grams").alias("one")), sets.select(F.col("key").alias("b"), F.col("grams").alias("other"))
    return pairs.join(one, "a").join(other, "b").where(similarity("one", "other") >= least).select("a", "b")


def comparisons(near: DataFrame, groups: DataFrame, large: DataFrame) -> DataFrame:
    """Members (`bucket`, `key`) of what is to be compared in full: `groups`, but buckets for `large` groups that are more work than their buckets.

    A group with a row per member takes as much work as its pairs; buckets hold a member many times, and to bring a text to a bucket
    takes as long as PAIRS_PER_MEMBER comparisons.
    """
    of_large = groups.join(F.broadcast(large), "bucket").select("key", F.col("bucket").alias("group"), "n")
    buckets = near.groupBy("bucket").agg(F.count("*").alias("held"), F.first("leader").alias("key"))
    work = F.sum(F.col("held").cast("double") * (F.col("held") + PAIRS_PER_MEMBER))
    wide = buckets.join(of_large, "key").groupBy("group", "n").agg(work.alias("work")).where(F.col("n").cast("double") * F.col("n") > F.col("work"))
    wide = materialize(wide.select("group"), "shingle-wide")  # as few rows as `large`
    parted = near.join(of_large.join(F.broadcast(wide), "group").select("key"), "key").select("bucket", "key")
    return groups.join(F.broadcast(wide.withColumnRenamed("group", "bucket")), "bucket", "left_anti").select("bucket", "key").unionByName(parted)


def link_cells(members: DataFrame, sets: DataFrame, trees: DataFrame, least: float) -> DataFrame:
    """Links (`a`, `b`) between members of a bucket that stand in different trees."""
    placed = members.join(trees.withColumnRenamed("node", "key").withColumnRenamed("component", "tree"), "key", "left").withColumn("tree", F.coalesce("tree", "key"))
    sized = placed.groupBy("bucket", "tree").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    # Buckets with the same members are compared once.
    apart = sized.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "tree")).alias("major"), F.count("*").alias("trees"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")
    ).where("trees > 1")
    apart = apart.groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "major")).alias("o"))
    cuts = lambda n: F.ceil(n / MEMBERS_PER_CELL).cast("int")
    apart = apart.select("o.bucket", F.col("o.major.tree").alias("major"), cuts(F.col("o.major.n")).alias("majors"), cuts(F.col("n") - F.col("o.major.n")).alias("minors"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod(F.xxhash64("key", F.lit(2)), F.col(n)).cast("int")
    cell = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    as_major = F.transform(every("minors"), lambda t: cell(mine("majors"), t))
    as_minor = F.transform(every("majors"), lambda s: cell(s, mine("minors")))
    others = F.transform(F.filter(every("minors"), lambda t: t != mine("minors")), lambda t: cell(-1 - F.least(t, mine("minors")), F.greatest(t, mine("minors"))))
    cells = placed.join(apart, "bucket").select("bucket", "key", "tree", F.explode(F.when(F.col("tree") == F.col("major"), as_major).otherwise(F.concat(as_minor, others))).alias("at"))

    def compare(group: pa.Table) -> pa.Table:
        held = [np.frombuffer(g.as_py(), np.uint64) for g in group.column("grams")]
        a, b = forest(group.column("key").to_numpy(), group.column("tree").to_numpy(), held, least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.join(sets, "key").select("bucket", "at.x", "at.y", "key", "tree", "grams").groupBy("bucket", "x", "y").applyInArrow(compare, "a long, b long")


def _placed(docs: DataFrame, doc_id: str, text: str, least: float) -> DataFrame:
    """doc_id, rid, component, and `first`: the smallest (doc_id, rid) of the component, of every row of `docs`; null ids are not smallest."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), row_id(doc_id, text).alias("rid"), F.col(text).cast("binary").alias("text"))
    bits, parts = layout(docs.count())
    prints = materialize(_prints(narrow, bits, parts), "shingle-prints")
    own = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rid")))
    distinct = prints.groupBy("key").agg(own.alias("first"), F.min("rid").alias("rid"), F.first("fp").alias("fp"), F.first("parts").alias("parts"))
    lows = materialize(distinct, "shingle-keys")
    near = materialize(link_anchors(lows.select("key", "fp", "parts"), bits, lows.count()), "shingle-near")
    stars = materialize(near.where("key <> leader").groupBy("key").agg(F.array_sort(F.collect_set("leader")).alias("leaders")), "shingle-stars")
    groups = materialize(connected_components(spokes(stars), "shingle-groups").select(F.col("component").alias("bucket"), F.col("node").alias("key")), "shingle-members")
    # At most one row per MEMBERS_PER_CELL texts.
    large = materialize(groups.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS_PER_CELL), "shingle-large")
    wanted = groups.select("key").join(lows.select("key", "rid"), "key")
    sets = materialize(_sets(narrow.select("rid", "text").join(wanted, "rid").dropDuplicates(["key"]).select("key", "text")), "shingle-sets")
    of_large = stars.join(groups.join(F.broadcast(large), "bucket").select("key"), "key")
    first = link_leaders(of_large.select(F.col("key").alias("a"), F.explode(F.slice("leaders", 1, LEADERS)).alias("b")), sets, least)
    trees = connected_components(first, "leader-trees")
    second = link_cells(comparisons(near, groups, large), sets, trees, least)
    parts = connected_components(trees.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second), "shingle-links")
    placed = lows.join(parts.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("component", "key").alias("component"))
    named = placed.join(placed.groupBy("component").agg(F.min("first").alias("low")), "component").select("key", "component", F.col("low").alias("first"))
    return prints.select("doc_id", "rid", "key").join(named, "key").select("doc_id", "rid", "component", "first")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = MIN_JACCARD) -> DataFrame:
    """One row per row of `docs`: `doc_id` and `component_id`, the smallest id among all documents reached through links.

    Null and empty texts are one group. Repeated rows give repeated results; a null id is kept and never becomes a
    component's id unless the whole component has null ids. An id that stands for several texts is in the component of each. An
    empty table gives an empty result.
    """
    return _placed(docs, doc_id, text, least).select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = MIN_JACCARD) -> DataFrame:
    """`docs` without near-duplicates: of each component one document stays, the one with the smallest id.

    A document is an id with its text: an id's other texts stay or go by their own components, and of several
    near-duplicates under the smallest id one stays. A row whose id is null is never dropped; rows that repeat a document that
    stays give one row.
    """
    parts = _placed(docs, doc_id, text, least)
    gone = parts.where("doc_id is not null and (doc_id <> first.doc_id or rid <> first.rid)")
    dropped = gone.select(F.col("doc_id").alias("_dropped"), F.col("rid").alias("_rid")).distinct()
    kept = docs.join(dropped, (F.col(doc_id) == dropped["_dropped"]) & (row_id(doc_id, text) == dropped["_rid"]), "left_anti")
    named = F.col(doc_id).isNotNull()
    if not docs.where(named).groupBy(doc_id).agg(F.count("*").alias("n")).where("n > 1").take(1):  # narrow: spares most inputs a shuffle of their texts
        return kept
    return kept.where(named).dropDuplicates([doc_id, text]).unionByName(kept.where(~named))
