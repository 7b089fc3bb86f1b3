"""The prefix trie of conversations: nodes, members, and the tokens that sharing prefixes saves.

A turn is known by 128 bits of a SHA-256 over its role and text. Its conversation's prefix of d turns has a
polynomial fingerprint, the sum of x_k B^k over its turns k = 1..d modulo two primes, where x_k comes from the turn's
identity. Turns are dealt by range of conversation and turn, so a long conversation spreads over tasks; numpy scans
each partition, and one row per partition carries the sums across borders.

Prefixes with equal depth and fingerprint are candidates for one node. The group's identities at that depth are compared
with its representative's, the member with the smallest id. Equal fingerprints with equal last turns have equal
fingerprints one turn before, so if all groups agree turn by turn, all their prefixes are equal. Members that differ are
split off with everything behind them, until all groups agree.

The rollup to parents needs no loop over depths. A node's representative also represents all nodes below it on its path, and
each node belongs to one such chain. What a subtree sums up is what its members' chains hold, less the part of the
representative's chain above the node: running sums along chains and one grouped sum.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, table

#: Base and modulus of the two polynomials; products of two residues fit into 62 bits.
POLYNOMIALS = ((1_103_515_247, 2_147_483_647), (1_664_525_321, 2_147_483_629))
PLAIN = (1, 1 << 62)  # base and modulus of an ordinary sum
ID_BITS = 10  # a piece of a node's ids holds those that agree but for the last bits
HEAD = 5  # turns that a conversation can take over
KEY = ("depth", "g1", "g2", "split")
NO_SPLIT = "array<struct<depth:bigint,c1:bigint,c2:bigint>>"


def powers(base: int, modulus: int, k: np.ndarray) -> np.ndarray:
    """base ** k modulo `modulus` for an array of exponents."""
    if base == 1:
        return np.ones(len(k), np.int64)

    def row(b: int, n: int) -> np.ndarray:
        out = np.ones(1, np.int64)
        while len(out) < n:  # doubling: the second half is the first times a power
            out = np.concatenate([out, out * pow(b, len(out), modulus) % modulus])
        return out

    low, high = k & 0xFFFF, k >> 16
    return row(base, int(low.max()) + 1)[low] * row(pow(base, 1 << 16, modulus), int(high.max()) + 1)[high] % modulus


def scan_batch(keys: np.ndarray, values: list[np.ndarray], polynomials, state):
    """Positions and running sums per run of equal keys; `state` is (key, position, sums) of the row before, or None."""
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    if state is not None and state[0] != keys[0]:
        state = None
    first = np.zeros(n, np.int64)
    first[starts] = starts
    first = np.maximum.accumulate(first)
    position = np.arange(n) - first + 1
    goes_on = first == 0  # rows of the first run, which may continue the batch before
    if state is not None:
        position[goes_on] += state[1]
    sums = []
    for k, (value, (base, modulus)) in enumerate(zip(values, polynomials, strict=True)):
        y = value % modulus * powers(base, modulus, position) % modulus
        run = np.cumsum(y)
        run -= (run - y)[first]
        if state is not None:
            run[goes_on] += state[2][k]
        sums.append(run % modulus)
    return position, sums, (keys[-1], int(position[-1]), [int(s[-1]) for s in sums])


def prefix_sums(df: DataFrame, key: str, order: tuple[str, ...], values: dict[str, tuple[int, int]], name: str) -> DataFrame:
    """`df` with `position` (from 1) of each row among those of its `key`, in `order`, and `<value>_sum` up to it.

    A sum adds value x base^position modulo the polynomial's modulus; PLAIN adds values as they are. `key` is a long column
    without nulls. Rows are dealt by ranges of key and order, so rows of one key may stand in many partitions.
    """
    cols, polynomials = list(values), list(values.values())
    schema = T.StructType(list(df.schema.fields)).add("position", "long")
    for c in cols:
        schema.add(f"{c}_sum", "long")
    schema.add("piece", "integer").add("opens", "boolean").add("closes", "boolean")

    def scan(batches):
        piece, opening, state, held = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.zeros(len(held[0]), bool))], schema.names)
            keys = batch.column(key).to_numpy()
            opening = keys[0] if opening is None else opening
            position, sums, state = scan_batch(keys, [batch.column(c).to_numpy() for c in cols], polynomials, state)
            held = [*batch.columns, pa.array(position), *map(pa.array, sums), pa.array(np.full(len(keys), piece, np.int32)), pa.array(keys == opening)]
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held, pa.array(np.arange(len(held[0])) == len(held[0]) - 1)], schema.names)

    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    local = materialize(dealt.mapInArrow(scan, schema), name)
    tails = local.where("closes").select("piece", key, "position", "opens", *[f"{c}_sum" for c in cols]).orderBy("piece").collect()  # one row per partition
    carries, state = [], None
    for r in tails:
        if state is not None:
            carries.append((r["piece"], state[0], state[1], *[x for s, p in zip(state[2], polynomials, strict=True) for x in (s, pow(p[0], state[1], p[1]))]))
        before = state if state is not None and state[0] == r[key] and r["opens"] else (None, 0, [0] * len(cols))
        state = (r[key], before[1] + r["position"], [(s + pow(p[0], before[1], p[1]) * r[f"{c}_sum"]) % p[1] for c, s, p in zip(cols, before[2], polynomials, strict=True)])
    fields = "".join(f", s{k} long, m{k} long" for k in range(len(cols)))
    carried = df.sparkSession.createDataFrame(carries, f"piece int, _key long, n long{fields}")
    joined = local.join(F.broadcast(carried), "piece", "left")
    held = F.col("opens") & (F.col("_key") == F.col(key))
    sums = [
        F.when(held, (F.col(f"s{k}") + F.col(f"m{k}") * F.col(f"{c}_sum")) % p[1]).otherwise(F.col(f"{c}_sum")).alias(f"{c}_sum")
        for k, (c, p) in enumerate(values.items())
    ]
    return joined.select(*df.columns, F.when(held, F.col("n") + F.col("position")).otherwise(F.col("position")).alias("position"), *sums)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, the turn's identity (c1, c2: 64 bits each, in the order of their hexadecimal digits), and its code points."""

    def digest(batches):
        for batch in batches:
            halves = []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                halves.append(hashlib.sha256(b"%d:%s%s" % (len(role), role, text)).digest()[:16])
            both = (np.frombuffer(b"".join(halves), ">u8").reshape(-1, 2) ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), batch.column("points")], ["conv_id", "turn", "c1", "c2", "points"])

    text = F.coalesce("text", F.lit(""))
    read = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).cast("binary").alias("role"), text.cast("binary").alias("text"), F.char_length(text).cast("long").alias("points")
    )
    return read.mapInArrow(digest, read.select("conv_id", "turn").schema.add("c1", "long").add("c2", "long").add("points", "long"))


def rebuilt(turns: DataFrame, polynomials=POLYNOMIALS) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and the conversations themselves.

    Turns: conv_id, depth, fingerprint g1 and g2 of the prefix that ends there, p1 and p2 of the one before, c1, c2, points
    and last (whether the conversation ends there). Conversations: conv_id and turns. A rebuilt fingerprint follows from those of the
    original prefixes: own turns move by a known number of places, which is a factor.
    """
    (b1, m1), (b2, m2) = polynomials
    valued = turns.withColumns({"v1": F.pmod("c1", F.lit(m1)), "v2": F.pmod("c2", F.lit(m2))})
    scanned = prefix_sums(valued, "conv_id", ("turn", "c1", "c2"), {"v1": (b1, m1), "v2": (b2, m2)}, "trie-turns")
    scanned = materialize(scanned.select("conv_id", "position", "c1", "c2", "v1", "v2", "points", F.col("v1_sum").alias("g1"), F.col("v2_sum").alias("g2")), "trie-prefixes")
    head = F.struct("position", "g1", "g2", "c1", "c2", "points")
    convs = scanned.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("position") <= HEAD, head))).alias("head"))
    convs = materialize(convs, "trie-heads")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6))
    at = lambda a, k, c: F.when(k > 0, F.element_at(F.col(a), k.cast("int"))[c]).otherwise(F.lit(0).cast("long"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("from_base"))
    plan = convs.withColumn("h", h).withColumn("base", F.expr("conv_id - conv_id % 100")).join(bases, "base", "left")
    plan = plan.withColumn("from_base", F.slice(F.coalesce("from_base", F.array().cast(convs.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    plan = plan.withColumns({"taken": F.size("from_base").cast("long"), "skipped": F.least("h", "n")})
    back = lambda b, m: F.element_at(F.array(*[F.lit(pow(b, -s, m)) for s in range(HEAD + 1)]), (F.col("h") - F.col("taken") + 1).cast("int"))
    plan = materialize(
        plan.select(
            "conv_id", "h", "taken", "from_base", (F.col("taken") + F.col("n") - F.col("skipped")).alias("turns"), back(b1, m1).alias("f1"), back(b2, m2).alias("f2"),
            at("from_base", F.col("taken"), "g1").alias("t1"), at("from_base", F.col("taken"), "g2").alias("t2"), at("head", F.col("skipped"), "g1").alias("s1"), at("head", F.col("skipped"), "g2").alias("s2"),
        ),
        "trie-plan",
    )
    lead = plan.select("conv_id", "turns", "from_base", F.posexplode("from_base").alias("k", "e"))
    before = lambda g: F.when(F.col("k") > 0, F.element_at("from_base", F.col("k"))[g]).otherwise(F.lit(0).cast("long"))
    lead = lead.select("conv_id", F.col("e.position").alias("depth"), "e.g1", "e.g2", before("g1").alias("p1"), before("g2").alias("p2"), "e.c1", "e.c2", "e.points", (F.col("e.position") == F.col("turns")).alias("last"))
    own = scanned.join(plan.drop("from_base"), "conv_id").where("position > h")
    moved = lambda g, k, m: F.pmod(F.col(f"t{k}") + F.pmod(g - F.col(f"s{k}"), F.lit(m)) * F.col(f"f{k}"), F.lit(m))
    # A fingerprint less its last term is that of the prefix before; the last term is v B^position.
    term = lambda v, b, m: F.col(v) * _power(b, m)(F.col("position")) % m
    depth = F.col("position") - F.col("h") + F.col("taken")
    own = own.select(
        "conv_id", depth.alias("depth"), moved(F.col("g1"), 1, m1).alias("g1"), moved(F.col("g2"), 2, m2).alias("g2"),
        moved(F.col("g1") - term("v1", b1, m1), 1, m1).alias("p1"), moved(F.col("g2") - term("v2", b2, m2), 2, m2).alias("p2"), "c1", "c2", "points", (depth == F.col("turns")).alias("last"),
    )
    return materialize(lead.unionByName(own), "trie-rebuilt"), plan.select("conv_id", "turns")


def _power(base: int, modulus: int):
    """base ** position modulo `modulus`, as a column function."""

    @F.pandas_udf("long")
    def power(k: pd.Series) -> pd.Series:
        return pd.Series(powers(base, modulus, k.to_numpy()))

    return power


def verified(rows: DataFrame) -> DataFrame:
    """`rows` with `split`: equal depth, fingerprint and split then mean equal prefixes.

    A split lists the depths at which a prefix differed from its group's representative, with its own turns there.
    """
    rows, marks = rows.withColumn("split", F.array().cast(NO_SPLIT)), None
    base = rows.drop("split")
    while True:
        groups = rows.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), *[f(c).alias(f"{n}{c}") for c in ("c1", "c2") for n, f in (("lo", F.min), ("hi", F.max))])
        mixed = materialize(groups.where("loc1 <> hic1 or loc2 <> hic2").select(*KEY, "rep"), "trie-mixed")
        if not mixed.take(1):
            return rows
        there = rows.join(mixed, list(KEY))
        of_rep = there.where("conv_id = rep").select(*KEY, F.col("c1").alias("r1"), F.col("c2").alias("r2")).distinct()
        new = there.join(of_rep, list(KEY)).where("c1 <> r1 or c2 <> r2").select("conv_id", F.struct("depth", "c1", "c2").alias("mark"))
        marks = materialize(new if marks is None else marks.unionByName(new), "trie-marks")
        found = marks.groupBy("conv_id").agg(F.sort_array(F.collect_list("mark")).alias("marks"))
        above = F.filter(F.coalesce("marks", F.array().cast(NO_SPLIT)), lambda m: m["depth"] <= F.col("depth"))
        rows = materialize(base.join(found, "conv_id", "left").withColumn("split", above).drop("marks"), "trie-split")


def ends_of(rows: DataFrame) -> DataFrame:
    """KEY and `ends_sha256` of every node at which conversations end.

    Ids are joined in pieces of at most 2^ID_BITS consecutive numbers first; the pieces of a node pass through the hash in order, one at a time.
    """
    pieces = rows.where("last").groupBy(*KEY, F.shiftright("conv_id", ID_BITS).alias("piece")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))).alias("ids"))
    named = pieces.select(*KEY, F.xxhash64(*KEY).alias("node"), "piece", "ids")
    schema = named.select(*KEY).schema.add("ends_sha256", "string")

    def hash_up(batches):
        key, last, held = None, None, None
        for batch in batches:
            out = []
            keys, ids = [batch.column(c) for c in KEY], batch.column("ids")
            for k in range(batch.num_rows):
                row = tuple(c[k].as_py() for c in keys[:3]) + (str(keys[3][k].as_py()),)
                if row != key:
                    if key is not None:
                        out.append((last, held.hexdigest()))
                    key, held = row, hashlib.sha256()
                else:
                    held.update(b",")
                held.update(ids[k].as_py().encode())
                last = [c[k].as_py() for c in keys]
            if out:
                yield _ended(out, schema)
        if key is not None:
            yield _ended([(last, held.hexdigest())], schema)

    return named.repartition("node").sortWithinPartitions("node", *KEY, "piece").select(*KEY, "ids").mapInArrow(hash_up, schema)


def _ended(out: list, schema) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    columns = [*zip(*[k for k, _ in out], strict=True), [h for _, h in out]]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.field(i).type) for i, c in enumerate(columns)], kinds.names)


def prefix_trie(conversations: DataFrame, polynomials=POLYNOMIALS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    Columns: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Turns are
    ordered by number, null first; turns of equal number by their identity, so repeated rows are turns of their own.
    Null roles and texts are empty. Rows with a null conversation belong to none and are left out; ids keep their sign, and
    the conversation that c takes turns from is c - c % 100 with the sign of c. Other columns are not read. An empty
    table gives an empty result.
    """
    rows, convs = rebuilt(turns_of(conversations), polynomials)
    rows = verified(rows)
    key, spark = list(KEY), conversations.sparkSession
    nodes = rows.groupBy(*key).agg(F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("conv_id", "p1", "p2", "points")])
    parent = F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("g1"), F.col("p2").alias("g2"), F.filter("split", lambda m: m["depth"] < F.col("depth")).alias("split"))
    nodes = materialize(nodes.select(*key, "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("points")).alias("own"), parent.alias("parent")), "trie-nodes")
    children = nodes.where("depth > 1").groupBy(*[F.col(f"parent.{c}").alias(c) for c in key]).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-children")
    # A node of one member has one leaf and nothing shared below it: only nodes of several members are rolled up.
    shared = nodes.where("n_convs > 1").select(*key, "conv_id", "own")
    above = prefix_sums(shared, "conv_id", ("depth",), {"own": PLAIN}, "trie-chains").select(*key, (F.col("own_sum") - F.col("own")).alias("above"))
    chains = nodes.groupBy("conv_id").agg(F.sum("own").alias("chain"), F.count_if(F.col("n_children") == 0).alias("leaf")).where("chain > 0 or leaf > 0")
    summed = rows.select(*key, "conv_id").join(shared.select(*key), key, "left_semi").join(chains, "conv_id").groupBy(*key).agg(F.sum("chain").alias("chain"), F.sum("leaf").alias("leaves"))
    up = nodes.where("n_children > 0").select(*[F.col(c).alias(f"_{c}") for c in key], F.col("conv_id").alias("_conv"))
    joined = nodes.join(above, key, "left").join(summed, key, "left").join(ends_of(rows), key, "left").join(up, [F.col(f"parent.{c}") == F.col(f"_{c}") for c in key], "left")
    # The root holds all conversations; those without turns end there.
    all_of = convs.agg(F.min("conv_id"), F.count("*")).first()
    tops = nodes.agg(F.count_if(F.col("depth") == 1), F.count_if(F.col("n_children") == 0), F.coalesce(F.sum("own"), F.lit(0))).first()
    zero = [F.lit(0).cast("long").alias(c) for c in key[:3]]
    bare = ends_of(convs.where("turns = 0").select("conv_id", *zero, F.array().cast(NO_SPLIT).alias("split"), F.lit(True).alias("last"))).first()
    none, alone = hashlib.sha256(b"").hexdigest(), F.col("n_convs") == 1
    root = [(all_of[0], 0, None, all_of[1], tops[0], max(1, tops[1]), tops[2], bare["ends_sha256"] if bare else none)] if all_of[1] else []
    below = joined.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(all_of[0])).otherwise(F.col("_conv")).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.when(alone, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), F.when(alone, F.lit(0)).otherwise(F.col("chain") - F.col("above")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    return below.unionByName(spark.createDataFrame(root, below.schema))


def op13(spark, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all `conversations`."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL_OP13 = r"""
WITH RECURSIVE table_of AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), table_of
), turns AS (
  SELECT conv_id, length(coalesce(text, '')) AS points, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), parts AS (
  SELECT ids.conv_id, 0 AS own, i, x, points FROM ids JOIN turns ON turns.conv_id = ids.base WHERE i <= h
  UNION ALL
  SELECT ids.conv_id, 1 AS own, i, x, points FROM ids JOIN turns ON turns.conv_id = ids.conv_id WHERE i > h
), rebuilt AS (
  SELECT conv_id, row_number() OVER w AS depth, points, string_agg(x, '') OVER w AS prefix, lead(x) OVER w IS NULL AS last
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)
), all_rows AS (
  SELECT conv_id, depth, points, prefix, last FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM ids
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(points) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM all_rows GROUP BY prefix, depth
), children AS (
  SELECT left(prefix, 64 * (depth - 1)) AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix)
), sums AS (
  SELECT r.prefix, sum(v.own) AS saved, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves
  FROM full_nodes v JOIN all_rows r ON r.conv_id = v.conv_id AND r.depth <= v.depth GROUP BY r.prefix
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums ON sums.prefix = n.prefix
LEFT JOIN full_nodes p ON n.depth > 0 AND p.prefix = left(n.prefix, 64 * (n.depth - 1))
"""

QUERIES = {"op13_conversation_trie": op13}
SQL = {"op13_conversation_trie": SQL_OP13}
