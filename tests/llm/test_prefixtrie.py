"""The prefix trie against a plain trie of nested dictionaries, with weak fingerprints, long and repeated turns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import prefixtrie

TURNS = "conv_id long, turn long, role string, text string"


def identity(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, identity(role or "", text or "")[:32], role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 6, abs(c) % 100
        whole[c] = own.get(c - rest if c >= 0 else c + rest, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = (0 if children.get(p) else 1), (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for q in children.get(p, []):
            a, b = below(q)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def tree(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for c in [*range(120), *range(500, 540), 1203, 1204, 70_000_000_007, -3, -104, -250]:
        for t in range(r.choice([1, 2, 3, 5, 8, 9])):
            out.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "ccc", "é😀", "", None])))
    out += [(c, t, "user", f"same {t}") for c in range(600, 680) for t in range(9)]  # a hot conversation
    out += [(40, None, "user", "first"), (40, 2, "user", "tie"), (40, 2, "user", "tie"), (40, 2, "user", "other tie"), (None, 1, "user", "nobody's"), (600, 3, "x", "y" * 50_000)]
    return out


def test_trie_equals_plain_trie(spark, rows):
    docs = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit(3), "position": F.lit("p"), "head": F.lit(1), "g1": F.lit(None).cast("int")})
    assert tree(prefixtrie.prefix_trie(docs)) == brute(rows)


def test_colliding_fingerprints_are_split(spark, rows):
    few = [r for r in rows if r[0] is not None and (r[0] < 25 or 600 <= r[0] < 606)]
    assert tree(prefixtrie.prefix_trie(spark.createDataFrame(few, TURNS), ((2, 3), (1, 2)))) == brute(few)


def test_a_long_conversation_spreads_over_tasks(spark):
    rows = [(100, t, "user", f"turn {t % 7}") for t in range(25_000)] + [(c, t, "user", f"turn {t % 7}") for c in (101, 102) for t in range(40)]
    dealt = prefixtrie.turns_of(spark.createDataFrame(rows, TURNS)).withColumn("v", F.pmod("c1", F.lit(101)))
    got = prefixtrie.prefix_sums(dealt, "conv_id", ("turn",), {"v": (3, 101)}, "test").where("conv_id = 100").orderBy("turn").select("position", "v", "v_sum").collect()
    assert spark.createDataFrame(rows, TURNS).repartitionByRange(4, "conv_id", "turn").where("conv_id = 100").select(F.spark_partition_id()).distinct().count() > 1
    total = 0
    for k, r in enumerate(got, 1):
        total = (total + r["v"] * pow(3, k, 101)) % 101
        assert (r["position"], r["v_sum"]) == (k, total)
    out = prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS)).agg(F.max("depth"), F.count("*"), F.max("n_convs")).first()
    assert tuple(out) == (25_000, 25_001, 3)


def test_ids_that_end_at_a_hot_node(spark):
    rows = [(c * 100, 0, "user", "hello") for c in range(5000)]
    out = tree(prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS)))
    assert len(out) == 2 and out[1][-1] == hashlib.sha256(",".join(str(c * 100) for c in range(5000)).encode()).hexdigest()
    assert out[1][3:7] == (5000, 0, 1, 4999 * 5)


def test_conversations_without_turns_and_empty_tables(spark):
    taken = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2][:3]
    rows = [(c, 0, "user", "x") for c in taken]  # no conversation 0: their only turn goes
    assert tree(prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS))) == brute(rows)
    assert prefixtrie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).count() == 0


def test_powers_and_scans():
    k = np.array([0, 1, 2, 65_535, 65_536, 200_001])
    assert list(prefixtrie.powers(7, 1_000_003, k)) == [pow(7, int(x), 1_000_003) for x in k]
    keys, v = np.array([1, 1, 2, 2, 2]), np.array([3, 4, 5, 6, 7])
    position, (s,), state = prefixtrie.scan_batch(keys, [v], [(10, 997)], (1, 2, [50]))
    assert list(position) == [3, 4, 1, 2, 3] and list(s) == [(50 + 3000) % 997, (50 + 3000 + 40_000) % 997, 50, 650, (650 + 7000) % 997] and state == (2, 3, [int(s[-1])])
