"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random

import numpy as np
import pytest

from tessella.llm import jaccard

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def grams(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def copies(count, low, high, seed):
    """`count` texts, each followed by a copy with replaced words at a five-word Jaccard between `low` and `high`."""
    r, out = random.Random(seed), []
    for _ in range(count):
        text = [f"w{r.randrange(5000)}" for _ in range(r.randrange(100, 800))]
        while True:
            copy = list(text)
            for k in r.sample(range(len(copy)), max(1, int(len(copy) * r.uniform(0.004, 0.06)))):
                copy[k] = f"x{r.randrange(5000)}"
            if low <= similarity(text, copy) <= high:
                break
        out += [text, copy]
    return out


def frame(spark, texts):
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_drops_copies_from_eighty_percent_on(spark):
    near, far = copies(60, 0.8, 0.95, 1), copies(30, 0.6, 0.79, 2)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark, near + far), "").collect()}
    assert kept == set(range(0, 120, 2)) | set(range(120, 180))


def components(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return dict(enumerate(root))


def test_large_groups_and_chains_equal_brute_force(spark, monkeypatch):
    r = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(60):  # one group: copies are nearer to the base than to each other, so leaders miss links
        copy = list(base)
        for k in r.sample(range(200), 4):
            copy[k] = f"x{r.randrange(10**6)}"
        texts.append(copy)
    texts += [base[k : k + 160] for k in range(0, 41, 8)] + [[f"y{k}" for k in range(s, s + 120)] for s in range(0, 90, 6)]
    want = components(texts)
    for limit in (1024, 7):
        monkeypatch.setattr(jaccard, "MEMBERS_PER_CELL", limit)
        got = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_components(frame(spark, texts)).collect()}
        assert got == want


def test_forest_links_what_brute_force_links():
    r = np.random.default_rng(3)
    sets = [np.unique(r.choice(40, 30)).astype(np.uint64) for _ in range(80)]
    keys = np.arange(80)
    a, b = jaccard.forest(keys, keys, sets, 0.6)
    share = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    assert all(share(i, j) >= 0.6 for i, j in zip(a, b, strict=True))

    def parts(links):
        root = list(range(80))
        for i, j in links:
            x, y = sorted((root[i], root[j]))
            root = [x if z == y else z for z in root]
        return root

    assert parts(zip(a, b, strict=True)) == parts([(i, j) for i in range(80) for j in range(i) if share(i, j) >= 0.6])


def test_awkward_rows(spark):
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t "), (None, "a b c d e f"), (5, "ab"), (6, "AB"), (7, "ab b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, key int")
    kept = jaccard.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 7]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_an_id_with_several_texts_loses_copies_only(spark):
    long = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, long(1)), (5, long(1)), (5, long(2)), (5, long(2)), (6, long(3)), (6, long(3) + " end"), (7, long(3)), (None, long(1)), (8, long(4)), (8, long(5))]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    one_of_six = [t for i, t in kept if i == 6]
    assert len(one_of_six) == 1 and one_of_six[0].startswith("w3x0 ")
    assert sorted(((i, t) for i, t in kept if i != 6), key=str) == sorted([(1, long(1)), (5, long(2)), (None, long(1)), (8, long(4)), (8, long(5))], key=str)
    named = [(r["doc_id"], r["text"]) for r in jaccard.keep_one_per_group(spark.createDataFrame([("b", long(1)), ("a", long(1)), ("a", long(2)), ("c", long(2))], "doc_id string, text string")).collect()]
    assert sorted(named) == [("a", long(1)), ("a", long(2))]


def test_simhash_anchors_bring_all_near_pairs_together(spark, monkeypatch):
    texts = copies(60, 0.8, 0.86, 5) + [[f"{k}y{i}" for i in range(n)] for k in range(12) for n in (8, 9)]  # also 4 shingles of 5
    bits, parts = jaccard.layout(len(texts))
    assert (1 - jaccard.MEETING[bits]) ** parts <= jaccard.MISSED
    rows = [(i, i, " ".join(t).encode()) for i, t in enumerate(texts)]
    prints = jaccard._prints(spark.createDataFrame(rows, "doc_id long, rid long, text binary"), bits, parts)
    keys = {r["doc_id"]: r["key"] for r in prints.collect()}
    for limit in (1024, 1):  # 1: all shared anchors are cut into cells
        monkeypatch.setattr(jaccard, "HOMES_PER_CELL", limit)
        held = {}
        for r in jaccard.link_anchors(prints.select("key", "fp", "parts"), bits, len(texts)).collect():
            held.setdefault(r["bucket"], set()).add(r["key"])
        met = {frozenset(b) for b in held.values()}
        assert met == {frozenset((keys[i], keys[i + 1])) for i in range(0, len(texts), 2)}


def edited(count, seed):
    """Copies of one text of 120 words, each with one to three words replaced: most pairs of copies are near, few are links."""
    r, out = random.Random(seed), []
    for _ in range(count):
        copy = [f"w{k}" for k in range(120)]
        for k in r.sample(range(120), r.randrange(1, 4)):
            copy[k] = f"x{r.randrange(10**6)}"
        out.append(copy)
    return out


def test_each_text_of_a_large_group_is_compared_in_one_place(spark, monkeypatch):
    texts, compared = edited(80, 4), []
    link_cells = jaccard.link_cells

    def counted(members, *rest):
        compared.append((members.count(), members.select("key").distinct().count()))
        return link_cells(members, *rest)

    monkeypatch.setattr(jaccard, "link_cells", counted)
    want = components(texts)
    assert 1 < len(set(want.values())) < 80
    for cell, weight in ((1024, 100), (7, 100), (7, -(10**9))):  # one cell, a grid of cells, the buckets in place of the group
        monkeypatch.setattr(jaccard, "MEMBERS_PER_CELL", cell)
        monkeypatch.setattr(jaccard, "PAIRS_PER_MEMBER", weight)
        assert {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_components(frame(spark, texts)).collect()} == want
    assert compared[0] == compared[1] == (80, 80)
    assert compared[2][0] > 160


def test_forest_in_parts_links_what_one_index_links(monkeypatch):
    r = np.random.default_rng(5)
    sets = [np.unique(r.choice(60, r.integers(20, 60))).astype(np.uint64) for _ in range(90)]
    keys = np.arange(90)
    whole = jaccard.forest(keys, keys // 2, sets, 0.55)
    trees = len(np.unique(keys // 2))
    for limit in (1, 100, 700):
        monkeypatch.setattr(jaccard, "GRAMS_PER_INDEX", limit)
        a, b = jaccard.forest(keys, keys // 2, sets, 0.55)
        share = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
        assert all(share(i, j) >= 0.55 for i, j in zip(a, b, strict=True))
        assert len(a) == len(whole[0]) < trees  # forests over the same components have as many links


def star_rows(spark, monkeypatch, count):
    """Rows of near buckets, edges for the components of the groups, and pairs of members and leaders, of `count` edited copies in a corpus of other texts."""
    r, seen = random.Random(8), {}
    texts = edited(count, 6) + [[f"z{r.randrange(10**6)}" for _ in range(30)] for _ in range(40)]
    near, joined, leaders = jaccard.link_anchors, jaccard.connected_components, jaccard.link_leaders

    def counted_near(*args):
        found = near(*args)
        seen["near"] = found.count()
        return found

    def counted_edges(edges, name):
        seen[name] = edges.count()
        return joined(edges, name)

    def counted_pairs(pairs, *rest):
        seen["leaders"] = pairs.count()
        return leaders(pairs, *rest)

    with monkeypatch.context() as m:
        m.setattr(jaccard, "link_anchors", counted_near)
        m.setattr(jaccard, "connected_components", counted_edges)
        m.setattr(jaccard, "link_leaders", counted_pairs)
        m.setattr(jaccard, "MEMBERS_PER_CELL", 16)
        got = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert got == components(texts)
    return seen["near"], seen["shingle-groups"], seen["leaders"]


def test_joins_get_few_rows_per_text_of_a_near_group(spark, monkeypatch):
    for count in (40, 120):
        near, edges, pairs = star_rows(spark, monkeypatch, count)
        parts = jaccard.layout(count + 40)[1]
        assert count <= near <= parts * count  # the task that compares a part's anchors ties them
        assert count - 1 <= edges <= 2 * count and pairs <= jaccard.LEADERS * count


def test_spokes_connect_what_leaders_connect(spark):
    r = random.Random(2)
    for keys, links in ((60, 30), (60, 70), (200, 400)):
        pairs = [sorted(r.sample(range(keys), 2)) for _ in range(links)]
        root = list(range(keys))
        for low, key in pairs:
            a, b = sorted((root[low], root[key]))
            root = [a if x == b else x for x in root]
        want = {k: root[k] for pair in pairs for k in pair}
        leaders = {}
        for low, key in pairs:
            leaders.setdefault(key, set()).add(low)
        stars = spark.createDataFrame([(k, sorted(v)) for k, v in leaders.items()], "key long, leaders array<long>")
        got = {x["node"]: x["component"] for x in jaccard.connected_components(jaccard.spokes(stars)).collect()}
        assert got == want
        low, key = jaccard.tied(*np.array(pairs).T)
        assert dict(zip(key.tolist(), low.tolist(), strict=True)) == want
