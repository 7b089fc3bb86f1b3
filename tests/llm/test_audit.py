"""The filter interaction audit against plain loops over all orders."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from tessella.llm import audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, labels):
    """part, order, step -> the eight counts, by applying the filters in turn to plain lists."""
    low = {}
    for i, text, _ in rows:
        if i is not None:
            low[text or ""] = min(i, low.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > low[t]}
        marks = [x for x in labels if x[0] == i and i is not None]
        docs.append((lang or "", {f for f in fails if fails[f]}, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    out = {}
    for part in {d[0] for d in docs}:
        own, sums = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[1]]
                alive = [d for d in alive if f not in d[1]]
                sums[f] += len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(sums[order[step - 1]])
    return out


def many(k):
    return " ".join(f"w{i}" for i in range(k))


def test_audit_equals_plain_loops_on_awkward_rows(spark):
    rows = [
        (1, many(250), "en"), (2, many(250), "en"), (2, many(250), "en"), (3, None, None), (4, "", ""), (5, "x " * 400, "en"), (6, "x $ " * 400, "de"), (7, "ABC " + many(300), "de"),
        (8, "AB CD", None), (9, many(300) + " #", "fr"), (10, many(199), "fr"), (11, many(200), "fr"), (None, many(250), "en"), (None, many(250), None), (12, " ".join(["a"] * 300), "en"),
        (13, "A" * 3 + "b" * 97, "de"), (14, "A" * 4 + "b" * 96, "de"), (15, "y" * 300_000, "es"), (0, many(250), "es"), (16, many(250), "a"), (17, "A\x0bB\x0cC\rD\nE\tF " * 50, "a"),
    ]
    labels = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (5, 1, 1), (6, 0, 1), (9, 1, None), (10, None, 1), (11, 1, 1), (99, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS).withColumns({"part": F.lit("x"), "A": F.lit(True), "digest": F.lit(1), "good": F.lit(2)})
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got} == brute(rows, labels)
    assert len(got) == 7 * 600 - 600  # en, de, fr, es, a and the empty string, which null joins
    empty = audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.columns == ["part", "filter_order", "step", *names] and empty.count() == 0


def test_states_are_walked_once_and_released(spark, monkeypatch):
    made = []
    keep = audit.materialize
    monkeypatch.setattr(audit, "materialize", lambda df, name: (made.append(name), keep(df, name))[1])
    verdicts = spark.createDataFrame([("p", a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)], "part string, X boolean, Y boolean, Z boolean")
    out = audit.interactions(verdicts, "XYZ")
    assert len(made) == len(set(made)) == 7  # all prefix states but the last, whose counts are those of the edges to it
    assert out.where("filter_order = 'YXZ'").orderBy("step").select("kept", "removed", "redundant", "unique_fails").collect() == [(4, 4, 0, 1), (2, 2, 2, 1), (1, 1, 3, 1)]
    assert not verdicts.is_cached
