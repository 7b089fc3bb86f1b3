"""Audit of how filters interact: what each removes, in every order in which they can be applied.

The orders of n filters form a trie of n! paths. Walked depth first, a node applies one filter more to the survivors of
its parent, which are a persisted DataFrame. What survives a prefix doesn't depend on the order within it, so nodes whose
prefixes hold the same filters share one state: 2^n states are visited instead of all nodes. At each state, one
aggregate over its survivors counts the actual removals on every edge that leaves it. The counts of all states,
one row per part and state, are joined with the orders at the end.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

WORDS = r"[^\x20\x09-\x0D]+"


def first_of_text(docs: DataFrame) -> DataFrame:
    """`digest` and `doc_id` of the smallest id of each text; `docs` has both columns. Copies are counted before the shuffle."""
    return docs.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


def contract_filters(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails the filters A to D."""
    found = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    return {
        "A": F.size(found) < 200,
        "B": 100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def walk(verdicts: DataFrame, filters: str, losses: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every prefix state and of the edges that leave it, per part.

    `verdicts` has `part`, a boolean column per letter of `filters` that says that the row fails it, and a boolean column
    per loss. A row of the result: part, state (a bit per filter that has been applied), alive (rows that survive it), and
    for every filter f removed_f and, per loss, f_<loss>: the rows that f removes next. The walk is depth first;
    survivors stay persisted while their subtree is walked, so at most one path of the trie is held. A part
    without survivors has no row in that state.
    """
    seen: set[int] = set()
    found: list[DataFrame] = []
    counts = [F.count("*").alias("alive"), *[F.count_if(F.col(f)).alias(f"removed_{f}") for f in filters]]
    counts.extend(F.count_if(F.col(f) & F.col(x)).alias(f"{f}_{x}") for f in filters for x in losses)

    def visit(survivors: DataFrame, state: int) -> None:
        seen.add(state)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        # The same columns at every state: Spark compiles the aggregate once.
        found.append(materialize(survivors.groupBy("part").agg(*counts), f"audit-{state}").withColumn("state", F.lit(state)))
        left = [k for k in range(len(filters)) if not state >> k & 1]
        for k in left:
            if len(left) > 1 and state | 1 << k not in seen:  # another order may have led there
                visit(survivors.where(~F.col(filters[k])), state | 1 << k)
        survivors.unpersist()

    visit(verdicts, 0)
    return reduce(DataFrame.unionByName, found)


def orders_of(filters: str) -> list[tuple[str, int, int, str]]:
    """Order, step, state before the step, and the step's filter, for every order of the filters."""
    rows = []
    for order in permutations(filters):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(order), step, state, f))
            state |= 1 << filters.index(f)
    return rows


def interactions(verdicts: DataFrame, filters: str, losses: tuple[str, ...] = ()) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    Columns: part, filter_order, step, kept, removed, redundant (rows that fail the step's filter but went earlier),
    unique_fails (rows that fail no other filter), one column per loss (lost at this step), and shapley (what the
    filter removes, summed over all orders). An order is a path of the trie; no row of `verdicts` is read here again.
    """
    spark = verdicts.sparkSession
    states = walk(verdicts, filters, losses)
    every = (1 << len(filters)) - 1
    edges = states.select(
        "part", "state",
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("f"), F.lit(k).alias("k"), "alive", F.col(f"removed_{f}").alias("removed"), *[F.col(f"{f}_{x}").alias(x) for x in losses])
            for k, f in enumerate(filters)
        ])).alias("e"),
    ).select("part", "state", "e.*").where(F.expr("shiftright(state, k) % 2 = 0"))
    # An edge out of a state of s filters lies on s! (n - 1 - s)! orders.
    n, size = len(filters), F.bit_count("state")
    weight = F.element_at(F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)]), (size + 1).cast("int"))
    of_filter = edges.groupBy("part", "f").agg(
        F.sum(F.col("removed") * weight).alias("shapley"),
        F.sum(F.when(F.col("state") == 0, F.col("removed")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("state") == F.lit(every) - F.expr("shiftleft(1, k)"), F.col("removed")).otherwise(0)).alias("unique_fails"),
    )
    orders = spark.createDataFrame(orders_of(filters), "filter_order string, step int, state int, f string")
    steps = of_filter.join(F.broadcast(orders), "f")  # n! n rows, however large the input
    named = steps.join(edges.drop("k"), ["part", "state", "f"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return named.select(
        "part", "filter_order", "step", (zero("alive") - zero("removed")).alias("kept"), zero("removed").alias("removed"),
        (F.col("fails") - zero("removed")).alias("redundant"), F.col("unique_fails"), *[zero(x).alias(x) for x in losses], "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of five filters over whole texts, per language.

    A document fails A with under 200 words, B if fewer than half of its words are distinct, C if over 3 % of its code
    points are of `[A-Z]`, D if it holds any of `#$%&*|`, E if a smaller doc_id has the same text. Losses: good_lost
    (`labels` quality is 1) and toxic_lost (toxic is 1). Null texts count as empty, null languages as the empty string.
    A row with a null id fails E never, makes no other row fail it, and has no labels; rows that agree in id and text
    share every verdict and count one by one; an id that has several labels loses what any of them says. An empty table
    gives an empty result. Columns other than doc_id, text and lang are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    found = contract_filters(F.col("text"))
    flagged = read.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), *[c.alias(f) for f, c in found.items()])
    flagged = materialize(flagged, "audit-texts")
    first = first_of_text(flagged).withColumn("first", F.lit(True))
    ids = F.col("doc_id").try_cast(docs.schema["doc_id"].dataType)  # ids of another type are no error
    marked = labels.groupBy(ids.alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    # By id and text, as by id alone, a key has one row unless the table repeats it: no copies meet in one task.
    verdicts = flagged.join(first, ["digest", "doc_id"], "left").join(marked, "doc_id", "left").select(
        "part", *found, (F.col("doc_id").isNotNull() & ~no("first")).alias("E"), no("good").alias("good_lost"), no("toxic").alias("toxic_lost")
    )
    return interactions(materialize(verdicts, "audit-verdicts"), "ABCDE", ("good_lost", "toxic_lost"))


def op11(spark, sf_dir: str) -> DataFrame:
    """The interactions of the five filters over all `documents`."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL_OP11 = r"""
WITH texts AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS text,
         coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts
), verdicts AS (
  SELECT part, good, toxic,
         (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
       + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 4 ELSE 0 END)
       + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
       + (CASE WHEN doc_id > first_id THEN 16 ELSE 0 END) AS mask
  FROM words
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS state
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), masks AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM verdicts GROUP BY part, mask
), counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (state | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & state = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & state > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & state = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & state = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""

QUERIES = {"op11_filter_interactions": op11}
SQL = {"op11_filter_interactions": SQL_OP11}
