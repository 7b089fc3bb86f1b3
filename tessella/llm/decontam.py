"""Benchmark decontamination by latent semantic retrieval.

Passages of documents and benchmark items are TF-IDF vectors over the benchmark's terms, hashed into BUCKETS buckets.
One distributed pass counts in how many passages each bucket stands; a second one sketches the Gram matrix of all
passages with a random test matrix, from which the leading right singular vectors follow (the single-pass
randomised factorisation of a positive semi-definite matrix). The last pass projects overlapping passages of
every document into the latent space, takes the items whose cosine is high enough as candidates, and checks
each by the longest common subsequence of words, for the whole item and for its answer part. Items of fewer than
SHORT words have no passages: they are found where their words stand in a row. The space is one for all items, of
at most BUCKETS x RANK numbers; the search takes items in blocks of about WORDS_AT_ONCE words, which changes no result.
"""

from __future__ import annotations

import re
from itertools import repeat

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

PASSAGE = 32  # words of a passage that is counted and sketched
STRIDE = 16  # words between the passages that are searched
BUCKETS = 1 << 16
RANK, OVERSAMPLING, SEED = 96, 16, 11
MAX_DF = 0.005  # terms in a larger share of the passages carry no weight, unless an item has few others
MIN_TERMS = 3  # weighted terms that every item keeps
SHORT = 5
MIN_COSINE = 0.2
MIN_LCS, SURE_LCS, MIN_ANSWER = 0.6, 0.8, 0.6
WORDS_AT_ONCE = 400_000
FAN_IN, LEVELS = 64, 4  # up to 64^4 tasks
CACHED_WORDS = 1 << 20
TERMS_PER_ROW = 50_000

SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def answer_of(item: str) -> list[str]:
    """The answer part of an item: its last sentence of three words or more, or else all of it."""
    parts = [words_of(s) for s in SENTENCE.split(item.strip())]
    return next((p for p in reversed(parts) if len(p) >= 3), words_of(item))


def masks_of(a: list) -> dict:
    """The positions of every word of a, as bits."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    return where


def lcs_length(a: list, b: list, where: dict | None = None) -> int:
    """Length of the longest common subsequence, one machine word operation per word of b."""
    where = masks_of(a) if where is None else where
    v = full = (1 << len(a)) - 1
    for w in b:
        m = where.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def bucket_of(word: str) -> int:
    return xxhash.xxh32_intdigest(word, SEED) % BUCKETS


class _Numbers(dict):
    """Word -> number of its bucket, worked out when first asked for."""

    def __init__(self, number: np.ndarray):
        self.number = number.tolist()

    def __missing__(self, word: str, digest=xxhash.xxh32_intdigest) -> int:
        n = self[word] = self.number[digest(word, SEED) % BUCKETS]
        return n


class Vocabulary:
    """The buckets of the benchmark's terms, numbered; words of other buckets have the number -1."""

    def __init__(self, buckets: list[int]):
        self.size = len(buckets)
        self.number = np.full(BUCKETS, -1, np.int32)
        self.number[sorted(buckets)] = np.arange(len(buckets), dtype=np.int32)
        self.seen = None

    def __getstate__(self):
        return self.__dict__ | {"seen": None}

    def encode(self, words: list[str]) -> np.ndarray:
        if self.seen is None or len(self.seen) > CACHED_WORDS:
            self.seen = _Numbers(self.number)
        return np.fromiter(map(self.seen.__getitem__, words), np.int32, len(words))


def _passage_terms(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, term and count of the known terms of one document's consecutive passages."""
    at = np.flatnonzero(codes >= 0)
    key = (at // PASSAGE).astype(np.int64) << 32 | codes[at]
    key, n = np.unique(key, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n


def passage_terms(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The known terms of all passages, some documents to a row: numbers of passage and term and counts as bytes."""

    def row(parts: list, passages: int) -> pa.RecordBatch:
        columns = [np.concatenate([x[k] for x in parts]).astype(np.int32).tobytes() for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array([passages], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], ["passages", "p", "t", "n"])

    def read(batches):
        parts, passages, held = [], 0, 0
        for batch in batches:
            for text in batch.column("text"):
                words = words_of(text.as_py())
                if words:
                    p, t, n = _passage_terms(vocabulary.encode(words))
                    parts.append((p + passages, t, n))
                    passages, held = passages + -(-len(words) // PASSAGE), held + len(p)
                if held > TERMS_PER_ROW:
                    yield row(parts, passages)
                    parts, passages, held = [], 0, 0
        if parts:
            yield row(parts, passages)

    return materialize(docs.select("text").mapInArrow(read, "passages long, p binary, t binary, n binary"), "passage-terms")


def document_frequencies(terms: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each term stands, and the number of passages."""

    def count(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            for t in batch.column("t"):
                df += np.bincount(np.frombuffer(t.as_py(), np.int32), minlength=size)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), pa.array(df[hit])], ["term", "n"])

    df = np.zeros(size, np.int64)
    for r in terms.select("t").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        df[r["term"]] = r["n"]
    return df, terms.agg(F.sum("passages")).first()[0] or 0


def _sketch(terms: DataFrame, idf: np.ndarray, width: int) -> np.ndarray:
    """The sum over all passages a of a (a . omega), with one partial sum per task."""
    size, block = len(idf), 512
    omega = np.random.default_rng(SEED).standard_normal((size, width)).astype(np.float32)

    def part(batches):
        y = np.zeros((size, width))
        for batch in batches:
            for row in zip(batch.column("p"), batch.column("t"), batch.column("n"), strict=True):
                p, t, n = (np.frombuffer(x.as_py(), np.int32) for x in row)
                keep = idf[t] > 0
                _add(y, omega, p[keep], t[keep], n[keep] * idf[t[keep]])
        for i in range(0, size, block):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y[i : i + block].tobytes()], pa.binary())], ["block", "y"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in group.column("y"))
        return pa.table({"block": group.column("block")[:1], "turn": group.column("turn")[:1], "y": pa.array([total.tobytes()], pa.binary())})

    # Partial sums meet FAN_IN at a time, so no group grows with the number of tasks.
    parts = terms.select("p", "t", "n").mapInArrow(part, "block long, y binary").withColumn("turn", F.spark_partition_id())
    for _ in range(LEVELS):
        parts = parts.withColumn("turn", F.floor(F.col("turn") / FAN_IN).cast("int")).groupBy("block", "turn").applyInArrow(add, "block long, turn int, y binary")
    y = np.zeros((size, width))
    for r in parts.collect():  # terms x width numbers
        part_y = np.frombuffer(r["y"]).reshape(-1, width)
        y[r["block"] : r["block"] + len(part_y)] = part_y
    return y


def _add(y, omega, p, t, w) -> None:
    """y += A' A omega for passages p with terms t of weights w, each passage normed to length 1."""
    if not len(t):
        return
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    norm = np.sqrt(np.add.reduceat(w * w, starts))
    sizes = np.diff(np.r_[starts, len(p)])
    w = (w / np.repeat(norm, sizes)).astype(np.float32)
    image = omega[t]
    image *= w[:, None]
    upto = np.cumsum(image, axis=0, out=image)  # passages have few terms: differences of running sums are quicker than reduceat
    projected = upto[np.r_[starts[1:], len(p)] - 1]
    projected[1:] -= projected[:-1].copy()
    order = np.argsort(t, kind="stable")
    t = t[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    np.take(projected, np.repeat(np.arange(len(starts)), sizes)[order], axis=0, out=image)
    image *= w[order][:, None]
    y[t[first]] += np.add.reduceat(image, first, axis=0)


def latent_space(y: np.ndarray, rank: int) -> np.ndarray:
    """The leading eigenvectors of the Gram matrix that `y` sketches: terms x rank."""
    omega = np.random.default_rng(SEED).standard_normal(y.shape).astype(np.float32).astype(float)
    shift = 1e-8 * np.linalg.norm(y) + 1e-12
    y = y + shift * omega
    core = omega.T @ y
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    keep = values > values.max() * 1e-10
    b = y @ (vectors[:, keep] / np.sqrt(values[keep]))
    u, _, _ = np.linalg.svd(b, full_matrices=False)
    return u[:, :rank]


class Matcher:
    """Finds the items of a block in a text."""

    def __init__(self, item_ids, items: list[str], vocabulary: Vocabulary, idf, basis):
        self.item_ids = item_ids
        items_words = [words_of(t) for t in items]
        self.ids = {w: i for i, w in enumerate(sorted({w for words in items_words for w in words}))}
        number = vocabulary.encode(list(self.ids))
        self.rows = (basis * idf[:, None]).astype(np.float32)[number]  # latent image of one occurrence of a word
        self.weighted = idf[number] > 0
        code = lambda words: [self.ids[w] for w in words]
        self.items, self.answers = [code(w) for w in items_words], [code(answer_of(t)) for t in items]
        self.masks, self.answer_masks = [masks_of(x) for x in self.items], [masks_of(x) for x in self.answers]
        self.short = None
        parts, owner = [np.zeros((0, self.rows.shape[1]), np.float32)], []
        for k, codes in enumerate(self.items):
            if len(codes) < SHORT:
                self.short = self.short or ahocorasick.Automaton()
                key = f" {' '.join(items_words[k])} "
                self.short.add_word(key, (len(key), [*(self.short.get(key, (0, []))[1]), k]))
                continue
            for i in range(0, max(1, len(codes) - PASSAGE // 2), PASSAGE):
                parts.append(self.rows[codes[i : i + 2 * PASSAGE]].sum(0, keepdims=True))
                owner.append(k)
        if self.short:
            self.short.make_automaton()
        # Which items hold each weighted word, and how many of these words an item's least subsequence must hold.
        pairs = sorted({(c, k) for k, codes in enumerate(self.items) for c in codes if self.weighted[c]})
        self.holders = np.array([k for _, k in pairs], np.int64)
        self.held = np.searchsorted(np.array([c for c, _ in pairs], np.int64), np.arange(len(self.ids) + 1))
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.needed = np.ceil(MIN_LCS * self.sizes - 1e-9) - np.array([sum(not self.weighted[c] for c in x) for x in self.items])
        # All items' distinct words with their numbers of times, item by item.
        self.words = np.array([c for m in self.masks for c in m], np.int64)
        self.times = np.array([x.bit_count() for m in self.masks for x in m.values()], np.int64)
        self.item_of = np.repeat(np.arange(len(self.masks)), [len(m) for m in self.masks])
        q = np.concatenate(parts)
        self.queries = q / np.maximum(np.linalg.norm(q, axis=1), 1e-9)[:, None]
        self.owner = np.array(owner, np.int64)

    def able(self, codes: np.ndarray) -> np.ndarray:
        """Which items have words enough in the whole text for their least subsequence; no other can pass `check`."""
        held = np.zeros(len(self.ids) + 1, bool)  # the last is that of the code -1
        held[codes] = True
        shared = np.bincount(self.item_of, self.times * held[self.words], len(self.items))
        return (shared >= MIN_LCS * self.sizes - 1e-9) & (self.sizes >= SHORT)

    def windows(self, codes: np.ndarray, at: np.ndarray):
        """Start and latent vector, normed, of the passages that hold a weighted word (these stand `at`), some at a time."""
        starts = np.arange(0, max(1, len(codes) - PASSAGE + STRIDE), STRIDE)
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + PASSAGE)
        starts, lo, hi = starts[hi > lo], lo[hi > lo], hi[hi > lo]
        for i in range(0, len(starts), 512):
            first, last = lo[i], hi[min(i + 512, len(hi)) - 1]
            sums = np.zeros((last - first + 1, self.rows.shape[1]), np.float32)
            np.cumsum(self.rows[codes[at[first:last]]], axis=0, out=sums[1:])
            v = sums[hi[i : i + 512] - first] - sums[lo[i : i + 512] - first]
            yield starts[i : i + 512], v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)[:, None]

    def possible(self, codes: np.ndarray, at: np.ndarray, ks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which candidates have as many of the item's weighted words around the passage as its least subsequence must hold."""
        first = self.held[codes[at]]
        n = self.held[codes[at] + 1] - first
        ends = np.cumsum(n)
        item = self.holders[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        place = np.sort(item << 32 | np.repeat(at, n))
        lo, hi = np.maximum(starts - self.sizes[ks], 0), starts + PASSAGE + self.sizes[ks]
        return np.searchsorted(place, ks << 32 | hi) - np.searchsorted(place, ks << 32 | lo) >= self.needed[ks]

    def check(self, k: int, start: int, codes: list[int]) -> tuple[float, float] | None:
        """Shares of item and answer that stand in order around a passage, if they suffice."""
        item, masks = self.items[k], self.masks[k]
        area = [c for c in codes[max(0, start - len(item)) : start + PASSAGE + len(item)] if c in masks]
        least = MIN_LCS * len(item) - 1e-9
        if len(area) < least or sum(masks[c].bit_count() for c in set(area)) < least:
            return None
        share = lcs_length(item, area, masks) / len(item)
        if share < MIN_LCS:
            return None
        area = codes[max(0, start - len(item)) : start + PASSAGE + len(item)]
        answer = lcs_length(self.answers[k], area, self.answer_masks[k]) / len(self.answers[k])
        return (share, answer) if share >= SURE_LCS or answer >= MIN_ANSWER else None

    def find(self, text: str | None) -> list[tuple[int, int, float, float, float]]:
        """(item number, first word of the passage, cosine, share of the item, share of its answer) of every match."""
        words = words_of(text)
        best: dict[int, tuple[int, int, float, float, float]] = {}
        if self.short and words:
            joined = f" {' '.join(words)} "
            for end, (n, ks) in self.short.iter(joined):
                for k in ks:
                    best.setdefault(k, (k, joined.count(" ", 0, end + 1 - n), 1.0, 1.0, 1.0))
        codes = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        at = np.flatnonzero(codes >= 0)
        at = at[self.weighted[codes[at]]]
        listed = None
        # The search is spared where no item's check could pass, whatever the cosine: this loses no match.
        wanted = np.flatnonzero(self.able(codes)[self.owner]) if len(self.owner) and len(at) else []
        queries = self.queries[wanted].T if len(wanted) else None
        for starts, v in self.windows(codes, at) if len(wanted) else ():
            cosine = v @ queries
            rows, columns = np.nonzero(cosine >= MIN_COSINE)
            qs = wanted[columns]
            good = self.possible(codes, at, self.owner[qs], starts[rows])
            for r, column, q in zip(rows[good].tolist(), columns[good].tolist(), qs[good].tolist(), strict=True):
                k = int(self.owner[q])
                if k in best and best[k][3] == 1.0:
                    continue
                listed = codes.tolist() if listed is None else listed
                found = self.check(k, int(starts[r]), listed)
                if found and (k not in best or best[k][3] < found[0]):
                    best[k] = k, int(starts[r]), float(cosine[r, column]), *found
        return list(best.values())


def _item_buckets(items: DataFrame, vocabulary: Vocabulary | None = None, df: np.ndarray | None = None, limit: float = 0.0) -> list[int]:
    """Buckets of all items' words; with frequencies: those of the MIN_TERMS rarest words of each item, by number."""

    def read(batches):
        seen: set[int] = set()
        for batch in batches:
            for text in batch.column("text"):
                words = set(words_of(text.as_py()))
                if df is None:
                    seen.update(map(bucket_of, words))
                else:
                    codes = np.unique(vocabulary.encode(list(words)))
                    seen.update(codes[np.argsort(df[codes], kind="stable")[:MIN_TERMS]].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], ["bucket"])

    return [r["bucket"] for r in items.select("text").mapInArrow(read, "bucket long").distinct().collect()]  # BUCKETS rows at most


def _matchers(docs: DataFrame, benchmark: DataFrame, item_id: str, text: str):
    """One matcher per block of about WORDS_AT_ONCE words of items; nothing for an empty benchmark."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("item_id is not null").dropDuplicates(["item_id", "text"])
    items = items.withColumn("n", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).where("n > 0")
    words = items.agg(F.sum("n")).first()[0]
    if not words:
        return
    passages_of = docs.select("text").unionByName(items.select("text"))  # the items are passages too
    vocabulary = Vocabulary(_item_buckets(items))
    terms = passage_terms(passages_of, vocabulary)
    df, passages = document_frequencies(terms, vocabulary.size)
    rare = df <= MAX_DF * passages
    rare[_item_buckets(items, vocabulary, df)] = True
    idf = np.where(rare, np.log((2 + passages) / (1 + df)), 0.0)
    width = min(RANK + OVERSAMPLING, vocabulary.size)
    basis = latent_space(_sketch(terms, idf, width), min(RANK, width))
    blocks = -(-words // WORDS_AT_ONCE)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about WORDS_AT_ONCE words
        if rows:
            yield Matcher([r["item_id"] for r in rows], [r["text"] for r in rows], vocabulary, idf, basis)


def _found(matcher: Matcher, kind: str):
    """A UDF from text to the array of its matches; `kind` is the type of item ids."""

    @F.pandas_udf(f"array<struct<item_id:{kind},start:int,cosine:double,lcs:double,answer:double>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([
            [{"item_id": matcher.item_ids[k], "start": s, "cosine": c, "lcs": share, "answer": a} for k, s, c, share, a in matcher.find(t)]
            for t in texts
        ])

    return of


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, start (word number), cosine, lcs and answer of every item that a document holds.

    A candidate counts if a subsequence of at least SURE_LCS of the item's words stands near the passage, or at
    least MIN_LCS of them and MIN_ANSWER of its answer part; an item of fewer than SHORT words if they stand in a row.
    Null and empty texts hold nothing; null and empty items are never found; repeated rows repeat their matches, repeated
    items count once; extra columns are not read; empty tables give an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out, kind = None, benchmark.schema[item_id].dataType.simpleString()
    for matcher in _matchers(rows, benchmark, item_id, "text"):
        hits = rows.select("doc_id", F.explode(_found(matcher, kind)("text")).alias("m")).select("doc_id", "m.*")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = rows.sparkSession.createDataFrame([], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {kind}, start int, cosine double, lcs double, answer double")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """`docs` without the documents that hold a benchmark item, as `contaminated_passages` finds them.

    Null and empty texts stay; repeated rows stay or go together; columns may have any names; an empty benchmark
    leaves all documents.
    """
    out, kind = docs, benchmark.schema[item_id].dataType.simpleString()
    for matcher in _matchers(docs.select(F.col(text).alias("text")), benchmark, item_id, "text"):
        out = out.where(F.size(_found(matcher, kind)(F.col(text))) == 0)
    return out


def op3(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, cosine, lcs and answer of every benchmark item found in `documents`."""
    return contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_benchmark_decontamination": op3}
SQL: dict[str, str] = {}
