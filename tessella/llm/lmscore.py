"""Cross-entropy difference of two matched n-gram models.

The background model is trained on all documents, the target model on those that a label table marks as good. Both are
bigram models over one vocabulary (all words of the corpus) with the same smoothing: a bigram's probability leans on
its word's with weight MU, a word's on an even base measure with weight NU. A document is scored by models of all the
*other* documents: its own counts are subtracted. Its score is its mean loss per word under the target model less its
mean loss under the background model: the lower, the more it reads like the target.

Nothing is cut: all words and bigrams count. Documents are dealt into blocks of about BLOCK_CHARS characters by a hash.
Each block counts its n-grams and sends them, sorted by hash, to shards of the hash space: one row per block and shard
with arrays of hashes and counts, so a frequent n-gram costs a block no more than a rare one. A shard answers with the
sums over all blocks in the order asked, and a block with its sums scores its documents. No task holds more than a
block or a shard (about SHARD_GRAMS n-grams); their numbers, and all volumes, follow the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

BLOCK_CHARS = 6_000_000
SHARD_GRAMS = 1_500_000
GRAMS_PER_CHAR = 0.13  # an estimate that only sets the number of shards
MU, NU = 4.0, 16.0
BASE = 2.0**-20  # base probability of every word
SEED = 13
FACTOR_H, FACTOR_W = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
START, WORD, TOTAL = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0xD1342543DE82EF95))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes, in this order."""
    x = (h * FACTOR_H) ^ (w * FACTOR_W + (h >> np.uint64(31)))
    return x ^ (x >> np.uint64(32))


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, which shuffles compress well."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(x: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).ravel()


class Block:
    """The n-grams of a block's documents, by hash: bigrams, words (also as histories), the start mark and all words."""

    def __init__(self, texts: list[str | None]):
        ids: dict[str, int] = {}
        parts, lengths = [], []
        for text in texts:
            words = words_of(text)
            lengths.append(len(words))
            parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
        self.lengths = np.array(lengths, np.int64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.lengths)
        self.word = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.size = len(ids)  # also the number of the start mark
        self.first = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        self.history = np.roll(self.word, 1)
        self.history[self.first] = self.size
        hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in ids], np.uint64)
        pair_gram, self.pair = np.unique(_mixed(np.append(hashes, START)[self.history], hashes[self.word]), return_inverse=True)
        self.pairs = len(pair_gram)
        grams = np.concatenate([pair_gram, _mixed(np.full(self.size, WORD), hashes), [START, TOTAL]])
        self.order = np.argsort(grams, kind="stable")
        self.grams = grams[self.order]

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """The counts of `grams` over all documents, weighted with 0 or 1."""
        each = weights[self.doc]
        ends = [weights[self.lengths > 0].sum(), each.sum()]
        return np.concatenate([np.bincount(self.pair, each, self.pairs), np.bincount(self.word, each, self.size), ends]).astype(np.int64)[self.order]

    def own(self, codes: np.ndarray) -> np.ndarray:
        """For every word of the block: how often its document holds the same code."""
        key = self.doc * np.int64(int(codes.max()) + 1 if len(codes) else 1) + codes
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        return n[at]

    def losses(self, n: np.ndarray, t: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean losses of every document under the target and the background model, given the sums of `grams`."""
        own_pair, own_word = self.own(self.pair), self.own(self.word)
        own_history = np.roll(own_word, 1)
        own_history[self.first] = 1
        out = []
        for sorted_sums, mine in ((t, target[self.doc]), (n, np.ones(len(self.doc)))):
            sums = np.empty(len(self.order))
            sums[self.order] = sorted_sums
            p = (sums[self.pairs + self.word] - mine * own_word + NU * BASE) / (sums[-1] - mine * self.lengths[self.doc] + NU)
            p = (sums[self.pair] - mine * own_pair + MU * p) / (sums[self.pairs + self.history] - mine * own_history + MU)
            out.append(np.bincount(self.doc, -np.log(p), len(self.lengths)) / np.maximum(self.lengths, 1))
        return out[0], out[1]


def _asking(shards: int):
    """What a block sends: for each shard the hashes of its n-grams, and their counts in all and in target documents."""

    def ask(docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({"block": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("grams", "n", "t")}})
        block = Block(docs.column("text").to_pylist())
        n, t = block.counts(np.ones(len(docs))), block.counts(_marked(docs, marks.column("key")))
        shard = ((block.grams >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        cut = lambda x: pa.array([packed(part) for part in np.split(x, starts[1:])], pa.binary())
        steps = np.diff(block.grams, prepend=np.uint64(0))
        steps[starts] = block.grams[starts]
        return pa.table({"block": pa.array(np.full(len(starts), docs.column("block")[0].as_py(), np.int32)), "shard": pa.array(shard[starts]), "grams": cut(steps), "n": cut(n), "t": cut(t)})

    return ask


def _marked(docs: pa.Table, keys) -> np.ndarray:
    """1 for documents whose key is among `keys`, else 0."""
    return np.isin(docs.column("key").to_numpy(), np.array(keys.drop_null().to_pylist(), np.int64)).astype(float)


def _answer(asked: pa.Table) -> pa.Table:
    """The sums of a shard's n-grams over all blocks, in the order in which each block asked."""
    grams = [np.cumsum(unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in asked.column("grams")]
    ends = np.cumsum([len(g) for g in grams])[:-1]
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    del grams
    out = {"block": asked.column("block"), "shard": asked.column("shard")}
    for c in ("n", "t"):
        each = np.concatenate([unpacked(x.as_py()) for x in asked.column(c)])
        sums = np.bincount(at, each).astype(np.int64)
        out[c] = pa.array([packed(part) for part in np.split(sums[at], ends)], pa.binary())
    return pa.table(out)


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    block = Block(docs.column("text").to_pylist())
    target = _marked(docs, answers.column("key"))
    parts = answers.filter(pa.compute.is_valid(answers.column("n"))).sort_by("shard")
    if len(docs):
        n, t = (np.concatenate([unpacked(x.as_py()) for x in parts.column(c)]) for c in ("n", "t"))
        loss_t, loss_n = block.losses(n, t, target)
    else:
        loss_t = loss_n = np.zeros(0)
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(block.lengths), "target_loss": pa.array(loss_t), "background_loss": pa.array(loss_n)})


def score(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score (their difference) of every row.

    Null and empty texts have n_words 0 and null losses and score; repeated rows get equal scores and count as
    often as they stand in the table, less once for themselves; ids in `target` that no document bears count nothing;
    an empty table gives an empty result. Extra columns are not read. N-grams are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, shards = max(1, -(-chars // block_chars)), max(1, -int(-chars * GRAMS_PER_CHAR // shard_grams))
    at = lambda key: F.pmod(key, F.lit(blocks)).cast("int").alias("block")
    key = F.xxhash64("doc_id")
    dealt = rows.select(at(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(key)), "doc_id", F.when(F.col("doc_id").isNotNull(), key).otherwise(0).alias("key"), "text")
    marks = target.where("doc_id is not null").select(key.alias("key")).distinct().select(at(F.col("key")), "key")
    asked = dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_asking(shards), "block int, shard int, grams binary, n binary, t binary")
    answers = asked.groupBy("shard").applyInArrow(_answer, "block int, shard int, n binary, t binary")
    answers = answers.withColumn("key", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score, f"doc_id {kind}, n_words long, target_loss double, background_loss double")
    losses = [F.when(F.col("n_words") > 0, F.col(c)).alias(c) for c in ("target_loss", "background_loss")]
    return scored.select("doc_id", "n_words", *losses).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op1(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, losses and score of every document; the target is what `labels` calls good quality.

    Labels of documents whose crc32(doc_id as text) mod 3 is 1 are left out, for measuring on them.
    """
    good = table(spark, sf_dir, "labels").where("quality = 1").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return score(table(spark, sf_dir, "documents"), good)


QUERIES = {"op1_lm_cross_entropy": op1}
SQL: dict[str, str] = {}
