"""Removal of line passages that repeat across documents, by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines that hold words decides where chunks end, at two scales. Coarse
chunks follow each other: one begins where the one before ended. Fine chunks overlap: one begins at every line
and runs to the first place where the hash ends it, in most cases after two lines. A fine chunk depends on nothing
outside itself, so a passage is cut alike wherever it stands, its edges included. A line of more than LONG_WORDS
words is a passage by itself. Chunks whose hash occurs again anywhere in the corpus are fetched, compared byte by
byte with the first occurrence, and removed if equal. The first occurrence of a line is never removed: every line
that goes stands, byte for byte, at an earlier place.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from .common import materialize, row_id, table

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
WINDOW, LONG_WORDS = 2, 50
COARSE = 8  # one place in so many ends a coarse chunk
FINE = 16  # all places but one in so many end a fine chunk
CHUNKS_PER_CELL = 500


def chunk_lines(lines: list[bytes], window: int = WINDOW, coarse: int = COARSE, fine: int = FINE, long_words: int = LONG_WORDS) -> list[tuple[int, int]]:
    """First line and line behind the last of every chunk: two or more lines with words, or one long line."""
    sizes = [len(line.split()) for line in lines]
    full = [i for i, n in enumerate(sizes) if n]
    ends, rolling, recent, drop = [], 0, [], pow(BASE, window, 1 << 64)
    for i in full:
        recent.append(xxhash.xxh64_intdigest(lines[i], 1))
        rolling = rolling * BASE + recent[-1] & MASK
        if len(recent) > window:
            rolling = rolling - recent[-1 - window] * drop & MASK
        ends.append((rolling ^ rolling >> 29) * MIX >> 20 & MASK)
    out, n = {(i, i + 1) for i in full if sizes[i] > long_words}, len(full)
    first, last, open_ = 0, n - 1, []
    for j in range(n):
        if open_ and ((ends[j] >> 12) % fine or j == last):
            out.update((full[k], full[j] + 1) for k in open_)
            open_ = []
        open_.append(j)
        if ends[j] % coarse == 0 or j == last:
            if j > first:
                out.add((full[first], full[j] + 1))
            first = j + 1
    return sorted(out)


def _batch(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _chunks(docs: DataFrame) -> DataFrame:
    """rid, id, first, stop and the two halves of the hash (h, g) of every chunk."""
    id_type = docs.schema["id"].dataType
    kinds = (pa.int64(), to_arrow_type(id_type), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def cut(batches):
        for batch in batches:
            out = []
            for r, d, text in zip(batch.column("rid").to_pylist(), batch.column("id").to_pylist(), batch.column("text"), strict=True):
                lines = (text.as_py() or b"").split(b"\n")
                for a, b in chunk_lines(lines):
                    x = xxhash.xxh3_128_intdigest(b"\n".join(lines[a:b]), 2)
                    out.append((r, d, a, b, (x >> 64) - (1 << 63), (x & MASK) - (1 << 63)))
            yield _batch(out, ["rid", "id", "first", "stop", "h", "g"], kinds)

    return docs.mapInArrow(cut, f"rid long, id {id_type.simpleString()}, first int, stop int, h long, g long")


def _fetched(docs: DataFrame, text: str) -> DataFrame:
    """The bytes of the chunks listed in `wanted`; a first occurrence is given to each of its cells."""
    id_type = docs.schema["id"].dataType
    kinds = (pa.int64(), to_arrow_type(id_type), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    names = ["rid", "id", "first", "stop", "h", "g", "cell", "keeper", "chunk"]

    def fetch(batches):
        for batch in batches:
            out = []
            texts = batch.column("row").field(text).cast(pa.binary())
            for r, d, wanted, t in zip(batch.column("rid").to_pylist(), batch.column("id").to_pylist(), batch.column("wanted").to_pylist(), texts, strict=True):
                lines = t.as_py().split(b"\n")
                for w in wanted:
                    cells = range(w["cells"]) if w["keeper"] else ((r ^ w["first"]) % w["cells"],)
                    out.extend((r, d, w["first"], w["stop"], w["h"], w["g"], c, w["keeper"], b"\n".join(lines[w["first"] : w["stop"]])) for c in cells)
            yield _batch(out, names, kinds)

    return docs.mapInArrow(fetch, f"rid long, id {id_type.simpleString()}, first int, stop int, h long, g long, cell int, keeper boolean, chunk binary")


def _cut(docs: DataFrame, text: str) -> DataFrame:
    """row, the text without the lines in `cuts`, and the numbers of chunks and lines removed."""

    def cut(batches):
        for batch in batches:
            texts, chunks, lines = [], [], []
            for t, cuts in zip(batch.column("row").field(text), batch.column("cuts").to_pylist(), strict=True):
                t = t.as_py()
                gone = {i for c in cuts or () for i in range(c["first"], c["stop"])}
                texts.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) if gone else t)
                chunks.append(len(cuts or ()))
                lines.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(chunks, pa.int32()), pa.array(lines, pa.int32())], ["row", "new", "chunks", "lines"])

    return docs.mapInArrow(cut, docs.select("row").schema.add("new", "string").add("chunks", "integer").add("lines", "integer"))


def repeated_chunks(whole: DataFrame, text: str) -> DataFrame:
    """rid, id, first and stop line of every chunk to remove from `whole` (rid, id, row).

    The first occurrence by id, then row identity, then line, stays. Rows that agree in id and text are
    one document: their chunks are kept or removed alike. Null and empty texts have no chunks. A chunk that occurs
    very often is compared in cells of about CHUNKS_PER_CELL, each with its own copy of the first occurrence.
    """
    chunks = materialize(_chunks(whole.select("rid", "id", F.col("row").getField(text).cast("binary").alias("text"))), "line-chunks")
    again = chunks.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("id", "rid", "first")).alias("k")).where("n > 1")
    again = again.select("h", "g", F.ceil(F.col("n") / CHUNKS_PER_CELL).cast("int").alias("cells"), "k")
    found = chunks.join(again, ["h", "g"])
    wanted = F.struct("first", "stop", "h", "g", "cells", (F.struct("id", "rid", "first") == F.col("k")).alias("keeper"))
    lists = found.groupBy("rid", "id").agg(F.collect_set(wanted).alias("wanted"))  # no longer than the document
    fetched = _fetched(whole.join(lists, ["rid", "id"]).select("rid", "id", "row", "wanted"), text)
    kept = F.max(F.when(F.col("keeper"), F.col("chunk"))).over(Window.partitionBy("h", "g", "cell"))
    return fetched.withColumn("kept", kept).where("not keeper and chunk = kept").select("rid", "id", "first", "stop")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, report: bool = False) -> DataFrame:
    """`docs` with repeated passages cut from `text`; every row stays, in its columns and order of columns.

    A document all of whose lines are repeats keeps an empty text; a null text stays null; `n_chars`, if
    given, names a column that is set to the new length. Ids that are not whole numbers are ordered as texts; null ids come first. With `report`, `removed_chunks` and
    `removed_lines` are added. Columns may have any names. An empty table gives an empty result.
    """
    # Id and hash tell rows apart; both uses below read this one exchange of the texts.
    whole_number = isinstance(docs.schema[doc_id].dataType, IntegralType)
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))) if whole_number else F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    whole = docs.select(row_id(doc_id, text).alias("rid"), number.alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    cuts = repeated_chunks(whole, text).groupBy("rid", "id").agg(F.collect_set(F.struct("first", "stop")).alias("cuts"))
    done = _cut(whole.join(cuts, ["rid", "id"], "left").select("rid", "id", "row", "cuts"), text)
    cols = [F.col("new").alias(c) if c == text else F.length("new").cast("long").alias(c) if c == n_chars else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.select(*cols, *([F.col("chunks").alias("removed_chunks"), F.col("lines").alias("removed_lines")] if report else []))


def op9(spark, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated passages, removed_chunks and removed_lines of every document."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


QUERIES = {"op9_line_dedup": op9}
SQL: dict[str, str] = {}
