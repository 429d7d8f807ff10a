"""Order MinHash fingerprints, which are sensitive to edit distance.

Every k-mer of code points is numbered by its occurrence, so repeats count, and hashed together with that
number. The hash's leading bits deal the k-mers into bins; each bin selects its `per_bin` minimal ones,
puts them back into text order and hashes that tuple, so a bin agrees only where two texts hold the same
k-mers in the same order. (One hash dealt into bins stands for as many permutations and costs one pass.)

A document's fingerprint is compared with that of its text after an edit by the next document, in ascending
order of doc_id. Rows are dealt into ranges of doc_id and stream through a task in order, so a document meets
its successor in the task itself; only the last one of each range waits for the first one of the next range.

Defined results: a null text counts as empty; a text shorter than k is one k-mer; an empty text has no k-mer,
so all bins are empty, and two such fingerprints are alike (1.0); null doc_ids come first; rows of one doc_id stand in the order of
their texts' hash; a table of one row is its own next document; an empty table gives no rows; other columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, small_batches

K, BINS, PER_BIN = 8, 64, 2
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
HALF = np.uint64(32)
#: K-mers a bin should keep as candidates on average before they are sorted.
CANDIDATES = 14

#: Columns of a result; digests and fingerprints travel as bytes and are shown in hexadecimal at the end.
RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> HALF)) * P2
    x = (x ^ (x >> np.uint64(29))) * P3
    return x ^ (x >> HALF)


def _kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k codes, built by doubling the window."""
    value, width, power = codes, 1, P1
    whole, size, high = None, 0, np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                if whole is None:
                    whole, size, high = value, width, power
                else:
                    n = len(value) - size
                    whole, size, high = value[:n] * high + whole[width : width + n], size + width, power * high
            if 2 * width > k:
                return whole
            value, power = value[: len(value) - width] * power + value[width:], power * power
            width *= 2


def signature(text: str, k: int = K, bins: int = BINS, per_bin: int = PER_BIN) -> np.ndarray:
    """A number under 65,536 for each bin: 0 if it is empty, else the hash of its ordered tuple."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return np.zeros(bins, np.uint16)
    with np.errstate(over="ignore"):
        hashes = _mix(_kmers(codes + np.uint64(1), min(k, len(codes))) + P1)
        n = len(hashes)
        # stable, so equal k-mers stay in text order; whole hashes, so a key depends on nothing but the k-mer and its number
        place = np.argsort(hashes, kind="stable")
        kmer = hashes[place]
        rank = np.arange(n)
        opens = np.empty(n, bool)
        opens[0] = True
        np.not_equal(kmer[1:], kmer[:-1], out=opens[1:])
        occurrence = rank - np.maximum.accumulate(np.where(opens, rank, 0))
        key = _mix(kmer + occurrence.astype(np.uint64) * P1)
        bits = np.uint64(bins.bit_length() - 1)
        chosen = _least(key, place.astype(np.uint64), bins, bits, per_bin, min(1.0, CANDIDATES * bins / n))
    return chosen


def _least(key, place, bins, bits, per_bin, share) -> np.ndarray:
    if share < 1:
        some = (key << bits) < np.uint64(int(share * 2**64))
        few, where = key[some], place[some]
    else:
        few, where = key, place
    shift = np.uint64(64) - bits
    order = np.argsort(few)
    few, where = few[order], where[order]
    starts = np.searchsorted(few >> shift, np.arange(bins + 1, dtype=np.uint64))
    counts = np.diff(starts)
    if share < 1 and (counts < per_bin).any():  # some bin may hold further k-mers
        return _least(key, place, bins, bits, per_bin, 1.0)
    result = np.zeros(bins, np.uint64)
    index = starts[:-1, None] + np.arange(per_bin)
    there = np.arange(per_bin) < counts[:, None]
    index = np.where(there, index, 0)
    at = np.where(there, where[index], np.iinfo(np.uint64).max)
    text_order = np.argsort(at, axis=1, kind="stable")
    values = np.take_along_axis(np.where(there, few[index], np.uint64(0)), text_order, axis=1)
    for i in range(per_bin):
        result = _mix(result * P1 + values[:, i] + np.uint64(1))
    short = (result >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
    return np.where(counts > 0, short, 0).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of bins that agree among those that either side fills; 1 if neither fills any."""
    filled = (a != 0) | (b != 0)
    n = int(filled.sum())
    return float(((a == b) & filled).sum() / n) if n else 1.0


def as_bytes(bins: np.ndarray) -> bytes:
    return bins.astype(">u2").tobytes()


def as_text(bins: np.ndarray) -> str:
    return as_bytes(bins).hex()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _result(doc_id, text: str, bins: np.ndarray, following: str, next_bins: np.ndarray) -> tuple:
    other = edited(text, following)
    other_bins = bins if other == text else signature(other)
    return doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).digest(), as_bytes(bins), as_bytes(other_bins), likeness(bins, other_bins), likeness(bins, next_bins)


#: Rows of a task: results, then its range's first and last document, which other ranges need or wait for.
STREAM = f"kind int, part int, {RESULT}, text string"
RESOLVED, FIRST, LAST = 0, 1, 2


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.strip().split(" ") for c in ddl.split(","))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def fingerprint_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its fingerprint, its edited text's, and their likenesses (see RESULT), digests in hexadecimal."""
    small_batches(docs.sparkSession, 500)
    plain = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranges = plain.repartitionByRange(*order).sortWithinPartitions(*order)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, schema, last = TaskContext.get().partitionId(), _schema(STREAM), None
        for batch in batches:
            rows = []
            for key, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                bins = last[2] if last and last[1] == own else signature(own)
                if last is None:
                    rows.append((FIRST, part, key, *[None] * 6, own))
                else:
                    rows.append((RESOLVED, part, *_result(*last, own, bins), None))
                last = (key, own, bins)
            if rows:
                yield _batch(rows, schema)
        if last:
            yield _batch([(LAST, part, last[0], *[None] * 6, last[1])], schema)

    def waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(RESULT)
        for batch in batches:
            found = []
            for key, own, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
                found.append(_result(key, own, signature(own), following, signature(following)))
            if found:
                yield _batch(found, schema)

    rows = materialize(ranges.mapInArrow(stream, STREAM), "ranges")
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    heads = rows.where(F.col("kind") == FIRST).select("part", F.col("text").alias("following"))
    # the ranges' numbers only: one small row a range
    turns = Window.orderBy("part")
    before = heads.select("part", F.coalesce(F.lag("part").over(turns), F.max("part").over(turns.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    nexts = heads.join(before, "part").select(F.col("before").alias("part"), "following")
    tails = rows.where(F.col("kind") == LAST).select("part", "doc_id", "text").join(nexts, "part").select("doc_id", "text", "following")
    found = rows.where(F.col("kind") == RESOLVED).select(*names).unionByName(tails.mapInArrow(waiting, RESULT))
    return found.select(*(F.lower(F.hex(c)).alias(c) if kind == "binary" else F.col(c) for c, kind in found.dtypes))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_order_minhash": op9_order_minhash}
