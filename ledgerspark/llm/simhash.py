"""SimHash near-duplicates by a segment-popcount embedding.

A document's fingerprint takes the majority of each bit over the hashes of its word shingles. Fingerprints
link if at most `radius` bits differ. To find the links, a fingerprint is cut into 32 segments of two bits
and mapped to the vector of their bit counts. Flipping one bit moves that vector by one, so the Manhattan
distance of two vectors never exceeds the number of differing bits: pairs further apart than the radius in
this space are no links. The space is joined on a grid: its coordinates form `2 * radius` blocks, and two
vectors within the radius differ in at most `radius` of them, so they fall into the same cell of at least
one of the grids over half of the blocks. Pairs in a cell pass the Manhattan bound first and are then
verified on all bits. Counts are kept in thermometer code (0, 1, 2 as 00, 01, 11), in which the Manhattan
distance is the number of differing bits, and a grid cell is the code under a mask.

Equal fingerprints are one row from the start, whatever the number of copies. Cells are counted first; a cell
of more than CELL fingerprints is dealt out as pairs of blocks, so no task holds more than two blocks, and
every task returns links that span its groups instead of all pairs, which loses no connection.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link to each
other and to any fingerprint near zero; repeated rows get the same result each; a null doc_id keeps its row and never
names a component unless all of its rows are null; other columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read, small_batches, text_or_empty
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a cell that one block holds.
CELL = 2048
EVEN = 0x5555555555555555
#: Pairs found before a task folds them into spanning links.
FOLD = 1 << 19


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n], ends[width - 1 :] or ends[-1:], strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):
        part = np.unpackbits(hashes[at : at + 255 * 256].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(part) // 255 * 255
        if full:
            ones += part[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += part[full:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, seed: int = SEED, keyed: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long; with the column key of docs if keyed."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width, seed) for t in texts], np.uint64).view(np.int64))

    key = ["key"] if keyed else []
    return docs.select(docs[f"`{doc_id}`"].alias("doc_id"), *key, prints(docs[f"`{text}`"]).alias("fp"))


def thermometer(fp):
    """The counts of a fingerprint's two-bit segments in thermometer code; fp: a long column or a numpy array."""
    if isinstance(fp, np.ndarray):
        high = fp >> np.uint64(1)
        return ((fp | high) & np.uint64(EVEN)) | ((fp & high & np.uint64(EVEN)) << np.uint64(1))
    high, even = F.shiftrightunsigned(fp, 1), F.lit(EVEN)
    return fp.bitwiseOR(high).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(even), 1))


def grid_masks(radius: int) -> list[int]:
    """Code masks of the grids: each keeps half of 2 * radius blocks of segments, as signed longs."""
    edges = [round(i * 32 / (2 * radius)) * 2 for i in range(2 * radius + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _fold(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node) that span what the links a-b connect."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _group_links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between rows of the same group (a sorted array of group numbers) within the radius."""
    code = thermometer(fp)
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    held: list = []
    count, step = 0, 1
    left = np.arange(len(fp) - 1) if len(fp) > 1 else np.empty(0, np.int64)
    while len(left := left[left + step < len(fp)]) and len(left := left[group[left] == group[left + step]]):
        near = left[np.bitwise_count(code[left] ^ code[left + step]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= radius]
        if len(near):
            held.append((fp[near], fp[near + step]))
            count += len(near)
        if count > FOLD:
            a, b = _fold(np.concatenate([a, *(h[0] for h in held)]), np.concatenate([b, *(h[1] for h in held)]))
            held, count = [], 0
        step += 1
    if count:
        a, b = _fold(np.concatenate([a, *(h[0] for h in held)]), np.concatenate([b, *(h[1] for h in held)]))
    return a, b


def links(distinct: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(u, v), u > v: links that connect all distinct fingerprints (column fp, signed) within the radius."""
    code = thermometer(F.col("fp"))
    grids = F.array(*(F.struct(F.lit(i).alias("grid"), F.col("code").bitwiseAND(F.lit(m)).alias("at")) for i, m in enumerate(grid_masks(radius))))
    cells = distinct.select("fp", code.alias("code")).select("fp", F.explode(grids).alias("c")).select("fp", "c.grid", "c.at")
    # a row for each crowded cell only: at most one in `cell` of the fingerprints' places
    crowded = materialize(cells.groupBy("grid", "at").agg(F.count("*").alias("n")).where(F.col("n") > cell), "crowded")
    blocks = F.ceil(F.col("n") / cell).cast("int")
    dealt = cells.join(crowded, ["grid", "at"], "left").withColumn("blocks", F.coalesce(blocks, F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    dealt = dealt.select("fp", "grid", "at", "own", F.explode(other).alias("other"))
    dealt = dealt.select("fp", "grid", "at", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    keys = ["grid", "at", "i", "j"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in [*keys, "fp"]]
            if kept:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            starts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in columns[:-1]])) + 1
            if not len(starts):
                kept = columns
                continue
            yield from found([c[: starts[-1]] for c in columns])
            kept = [c[starts[-1] :] for c in columns]
        if kept:
            yield from found(kept)

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        changes = np.logical_or.reduce([k[1:] != k[:-1] for k in columns[:-1]]) if len(columns[0]) > 1 else np.empty(0, bool)
        group = np.concatenate([[0], np.cumsum(changes)])
        a, b = _group_links(group, columns[-1].view(np.uint64), radius)
        if len(a):
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.record_batch({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    return dealt.mapInArrow(linked, "u long, v long").distinct()


def _rooted(prints: DataFrame, least: Column, radius: int) -> DataFrame:
    """(fp, root, least): each distinct fingerprint of prints, its component's name and the least of its rows."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(least).alias("least")), "fps")
    joined = components(links(distinct, radius))
    return distinct.join(joined, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of docs, component_id the least doc_id it is linked to."""
    prints = materialize(fingerprints(docs, doc_id, text), "prints")
    rooted = _rooted(prints, F.col("doc_id"), radius)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = materialize(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without all but one row of each class: the one of the least doc_id (a null one comes last), then the least text hash.

    Rows of one doc_id are told apart by their texts, so unlike texts under one doc_id are all kept; of rows equal
    in doc_id and text one is kept. Null texts count as empty, and texts without words form one class. Columns of
    any names are kept.
    """
    key = F.xxhash64("doc_id", text_or_empty())
    prints = materialize(fingerprints(docs.select("doc_id", "text", key.alias("key")), keyed=True), "prints")
    rooted = _rooted(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"), radius)
    kept = materialize(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("_key")), "kept")
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_key")).join(kept, "_key", "left_semi")
    # rows equal in doc_id and text meet in partial aggregates first, so many of them cost a task little
    return rows.groupBy("_key").agg(F.first("_row").alias("_row")).select("_row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
