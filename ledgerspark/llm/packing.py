"""Packing by lexical retrieval: each seed document's window is filled with its BM25 neighbours.

A task's documents are taken in shards of bounded size. A shard's token ids make an inverted index (postings
by token with BM25 weights). Documents give off full windows of their own; a window then opens with the next
document that has ids left as its seed, whose terms look up unused neighbours, best first, until the
window is full. The neighbour that passes the end is cut there, and its rest seeds the next window, so windows
of a task have no padding at all; a window that is still open at the end of a shard is filled from the next
shard. What is left at the end of a task is cut at powers of two, which need no padding either.

Rows are not shuffled: a shard is a stretch of a task's input, so no key can crowd a task and a lost task is
redone from its own input alone. A sequence's id is made of the task's number and the sequence's number in it.

Defined results: a null text counts as empty and is its end id alone; rows that repeat are packed each; a
document of any length is cut over as many sequences as it takes; an empty table gives no rows; other columns don't take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

WINDOW, END_ID = 1024, 0
#: A shard closes at so many documents or ids.
SHARD_DOCS, SHARD_IDS = 2048, 4_000_000
K1, B = 1.2, 0.75
#: Terms in so large a share of a shard's documents are kept as rows of a matrix, the others as postings.
COMMON = 1/32
#: Room for a task's sequences in an id.
TASK_BITS = 33

PIECES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


@lru_cache(maxsize=1)
def encoder(json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> Callable[[str], np.ndarray]:
    """Ids of a text as the library of the .json gives them, without added special tokens.

    Where the same vocabulary is also at hand as ranks, texts go through the faster library, which gives the
    same ids (tested over all code points), and only texts that it can't take go through the .json.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    plain = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if ranks_path is None:
        return plain
    import base64

    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    special = {token.content: i for i, token in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern engine gives up on very long runs of blanks
            return plain(text)

    return ids


class Index:
    """An inverted index of a shard: postings by token, with BM25 weights of its documents."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        keys = np.concatenate(docs).astype(np.uint64) | (np.repeat(np.arange(len(docs), dtype=np.uint64), sizes) << np.uint64(32))
        keys.sort()
        opens = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        tf = np.diff(np.append(opens, len(keys))).astype(np.float32)
        pairs = keys[opens]
        doc, term = (pairs >> np.uint64(32)).astype(np.int32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        df = np.bincount(term)
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
        idf[df < 2] = 0  # a term of one document finds no neighbour
        norm = (K1 * (1 - B + B * sizes / max(1.0, sizes.mean()))).astype(np.float32)
        self.weight = idf[term] * tf * np.float32(K1 + 1) / (tf + norm[doc])
        self.term, self.n = term, len(docs)
        self.own = np.searchsorted(doc, np.arange(len(docs) + 1))
        by_term = np.argsort(term, kind="stable")
        self.at = np.concatenate([[0], np.cumsum(df)])
        self.posted, self.posted_weight = doc[by_term], self.weight[by_term]
        common = np.flatnonzero(df >= max(2, COMMON * len(docs)))
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), len(docs)), np.float32)
        there = self.row[term] >= 0
        self.matrix[self.row[term[there]], doc[there]] = self.weight[there]

    def neighbours(self, doc: int, terms: int | None = None) -> np.ndarray:
        """Documents by the BM25 scores of all the seed's terms (or of its `terms` heaviest), best first, ties in order."""
        a, b = self.own[doc], self.own[doc + 1]
        weight = self.weight[a:b]
        top = np.argpartition(weight, len(weight) - terms)[-terms:] if terms and len(weight) > terms else np.arange(len(weight))
        top = np.sort(top[weight[top] > 0])
        if not len(top):
            return top
        own = self.term[a + top]
        row = self.row[own]
        score = self.matrix[row[row >= 0]].sum(axis=0).astype(np.float64)
        spans = [slice(self.at[t], self.at[t + 1]) for t in own[row < 0].tolist()]
        if spans:
            found = np.concatenate([self.posted[s] for s in spans])
            score += np.bincount(found, np.concatenate([self.posted_weight[s] for s in spans]), self.n)
        hits = np.flatnonzero(score)
        return hits[np.argsort(-score[hits], kind="stable")]


class Packer:
    """Packs documents as they come; yields pieces (doc_id, start, ids, doc_tokens, sequence number, offset)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.number, self.open, self.filled = window, 0, [], 0

    def _add(self, doc_id, ids: np.ndarray, start: int, length: int) -> None:
        self.open.append((doc_id, start, ids[start : start + length], len(ids), self.number, self.filled))
        self.filled += length

    def _close(self) -> list[tuple]:
        done, self.open, self.filled = self.open, [], 0
        self.number += 1
        return done

    def shard(self, doc_ids: list, docs: list[np.ndarray]) -> Iterator[tuple]:
        index, starts, turn, seed = Index(docs), [0] * len(docs), 0, None
        near: Iterator[int] = iter(())
        used = [False] * len(docs)

        def put(i: int) -> bool:
            """Adds what fits of document i; whether it is used up."""
            length = min(len(docs[i]) - starts[i], self.window - self.filled)
            self._add(doc_ids[i], docs[i], starts[i], length)
            starts[i] += length
            used[i] = starts[i] == len(docs[i])
            return used[i]

        while True:
            if seed is None:  # the rest of a cut document, else the best unused neighbour, else the next document
                seed = next((i for i in near if not used[i]), None)
            if seed is None:
                while turn < len(docs) and used[turn]:
                    turn += 1
                if turn == len(docs):
                    return
                seed = turn
                near = iter(index.neighbours(seed).tolist())
            done = put(seed)
            if self.filled == self.window:
                yield from self._close()
                if not done:
                    near = iter(())
                    if len(docs[seed]) - starts[seed] < self.window:  # this rest opens the next window and seeks its own neighbours
                        near = iter(index.neighbours(seed).tolist())
                    continue
                near = iter(())
            seed = None

    def finish(self) -> Iterator[tuple]:
        """The open window, cut at powers of two."""
        rest, self.open, total = self.open, [], self.filled
        self.filled = 0
        size = 0
        for doc_id, start, ids, doc_tokens, _, _ in rest:
            at = 0
            while at < len(ids):
                if not size:
                    size = 1 << (total.bit_length() - 1)
                    total -= size
                part = ids[at : at + size - self.filled]
                yield doc_id, start + at, part, doc_tokens, self.number, self.filled
                at, self.filled = at + len(part), self.filled + len(part)
                if self.filled == size:
                    self.number, self.filled, size = self.number + 1, 0, 0


def _packed(docs: DataFrame, load: Callable[[], Callable[[str], np.ndarray]], last: tuple[str, pa.DataType, Callable], doc_id: str, text: str, window: int, end_id: int) -> DataFrame:
    small_batches(docs.sparkSession, 500)
    name, kind, value = last
    schema = pa.schema([*PIECES, (name, kind)])

    def rows(pieces: Iterator[tuple], task: int) -> Iterator[pa.RecordBatch]:
        held: list = []
        for key, start, ids, doc_tokens, number, offset in pieces:
            held.append((key, start, len(ids), doc_tokens, (task << TASK_BITS) + number, offset, value(ids)))
            if len(held) == 20_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, encode, packer = TaskContext.get().partitionId(), load(), Packer(window)
        end = np.array([end_id], np.uint32)

        def pieces() -> Iterator[tuple]:
            keys: list = []
            held: list[np.ndarray] = []
            size = 0
            for batch in batches:
                for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.concatenate([encode(words), end]) if words else end
                    keys.append(key)
                    held.append(ids)
                    size += len(ids)
                    if len(held) == SHARD_DOCS or size >= SHARD_IDS:
                        yield from packer.shard(keys, held)
                        keys, held, size = [], [], 0
            if held:
                yield from packer.shard(keys, held)
            yield from packer.finish()

        yield from rows(pieces(), number)

    ddl = ", ".join(f"{n} long" for n, _ in PIECES) + f", {name} {'long' if kind == pa.int64() else 'array<int>'}"
    return docs.select(docs[f"`{doc_id}`"].cast("long"), docs[f"`{text}`"]).mapInArrow(task, ddl)


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start and length in its document, its document's ids in all (doc_tokens),
    sequence_id, offset in the sequence, and the ids themselves."""
    return _packed(docs, lambda: encoder(json_path, ranks_path, pattern), ("ids", pa.list_(pa.int32()), lambda ids: ids.astype(np.int32)), doc_id, text, window, end_id)


def pack_digests(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of pack() with ids_crc32, the CRC-32 of the ids as little-endian 32-bit numbers, in place of ids."""
    return _packed(docs, lambda: encoder(json_path, ranks_path, pattern), ("ids_crc32", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes())), doc_id, text, window, end_id)


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packed_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", F.col("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op7_packing": op7_packing}
