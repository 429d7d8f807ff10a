"""Token counts of whole texts by the whole-token shortcut.

Blanks only ever open a token of this vocabulary, so a text falls into pre-tokens (its blanks and the
characters that follow them) across which nothing merges. Which pre-tokens are a single token is proved
once, on the driver, by encoding every vocabulary string alone. A worker then counts those directly and
merges only the pre-tokens that are left, each distinct one once.

Defined results: a null text counts as empty; an empty text has 0 tokens; columns that are already called
n_bytes, n_tokens or over_limit are replaced, all others kept; repeated rows are counted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, small_batches

META = "▁"
#: A pre-token's own key: what follows its first blank. Blanks at the end of a text are a pre-token too.
PRETOKEN = re.compile(" (?: *[^ ]+| *$)")
#: Pre-tokens remembered by a worker at most, and the longest that is worth remembering.
MEMORY, LONGEST = 400_000, 64


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_blanks(path: str) -> bool:
    """Whether the model leaves texts as they are and no vocabulary string has a blank after another character."""
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    plain = proto.normalizer_spec
    pieces = [p for p in proto.pieces if p.type == model.ModelProto.SentencePiece.Type.NORMAL]
    own = [p for p in proto.pieces if p.type == model.ModelProto.SentencePiece.Type.USER_DEFINED]
    return (
        not plain.precompiled_charsmap
        and plain.add_dummy_prefix
        and plain.escape_whitespaces
        and not plain.remove_extra_whitespaces
        and not own
        and not any(META in p.piece.lstrip(META) for p in pieces)
    )


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings, without their opening blank, that encode alone as exactly their own token."""
    sp = _processor(path)
    opening = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if sp.id_to_piece(i).startswith(META)]
    keys = [piece[1:].replace(META, " ") for _, piece in opening]
    return frozenset(k for k, (i, _), ids in zip(keys, opening, sp.encode(keys), strict=True) if k and ids == [i])


def pretokens(text: str) -> list[str]:
    """Keys of a text's pre-tokens: encoding a key gives exactly the tokens of its pre-token."""
    text = text.replace(META, " ")
    words = text.split(" ")
    return [m[1:] for m in PRETOKEN.findall(" " + text)] if "" in words else words


class Counter:
    def __init__(self, path: str, whole: frozenset[str]):
        self.sp, self.whole = _processor(path), whole
        self.blank = len(self.sp.encode("a ")) - len(self.sp.encode("a"))
        self.known: dict[str, int] = {}
        self.restart()

    def restart(self) -> None:
        self.known = dict.fromkeys(self.whole, 1) | {"": self.blank}

    def __call__(self, texts) -> list[int]:
        if len(self.known) > MEMORY:
            self.restart()
        split = [pretokens(t) if t else () for t in texts]
        known = self.known
        left = list({w for words in split for w in words if w not in known})
        rare = {}
        for start in range(0, len(left), 10_000):
            part = left[start : start + 10_000]
            for word, ids in zip(part, self.sp.encode(part, num_threads=1), strict=True):
                (known if len(word) <= LONGEST else rare)[word] = len(ids)
        if rare:
            known = known | rare
        return [sum(map(known.__getitem__, words)) for words in split]


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens (as the model's library counts) and over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(whole_tokens(model_path) if splits_at_blanks(model_path) else None)

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if shared.value is None:  # nothing proved for this vocabulary: encode whole texts
            sp = _processor(model_path)
            for texts in batches:
                yield pd.Series([len(ids) for ids in sp.encode([t or "" for t in texts], num_threads=1)], dtype="int64")
            return
        count = Counter(model_path, shared.value)
        for texts in batches:
            yield pd.Series(count(texts), dtype="int64")

    kept = [docs[f"`{c}`"] for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    whole = F.coalesce(docs[f"`{text}`"], F.lit(""))
    counted = docs.select(*kept, F.octet_length(whole).cast("long").alias("n_bytes"), tokens(whole).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op1_token_counts": op1_token_counts}
