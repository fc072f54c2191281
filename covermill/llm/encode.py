"""Problem 7: encoding of whole texts with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermill.session import Scratch

#: Texts of more characters are cut into parts of this length that are encoded in parallel.
PART_CHARS = 1 << 18
#: Tokens on either side of a join that are encoded anew at first, and that must come out as before.
WINDOW, AGREED = 32, 8


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _text_ids(path: str, text: str) -> np.ndarray:
    return np.asarray(_encoding(path).encode_ordinary(text), dtype=np.int32)


def _edge(path: str, ids: np.ndarray, want: int, left: bool) -> int:
    """How many tokens of the end (``left``) or start of ``ids`` make whole characters, ``want`` or more."""
    enc = _encoding(path)
    for n in range(min(want, len(ids)), len(ids)):
        cut = enc.decode_single_token_bytes(int(ids[len(ids) - n if left else n]))
        if cut[0] & 0xC0 != 0x80:
            return n
    return len(ids)


def joined_ids(path: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids of two encoded texts put together.

    A window around the join is encoded anew and grows until it begins and ends with the same tokens as before. A
    sequence in which every two neighbours are what their own bytes are encoded to is the encoding of the whole.
    """
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    enc, want = _encoding(path), WINDOW
    while True:
        i, j = _edge(path, left, want, True), _edge(path, right, want, False)
        window = np.concatenate([left[len(left) - i :], right[:j]])
        new = _text_ids(path, enc.decode_bytes(window.tolist()).decode("utf-8"))
        same_left = i == len(left) or (len(new) >= 2 * AGREED and np.array_equal(new[:AGREED], window[:AGREED]))
        same_right = j == len(right) or (len(new) >= 2 * AGREED and np.array_equal(new[-AGREED:], window[-AGREED:]))
        if same_left and same_right:
            return np.concatenate([left[: len(left) - i], new, right[j:]])
        want *= 2


def _encoder(path: str, keys: list[str], types: list[pa.DataType]):
    fields = [pa.field(k, t) for k, t in zip(keys, types)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_text_ids(path, t) if t else np.empty(0, np.int32) for t in batch.column(batch.num_columns - 1).to_pylist()]
            ends = np.cumsum([0, *(len(x) for x in ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            cols = [batch.column(k) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, lists], schema=pa.schema([*fields, pa.field("ids", pa.list_(pa.int32()))]))

    return encode


def _join_two(path: str):
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", ignore_index=True)
        ids = np.asarray(pdf["ids"][0], dtype=np.int32)
        for more in pdf["ids"][1:]:
            ids = joined_ids(path, ids, np.asarray(more, dtype=np.int32))
        return pd.DataFrame({"doc_id": pdf["doc_id"][:1], "part": pdf["part"][:1] // 2, "ids": [ids]})

    return join


def encoded(scratch: Scratch, docs: DataFrame, doc: str, text: str, path: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs``; null and empty texts give an empty list.

    Short texts are encoded where they are read. A longer one is cut into parts; parts are encoded in parallel and
    joined two by two, in as many rounds as the logarithm of the longest text's parts. Rows of one id and several
    long texts are not supported; the ids of documents are unique.
    """
    path = path or vocabulary_path()
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    longest = rows.agg(F.max(F.length("text"))).first()[0] or 0
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= part_chars) if longest > part_chars else rows
    out = "doc_id long, ids array<int>"
    done = short.mapInArrow(_encoder(path, ["doc_id"], [pa.int64()]), out)
    if longest <= part_chars:
        return done
    starts = F.expr(f"sequence(0, (length(text) - 1) div {part_chars})")
    parts = rows.where(F.length("text") > part_chars).select("doc_id", "text", F.explode(starts).alias("part"))
    parts = parts.select("doc_id", F.col("part").cast("long").alias("part"), F.expr(f"substring(text, cast(part * {part_chars} + 1 as int), {part_chars})").alias("text"))
    parts = parts.repartition("doc_id", "part")
    trees = scratch.keep(parts.mapInArrow(_encoder(path, ["doc_id", "part"], [pa.int64(), pa.int64()]), "doc_id long, part long, ids array<int>"))
    left = -(-longest // part_chars)
    while left > 1:
        pairs = trees.withColumn("pair", F.expr("part div 2")).groupBy("doc_id", "pair")
        trees = scratch.keep(pairs.applyInPandas(_join_two(path), "doc_id long, part long, ids array<int>"))
        left = -(-left // 2)
    return done.unionByName(trees.select("doc_id", "ids"))
