"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut at safe boundaries before encoding: a piece always starts
with a white-space run that follows a non-space character. Every match of the
split pattern ends before such a run, so the pieces' ids, put together, are the
ids of the whole text.

Cases: a null text counts as empty (no ids); an empty text has no ids; repeated
rows give repeated results; an empty table gives an empty result; columns of the
input other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters with the Unicode property White_Space (fixed values), as the split pattern's \\s takes them.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points of one piece before the next safe boundary is taken.
PIECE = 50_000

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.BinaryType()),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)

_BOUNDARY = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


class ByteBpe:
    """A rank file's encoder and decoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def from_lines(cls, data: bytes, pattern: str) -> ByteBpe:
        ranks = {}
        for line in data.splitlines():
            if line:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks, pattern)

    def pieces(self, text: str, size: int = PIECE) -> Iterator[str]:
        """``text`` in pieces of at least ``size`` code points, cut at safe boundaries."""
        start = 0
        while len(text) - start > size:
            cut = _BOUNDARY.search(text, start + size)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= PIECE:
            return self.encoding.encode_ordinary(text)
        return [i for piece in self.pieces(text) for i in self.encoding.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


_LOADED: dict[tuple, ByteBpe] = {}


def _loaded(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file, read once in each Python worker."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path, pattern] = ByteBpe.from_lines(f.read(), pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Each document's ids (little-endian unsigned 32-bit) and the bytes they decode to.

    ``rank_file`` is a file installed with the tokenizer package on every
    machine. With ``digests`` the ids and bytes are replaced by their SHA-256
    inside the same pass, so the payload never leaves the worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _loaded(rank_file, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = bpe.encode(text)
                packed, raw = np.asarray(ids, dtype="<u4").tobytes(), bpe.decode(ids)
                if digests:
                    packed, raw = hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw).hexdigest()
                rows.append((doc_id, len(ids), packed, raw))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "a", "b"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.rename(columns=dict(zip(("a", "b"), names, strict=True)))

    schema = DIGESTS if digests else SCHEMA
    names = schema.names[2:]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
