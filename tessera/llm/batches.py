"""Batches of documents that ask questions of hash buckets and get answers back.

Some operators need, for each value of a document (a window's hash, a word), what
the whole corpus knows of it. A row for each value would move far more bytes than
the values have. Here documents are packed, in ascending id order, into batches of
a few megabytes, stored bucketed by batch number. A round then goes:

1. each batch makes its distinct values and sends each hash bucket one message;
2. each bucket, over all its messages, makes an answer for each batch;
3. answers are gathered by batch and joined to the stored batches, whose own rows
   aren't moved, for the next round or the result.

Values are made distinct within a batch before they move, so a value that a third
of all documents hold costs one entry a batch. Each round's answers are written
to the shared folder; a lost executor repeats at most its tasks of one round.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .shared import saved, shared_folder

#: Characters of a batch, about; one longer document makes a batch of its own.
CHARS = 1_000_000

PACKED = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lens", T.BinaryType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("rest", T.BinaryType()),
    ]
)
#: Carried columns keep microseconds, with and without a zone.
CARRIED = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
MESSAGE = "bucket int, batch_id long, body binary"


class Batch:
    """A packed batch in a worker: ``doc_ids``, ``nulls``, ``texts`` and ``rest``."""

    def __init__(self, row, with_rest: bool = False):
        self.batch_id = int(row.batch_id)
        self.doc_ids = [None if pd.isna(i) else int(i) for i in row.doc_ids]
        lens = np.frombuffer(row.lens, dtype="<i8")
        self.nulls = (lens < 0).tolist()
        body = zstandard.ZstdDecompressor().decompress(row.body) if len(row.body) else b""
        ends = np.cumsum(np.maximum(lens, 0)).tolist()
        self.texts = [body[b - max(n, 0) : b].decode("utf-8", "surrogatepass") for b, n in zip(ends, lens.tolist(), strict=True)]
        if with_rest:
            rest = zstandard.ZstdDecompressor().decompress(row.rest).decode("utf-8", "surrogatepass").split("\n")
            self.rest = rest[: len(lens)]


class Batches:
    """The packed documents, stored once and bucketed by batch."""

    def __init__(self, docs: DataFrame, rest: list[str] | None = None, ordered: bool = True):
        """``docs`` has doc_id and text; the columns of ``rest`` are carried along as JSON.

        Unordered batches are packed where the documents are read, without moving them.
        """
        spark = docs.sparkSession
        self.spark, self.n = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = 2 * self.n
        carried = F.to_json(F.struct(*rest), CARRIED) if rest else F.lit("")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", carried.alias("rest"))
        if ordered:
            rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        packed = rows.mapInPandas(_packer(CHARS), PACKED)
        name = f"batches_{uuid.uuid4().hex[:12]}"
        packed.write.bucketBy(self.n, "batch_id").option("path", shared_folder(spark, "batches")).option("compression", "uncompressed").saveAsTable(name)
        self.table = spark.table(name)

    def send(self, make: Callable[[Batch, dict[str, dict[int, bytes]]], Iterator[tuple[int, bytes]]], **answers: DataFrame) -> DataFrame:
        """Messages (bucket, body) that ``make`` has for each batch, given its answers so far."""
        run = _over_batches(make, sorted(answers), MESSAGE)
        return self._with(answers).mapInPandas(run, MESSAGE)

    def result(self, make: Callable, schema: T.StructType, with_rest: bool = False, **answers: DataFrame) -> DataFrame:
        """What ``make`` yields (data frames) for each batch, given its answers."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    yield make(Batch(row, with_rest), _answers(row, names))
                wordhash.trim()

        names = sorted(answers)
        return self._with(answers, with_rest).mapInPandas(run, schema)

    def _with(self, answers: dict[str, DataFrame], with_rest: bool = False) -> DataFrame:
        rows = self.table if with_rest else self.table.drop("rest")
        for name, answer in sorted(answers.items()):
            of_batch = answer.filter("batch_id >= 0").groupBy("batch_id").agg(F.collect_list("bucket").alias(f"{name}_to"), F.collect_list("body").alias(f"{name}_body"))
            rows = rows.join(of_batch, "batch_id", "left")
        return rows


def answered(messages: DataFrame, answer: Callable[[list[bytes]], tuple[list[bytes], bytes]], tag: str) -> DataFrame:
    """Each bucket's answers, batches ascending.

    ``answer(bodies)`` gives one body a message, and one for the driver, which
    stands under batch -1 and is bounded, as there is one a bucket.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("batch_id", kind="stable")
        bodies, told = answer(frame["body"].tolist())
        ids, k = frame["batch_id"].tolist(), int(frame["bucket"].iloc[0])
        wordhash.trim()
        return pd.DataFrame({"bucket": np.full(len(ids) + 1, k, dtype=np.int32), "batch_id": [*ids, -1], "body": [*bodies, told]})

    return saved(messages.groupBy("bucket").applyInPandas(run, MESSAGE), tag)


def told(answers: DataFrame) -> list[bytes]:
    """What the buckets have for the driver, in order of bucket."""
    return [bytes(r["body"]) for r in answers.filter("batch_id = -1").select("bucket", "body").orderBy("bucket").collect()]


def _answers(row, names: list[str]) -> dict[str, dict[int, bytes]]:
    out = {}
    for name in names:
        to, body = getattr(row, f"{name}_to"), getattr(row, f"{name}_body")
        out[name] = {} if to is None else {int(k): bytes(v) for k, v in zip(to, body, strict=True)}
    return out


def _over_batches(make: Callable, names: list[str], schema: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                batch = Batch(row)
                found = list(make(batch, _answers(row, names)))
                yield pd.DataFrame({"bucket": [k for k, _ in found], "batch_id": [batch.batch_id] * len(found), "body": [b for _, b in found]}).astype({"bucket": "int32", "batch_id": "int64"})
                del batch, found
            wordhash.trim()

    return run


def _packer(chars: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, part = 0, TaskContext.get().partitionId()
        ids: list[int | None] = []
        parts: list[bytes] = []
        lens: list[int] = []
        rest: list[str] = []
        press = zstandard.ZstdCompressor(level=3)

        def row() -> pd.DataFrame:
            made = (part << 32 | number, list(ids), np.array(lens, dtype="<i8").tobytes(), press.compress(b"".join(parts)), press.compress("\n".join(rest).encode("utf-8", "surrogatepass")))
            return pd.DataFrame([made], columns=PACKED.names)

        used = 0
        for frame in frames:
            for doc_id, text, more in zip(frame["doc_id"], frame["text"], frame["rest"], strict=True):
                is_text = isinstance(text, str)
                if ids and used + (len(text) if is_text else 0) > chars:
                    yield row()
                    number, ids, parts, lens, rest, used = number + 1, [], [], [], [], 0
                raw = text.encode("utf-8", "surrogatepass") if is_text else b""
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                parts.append(raw)
                lens.append(len(raw) if is_text else -1)
                rest.append(more)
                used += len(text) if is_text else 0
        if ids:
            yield row()
        ids, parts, rest = [], [], []
        wordhash.trim()

    return pack


def by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The runs of sorted 64-bit ``keys`` that belong to each bucket, by value ranges."""
    step = (1 << 64) // buckets + 1
    cuts = np.searchsorted(keys, np.array([k * step for k in range(1, buckets)], dtype=np.uint64))
    edges = [0, *cuts.tolist(), len(keys)]
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))[:n].astype(bool)


def gather(runs: list[tuple[int, slice]], total: int, answers: dict[int, bytes]) -> np.ndarray:
    """The bits answered to a batch's sorted keys, in their order."""
    out = np.zeros(total, dtype=bool)
    for k, run in runs:
        if k in answers:
            out[run] = unbits(answers[k], run.stop - run.start)
    return out


__all__ = ["CARRIED", "Batch", "Batches", "answered", "bits", "by_bucket", "gather", "told", "unbits"]
