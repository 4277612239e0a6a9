"""Token-ID output: documents' ids in files of directly addressable codes.

The files are Parquet rows of segments: documents in ascending id order, each
segment with its document ids, their token offsets and the ids as a directly
addressable code (see ``dac``), so a document, or one token of it, is read
without decoding what stands before it. Spark's writer commits them, so a lost
executor leaves no half-written segment and any file system Spark writes to will
do. A segment knows the tokens before it in its range of ids; the totals of the
ranges, of which there are no more than shuffle partitions, give global places.

Cases: a null text counts as empty; an empty document has the end id alone;
repeated rows are kept and stand side by side; an empty table gives files with no
segments; a null id sorts first; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from . import dac, wordhash
from .shared import shared_folder

# A task has one core; more threads would only hold more memory.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Tokens after which a segment is closed at the next document.
SEGMENT = 1 << 19
#: Distinct words that each half of a worker's memory of ids holds.
REMEMBERED = 500_000
#: Characters whose words are told apart at once.
SLICE = 1_500_000
#: Latin letters in composed form, alike in all versions of Unicode and with one letter as lower case, then ASCII marks but the apostrophe.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_M = re.escape(_MARKS)
_SIMPLE = re.compile(f"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u024f]+[{_M}]*")
_BEFORE_MARKS = re.compile(f"(?<=[^ {_M}])(?=[{_M}])")
#: Words on which the direct way must agree with the whole tokenizer.
_TRIAL = ["A", "the", "end.", "so...", "what?!", "junk%%%", "a_-", "x<>", "Straße", "ÉTÉ", "niño", "œuvre", "Internationalization", "zzxqj", "Ÿ"]

SEGMENTS = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("offsets", T.BinaryType()),
        T.StructField("codes", T.BinaryType()),
    ]
)
ROWS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)

#: Texts with these are encoded whole: spaces and separators on which engines differ, and special tokens' brackets.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|")


def _is_odd(text: str) -> bool:
    if text.isascii():
        return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _ODD.search(text) is not None


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and never merges across it.

    Each distinct word is encoded once and remembered, many words a call; a text's
    ids are its words' ids in order. New words that are Latin letters with end
    marks go to the tokenizer's own merge model directly, without the general
    normalizer, where a trial at loading shows that this gives the same ids.
    """

    def __init__(self, path: str):
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # special tokens' strings in a text are ordinary text
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ends = np.zeros(1, dtype=bool)
        suffix = getattr(self.plain.model, "end_of_word_suffix", None)
        self.letters = None
        if suffix:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            # Each word comes once, so the model's own cache would only cost time.
            self.letters = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix, cache_capacity=0))
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.plain.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            if [i for w in _TRIAL for i in np.frombuffer(self._by_letters([w])[0], "<u4")] != [i for w in _TRIAL for i in self._plainly(w)]:
                self.letters = None

    def _plainly(self, text: str) -> list[int]:
        return self.plain.encode(text, add_special_tokens=False).ids

    def _by_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters and end marks: letters, and marks, end with a token that has the end mark."""
        text = _BEFORE_MARKS.sub(" ", " ".join(words).lower())
        ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids])
        last = np.cumsum([2 if w[-1] in _MARKS else 1 for w in words]) - 1
        if len(ends) != last[-1] + 1:
            return [np.array(self._plainly(w), dtype="<u4").tobytes() for w in words]
        cuts = (4 * (ends[last] + 1)).tolist()
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip([0, *cuts], cuts, strict=False)]

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of new words, in order."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        simple = [self.letters is not None and _SIMPLE.fullmatch(t) is not None for t in texts]
        direct = [t for t, s in zip(texts, simple, strict=True) if s]
        others = [t for t, s in zip(texts, simple, strict=True) if not s]
        quick, slow = [], []
        for i in range(0, len(direct), 512):
            quick += self._by_letters(direct[i : i + 512])
        for i in range(0, len(others), 4096):
            slow += [np.array(got.ids, dtype="<u4").tobytes() for got in self.plain.encode_batch_fast(others[i : i + 4096], add_special_tokens=False)]
        quick_ids, slow_ids = iter(quick), iter(slow)
        found = [next(quick_ids) if s else next(slow_ids) for s in simple]
        self.young.update(zip(words, found, strict=True))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        A slice's words are told apart by 64-bit hashes, so the memory of words is
        asked once for each distinct word of a slice.
        """
        odd = {i: np.array(self._plainly(t), dtype="<u4").tobytes() for i, t in enumerate(texts) if t and _is_odd(t)}
        usual = [None if i in odd else t for i, t in enumerate(texts)]
        out = []
        for a, b in wordhash.slices([len(t or "") for t in usual], SLICE):
            out += self._slice(usual[a:b])
        return [odd.get(i, x) for i, x in enumerate(out)]

    def _slice(self, texts: list[str | None]) -> list[bytes]:
        words = wordhash.Words(texts)
        place, distinct = pd.factorize(words.hash)
        first = np.empty(len(distinct), dtype=np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        raw = words.raw
        wanted = [raw[x:y] for x, y in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
        if len(self.young) + len(wanted) > REMEMBERED:  # words still in use move on to the young half
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, wanted))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            if (ids := old.get(wanted[i])) is None:
                new.append(i)
            else:
                young[wanted[i]] = found[i] = ids
        for i, ids in zip(new, self._learn([wanted[i] for i in new]), strict=True):
            found[i] = ids
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        start = np.cumsum(size) - size
        each = size[place]
        ends = np.cumsum(each)
        ids = flat[np.repeat(start[place] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        packed, cuts = ids.tobytes(), (4 * np.concatenate([[0], ends])[words.first]).tolist()
        return [packed[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


_LOADED: dict[str, WordEncoder] = {}


def _loaded(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document and write segments in ascending id order to ``path``."""
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, before = _loaded(tokenizer_file), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        offsets, codes = [0], []

        def segment() -> pd.DataFrame:
            data = np.frombuffer(b"".join(codes), dtype="<u4")
            row = (part, before, len(data), list(ids), np.array(offsets, dtype="<u8").tobytes(), dac.encode(data))
            return pd.DataFrame([row], columns=SEGMENTS.names)

        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for first in range(0, len(texts), 2048):
                for doc_id, raw in zip(batch["doc_id"].iloc[first : first + 2048], encoder.encode(texts[first : first + 2048]), strict=True):
                    ids.append(None if pd.isna(doc_id) else int(doc_id))
                    codes.append(raw + tail)
                    offsets.append(offsets[-1] + len(codes[-1]) // 4)
                    if offsets[-1] >= SEGMENT:
                        yield segment()
                        before += offsets[-1]
                        ids, offsets, codes = [], [0], []
            wordhash.trim()
        if ids:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInPandas(run, SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Each document's place, length and checksum, read back from the files.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over
    the ids as little-endian unsigned 32-bit integers. Here every id is wanted, so a
    segment is read by one slice; ``document_ids`` reads a single document.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each range of ids: no more than the writer's shuffle partitions.
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                code, offsets = dac.Dac(row.codes), np.frombuffer(row.offsets, dtype="<u8").astype(np.int64)
                ids, cuts = memoryview(code.slice(0, len(code)).astype("<u4").tobytes()), (4 * offsets).tolist()
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if pd.isna(i) else int(i) for i in row.doc_ids], dtype="Int64"),
                        "start": offsets[:-1] + row.start,
                        "n_tokens": np.diff(offsets),
                        "ids_crc32": np.array(crcs, dtype=np.int64),
                    }
                )

    placed = segments.join(F.broadcast(starts), "part").select("doc_ids", "offsets", "codes", (F.col("base") + F.col("part_start")).alias("start"))
    return placed.mapInPandas(run, ROWS)


def token_at(segment: dict, i: int) -> int:
    """The ``i``-th id of a segment row, without decoding the others."""
    return dac.Dac(bytes(segment["codes"]))[i]


def document_ids(segment: dict, i: int) -> np.ndarray:
    """The ids of a segment row's ``i``-th document, without decoding the others."""
    offsets = np.frombuffer(bytes(segment["offsets"]), dtype="<u8")
    return dac.Dac(bytes(segment["codes"])).slice(int(offsets[i]), int(offsets[i + 1]))


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int | None = None) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file, end_id)
    return read_tokens(docs.sparkSession, path)
