"""Substring dedup: words of passages that stood earlier in the corpus are removed.

A window is ``WINDOW`` consecutive words of one document. Windows count as equal
by 96-bit hashes of their words, unchanged. A word goes if a window over it has a
sequence that also starts earlier: in a smaller id, or earlier in the document.

Rounds, over the batches and hash buckets of ``batches``:

1. Anchors. In every window the run of ``RUN`` words with the least hash is its
   anchor, so equal windows have equal anchors at the same place. Anchors are a
   fifth of the windows. Buckets tell each batch which of its anchors stand at two
   places or more; windows with other anchors cannot recur.
2. Confirmation. The remaining windows' hashes, distinct in each batch, go to
   buckets, which tell each batch which of them recur in the corpus, and which an
   earlier batch holds. The confirmed windows are the batch's shard of the phrase
   dictionary: each is entered by its anchor, as a phrase of ``RUN`` words, and by its
   hash.
3. Location. The shard's phrases are compiled into one Aho-Corasick automaton over
   word numbers, and all documents of the batch are streamed through it. Around every
   occurrence of a phrase the windows that could have it as their anchor are looked
   up in the shard. What is found so are the occurrences; nothing else is removed.
   One that no earlier batch holds is kept at the first place it is found at.

So each automaton is bounded by its batch, and every document meets all phrases it
can hold, at any size of the corpus.

Cases: a null text has no words, like an empty one, and stays null; fewer than ``WINDOW`` words
have no window; of repeated rows, or rows with one id, the first in order of text
counts as earlier; a null id comes first; an empty table gives an empty result;
other columns are ignored, or carried along by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import struct

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .batches import CARRIED, Batch, Batches, answered, bits, by_bucket, gather, unbits

WINDOW = 20
RUN = 10

DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rest", T.StringType())])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive values, the leftmost of equals."""
    n = len(values) - width + 1
    v, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left = v[:-step] <= v[step:]
        v, at = np.where(left, v[:-step], v[step:]), np.where(left, at[:-step], at[step:])
        have += step
    return at[:n]


class _Anchored:
    """A batch's words with the anchors of its windows.

    ``starts``: first words of the windows; ``anchor``: each window's entry in
    ``keys``, the sorted distinct anchor hashes; ``twice``: which of them have two
    places or more in this batch; ``places``: the first word of each window's anchor.
    """

    def __init__(self, batch: Batch):
        self.words = wordhash.Words(batch.texts)
        h, first = self.words.hash, self.words.first
        self.starts = np.flatnonzero(wordhash.within(first, WINDOW, len(h)))
        if not len(self.starts):
            self.keys, self.twice, self.anchor = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
            self.places = self.anchor
            return
        runs = wordhash.windows(h, RUN)
        places = self.places = _least(runs, WINDOW - RUN + 1)[self.starts]
        new = np.diff(places, prepend=-1) != 0
        self.keys, inverse, counts = np.unique(runs[places[new]], return_inverse=True, return_counts=True)
        self.twice = counts > 1
        self.anchor = inverse[np.cumsum(new) - 1]


def _ask_anchors(buckets: int):
    def make(batch: Batch, answers: dict):
        a = _Anchored(batch)
        for k, run in by_bucket(a.keys, buckets):
            yield k, a.keys[run].astype("<u8").tobytes() + bits(a.twice[run])

    return make


def _split_anchors(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = next(n for n in range(8 * len(body) // 65, 8 * len(body) // 64 + 1) if 8 * n + (n + 7) // 8 == len(body))
    return np.frombuffer(body, "<u8", n), np.unpackbits(np.frombuffer(body, np.uint8, offset=8 * n))[:n]


def _answer_anchors(bodies: list[bytes]) -> tuple[list[bytes], bytes]:
    """Bits: the anchor has two places or more in the corpus."""
    keys, twice = zip(*(_split_anchors(b) for b in bodies), strict=True)
    every = np.concatenate(keys)
    distinct, inverse = np.unique(every, return_inverse=True)
    weight = np.bincount(inverse, weights=1.0 + np.concatenate(twice), minlength=len(distinct))
    again = weight[inverse] > 1
    ends = np.cumsum([len(k) for k in keys])
    return [bits(again[e - len(k) : e]) for e, k in zip(ends, keys, strict=True)], b""


def _window_hashes(words: wordhash.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the windows that start at ``at``."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    two = wordhash.windows(words.hashes(1), WINDOW, seed=1)[at] >> np.uint64(32)
    return wordhash.windows(words.hash, WINDOW)[at], two.astype(np.uint32)


class _Suspects(_Anchored):
    """A batch's distinct windows that may recur: sorted ``keys`` and ``tails``, which of them stand ``twice`` in the
    batch, and the place of the ``phrase`` (anchor) of each."""

    def __init__(self, batch: Batch, again: dict[int, bytes], buckets: int):
        super().__init__(batch)
        recurs = gather(by_bucket(self.keys, buckets), len(self.keys), again)
        chosen = recurs[self.anchor] if len(self.starts) else np.zeros(0, bool)
        at, places = self.starts[chosen], self.places[chosen]
        one, two = _window_hashes(self.words, at)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.keys, self.tails = one[new], two[new]
        self.twice = np.bincount(np.cumsum(new) - 1, minlength=len(self.keys)) > 1
        self.phrase = places[order[new]]


def _ask_windows(buckets: int):
    def make(batch: Batch, answers: dict):
        s = _Suspects(batch, answers["anchors"], buckets)
        for k, run in by_bucket(s.keys, buckets):
            yield k, struct.pack("<Q", run.stop - run.start) + s.keys[run].astype("<u8").tobytes() + s.tails[run].astype("<u4").tobytes() + bits(s.twice[run])

    return make


def _answer_windows(bodies: list[bytes]) -> tuple[list[bytes], bytes]:
    """Bits: the window has two places or more in the corpus; then: an earlier batch holds it. Batches come in ascending order."""
    sizes = [struct.unpack_from("<Q", b)[0] for b in bodies]
    one = np.concatenate([np.frombuffer(b, "<u8", n, 8) for b, n in zip(bodies, sizes, strict=True)])
    two = np.concatenate([np.frombuffer(b, "<u4", n, 8 + 8 * n) for b, n in zip(bodies, sizes, strict=True)])
    twice = np.concatenate([unbits(b[8 + 12 * n :], n) for b, n in zip(bodies, sizes, strict=True)])
    order = np.lexsort((two, one))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    entry = np.empty(len(order), dtype=np.int64)
    entry[order] = np.cumsum(first) - 1
    earlier = np.empty(len(order), dtype=bool)
    earlier[order] = ~first
    recurs = np.bincount(entry, weights=1.0 + twice, minlength=1)[entry] > 1
    ends = np.cumsum(sizes)
    return [bits(recurs[e - n : e]) + bits(earlier[e - n : e]) for e, n in zip(ends, sizes, strict=True)], b""


class Shard:
    """A batch's shard of the phrase dictionary: confirmed windows by hash, whether an earlier batch holds them, and their phrases."""

    def __init__(self, keys: np.ndarray, tails: np.ndarray, earlier: np.ndarray, phrases: np.ndarray):
        self.keys, self.tails, self.earlier, self.phrases = keys, tails, earlier, phrases

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The entry of each window hash, or -1."""
        out = np.full(len(one), -1, dtype=np.int64)
        at, last = np.searchsorted(self.keys, one), len(self.keys) - 1
        pending = np.flatnonzero(at <= last)
        while len(pending):  # more than once only where 64 bits agree and 32 don't
            same = self.keys[at[pending]] == one[pending]
            hit = same & (self.tails[at[pending]] == two[pending])
            out[pending[hit]] = at[pending[hit]]
            pending = pending[same & ~hit]
            at[pending] += 1
            pending = pending[at[pending] <= last]
        return out


def _as_text(words: wordhash.Words) -> str:
    """The batch's documents as one string: a character a distinct word, documents apart by U+0000."""
    number = np.unique(words.hash, return_inverse=True)[1] + 1
    number += (number >= 0xD800) * 0x800  # no surrogates
    return np.insert(number, words.first[1:-1], 0).astype("<u4").tobytes().decode("utf-32-le")


def locate(words: wordhash.Words, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Places and entries of the shard's windows in the batch, by streaming all its documents through the automaton."""
    if not len(shard.phrases):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, first = _as_text(words), words.first
    # Words and characters differ by the marks between documents.
    doc_of = lambda place: np.searchsorted(first, place, side="right") - 1
    chars = (shard.phrases + np.minimum(doc_of(shard.phrases), len(first) - 2)).tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for phrase in {text[c : c + RUN] for c in chars}:
        automaton.add_word(phrase, 1)
    automaton.make_automaton()
    ends = np.fromiter((end for end, _ in automaton.iter(text)), dtype=np.int64)
    marks = first[1:-1] + np.arange(len(first) - 2)
    places = ends - (RUN - 1) - np.searchsorted(marks, ends)
    # Windows that could have the phrase as their anchor.
    n = len(words.hash) + 2
    edge = np.bincount(np.maximum(places - (WINDOW - RUN), 0), minlength=n) - np.bincount(places + 1, minlength=n)
    near = np.cumsum(edge)[: max(len(words.hash) - WINDOW + 1, 0)] > 0
    at = np.flatnonzero(near & wordhash.within(first, WINDOW, len(words.hash)))
    entry = shard.find(*_window_hashes(words, at))
    return at[entry >= 0], entry[entry >= 0]


def shard_of(batch: Batch, answers: dict, buckets: int) -> tuple[wordhash.Words, Shard]:
    """A batch's words and its shard of the dictionary, from the buckets' answers."""
    s = _Suspects(batch, answers["anchors"], buckets)
    recurs, earlier = np.zeros(len(s.keys), dtype=bool), np.zeros(len(s.keys), dtype=bool)
    for k, run in by_bucket(s.keys, buckets):
        if k in answers["windows"]:
            n, body = run.stop - run.start, answers["windows"][k]
            recurs[run], earlier[run] = unbits(body[: (n + 7) // 8], n), unbits(body[(n + 7) // 8 :], n)
    return s.words, Shard(s.keys[recurs], s.tails[recurs], earlier[recurs], s.phrase[recurs])


def _removed(batch: Batch, answers: dict, buckets: int) -> tuple[wordhash.Words, np.ndarray]:
    """A batch's words, and which of them go: those of located windows that also start earlier."""
    words, shard = shard_of(batch, answers, buckets)
    edge = np.zeros(len(words.hash) + 1, dtype=np.int64)
    at, entry = locate(words, shard)
    if len(at):
        later = np.ones(len(at), dtype=bool)
        later[np.unique(entry, return_index=True)[1]] = False  # places ascend
        gone = at[later | shard.earlier[entry]]
        edge[gone] += 1
        np.subtract.at(edge, gone + WINDOW, 1)
    return words, np.cumsum(edge[:-1]) > 0


def _kept_bytes(words: wordhash.Words, gone: np.ndarray) -> list[bytes]:
    """Each document's remaining words, joined by one space."""
    start, end, first = words.start, words.end, words.first
    mark = np.zeros(len(words.buf) + 1, dtype=np.int8)
    mark[start[~gone]] += 1
    mark[end[~gone] + 1] -= 1  # a word and the white space after it
    buf = words.buf.copy()
    buf[end[~gone]] = 0x20
    take = np.cumsum(mark[:-1], dtype=np.int8) > 0
    out = buf[take].tobytes()
    size = np.where(gone, 0, end - start + 1)
    ends = np.concatenate([[0], np.cumsum(size)])[first].tolist()
    return [out[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _digest(buckets: int):
    def make(batch: Batch, answers: dict) -> pd.DataFrame:
        words, gone = _removed(batch, answers, buckets)
        removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
        shas = [hashlib.sha256(x).hexdigest() for x in _kept_bytes(words, gone)]
        return pd.DataFrame({"doc_id": pd.array(batch.doc_ids, dtype="Int64"), "n_words": words.counts(), "n_removed": np.diff(removed), "kept_sha256": shas})

    return make


def _texts(buckets: int):
    def make(batch: Batch, answers: dict) -> pd.DataFrame:
        words, gone = _removed(batch, answers, buckets)
        lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        texts = [None if null else old if not n else new.decode("utf-8", "surrogatepass") for null, old, new, n in zip(batch.nulls, batch.texts, _kept_bytes(words, gone), lost.tolist(), strict=True)]
        return pd.DataFrame({"doc_id": pd.array(batch.doc_ids, dtype="Int64"), "text": texts, "rest": batch.rest})

    return make


def _rounds(docs: DataFrame, rest: list[str] | None = None) -> tuple[Batches, dict[str, DataFrame]]:
    batches = Batches(docs, rest)
    anchors = answered(batches.send(_ask_anchors(batches.buckets)), _answer_anchors, "anchors")
    windows = answered(batches.send(_ask_windows(batches.buckets), anchors=anchors), _answer_windows, "windows")
    return batches, {"anchors": anchors, "windows": windows}


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    batches, answers = _rounds(docs.select("doc_id", "text"))
    return batches.result(_digest(batches.buckets), DIGEST, **answers)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from the texts; untouched texts stay as they are.

    A changed text is its remaining words joined by one space, and ``n_chars``, if
    there is such a column and a text, follows.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    batches, answers = _rounds(docs, others)
    found = batches.result(_texts(batches.buckets), KEPT, with_rest=True, **answers)
    if others:
        schema = T.StructType([docs.schema[c] for c in others])
        found = found.withColumn("_rest", F.from_json("rest", schema, CARRIED))
    columns = []
    for c in docs.columns:
        if c == "n_chars":
            columns.append(F.coalesce(F.length("text").cast(docs.schema[c].dataType), F.col("_rest")[c]).alias(c))
        else:
            columns.append(F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c))
    return found.select(columns)
