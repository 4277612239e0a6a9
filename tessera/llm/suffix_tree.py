"""Language-model scores by a probabilistic suffix tree over words.

The root's distribution is the add-one share of each word. The other states are
contexts of 1 to ``DEPTH`` preceding words, learned from the training texts. A context
with ``LEAST`` training occurrences or more is a candidate, at any size of the corpus,
so the tree grows with the text. It is retained if its next-word distribution diverges
from its parent's (the state of its longest retained suffix): the mean gain in log
probability of its own observations, each left out of the counts in turn, must reach
``GAIN``. For this test the parent's probabilities are rounded to a tenth of a nat. A
state's distribution is smoothed towards its parent's with as many
pseudo-observations, of ``MASSES``, as give it the most gain. A word is scored by the
longest retained suffix of the words before it. A text ends with one end token, which
is counted and scored.

The counts are gathered by the rounds of ``batches``: words, then the next words of
candidate contexts of one word, of two, and so on. Values are counted in each batch
before they move, and a batch gets back the counts of what stands in it and the
verdicts on its contexts, so no task holds the tree. A context that holds more than a
quarter bucket's share of the corpus is dealt to several buckets by its next word;
there are at most four times as many such contexts as buckets at each depth, and the
driver adds up their gains.

Words count as equal by 64-bit hashes of their A-to-Z-lowered bytes; next words in one
context by 40 bits.

Cases: a null or blank text has the end token alone; a null id counts as training;
repeated rows are counted and scored each; words in equal numbers are told apart by
their hashes alone, so order and layout don't matter; with no training text every token
is unknown; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import wordhash
from .batches import Batch, Batches, answered, by_bucket, told

#: Training occurrences that make a context a candidate; mean gain in nats that retains it; words of the longest context.
LEAST, GAIN, DEPTH = 2, 0.02, 3
#: Pseudo-observations from the parent that a state's distribution may have.
MASSES = (1.0, 5.0, 25.0, 125.0, 625.0, 3125.0)
#: Steps of a nat in which a parent's probabilities enter the test.
NAT = 10
FOLDS, HELD = 7, 2
END = np.uint64(0xE0D0C0B0A0908070)
U = np.uint64

SCORES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed body, each with its length and type kept by the caller."""
    press = zstandard.ZstdCompressor(level=1)
    # Bytes of equal weight stand together, as high bytes of counts are mostly zero.
    parts = [press.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T)) if len(a) else b"" for a in arrays]
    return struct.pack(f"<B{2 * len(parts)}Q", len(parts), *(x for a, p in zip(arrays, parts, strict=True) for x in (len(a), len(p)))) + b"".join(parts)


def _unsqueeze(body: bytes, *kinds: str) -> list[np.ndarray]:
    n = body[0]
    head = struct.unpack_from(f"<{2 * n}Q", body, 1)
    at, out = 1 + 16 * n, []
    for kind, length, size in zip(kinds, head[0::2], head[1::2], strict=True):
        if not length:
            out.append(np.zeros(0, kind))
            continue
        raw = zstandard.ZstdDecompressor().decompress(body[at : at + size])
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, length).T).reshape(-1).view(kind))
        at += size
    return out


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the place of each one in them."""
    low = U(max(len(hashes) - 1, 1).bit_length())
    # Numbers sort faster than their order is found, so places stand in the low bits.
    order = (np.sort(hashes >> low << low | np.arange(len(hashes), dtype=U)) & ((U(1) << low) - U(1))).astype(np.int64)
    found = hashes[order]
    if (found[1:] < found[:-1]).any():  # two hashes that agree in their high bits
        order = np.argsort(hashes)
        found = hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.diff(found) != 0
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return found[new], inverse


class _Tokens:
    """A batch's tokens: ``hash``, ``start`` of each document, ``train`` a token, and its distinct words."""

    def __init__(self, batch: Batch):
        words = wordhash.Words(batch.texts, lower=True)
        self.hash = np.insert(words.hash, words.first[1:], END)
        self.start = words.first + np.arange(len(words.first))
        self.n = np.diff(self.start)
        self.held = np.array([held_out(i) for i in batch.doc_ids], dtype=bool)
        self.train = np.repeat(~self.held, self.n)
        self.keys, self.entry = _distinct(self.hash)
        self.place = np.arange(len(self.hash)) - np.repeat(self.start[:-1], self.n)

    def counts(self) -> np.ndarray:
        return np.bincount(self.entry[self.train], minlength=len(self.keys))


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, whose high bytes are mostly zero."""
    return np.diff(keys, prepend=U(0)).astype("<u8")


def _ask_words(buckets: int):
    def make(batch: Batch, answers: dict):
        t = _Tokens(batch)
        counts = t.counts().astype("<u4")
        for k, run in by_bucket(t.keys, buckets):
            yield k, _squeeze(_steps(t.keys[run]), counts[run])

    return make


def _answer_words(bodies: list[bytes]) -> tuple[list[bytes], bytes]:
    """Each word's training count in the corpus; to the driver, the bucket's tokens and distinct words."""
    split = [_unsqueeze(b, "<u8", "<u4") for b in bodies]
    every, inverse = np.unique(np.concatenate([np.cumsum(k, dtype=U) for k, _ in split]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([c for _, c in split]).astype(np.float64), minlength=len(every)).astype("<i8")
    ends = np.cumsum([len(k) for k, _ in split])
    out = [_squeeze(total[inverse[e - len(k) : e]]) for e, (k, _) in zip(ends, split, strict=True)]
    return out, struct.pack("<QQ", int(total.sum()), int((total > 0).sum()))


def _words(t: _Tokens, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """The training counts of a batch's distinct words."""
    out = np.zeros(len(t.keys), dtype=np.int64)
    for k, run in by_bucket(t.keys, buckets):
        out[run] = _unsqueeze(answers[k], "<i8")[0]
    return out


def _ordered(rank: np.ndarray, minor: np.ndarray, ranks: int, minors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of pairs of small numbers, and where in it a rank, and a pair, begins."""
    n = len(rank)
    low, place = U(max(minors - 1, 1).bit_length()), U(max(n - 1, 1).bit_length())
    high = max(ranks - 1, 1).bit_length()
    if high + int(low) > 64:
        order = np.lexsort((minor, rank))
        new_rank, new = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        new_rank[1:] = np.diff(rank[order]) != 0
        new[1:] = new_rank[1:] | (np.diff(minor[order]) != 0)
        return order, new_rank, new
    code = rank.astype(U) << low | minor.astype(U)
    if high + int(low) + int(place) > 64:
        order = np.argsort(code)
        code = code[order]
    else:  # with the place, as numbers sort faster than their order is found
        code = np.sort(code << place | np.arange(n, dtype=U))
        order = (code & ((U(1) << place) - U(1))).astype(np.int64)
        code >>= place
    new_rank, new = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    new_rank[1:] = np.diff(code >> low) != 0
    new[1:] = np.diff(code) != 0
    return order, new_rank, new


class _Pairs:
    """A batch's pairs of a candidate context and a next word.

    ``at``: their tokens; ``entry``: each one's distinct pair. Distinct pairs are
    ordered by ``group`` (the context, and its salt if it is large) and ``next``.
    """

    def __init__(self, t: _Tokens, at: np.ndarray, ids: np.ndarray, context: np.ndarray, count: np.ndarray, share: float):
        """``ids``: small numbers that tell the contexts at ``at`` apart."""
        self.at, self.count_at = at, count
        following = t.hash[at]
        # A context has as many slots as salts; hashes and their order are made once a slot.
        one = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=np.int64)
        one[ids] = np.arange(1, len(at) + 1)
        salts = np.where(one > 0, 1 + count[one - 1] / share, 0).astype(np.int64) if len(at) else one
        ends = np.cumsum(salts)
        slot, owner = (ends - salts)[ids], np.repeat(one - 1, salts)
        salt_at = salts[ids]
        large = np.flatnonzero(salt_at > 1)
        slot[large] += (following[large] % salt_at[large].astype(U)).astype(np.int64)
        salt = np.arange(len(owner)) - np.repeat(ends - salts, salts)
        group = wordhash.mix(context[owner] + salt.astype(U) * U(0xA24BAED4963EE407))
        by_group = np.argsort(group)
        rank = np.empty(len(group), dtype=np.int64)
        rank[by_group] = np.arange(len(group))
        order, new_group, new = _ordered(rank[slot], t.entry[at], len(group), len(t.keys))
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.lead = order[new]
        self.next = following[self.lead] >> U(24)
        self.group_of = np.cumsum(new_group[new]) - 1  # of each distinct pair
        first = order[new_group]
        self.groups = group[slot[first]]
        self.context, self.count, self.salted = context[first], count[first], salt_at[first] > 1
        self.train = np.bincount(self.entry[t.train[at]], minlength=len(self.next))

    def runs(self, buckets: int) -> Iterator[tuple[int, slice, slice]]:
        """Each bucket's run of groups and of pairs."""
        for k, run in by_bucket(self.groups, buckets):
            a, b = np.searchsorted(self.group_of, [run.start, run.stop])
            yield k, run, slice(int(a), int(b))

    def messages(self, buckets: int, parent: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """``parent``: the parent state's probability of each token of ``at``, the same wherever a pair stands."""
        cost = np.rint(np.minimum(-np.log(parent[self.lead]) * NAT, 255)).astype("u1")
        for k, run, pairs in self.runs(buckets):
            sizes = np.bincount(self.group_of[pairs] - run.start, minlength=run.stop - run.start)
            near, salted = self.next[pairs], self.salted[run]
            ids = [(near & U(0xFFFFFFFF)).astype("<u4"), (near >> U(32)).astype("u1")]
            large = [self.context[run][salted], self.count[run][salted].astype("<i8")]
            yield k, _squeeze(_steps(self.groups[run]), salted.astype("u1"), *large, sizes.astype("<u4"), *ids, cost[pairs], self.train[pairs].astype("<u4"))

    def answers(self, answers: dict[int, bytes], buckets: int, large: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The corpus' count of each distinct pair, and the verdict on each group's context."""
        total, kept = np.zeros(len(self.next), dtype=np.int64), np.zeros(len(self.groups), dtype=np.uint8)
        for k, run, pairs in self.runs(buckets):
            kept[run], total[pairs] = _unsqueeze(answers[k], "u1", "<i8")
        if large:
            kept[self.salted] = [large.get(int(c), 0) for c in self.context[self.salted]]
        return total, kept


def _answer_pairs(bodies: list[bytes]) -> tuple[list[bytes], bytes]:
    """Corpus counts of pairs and verdicts on contexts; to the driver, large contexts' gains.

    A verdict is 0 for a context that isn't retained, else one more than the place
    of its pseudo-observations in ``MASSES``.
    """
    split = [_unsqueeze(b, "<u8", "u1", "<u8", "<i8", "<u4", "<u4", "u1", "u1", "<u4") for b in bodies]
    own = [np.cumsum(m[0], dtype=U) for m in split]
    groups, rank = np.unique(np.concatenate(own), return_inverse=True)
    near = np.concatenate([m[5].astype(U) | m[6].astype(U) << U(32) for m in split])
    cost = np.concatenate([m[7] for m in split])
    train = np.concatenate([m[8] for m in split]).astype(np.float64)
    sizes = np.concatenate([m[4] for m in split])
    order, new_group, new = _ordered(np.repeat(rank, sizes), near, len(groups), 1 << 40)
    pair = np.empty(len(order), dtype=np.int64)
    pair[order] = np.cumsum(new) - 1
    total = np.bincount(pair, weights=train)
    parent = np.exp(cost[order[new]] / -NAT)
    of = np.cumsum(new_group[new]) - 1
    # A context's count is that of its next words; large contexts are told theirs.
    count, known = np.bincount(of, weights=total, minlength=len(groups)), {}
    for g, m in zip(own, split, strict=True):
        known.update(zip(g[m[1].astype(bool)].tolist(), zip(m[2].tolist(), m[3].tolist(), strict=True), strict=True))
    salted = np.isin(groups, np.fromiter(known, dtype=U, count=len(known)))
    count[salted] = [known[int(g)][1] for g in groups[salted]]
    seen, others = np.maximum(total - 1, 0), np.maximum(count[of] - 1, 0)
    gains = np.stack([np.bincount(of, weights=total * np.log((seen + mass * parent) / ((others + mass) * parent)), minlength=len(groups)) for mass in MASSES])
    kept = np.where(salted, 0, _verdicts(gains, count)).astype(np.uint8)
    out, head, end = [], 0, 0
    for m in split:
        heads, n = len(m[4]), int(m[4].sum())
        out.append(_squeeze(kept[rank[head : head + heads]], total[pair[end : end + n]].astype("<i8")))
        head, end = head + heads, end + n
    large = [struct.pack(_LARGE, *known[int(g)], *x) for g, x in zip(groups[salted], gains[:, salted].T, strict=True)]
    return out, b"".join(large)


_LARGE = f"<Qq{len(MASSES)}d"


def _verdicts(gains: np.ndarray, count: np.ndarray) -> np.ndarray:
    best = gains.argmax(axis=0)
    return np.where((count > 0) & (gains.max(axis=0) >= GAIN * count), best + 1, 0)


def _large(answers: DataFrame) -> dict[int, int]:
    """Verdicts on the contexts dealt to several buckets: at most four a bucket."""
    gain: dict[int, np.ndarray] = {}
    count: dict[int, int] = {}
    for body in told(answers):
        for context, n, *x in struct.iter_unpack(_LARGE, body):
            gain[context] = gain.get(context, 0.0) + np.array(x)
            count[context] = n
    return {c: int(_verdicts(x[:, None], np.array([count[c]]))[0]) for c, x in gain.items()}


class _Model:
    """What a batch knows after its answers: the probability of each token by its longest retained suffix.

    ``pairs`` are those of the next depth, whose answers aren't there yet.
    """

    def __init__(self, batch: Batch, answers: dict, buckets: int, n: int, v: int, large: list[dict[int, int]]):
        self.t = t = _Tokens(batch)
        share = max(n / (4 * buckets), 1.0)
        self.count = _words(t, answers["words"], buckets)[t.entry]
        self.root = (self.count + 1.0) / (n + v + 1.0)
        self.p, self.pairs = self.root.copy(), None
        # The training count of the words that end at each token, as many as the depth; and the hash of as many before it.
        grams, context, ids = self.count, np.zeros(len(t.hash), dtype=U), t.entry
        for depth in range(1, len(large) + 2):
            before = np.roll(t.hash, depth)
            context += before if depth == 1 else wordhash.mix(before ^ U(0x2545F4914F6CDD1D * depth % 2**64))
            at = np.flatnonzero(t.place >= depth)
            at = at[grams[at - 1] >= LEAST]
            self.pairs = _Pairs(t, at, ids[at - 1], context[at], grams[at - 1], share)
            if depth <= len(large):
                grams = self._learn(self.pairs, answers[f"depth{depth}"], buckets, large[depth - 1])
                ids = np.zeros(len(t.hash), dtype=np.int64)
                ids[at] = self.pairs.entry
            if depth == DEPTH:
                break

    def _learn(self, q: _Pairs, answers: dict[int, bytes], buckets: int, large: dict[int, int]) -> np.ndarray:
        total, kept = q.answers(answers, buckets, large)
        mine, verdict = total[q.entry], kept[q.group_of][q.entry]
        grams = np.zeros(len(self.p), dtype=np.int64)
        grams[q.at] = mine
        mass = np.array([np.inf, *MASSES])[verdict]
        at, mass, mine, n = q.at[verdict > 0], mass[verdict > 0], mine[verdict > 0], q.count_at[verdict > 0]
        self.p[at] = (mine + mass * self.p[at]) / (n + mass)
        return grams


def _ask_pairs(buckets: int, n: int, v: int, large: list[dict[int, int]]):
    def make(batch: Batch, answers: dict):
        m = _Model(batch, answers, buckets, n, v, large)
        if len(m.pairs.at):
            yield from m.pairs.messages(buckets, m.p[m.pairs.at])

    return make


def _score(buckets: int, n: int, v: int, large: list[dict[int, int]]):
    def make(batch: Batch, answers: dict) -> pd.DataFrame:
        m = _Model(batch, answers, buckets, n, v, large)
        starts = m.t.start[:-1]
        return pd.DataFrame(
            {
                "doc_id": pd.array(batch.doc_ids, dtype="Int64"),
                "held_out": m.t.held,
                "n_tokens": m.t.n,
                "n_known": np.add.reduceat((m.count > 0).astype(np.int64), starts),
                "train_tokens": n,
                "base_score": np.add.reduceat(np.log10(m.root), starts),
                "score": np.add.reduceat(np.log10(m.p), starts),
            }
        )

    return make


def score_documents(docs: DataFrame) -> DataFrame:
    """Both scores of every document, by counts over all training documents."""
    batches = Batches(docs.select("doc_id", "text"), ordered=False)
    b = batches.buckets
    answers = {"words": answered(batches.send(_ask_words(b)), _answer_words, "words")}
    counted = [struct.unpack("<QQ", x) for x in told(answers["words"])]
    n, v = sum(x for x, _ in counted), sum(x for _, x in counted)
    large: list[dict[int, int]] = []
    for depth in range(1, DEPTH + 1):
        found = answered(batches.send(_ask_pairs(b, n, v, large), **answers), _answer_pairs, f"depth{depth}")
        large.append(_large(found))
        answers[f"depth{depth}"] = found
    return batches.result(_score(b, n, v, large), SCORES, **answers)
