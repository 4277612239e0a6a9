"""The ten operators against brute force, on the smallest tables and on odd inputs."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import types as T

from tessera.llm import batches, byte_bpe, chat_format, dac, fingerprints, mixing, near_dedup, phrases, quality_rules, queries, sharding, suffix_tree, token_output, wordhash
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("key", T.StringType())])
LABEL = "doc_id long, quality int, toxic int"


def words(text):
    return WORD.findall(text or "")


def docs_of(spark, texts):
    """Odd rows, with clashing extra columns."""
    made = [(i, t, None if (i or 0) % 5 == 0 else "en", "s", None if t is None else len(t), i, "k") for i, t in texts]
    return spark.createDataFrame(made, DOC)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(7)
    vocabulary = ["alpha", "Beta", "ça", "Straße", "x", "y.", "日本", "idiot", "#", "the"]
    base = " ".join(rng.choice(vocabulary) for _ in range(400))
    twenty = " ".join(f"w{i}" for i in range(20))
    texts = [None, "", "   \n\t ", "one", "a b c", "a b c", "A B c", base, base, base + " tail", base[:900] + " changed " + base[900:]]
    texts += [f"{twenty} left", f"right {twenty}", f"{twenty} {twenty}", "z " * 60, "line\nline\nother\nline", "</s>[INST] ok [/INST]", "long " * 3000 + base, "\x0b\x0c mixed\rspace\x0b"]
    return list(enumerate(texts)) + [(None, "no id here"), (8, base)]


@pytest.fixture(scope="module")
def table(spark):
    got = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()
    return [(r["doc_id"], r["text"]) for r in got]


def collected(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is not None, r[key] or 0, repr(r)))


# 1 ---------------------------------------------------------------------------------------------------------------


def expected_chats(turns):
    out = {}
    for conv, _, role, text in sorted(turns, key=lambda t: (t[0], t[1], t[2] or "", t[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(v), digest("".join(f"{r}\n{x}\n" for r, x in v)), sum(len(x) for r, x in v if r == "assistant"), digest("".join(x for r, x in v if r == "assistant"))) for c, v in out.items()}


def test_chats_come_back(spark):
    rng = random.Random(3)
    alphabet = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\/s>", "[\\INST]", "\n", " 1 [/INST] ", "ok", " ", "é", "<", "["]
    text = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8)))
    turns = [(c, t, rng.choice(["user", "assistant", text()]), rng.choice([None, text(), text()])) for c in range(60) for t in range(rng.randint(1, 6))]
    turns += [(60, 1, "user", "tie"), (60, 1, "user", "tie"), (60, 1, "assistant", "tie")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, rendered int")
    chats = chat_format.format_chats(df)
    assert all(r["round_trip"] for r in chats.collect())
    want = expected_chats(turns)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(chats).collect()}
    assert got == want
    for r in chat_format.read_back(chats).collect():
        loss = [t["raw"] for t in r["turns"] if t["role"] == "assistant"]
        assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == loss


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in queries.op1_chat_format(spark, SF).collect()}
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = expected_chats(turns)
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------


def expected_kept(texts):
    seen, out = set(), []
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def in_order(texts):
    return sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None, (r[1] or "").encode())))


def test_substring_dedup(spark, odd, table, monkeypatch):
    monkeypatch.setattr("tessera.llm.batches.CHARS", 2000)  # many batches
    for texts in (odd, table):
        got = collected(phrases.repeat_digests(docs_of(spark, texts)))
        assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((repr(i), *x) for i, *x in expected_kept(in_order(texts)))
    assert phrases.repeat_digests(docs_of(spark, [])).count() == 0


def test_remove_repeats_keeps_columns(spark, odd):
    df = docs_of(spark, odd)
    out = phrases.remove_repeats(df)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    assert out.count() == len(odd)
    untouched = {r["doc_id"]: r["text"] for r in out.collect()}
    assert untouched[4] == "a b c" and untouched[2] == "   \n\t " and untouched[0] is None


def test_remove_repeats_carries_any_type(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    df = spark.sql(f"SELECT id AS doc_id, '{passage}' AS text, timestamp'2024-01-02 03:04:05.123456' AS t, timestamp_ntz'2024-01-02 03:04:05.123456' AS u, date'2024-01-02' AS d, 1.5BD AS e, X'00ff' AS b, array(1, null) AS a, CAST(null AS int) AS n, named_struct('text', 'x', 'doc_id', 1) AS s FROM range(3)")
    out = phrases.remove_repeats(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert [r.asDict() | {"text": None} for r in out.orderBy("doc_id").collect()] == [r.asDict() | {"text": None} for r in df.orderBy("doc_id").collect()]
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == [passage, "", ""]


def test_removal_comes_from_the_dictionary(spark, table, monkeypatch):
    """Without phrases in the shards nothing is removed, and only their occurrences are."""
    texts = in_order(table)
    body = "".join(t or "" for _, t in texts).encode()
    batch = batches.Batch(SimpleNamespace(batch_id=0, doc_ids=[i for i, _ in texts], lens=np.array([len((t or "").encode()) for _, t in texts], dtype="<i8").tobytes(), body=zstandard.ZstdCompressor().compress(body)))
    anchors = {k: phrases._answer_anchors([b])[0][0] for k, b in phrases._ask_anchors(2)(batch, {})}
    windows = {k: phrases._answer_windows([b])[0][0] for k, b in phrases._ask_windows(2)(batch, {"anchors": anchors})}
    answers = {"anchors": anchors, "windows": windows}
    words_, shard = phrases.shard_of(batch, answers, 2)
    at, _ = phrases.locate(words_, shard)
    listed = [w for _, t in texts for w in words(t)]
    doc = np.repeat(np.arange(len(texts)), words_.counts())
    grams = Counter(tuple(listed[i : i + 20]) for i in range(len(listed) - 19) if doc[i] == doc[i + 19])
    assert at.tolist() == [i for i in range(len(listed) - 19) if doc[i] == doc[i + 19] and grams[tuple(listed[i : i + 20])] > 1] and len(at)
    assert phrases._removed(batch, answers, 2)[1].any()
    none = {k: bytes(len(v)) for k, v in windows.items()}
    assert not phrases._removed(batch, answers | {"windows": none}, 2)[1].any()
    half = phrases.Shard(shard.keys, shard.tails, shard.earlier, shard.phrases[:0])
    assert not len(phrases.locate(words_, half)[0])


def test_window_hashes_match_words():
    texts = ["a b c d e f", None, "  ", "a b c d e f g", "é\x0bb c"]
    w = wordhash.Words(texts)
    assert w.counts().tolist() == [6, 0, 0, 7, 3]
    assert w.hash[:6].tolist() == w.hash[6:12].tolist() and len(set(w.hash.tolist())) == 8
    g = wordhash.windows(w.hash, 3)
    assert g[0] == g[6] and wordhash.within(w.first, 3, len(w.hash)).sum() == 4 + 5 + 1


# 3 ---------------------------------------------------------------------------------------------------------------


def test_dac_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 511, 512, 513, 5000):
        values = (2 ** rng.uniform(0, 31.9, n)).astype(np.uint32)
        code = dac.Dac(dac.encode(values))
        assert len(code) == n and code.slice(0, n).tolist() == values.tolist()
        for i in rng.integers(0, max(n, 1), 50 if n else 0):
            assert code[int(i)] == values[i]
        if n > 10:
            a, b = sorted(rng.integers(0, n, 2).tolist())
            assert code.slice(a, b).tolist() == values[a:b].tolist()


def test_word_encoder_equals_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, rng = token_output.WordEncoder(path), random.Random(1)
    alphabet = "aZé'sß \t\n\x0b\x85\xa0 .,!?;:1२<|endoftext|>İŸﬁ́µªºŉǅΣσς漢😀&\x1c-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a<|endoftext|>b", "l'été don't we'll", None, ""]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == encoder.plain.encode(text or "", add_special_tokens=False).ids


def test_token_files(spark, odd, table):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = token_output.WordEncoder(path).plain
    for texts in (odd, table, []):
        at, want = 0, []
        for i, t in in_order(texts):
            ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            at += len(ids)
        got = token_output.token_files(docs_of(spark, texts), path, end_id=2).collect()
        assert sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == [w[1:] for w in want]
        assert {(r["doc_id"], r["start"]) for r in got} == {w[:2] for w in want}


# 4 ---------------------------------------------------------------------------------------------------------------


def expected_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    count, covered = Counter(grams), set()
    for j, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(j, j + 5))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def binomial_cdf(k, n, p):
    term = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)
    return math.fsum(math.exp(term(j)) for j in range(k + 1))


def expected_verdicts(texts, langs, labels):
    """Verdicts by direct counting, strata taken as languages."""
    base = {i: expected_quality(t) for i, t in texts}
    signal = {}
    for i, t in texts:
        n, chars, symbols, dup, repeats, _ = base[i]
        lines = len([x for x in (t or "").split("\n") if words(x)])
        signal[i] = {"symbols": 1000 * symbols // max(chars, 1), "dup_lines": 1000 * dup // max(lines, 1), "repeats": 1000 * repeats // max(n, 1)}
    good = {i for i, q, _ in labels if q == 1 and i in base}
    strata = {langs[i] for i in good}
    m = max(1, len(strata)) * sum(map(len, quality_rules.GRIDS.values()))
    cut = {}
    for s in strata:
        held = [i for i in good if langs[i] == s]
        for name, grid in quality_rules.GRIDS.items():
            passed = [c for c in grid if binomial_cdf(sum(signal[i][name] > c for i in held), len(held), quality_rules.RISK / len(quality_rules.GRIDS)) <= quality_rules.DELTA / m]
            if passed:
                cut[s, name] = min(passed)
    return {i: (*base[i], not base[i][5] and not any(signal[i][n] > cut.get((langs[i], n), 10**9) for n in quality_rules.GRIDS)) for i, _ in texts}


def test_quality_rules(spark, odd, table):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    # Every clean row is a label many times over under other ids, so that cutoffs get certified.
    many = [(i + 1000 * k, t) for i, t in table for k in range(16)]
    langs = {i + 1000 * k: "en" for i in langs for k in range(16)}
    labels = [(i, int(expected_quality(t)[2] == 0), 0) for i, t in many]
    df = spark.createDataFrame([(i, t, langs[i]) for i, t in many], "doc_id long, text string, lang string")
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_rules.quality(df, spark.createDataFrame(labels, LABEL)).collect()}
    want = expected_verdicts(many, langs, labels)
    assert got == {i: tuple(w) for i, w in want.items()}
    assert any(not w[5] and not w[6] for w in want.values())  # some cutoff was certified and used
    empty = spark.createDataFrame([], LABEL)
    got = sorted(map(repr, (tuple(r) for r in quality_rules.quality(docs_of(spark, odd), empty).collect())))
    assert got == sorted(repr((i, *expected_quality(t), not expected_quality(t)[5])) for i, t in odd)
    kept = quality_rules.filter_documents(docs_of(spark, odd), empty)
    assert kept.columns == DOC.names and kept.count() == sum(not expected_quality(t)[5] for _, t in odd)
    assert quality_rules.quality(docs_of(spark, []), empty).count() == 0


def test_strata_are_languages(spark, table):
    """Each language, null included, has its own cutoffs, however many there are."""
    clean = " ".join(f"clean{i}" for i in range(12))
    noisy = " ".join(f"word{i}" for i in range(12)) + " $$$"
    rows = [(10_000 * k + i, noisy if k % 2 else clean, None if k == 1 else f"l{k}") for k in range(4) for i in range(1500)]
    rows += [(90_000 + k, noisy, None if k == 1 else f"l{k}") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows if i < 90_000], LABEL)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality(df, labels).filter("doc_id >= 90000").collect()}
    # Where clean documents have no symbols, a text with some goes; where they have them, it stays.
    assert got == {90_000: False, 90_001: True, 90_002: False, 90_003: True}


def test_binomial_tail(spark):
    df = spark.createDataFrame([(k, n) for n in (1, 5, 50, 800) for k in range(0, n + 1, max(1, n // 7))], "k long, n long")
    from pyspark.sql import functions as F

    for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.03).alias("p")).collect():
        assert r["p"] == pytest.approx(min(1.0, binomial_cdf(r["k"], r["n"], 0.03)), rel=1e-9)


# 5 ---------------------------------------------------------------------------------------------------------------


def test_byte_bpe(spark, odd, table):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        bpe = byte_bpe.ByteBpe.from_lines(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(5)
    alphabet = ["ab", " ", "  ", "\n", "\t", "'s", "1", "é", "日", " ", "\x1c", "!?", "\x85"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(60))
        assert [i for p in bpe.pieces(text, 5) for i in bpe.encoding.encode_ordinary(p)] == bpe.encoding.encode_ordinary(text)
    for texts in (odd, table):
        got = byte_bpe.encode_documents(docs_of(spark, texts), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
        want = [(i, np.asarray(bpe.encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in texts]
        assert sorted((repr(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in got.collect()) == sorted((repr(i), a, b) for i, a, b in want)
    r = queries.op5_byte_bpe(spark, SF).filter("doc_id = 3").first()
    ids = bpe.encoding.encode_ordinary(dict(table)[3])
    assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(dict(table)[3].encode()).hexdigest())


# 6 ---------------------------------------------------------------------------------------------------------------


def best_capacity(sizes, shards):
    """The minimax by dynamic programming."""
    sums = [0, *np.cumsum(sizes).tolist()]
    best = sums[:]
    for _ in range(shards - 1):
        best = [0] + [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(1, len(sums))]
    return best[-1]


def test_minimax_cuts():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 3, 10, 50]) for _ in range(rng.randint(1, 30))]
        shards = rng.randint(1, 8)
        capacity = sharding.smallest_capacity(sizes, shards)
        assert capacity == best_capacity(sizes, shards)
        edges = [0, *sharding.cuts(sizes, shards), len(sizes)]
        assert edges == sorted(edges) and max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:], strict=False)) <= capacity


def test_sharding(spark, odd, table):
    for texts in (odd, table + table):
        got = sharding.shard(docs_of(spark, texts)).collect()
        want = sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
        assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
        shard_of, slots, total = {}, {}, Counter()
        for r in got:
            assert shard_of.setdefault(r["text_crc32"], r["shard"]) == r["shard"] and 0 <= r["shard"] < 24
            slots.setdefault(r["shard"], []).append(r["slot"])
            total[r["shard"]] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t in table + table:
        groups[t] += len(t.encode()) + 8
    assert max(total.values()) <= sum(groups.values()) / 24 + max(groups.values())
    assert sharding.shard(docs_of(spark, [])).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, odd, table):
    for texts in (odd, table):
        got = collected(fingerprints.fingerprints(docs_of(spark, texts)))
        assert len(got) == len(texts)
        by_text, ordered = {}, in_order([(i, t or "") for i, t in texts])
        ids = [i for i, _ in ordered if i is not None]
        edited = {}
        for k, (i, t) in enumerate(ordered):
            cut = len(t) // 4
            edited[i] = t[: len(t) - cut] + ordered[(k + 1) % len(ordered)][1][:cut]
        for r in got:
            text = dict(texts)[r["doc_id"]] or ""
            assert r["n_chars"] == len(text) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
            if ids.count(r["doc_id"]) == 1:
                assert r["edited_sha256"] == hashlib.sha256(edited[r["doc_id"]].encode()).hexdigest()
                assert (edited[r["doc_id"]] != text) or r["near_edited"] == 1
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 0.98 * len(got)
    assert fingerprints.fingerprints(docs_of(spark, [])).count() == 0


def spark_hash(*parts):
    """Spark's xxhash64 of longs and, at the end, an int."""
    h = 42
    for x in parts:
        h = xxhash.xxh64(x, seed=h).intdigest()
    return h


def expected_entries(text):
    """Closed syncmers by a direct pass: 32 bits of each anchor's words and of the distance to the next."""
    h = [spark_hash(w.encode()) for w in words(text)]
    h = [x - 2**64 if x >= 2**63 else x for x in h]
    k, marks = fingerprints.K, [fingerprints.MARK] * (fingerprints.K - 1)
    h = [*marks, *h] if h else []
    places = [i for i in range(len(h) - k + 1) if min(h[i : i + k]) in (h[i], h[i + k - 1])]
    after = [b - a for a, b in zip(places, places[1:], strict=False)] + [0]
    return [spark_hash(*(struct.pack("<q", x) for x in h[i : i + k]), struct.pack("<i", d)) & 0xFFFFFFFF for i, d in zip(places, after, strict=False)]


def test_fingerprints_by_hand(spark, odd, table):
    like = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
    for texts in ([(i, t) for i, t in odd[:-2]], table):
        ordered = in_order([(i, t or "") for i, t in texts])
        got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs_of(spark, texts)).collect()}
        for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
            own, edited = expected_entries(t), expected_entries(t[: len(t) - len(t) // 4] + after[: len(t) // 4])
            assert got[i]["fingerprint"] == "".join(f"{x:08x}" for x in own)
            assert got[i]["edited_fingerprint"] == "".join(f"{x:08x}" for x in edited)
            assert got[i]["near_edited"] == pytest.approx(like(own, edited)) and got[i]["near_next"] == pytest.approx(like(own, expected_entries(after)))


@pytest.mark.parametrize("n", [5, 8, 16, 30, 31, 32, 100])
def test_near_copies_of_any_length(spark, n):
    """A text and its copy with a word more are alike, by one rule at every number of words."""
    rng = random.Random(3)
    texts = []
    for k in range(30):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
        texts += [(2 * k, text), (2 * k + 1, text + " more")]
    got = [r["near_next"] for r in fingerprints.fingerprints(docs_of(spark, texts)).collect() if r["doc_id"] % 2 == 0]
    assert min(got) > 0 and sorted(got)[15] >= (0.6 if n >= 30 else 0.3), n


# 8 ---------------------------------------------------------------------------------------------------------------


def expected_components(texts):
    sets = []
    for i, t in texts:
        w = words((t or "").translate(LOWER))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            smallest[find(k)] = min(smallest.get(find(k), i), i)
    return [(i, len(s), None if i is None else smallest[find(k)], i is None or smallest[find(k)] == i) for k, (i, s) in enumerate(sets)]


def test_near_dedup(spark, odd, table):
    rng = random.Random(4)
    base = words(table[3][1])[:200]
    near = []
    for k in range(60):  # a family around the threshold
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        near.append((5000 + k, " ".join(w)))
    for texts in (odd, table + near):
        got = near_dedup.near_duplicates(docs_of(spark, texts)).collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected_components(texts)))
    kept = near_dedup.keep_one(docs_of(spark, odd))
    assert kept.columns == DOC.names and kept.count() == sum(k for *_, k in expected_components(odd))
    assert near_dedup.near_duplicates(docs_of(spark, [])).count() == 0


def test_estimate_follows_similarity(spark):
    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i}" if i < 900 else f"v{i}" for i in range(1000))
    got = near_dedup.signatures([a, b])
    df = spark.createDataFrame([tuple(int(got[f"s{i}"][k]) for k in (0, 1) for i in range(near_dedup.LONGS))], [f"{p}s{i}" for p in "xy" for i in range(near_dedup.LONGS)])
    assert df.select(near_dedup.estimate("x", "y").alias("e")).first()["e"] == pytest.approx(896 / 1096, abs=0.1)


# 9 ---------------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    """With sharp posteriors the expected totals are the targets."""
    rng = np.random.default_rng(1)
    p, n = rng.dirichlet([0.02, 0.02, 0.02], 600), rng.integers(1, 500, 600)
    df = spark.createDataFrame([(int(a), *map(float, q)) for a, q in zip(n, p, strict=True)], "n_tokens long, p0 double, p1 double, p2 double")
    fitted, info = mixing.fit_rates(mixing.saved(df, "rows"), {"good": 0.7, "poor": 0.2, "toxic": 0.1}, ridge=0.001)
    found = fitted.toPandas()
    assert (found["rate"] >= 0).all()
    got = (found["rate"].to_numpy()[:, None] * found["n_tokens"].to_numpy()[:, None] * found[["p0", "p1", "p2"]].to_numpy()).sum(axis=0)
    assert np.allclose(got, info["got"], rtol=1e-6) and np.allclose(got, info["target"], rtol=0.02)


def test_rates_solve_the_problem(spark):
    """The fitted rates against projected gradient in numpy, run much longer."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 500, 400)
    df = spark.createDataFrame([(int(a), *map(float, q)) for a, q in zip(n, p, strict=True)], "n_tokens long, p0 double, p1 double, p2 double")
    fitted, info = mixing.fit_rates(mixing.saved(df, "rows"))
    had, goal, x = np.array(info["had"]), np.array(info["goal"]), np.ones(400)
    for _ in range(3000):
        x = np.clip(x - (p @ (((x * n) @ p - goal) / np.maximum(had, goal)) + mixing.RIDGE * (x - 1)) / (1 + mixing.RIDGE), 0, mixing.MOST)
    loss = lambda x, n, sums: 0.5 * ((sums - goal) ** 2 / np.maximum(had, goal)).sum() + mixing.RIDGE / 2 * (n * (x - 1) ** 2).sum()
    found = fitted.toPandas()
    assert loss(found["rate"], found["n_tokens"], np.array(info["got"])) <= 1.05 * loss(x, n, (x * n) @ p)


def test_mixture_follows_rates(spark):
    """Every document enters as often as its fitted rate says, whatever its likeliest domain is."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, labels).collect()}
    assert 0 in copies.values()
    assert Counter(r["doc_id"] for r in mixing.mix_documents(docs, labels).collect()) == Counter({i: c for i, c in copies.items() if c})


def test_mixing_odd_rows(spark, odd):
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (15, 0, 1), (3, None, None)], LABEL)
    got = mixing.mix(docs_of(spark, odd), labels).collect()
    assert len(got) == len(odd) and all(r["copies"] >= 0 and r["rate"] >= 0 for r in got)
    none = spark.createDataFrame([], LABEL)
    assert mixing.mix(docs_of(spark, odd), none).count() == len(odd)
    assert mixing.mix(docs_of(spark, []), none).count() == 0
    assert mixing.mix_documents(docs_of(spark, odd), labels).columns == DOC.names


# 10 --------------------------------------------------------------------------------------------------------------


def expected_scores(texts):
    tokens = [(i, [*words((t or "").translate(LOWER)), "\n"]) for i, t in texts]
    count = Counter(w for i, ws in tokens for w in ws if not suffix_tree.held_out(i))
    n, v = sum(count.values()), len(count)
    return [(i, suffix_tree.held_out(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens]


def test_base_scores(spark, odd, table):
    for texts in (odd, table):
        got = suffix_tree.score_documents(docs_of(spark, texts)).collect()
        assert sorted(repr((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in got) == sorted(map(repr, expected_scores(texts)))
    assert suffix_tree.score_documents(docs_of(spark, [])).count() == 0


def test_suffix_tree_learns(spark, monkeypatch):
    """Texts of a second-order chain: contexts are retained and help on held-out texts; probabilities sum to one."""
    rng = random.Random(6)
    following = {(a, b): [rng.choice("abcdefgh") for _ in range(2)] for a in "abcdefgh" for b in "abcdefgh"}
    texts = []
    for i in range(300):
        w = [rng.choice("abcdefgh"), rng.choice("abcdefgh")]
        for _ in range(150):
            w.append(rng.choice(following[w[-2], w[-1]]))
        texts.append((i, " ".join(w)))
    got = suffix_tree.score_documents(docs_of(spark, texts)).toPandas()
    held = got[got["held_out"]]
    per_token = (held["score"] - held["base_score"]).sum() / held["n_tokens"].sum()
    assert per_token > 0.4  # the chain has one bit a word, single words have three


@pytest.mark.parametrize("n", [10_000, 10**7, 10**10])
def test_candidates_at_any_size(n):
    """A context that occurs often enough is a candidate however large the corpus is."""
    train = [i for i in range(70) if not suffix_tree.held_out(i)][: suffix_tree.LEAST]
    texts = [f"often x{i}" for i in train] + ["rare y"]
    ids = [*train, next(i for i in range(100, 200) if not suffix_tree.held_out(i))]
    body = zstandard.ZstdCompressor().compress("".join(texts).encode())
    batch = batches.Batch(SimpleNamespace(batch_id=0, doc_ids=ids, lens=np.array([len(t) for t in texts], dtype="<i8").tobytes(), body=body))
    answers = {k: suffix_tree._answer_words([body])[0][0] for k, body in suffix_tree._ask_words(2)(batch, {})}
    model = suffix_tree._Model(batch, {"words": answers}, 2, n, 100, [])
    assert set(model.pairs.at.tolist()) == set((model.t.start[: len(train)] + 1).tolist())


def expected_tree_scores(texts):
    """Scores by a tree in dictionaries."""
    tokens = [(i, [*words((t or "").translate(LOWER)), None]) for i, t in texts]
    count = Counter(w for i, ws in tokens for w in ws if not suffix_tree.held_out(i))
    n, v = sum(count.values()), len(count)
    following = {}
    for i, ws in tokens:
        if not suffix_tree.held_out(i):
            for j, w in enumerate(ws):
                for d in range(1, min(j, suffix_tree.DEPTH) + 1):
                    following.setdefault(tuple(ws[j - d : j]), Counter())[w] += 1
    mass = {}

    def p(context, w):
        for d in range(len(context), 0, -1):
            c = context[len(context) - d :]
            if c in mass:
                own = following[c]
                return (own[w] + mass[c] * p(c[1:], w)) / (own.total() + mass[c])
        return (count[w] + 1) / (n + v + 1)

    for c in sorted(following, key=len):
        own = following[c]
        if own.total() < suffix_tree.LEAST:
            continue
        q = {w: math.exp(-round(min(-math.log(p(c[1:], w)) * suffix_tree.NAT, 255)) / suffix_tree.NAT) for w in own}
        gain = [math.fsum(x * math.log((x - 1 + m * q[w]) / ((own.total() - 1 + m) * q[w])) for w, x in own.items()) for m in suffix_tree.MASSES]
        if max(gain) >= suffix_tree.GAIN * own.total():
            mass[c] = suffix_tree.MASSES[gain.index(max(gain))]
    assert any(len(c) == suffix_tree.DEPTH for c in mass) and any(len(c) == 1 for c in mass)
    return sorted((repr(i), round(sum(math.log10(p(tuple(ws[max(0, j - suffix_tree.DEPTH) : j]), w)) for j, w in enumerate(ws)), 4)) for i, ws in tokens)


def test_hashes_that_agree_in_their_high_bits():
    hashes = np.array([5, 3, 5, 4, 3, 1 << 63], dtype=np.uint64)
    keys, inverse = suffix_tree._distinct(hashes)
    assert keys.tolist() == [3, 4, 5, 1 << 63] and keys[inverse].tolist() == hashes.tolist()


@pytest.mark.parametrize("minors", [4, 1 << 40, 1 << 62, 1 << 64])
def test_order_of_pairs_by_numbers_of_any_size(minors):
    rank = np.array([1, 0, 1, 3, 0, 1, 0], dtype=np.int64)
    minor = np.array([2, minors - 1, 0, 3, 1, 2, 1], dtype=np.uint64)
    order, new_rank, new = suffix_tree._ordered(rank, minor, 4, minors)
    found = list(zip(rank[order].tolist(), minor[order].tolist(), strict=True))
    assert found == sorted(zip(rank.tolist(), minor.tolist(), strict=True))
    assert new.tolist() == [i == 0 or found[i] != found[i - 1] for i in range(7)]
    assert new_rank.tolist() == [i == 0 or found[i][0] != found[i - 1][0] for i in range(7)]


def test_scores_equal_a_tree_by_hand(spark, odd, table, monkeypatch):
    """Over several layouts: one batch, many batches, other partitions, contexts dealt to several buckets."""
    for texts in (odd, table):
        want = expected_tree_scores(texts)
        for chars, parts in ((10**6, 1), (2000, 7), (300, 3)):
            monkeypatch.setattr("tessera.llm.batches.CHARS", chars)
            got = suffix_tree.score_documents(docs_of(spark, texts).repartition(parts)).collect()
            assert sorted((repr(r["doc_id"]), round(r["score"], 4)) for r in got) == [(i, pytest.approx(x, abs=2e-3)) for i, x in want]


def test_repeated_texts_are_told_apart(spark):
    """Texts that occur twice score higher than those that occur once, in the whole corpus' model."""
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(3000)]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(80))) for i in range(600) if not suffix_tree.held_out(i)]
    twins = [(1000 + i, t) for i, t in texts[:40] if not suffix_tree.held_out(1000 + i)]
    rows = suffix_tree.score_documents(docs_of(spark, texts + twins)).collect()
    twice = {i - 1000 for i, _ in twins} | {i for i, _ in twins}
    per = {r["doc_id"]: r["score"] / r["n_tokens"] for r in rows}
    assert min(x for i, x in per.items() if i in twice) > max(x for i, x in per.items() if i not in twice) + 0.3


def test_sql_matches(spark, duck):
    from tests.conftest import canonical, rows

    for name, sql in queries.oracle_sql().items():
        df, found = queries.queries()[name](spark, SF), duck(SF).sql(sql)
        columns = [d[0] for d in found.description]
        order = [columns.index(c) for c in sorted(df.columns)]
        assert rows(df) == canonical([[r[i] for i in order] for r in found.fetchall()]), name


# all -------------------------------------------------------------------------------------------------------------


def test_pipeline_columns_and_effects(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["quality rules", "near-duplicates", "repeated passages", "mixing", "byte-level BPE"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    first = mixing.saved(corpus_pipeline.STAGES[0][1](spark, docs, SF), "stage")
    verdict = {r["doc_id"]: r["kept"] for r in queries.op4_quality_rules(spark, SF).collect()}
    assert {r["doc_id"] for r in first.collect()} == {i for i, k in verdict.items() if k} and first.columns == docs.columns
    second = mixing.saved(corpus_pipeline.STAGES[1][1](spark, first, SF), "stage")
    texts = [(r["doc_id"], r["text"]) for r in first.orderBy("doc_id").collect()]
    assert {r["doc_id"] for r in second.collect()} == {i for i, _, _, k in expected_components(texts) if k}
    third = mixing.saved(corpus_pipeline.STAGES[2][1](spark, second, SF), "stage")
    texts = [(r["doc_id"], r["text"]) for r in second.orderBy("doc_id").collect()]
    shas = {r["doc_id"]: hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() for r in third.collect()}
    assert shas == {i: sha for i, _, _, sha in expected_kept(texts)}
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= third.count()
