"""Mixing: the whole query by hand, and rates in cases where targets can't be met."""

import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import mixing, queries
from tests.conftest import DATA

LABEL = "doc_id long, quality int, toxic int"


def hashed(value, seed=42):
    """Spark's xxhash64, as an unsigned number."""
    raw = value.encode() if isinstance(value, str) else value
    return xxhash.xxh64(raw, seed=seed).intdigest()


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def long_hash(x, *more):
    h = hashed(struct.pack("<q", x))
    for m in more:
        h = hashed(m, h)
    return signed(h)


def level(part, whole):
    return math.floor(math.log2(1000 * part / max(whole, 1) + 1))


def features(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if w]
    lines = [x for x in re.split(r"\s*\n\s*", text, flags=re.ASCII) if x]
    levels = {"marks": level(sum(c in "!?#*$%&|<>" for c in text), len(text)), "words": level(len(words) - len(set(words)), len(words)), "lines": level(len(lines) - len(set(lines)), len(lines))}
    named = {signed(hashed(struct.pack("<i", x), hashed(f"level of {n}"))) for n, x in levels.items()}
    return len(words), {signed(hashed(w)) for w in words} | named


def g_statistic(a, n_a, b, n_b):
    share = (a + b) / (n_a + n_b)
    term = lambda x, y: x * math.log(x / y) if x > 0 else 0.0
    return 2 * (term(a, n_a * share) + term(n_a - a, n_a * (1 - share)) + term(b, n_b * share) + term(n_b - b, n_b * (1 - share)))


def expected(texts, labels):
    """Tokens and posteriors of each document."""
    domain = {i: 2 if t == 1 else 0 if q == 1 else 1 for i, q, t in labels}
    found = {i: features(t) for i, t in texts}
    learn = [i for i in domain if long_hash(i) % 2 == 0 and i in found]
    distinct = {(domain[i], dict(texts)[i]): i for i in learn}.values()
    n = Counter(domain[i] for i in distinct)
    count = {}
    for i in distinct:
        for f in found[i][1]:
            count.setdefault(f, [0, 0, 0])[domain[i]] += 1
    telling = []
    for f, c in count.items():
        g = {k: g_statistic(c[k], n[k], c[0], n[0]) for k in (1, 2)}
        if max(g.values()) >= mixing.TELLING:
            p = {k: (c[k] + c[0]) / (n[k] + n[0]) for k in g}
            ratio = {k: round(math.log((c[k] + p[k]) / (n[k] + 1)) - math.log((c[0] + p[k]) / (n[0] + 1)), 6) if g[k] >= mixing.TELLING else 0.0 for k in g}
            telling.append((-round(max(g.values()), 6), f, ratio))
    table = {}
    for _, f, ratio in sorted(telling, key=lambda x: x[:2])[: mixing.SELECTED]:
        table.setdefault(f % mixing.SLOTS, (f, ratio))
    ratios = dict(table.values())
    bins = len(mixing.EDGES) + 1
    cell = {}
    for i, (_, fs) in found.items():
        s = [sum(ratios[f][k] for f in fs if f in ratios) for k in (1, 2)]
        cell[i] = tuple(sum(x > e for e in mixing.EDGES) for x in s)
    held = Counter((cell[i], domain[i]) for i in domain if i in found and i not in set(learn))
    total = [1 + sum(v for (_, k), v in held.items() if k == d) for d in range(3)]
    prior = [x / sum(total) for x in total]

    def margin(j, b):
        m = [sum(v for (c, k), v in held.items() if c[j] == b and k == d) for d in range(3)]
        return [(x + mixing.SMOOTH * q) / (sum(m) + mixing.SMOOTH) for x, q in zip(m, prior, strict=True)]

    out = {}
    for i, c in cell.items():
        product = [margin(0, c[0])[k] * margin(1, c[1])[k] / prior[k] for k in range(3)]
        m = [held[c, k] for k in range(3)]
        out[i] = (found[i][0], [(x + mixing.SMOOTH * q / sum(product)) / (sum(m) + mixing.SMOOTH) for x, q in zip(m, product, strict=True)])
    assert bins == 6 and ratios  # some features tell domains apart here
    return out


def test_query_by_hand(spark):
    folder = f"{DATA}/sf0.01"
    texts = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    want = expected(texts, labels)
    got = queries.op9_mixing(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        n, p = want[r["doc_id"]]
        assert r["n_tokens"] == n and [r["p_good"], r["p_poor"], r["p_toxic"]] == pytest.approx(p, rel=1e-6)
        u = long_hash(r["doc_id"], "mix") % (1 << 30) / (1 << 30)
        assert r["copies"] == math.floor(r["rate"]) + (u < r["rate"] - math.floor(r["rate"]))
    # The rates against projected gradient over all documents, run much longer.
    n, p = np.array([want[r["doc_id"]][0] for r in got]), np.array([want[r["doc_id"]][1] for r in got])
    had, x = n @ p, np.ones(len(n))
    goal = mixing.HEADROOM * had[0] * np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]) / mixing.TARGETS["good"]
    goal = np.minimum(goal, mixing.SUPPLY * had)
    for _ in range(20_000):
        x = np.clip(x - (p @ (((x * n) @ p - goal) / np.maximum(had, goal)) + mixing.RIDGE * (x - 1)) / (1 + mixing.RIDGE), 0, mixing.MOST)
    loss = lambda x: 0.5 * (((x * n) @ p - goal) ** 2 / np.maximum(had, goal)).sum() + mixing.RIDGE / 2 * (n * (x - 1) ** 2).sum()
    rate = np.array([r["rate"] for r in got])
    assert loss(rate) <= 1.05 * loss(x) and np.allclose((rate * n) @ p, (x * n) @ p, rtol=0.02)


def test_domains_come_out_as_labelled(spark):
    folder = f"{DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found, info = mixing.rated(docs.select("doc_id", "text"), labels)
    assert mixing.missed(info) == {}  # targets within 2 %
    rows = found.toPandas().merge(labels.toPandas(), on="doc_id")
    good, toxic = rows[(rows["quality"] == 1) & (rows["toxic"] == 0)], rows[rows["toxic"] == 1]
    assert good["p0"].mean() > 0.95 and toxic["p2"].mean() > 0.75
    assert (good["copies"] > 0).mean() > 0.98 and (toxic["copies"] > 0).mean() < 0.25


@pytest.mark.parametrize("rows, off", [([(10, 0.5, 0.3, 0.2)] * 7, {"good", "poor", "toxic"}), ([(10, 1.0, 0.0, 0.0), (5, 0.5, 0.5, 0.0)], {"poor", "toxic"}), ([(0, 1.0, 0.0, 0.0)], set())])
def test_targets_out_of_reach(spark, rows, off):
    """Equal posteriors, an absent domain, no tokens: rates stay finite, and what is missed is named."""
    df = spark.createDataFrame(rows, "n_tokens long, p0 double, p1 double, p2 double")
    fitted, info = mixing.fit_rates(mixing.saved(df, "rows"))
    assert all(0 <= r["rate"] < 100 for r in fitted.collect())
    assert set(mixing.missed(info)) <= off


def test_one_domain_labelled(spark):
    docs = spark.createDataFrame([(i, f"word{i} again") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], LABEL)
    got = mixing.mix(docs, labels).collect()
    assert len(got) == 30 and all(r["p_good"] > 0.8 for r in got)


def test_scarce_domain_costs_no_clean_documents(spark):
    """A domain that hardly occurs is not met by thinning the rest or by repeating a few documents."""
    rows = [(1000, 0.9999, 0.0001, 0.0)] * 50 + [(9000, 0.98, 0.02, 0.0)]
    fitted, info = mixing.fit_rates(mixing.saved(spark.createDataFrame(rows, "n_tokens long, p0 double, p1 double, p2 double"), "rows"))
    rates = [r["rate"] for r in fitted.collect()]
    assert min(rates) > 0.9 and max(rates) < 2 and "poor" in mixing.missed(info)
