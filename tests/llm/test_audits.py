"""Filter interactions and source divergence against brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
from llm_brute import WORDS
from pyspark.sql import functions as F

from tierwalk.llm import divergence, interactions

ROWS = "doc_id bigint, text string, lang string, source string"


def brute_audit(rows, labels):
    """Every order applied to every row, one after the other."""
    least, good, toxic = {}, set(), set()
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    parts = defaultdict(list)
    for i, t, _, part in rows:
        t = t or ""
        words = WORDS.findall(t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and least.get(t, i) < i,
        }
        parts[part or ""].append(({f for f, v in fails.items() if v}, i in good, i in toxic))
    out, totals = [], Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in docs)
                totals[part, f] += len(gone)
                alone = sum(d[0] == {f} for d in docs)
                out.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone), f])
    return sorted((*r[:-1], totals[r[0], r[-1]]) for r in out)


def odd_rows():
    dice = random.Random(3)
    bodies = [None, "", " \t\n", "x", "LOUD", "a | b", "the " * 60, " ".join(f"w{n}" for n in range(70)), " ".join(f"W{n} $" for n in range(60)), "É" * 30 + "AB", "w w " * 50]
    rows = [(n, dice.choice(bodies), None, dice.choice(["a", "b", None, ""])) for n in range(150)]
    return rows + [(None, "x", "en", "a"), (None, None, None, None), (3, "x", "en", "a"), (3, "x", "en", "a"), (3, "x", "en", "b"), (200, "zz " * 40000, "en", "solo")]


def test_interactions(spark):
    dice = random.Random(5)
    labels = [(n, dice.choice([0, 1, None]), dice.choice([0, 1, None])) for n in range(0, 170, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(odd_rows(), ROWS).repartition(3)
    docs = docs.select("*", *(F.lit("own").alias(c) for c in ("part", "failed", "n", "good", "toxic", "digest", "kept", "step", "quality")))
    rated = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("own"))
    got = interactions.audit(interactions.outcomes(docs, rated)).collect()
    assert sorted(map(tuple, got)) == brute_audit(odd_rows(), labels)
    none = spark.createDataFrame([], ROWS)
    assert interactions.audit(interactions.outcomes(none, rated)).collect() == []
    unlabelled = interactions.audit(interactions.outcomes(docs, rated.where("false"))).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(unlabelled) == (0, 0, 4 * 600)


def test_potentials_give_shapley_values():
    """Against marginal contributions over all orders of any game."""
    dice = np.random.default_rng(2)
    for players in (1, 2, 3, 4):
        value = dice.integers(-50, 50, (3, 1 << players))
        value[:, 0] = 0
        potential = interactions.potentials(value, players)
        for i in range(players):
            want = sum(
                value[:, sum(1 << p for p in order[: order.index(i) + 1])] - value[:, sum(1 << p for p in order[: order.index(i)])]
                for order in itertools.permutations(range(players))
            )
            everyone = (1 << players) - 1
            assert np.array_equal(potential[:, everyone] - potential[:, everyone - (1 << i)], want)


def brute_divergence(rows, least):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words, run = [], ""
        for c in [*(text or ""), " "]:
            if c in "\x7f" or ord(c) <= 0x40 or 0x5B <= ord(c) <= 0x60 or 0x7B <= ord(c) <= 0x7F:
                words += [run] if run else []
                run = ""
            else:
                run += c.lower() if "A" <= c <= "Z" else c
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in held[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({w: counts[lang, s][w] for w in kept})

        def shares(count, kept=kept):
            total = sum(count[w] for w in kept) + 2 * len(kept)
            return {w: 1 + 10**9 * (count[w] + 2) // total for w in kept}

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        by = {s: shares(counts[lang, s]) for s in sources}
        mean = shares(whole)
        for s in sources:
            pairs = [(o, sum(apart(by[s][w], by[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, apart(by[s][w], mean[w])) for w in kept if counts[lang, s][w] and by[s][w] > mean[w]]
            for kind, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda f: (-f[1], f[0].encode()))
                out += [(lang, s, kind, item, v, n) for n, (item, v) in enumerate(found if kind == "pair" else found[:10], 1)]
    return sorted(out)


def spread_rows():
    dice = random.Random(11)
    rows = []
    for n in range(400):
        source = f"s{dice.randrange(70)}" if n % 3 else "hot"
        bag = [f"{chr(97 + dice.randrange(20))}{chr(97 + dice.randrange(8))}" for _ in range(dice.randrange(25))] + dice.choices(["naïve", "Ünï", "日本", "THE", "the"], k=3)
        rows.append((n, dice.choice(" -9_").join(bag), dice.choice(["en", "en", "de", None]), source))
    rows += [(500, None, "en", "empty"), (501, "  12 ", "xx", "alone"), (502, "", "yy", "one"), (503, None, "yy", None), (504, "rare", "zz", "a"), (505, "the " * 50000, "en", "hot")]
    return rows + rows[:2]


def test_divergence(spark, monkeypatch):
    rows = spread_rows()
    docs = spark.createDataFrame(rows, ROWS).repartition(3)
    docs = docs.select("*", *(F.lit("own").alias(c) for c in ("part", "grp", "term", "n", "total", "shard", "item", "value", "rank", "kind")))
    want = brute_divergence(rows, 10)
    for shard in (divergence.LARGEST, 100):  # in one shard and in many
        monkeypatch.setattr(divergence, "SHARD", shard)
        monkeypatch.setattr(divergence, "LARGEST", shard)
        got = divergence.audit(docs.select("*")).select("part", "grp", "kind", "item", "value", "rank").collect()
        assert sorted(map(tuple, got)) == want
    assert divergence.audit(spark.createDataFrame([], ROWS)).collect() == []


def test_quadtree(monkeypatch):
    """All pairs of bands of random sparse matrices, leaves of any size."""
    dice = np.random.default_rng(4)
    for leaf, n_rows, n_columns, share in ((2, 7, 50, 0.05), (4, 33, 9, 0.2), (32, 40, 100, 0.3), (4, 1, 1, 1), (2, 5, 30, 0)):
        monkeypatch.setattr(divergence, "LEAF", leaf)
        matrix = dice.integers(1, 100, (n_rows, n_columns)) * (dice.random((n_rows, n_columns)) < share)
        row, column = np.nonzero(matrix)
        tree = divergence.Quadtree(row, column, matrix[row, column], n_rows, n_columns)
        total = matrix.sum(axis=1) + 2 * n_columns
        p = divergence.share(matrix, total[:, None])
        for a in range(-(-n_rows // leaf)):
            for b in range(a, -(-n_rows // leaf)):
                some = p[a * leaf : (a + 1) * leaf, None, :], p[None, b * leaf : (b + 1) * leaf, :]
                assert np.array_equal(tree.distances(a, b, total), divergence.apart(*some).sum(axis=2))
    assert not tree.joint(0, 1)[1].size and tree.joint(0, 1)[0] == 30  # nothing but one analytic price


def test_shares_are_exact():
    for count, total in ((0, 3), (10**15, 3 * 10**15 + 7), (9 * 10**15 - 5, 9 * 10**15 - 3), (123456789, 987654321987)):
        assert divergence.share(np.array([count]), np.int64(total))[0] == 1 + 10**9 * (count + 2) // total
