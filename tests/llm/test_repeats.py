"""Operators on repeated and near-repeated text against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_brute import cut_words, drop_bytes, near_duplicates

from tierwalk.llm import minhash, phrases, suffixes
from tierwalk.llm.anchors import RangeHash, blocks
from tierwalk.llm.batches import Texts
from tierwalk.llm.components import components
from tierwalk.llm.shingles import BANDS, ROWS, band_keys, shingle_sets, signatures
from tierwalk.workspace import Workspace


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, corpus, size):
    got = minhash.near_duplicates(docs, size=size).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = [(i, n, c, True if i is None else k) for i, n, c, k in near_duplicates(corpus, size, 80)]
    assert ordered(got) == ordered(want)


def test_near_duplicates_of_nothing(no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []


def test_links_lost_to_the_pivot_are_found(spark, monkeypatch):
    """A family whose members are near a chain of others, in chunks far smaller than its buckets."""
    monkeypatch.setattr(minhash, "CHUNK", 7)
    dice, rows = random.Random(5), []
    base = [f"w{n}" for n in range(120)]
    for i in range(60):
        words = list(base)
        for _ in range(dice.randrange(9)):
            words[dice.randrange(120)] = f"x{dice.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size=4).collect()
    assert ordered(got) == ordered(near_duplicates(rows, 4, 80))


def foreign_pivot(seed: int) -> tuple[list[tuple], bool]:
    """Two linked texts and one that is linked with neither but sits in all their common buckets; whether these come after a band
    that is equal in its low bytes only, and the third is in most buckets."""
    dice = random.Random(seed)
    names = [f"w{dice.randrange(10**9)}" for _ in range(120)]
    common, a, b = names[:100], names[:110], names[:100] + names[110:]
    sets = shingle_sets(Texts(pa.array([*names, " ".join(a), " ".join(b)])), 1)
    minima = signatures(sets)
    equal = (minima[-2] == minima[-1]).reshape(BANDS, ROWS)
    low = (minima[-2].astype(np.uint8) == minima[-1].astype(np.uint8)).reshape(BANDS, ROWS)
    shared = np.flatnonzero(equal.all(axis=1))
    mid = [w for n, w in enumerate(common) if (minima[n].reshape(BANDS, ROWS)[shared] == minima[-2].reshape(BANDS, ROWS)[shared]).any()]
    third = band_keys(signatures(shingle_sets(Texts(pa.array([" ".join(mid)])), 1)))[0]
    keys = band_keys(minima[-2:])
    alone = [((keys[i] == third) & (keys[0] != keys[1])).any() for i in (0, 1)]
    fits = len(shared) > 0 and low.all(axis=1)[: shared[0]].any() and all(alone) and len(mid) < 80
    return [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(mid))], fits


def test_a_band_of_equal_low_bytes_is_no_bucket(spark):
    rows, fits = foreign_pivot(2571)
    assert fits
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size=1).collect()
    assert ordered(got) == ordered(near_duplicates(rows, 1, 80))


def test_rows_of_one_id_join_their_classes(spark):
    x, y, z = (" ".join(f"{c}{n}" for n in range(60)) for c in "xyz")
    near = z.replace("z30 ", "other ")
    rows = [(1, x), (5, x), (5, y), (9, y), (9, ""), (9, None), (12, z), (13, near), (13, y), (14, ""), (14, "  "), (20, "p q r s t"), (20, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size=4).collect()
    assert ordered(got) == ordered(near_duplicates(rows, 4, 80))


def test_components(spark):
    dice = random.Random(3)
    pairs = [(dice.randrange(200), dice.randrange(200)) for _ in range(120)] + [(n, n + 1) for n in range(300, 330)] + [(400, n) for n in range(401, 450)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(links, Workspace(spark, "test"), "c").collect()}
    parent = {n: n for pair in pairs for n in pair}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert got == {n: top(n) for n in parent if any(n in p and p[0] != p[1] for p in pairs)}


@pytest.mark.parametrize("shard_bytes", [8 << 20, 3000])
def test_cut_repeats(docs, corpus, shard_bytes):
    out = phrases.cut_repeats(docs, window=35, shard_bytes=shard_bytes, prefix="_")
    assert out.columns[: len(docs.columns)] == docs.columns
    got = [(r["doc_id"], r["_n_words"], r["_n_removed"], " ".join(r["_kept_text"].encode().split() and r["_kept_text"].split())) for r in out.collect()]
    want = cut_words(corpus, 35)
    plain = [(i, n, m) for i, n, m, _ in want]
    assert ordered(g[:3] for g in got) == ordered(plain)
    by_id = {i: k for i, _, m, k in want if m}
    for i, _, m, kept in got:
        if m and i is not None:
            assert kept.split() == by_id[i].split()
    text = dict((r["doc_id"], (r["text"], r["_kept_text"], r["_n_removed"])) for r in out.collect())
    assert all((a or "") == b for a, b, m in text.values() if not m)


@pytest.mark.parametrize("shard_bytes, hot", [(8 << 20, 20_000), (3000, 20_000), (3000, 1)])
def test_drop_repeats(docs, corpus, shard_bytes, hot):
    out = suffixes.drop_repeats(docs, window=50, shard_bytes=shard_bytes, hot=hot, prefix="_")
    got = [(r["doc_id"], r["_n_bytes"], r["_n_removed"], r["_n_spans"], hashlib.md5(r["_kept"]).hexdigest()) for r in out.collect()]
    want = [(*w[:4], hashlib.md5(w[4]).hexdigest()) for w in drop_bytes(corpus, 50)]
    assert ordered(got) == ordered(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.text("ab", min_size=20, max_size=60)), min_size=1, max_size=8), st.integers(1, 20))
def test_suffixes_are_ordered(rows, depth):
    data, starts, docs = b"".join(t.encode() for _, t in rows), [], []
    place = 0
    for doc, text in rows:
        starts += range(place, place + len(text) - depth + 1)
        docs += [doc] * (len(text) - depth + 1)
        place += len(text)
    found, group = suffixes.order_suffixes(np.frombuffer(data, np.uint8), np.array(starts), np.array(docs), depth)
    begins = [data[s : s + depth] for s in starts]
    holders = {}
    for begin, doc in zip(begins, docs, strict=True):
        holders.setdefault(begin, set()).add(doc)
    want = sorted(begin for begin in begins if len(holders[begin]) > 1)
    assert [begins[i] for i in found.tolist()] == want and len(set(found.tolist())) == len(found)
    assert all((group[i] == group[i - 1]) == (want[i] == want[i - 1]) for i in range(1, len(want)))


def test_one_line_in_many_contexts(spark):
    """A passage that every document has, between others, as blocks of its gram and as windows dealt one by one."""
    dice, line = random.Random(9), "the same sixty bytes or more stand in all of these documents, always"
    rows = [(i, "".join(dice.choice("qwertyuiop") for _ in range(70)) + line + "".join(dice.choice("asdf") for _ in range(70))) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = ordered(drop_bytes(rows, 50))
    for hot in (10, 10**6):
        got = suffixes.drop_repeats(frame, shard_bytes=6000, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
        assert ordered((*r[:4], bytes(r[4])) for r in got) == want
    assert sum(w[2] for w in want) >= 299 * len(line)


def test_repeats_of_nothing(no_docs):
    assert phrases.cut_repeats(no_docs).collect() == []
    assert suffixes.drop_repeats(no_docs).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", max_size=60), min_size=1, max_size=6), st.integers(3, 12))
def test_windows_of_equal_tokens_share_a_gram(texts, length):
    data = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(d) for d in data]))
    values = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = blocks(values, offsets, length, max(1, length // 2))
    gram_of, covered = {}, 0
    for first, last, gram in zip(found.first.tolist(), found.last.tolist(), found.gram.tolist(), strict=True):
        for s in range(first, last + 1):
            covered += 1
            assert gram_of.setdefault(b"".join(data)[s : s + length], gram) == gram
    assert covered == sum(max(0, len(d) - length + 1) for d in data)


def test_range_hash():
    values = np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64)
    values[20:30] = values[3:13]
    ranges = RangeHash(values)
    one = ranges.of(np.array([20]), np.array([30]))
    assert one == ranges.of(np.array([3]), np.array([13])) and one == ranges.runs(10)[3]
    assert len(set(ranges.runs(10).tolist())) == 30


def test_a_shard_holds_one_slice_of_its_texts_at_a_time(monkeypatch):
    """Same cuts and probes whatever the slice, in far less memory than for the shard as a whole."""
    dice = random.Random(3)
    names = [f"word{n}" for n in range(5000)]
    shared = [dice.choices(names, k=60) for _ in range(200)]
    texts = [" ".join(dice.choices(names, k=40) + dice.choice(shared) + dice.choices(names, k=40)) for _ in range(2500)]
    docs = pa.record_batch({"doc_id": pa.array(range(2500)), "text": pa.array(texts), "shard": pa.array([7] * 2500, pa.int32())})
    words, found = phrases._blocks(Texts(docs.column("text")), 35, 8)
    windows, n = np.unique(found.hashes.runs(35), return_counts=True)
    value = np.append(found.value, windows[n > 1])
    kind = np.append(np.full(len(found.value), phrases.PROBED), np.full((n > 1).sum(), phrases.SINGLE))
    marks = pa.table({"shard": np.full(len(value), 7, np.int32), "kind": kind, "value": value.view(np.int64)})

    def run(slice_bytes):
        monkeypatch.setattr(phrases, "SLICE_BYTES", slice_bytes)
        tracemalloc.start()
        cut = phrases.cut_shard(docs, marks, 35, 8, "text", ["kept", "n_words", "n_removed"])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return cut.to_pydict(), phrases.probe_windows(pa.table(docs), marks, 35, 8).to_pydict(), peak

    whole, sliced, tiny = run(1 << 30), run(1 << 17), run(1)
    assert whole[:2] == sliced[:2] == tiny[:2]
    assert sum(whole[0]["n_removed"]) > 2000 * 60
    assert 3 * sliced[2] < whole[2]
