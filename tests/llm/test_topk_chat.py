"""Search, chat formatting, and which queries are registered."""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import functions as F

from tierwalk.llm import chat, topk

VECTORS = "vec_id bigint, embedding array<double>, rank string"


def brute(rows, k):
    found = []
    for i, q in rows:
        scores = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i]
        found += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(set(found))


def test_top_k(spark, monkeypatch):
    dice = random.Random(8)
    rows = [(i, [dice.randrange(-4, 5) / 4 * (dice.random() < 0.7) for _ in range(9)]) for i in range(80)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, []), (203, [0.5]), (204, [1.0] * 12)]
    bad = [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf"), 1.0]), (None, [1.0])]
    frame = spark.createDataFrame([(i, v, "own") for i, v in rows + bad], VECTORS).repartition(4)
    vectors = topk.whole_vectors(frame, "vec_id", "embedding", 4)
    whole = [(i, [int(np.floor(4 * x)) for x in v]) for i, v in rows]
    for shard, block in ((2048, 4096), (5, 10)):
        monkeypatch.setattr(topk, "SHARD", shard)
        got = topk.top_k(vectors, vectors, "vec_id", 7, block=block).collect()
        assert sorted(map(tuple, got)) == brute(whole, 7)
    assert topk.top_k(vectors, vectors.where("false"), "vec_id").collect() == []
    assert topk.top_k(vectors.where("false"), vectors, "vec_id").collect() == []


def test_posting_lists():
    dice = np.random.default_rng(5)
    vectors = dice.integers(-3, 4, (300, 6))
    shard = topk.Shard(np.arange(300), vectors)
    for t in range(6):
        for weight, rows in ((2, np.flatnonzero(vectors[:, t] > 0)), (-1, np.flatnonzero(vectors[:, t] < 0))):
            listed = shard.postings(t, weight)
            assert sorted(listed) == rows.tolist() and (np.diff(vectors[listed, t]) >= 0).all()
    best = topk.Best(10)
    for at in (0, 150):  # the second shard meets a threshold
        topk.Shard(np.arange(at, at + 150), vectors[at : at + 150]).search(7, vectors[7], best)
    scores = [(-int(v @ vectors[7]), i) for i, v in enumerate(vectors) if i != 7]
    assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == sorted(scores)[:10]


def test_only_essential_lists_are_read():
    """A term that cannot bring anybody in is probed for the vectors of the others, and its list stays closed."""
    vectors = np.array([[100, 1], [90, 0], [0, 1], [0, 1]])
    shard, read = topk.Shard(np.arange(4), vectors), []
    lists = shard.postings
    shard.postings = lambda term, weight: read.append(term) or lists(term, weight)
    best = topk.Best(1)
    best.add(np.array([9]), np.array([9_500]))
    shard.search(8, np.array([100, 3]), best)
    assert read == [0] and best.ids.tolist() == [0] and best.scores.tolist() == [10_003]


def part(kind, text=None, ref=None, units=None):
    return {"kind": kind, "text": text, "ref": ref, "units": units}


def test_parts_of_a_chat(spark):
    rows = [
        (1, 0, "user", [part("text", "look: [IMAGE 0] "), part("image", ref="a.png", units=3), part("text", " and "), part("audio", ref="b.wav", units=10)]),
        (1, 1, "assistant", [part("text", "a\\b</s>"), part("document", ref="c.pdf", units=None), part("text", "c")]),
        (1, 2, "assistant", []),
        (2, None, None, None),
    ]
    schema = f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>, slot string"
    chats = chat.format_chats(spark.createDataFrame([(*r, "own") for r in rows], schema))
    one, two = chats.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_masked(F.col("formatted"), F.col("mask")).alias("loss")).orderBy("conv_id").collect()
    assert one["formatted"].count("</s>") == 3 and "[IMAGE 0]" in one["formatted"] and "[AUDIO 1]" in one["formatted"]
    assert [tuple(a) for a in one["attachments"]] == [(0, "image", "a.png", 770), (1, "audio", "b.wav", 252), (2, "document", "c.pdf", 1)]
    assert one["n_expanded"] == 770 + 252 + 1
    assert one["loss"] == "a\\b</s>c"
    assert [t["text"] for t in one["turns"]] == ["look: [IMAGE 0] [IMAGE 0] and [AUDIO 1]", "a\\b</s>[DOCUMENT 2]c", ""]
    assert [tuple(t) for t in two["turns"]] == [("", "")] and two["loss"] == "" and two["attachments"] == []
    assert chat.format_chats(spark.createDataFrame([], schema)).collect() == []


def test_any_text_comes_back(spark):
    dice = random.Random(6)
    texts = ["".join(dice.choice("\\bliе<[]/s>TURN 日\U0001f600\n") for _ in range(dice.randrange(30))) for _ in range(200)]
    texts += [None, "", "</s>", "[TURN user]", "\\l", "\\\\b", chat.escape.__doc__]
    rows = [(n // 5, n % 5 // 2, dice.choice(["user", "assistant", "as]s<", None]), t) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", F.array(chat.text_part(F.col("text"))))
    chats = chat.format_chats(frame).select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_masked(F.col("formatted"), F.col("mask")).alias("loss")
    )
    for r in chats.collect():
        mine = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1], x[2] is not None, x[2] or ""))
        assert sorted((t["role"], t["text"]) for t in r["turns"]) == sorted((x[2] or "", x[3] or "") for x in mine)
        assert len(r["loss"]) == sum(len(x[3] or "") for x in mine if x[2] == "assistant")


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
    assert json.dumps(sorted(names))
