"""Levenshtein automata against edit distances, the windows around a word, and scores of held-out texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierwalk.llm import toxicity
from tierwalk.llm.automaton import Letters, build, intersect
from tierwalk.llm.batches import Texts

FOLDER = "/root/testdata/sf0.1"


def edits_to_beginnings(a: str, b: str) -> list[int]:
    """Edits (with swaps of neighbours) from a to every beginning of b."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1]


@pytest.mark.parametrize("k", [0, 1, 2])
def test_automata_accept_what_is_near(k):
    dice = random.Random(k)
    for _ in range(15):
        terms = sorted({"".join(dice.choice("abé") for _ in range(dice.randint(1, 7))) for _ in range(15)})
        words = ["".join(dice.choice("abéc") for _ in range(dice.randint(0, 10))) for _ in range(60)] + terms
        entries = [(i, t, i % 3 == 0) for i, t in enumerate(terms)]
        got = {(int(w), int(e)): int(c) for w, e, c in zip(*intersect(build(entries), Letters(pa.array(words), 7, k), k), strict=True)}
        want = {}
        for w, word in enumerate(words):
            for e, term, stem in entries:
                row = edits_to_beginnings(term, word)
                if (cost := min(row) if stem else row[-1]) <= k:
                    want[w, e] = cost
        assert got == want


@pytest.fixture(scope="module")
def model(spark):
    from tierwalk.llm.queries import held_out, table

    return toxicity.fit(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels").where(~held_out("doc_id")))


def test_held_out_labels(spark, model):
    from tierwalk.llm.queries import held_out, table

    held = toxicity.score(table(spark, FOLDER, "documents").select("doc_id", "text"), model).join(table(spark, FOLDER, "labels"), "doc_id").where(held_out("doc_id")).toPandas()
    toxic, rank = held.toxic == 1, held.score.rank()
    area = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert held.score.between(0, 1).all() and area > 0.95
    assert ((held.score >= 0.5) == toxic).mean() > 0.98
    assert (held.score[~toxic] >= 0.5).mean() < 0.01 and (held.score[toxic] >= 0.5).mean() > 0.9


def one(model, *texts):
    return model.scores(Texts(pa.array(texts))).tolist()


def test_misspelled_terms_are_caught(model):
    plain = "this and that is what they did in the end of it all " * 3
    clean, exact, misspelled, stretched = one(model, plain, plain + "you stupid worthless idiot", plain + "you stupdi wortless idoit", plain + "you STUUUUPID, worthlesss! idiiiiiot...")
    assert clean < 0.1 and exact > 0.5 and misspelled > 0.5 and stretched > 0.5
    assert exact > misspelled > clean


def test_quotation_is_not_abuse(model):
    plain = "what they did in the end of it all was this and that and more of it " * 3
    used, quoted, reported = one(model, plain + "stupid worthless idiot trash", plain + 'he said: "stupid worthless idiot trash", and left', plain + "the terms stupid and worthless and idiot and trash occur")
    assert used > 0.5 > quoted and used > reported > quoted
    long = plain + '" ' + "so on " * 40 + "stupid worthless idiot trash " + "so on " * 40 + '"'  # marks beyond the window
    assert one(model, long)[0] > quoted
    # The window ends with the text.
    assert model.features(Texts(pa.array(['"', "stupid", '"'])))[1, 3] == model.features(Texts(pa.array(["stupid"])))[0, 3]


def test_windows_count_words(model):
    from tierwalk.llm.batches import Words

    text = '"a b" c said d e f g h you i "j, k." l'
    words = Words(Texts(pa.array(["z \"", text, '" z'])))
    known = toxicity.Vocabulary(words)
    got = toxicity.windows(words, known, np.arange(words.first[1], words.first[2])).round(3).tolist()
    q, r, a = toxicity.QUOTED, toxicity.REPORTED, toxicity.ADDRESSED
    near_said, near_you = set(range(0, 9)), set(range(4, 14))
    want = []
    for n in range(len(text.split())):
        quoted = n in (0, 1, 11, 12)
        want.append(round((q if quoted else 1) * (r if n in near_said else 1) * (a if n in near_you and not quoted else 1), 3))
    assert got == want


def test_edges(spark, docs, no_docs):
    labels = "doc_id bigint, toxic int"
    assert toxicity.score(no_docs, toxicity.Model()).collect() == []
    none = toxicity.fit(docs, spark.createDataFrame([], labels))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    only = toxicity.fit(docs, spark.createDataFrame([(11, 1), (11, 0), (4, 1), (None, 1), (999, 0), (7, 5), (7, None)], labels))
    assert {r["score"] for r in toxicity.score(docs, only).collect()} == {1.0}
    weak = toxicity.fit(docs, spark.createDataFrame([(11, 1), (4, 0)], labels))  # nothing to learn from
    assert {r["score"] for r in toxicity.score(docs, weak).collect()} == {0.5}


def test_fit_on_odd_rows(spark):
    dice = random.Random(1)
    words = [f"word{n}" for n in range(40)]
    rows = [(n, " ".join(dice.choices(words, k=30) + (["Blarg!", "blargen", "flump"] if n % 4 == 0 else []))) for n in range(120)]
    rows += [(200, None), (201, ""), (202, "blarg flump " * 20000), (None, "blarg"), (0, rows[0][1]), (0, "another text of this id"), (203, "\t\n ")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *(F.lit("own").alias(c) for c in ("score", "toxic", "letters", "kind", "_id", "one")))
    labels = spark.createDataFrame([(n, int(n % 4 == 0)) for n in range(120)] + [(200, 0), (201, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(frame, labels)
    assert {e for e, _ in model.entries} >= {"blarg", "flump"} or ("blarg", True) in model.entries
    scored = toxicity.score(frame.repartition(4), model)
    assert scored.columns == [*(c for c in frame.columns if c != "score"), "score"]
    by_id = {r["doc_id"]: r["score"] for r in scored.where("doc_id > 0").collect()}
    assert all((by_id[n] >= 0.5) == (n % 4 == 0) for n in range(1, 120))
    assert by_id[200] < 0.5 and by_id[200] == by_id[201] == by_id[203] and by_id[202] > 0.5
    again = toxicity.fit(frame.repartition(5), labels)
    assert again.entries == model.entries and np.allclose(again.beta, model.beta)
