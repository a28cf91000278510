"""Tokenizing, sampling, counting, classifying and cleaning against the libraries and brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_brute import edits
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tierwalk.llm import counts, decontam, ordinal, sampling, tokenfile
from tierwalk.llm.batches import Texts, Words

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def test_words_of_texts():
    texts = ["a b", "", None, " c\td ", "e", "f\u00a0g h"]
    words = Words(Texts(pa.array(texts)))
    found = [[words.texts.bytes[words.start[k] : words.stop[k]].tobytes().decode() for k in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:])]
    assert found == [["a", "b"], [], [], ["c", "d"], ["e"], ["f\u00a0g", "h"]]


def test_token_files(spark, docs, corpus, tmp_path):
    path = str(tmp_path / "ids")
    tokenfile.write(docs, path, WORD, end=2)
    tokens = tokenfile.read(spark, path)
    got = tokenfile.with_start(tokenfile.digest(tokens), tokens).orderBy("start").collect()
    library, place, want = Tokenizer.from_file(WORD), 0, []
    for key, text in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        place += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want


def test_token_files_are_read_in_part(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    tokenfile.write(docs, path, WORD, end=2)
    plan = tokenfile.read(spark, path).where("doc_id BETWEEN 20 AND 25").select("doc_id", "n")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_token_files_of_nothing(spark, no_docs, tmp_path):
    tokenfile.write(no_docs, str(tmp_path / "ids"), WORD, end=2)
    tokens = tokenfile.read(spark, str(tmp_path / "ids"))
    assert tokenfile.with_start(tokenfile.digest(tokens), tokens).collect() == []


@pytest.mark.parametrize("head", [0, 20, 10**5])
def test_token_counts(docs, corpus, head):
    got = counts.count_tokens(docs, BYTE, head=head).collect()
    library = Tokenizer.from_file(BYTE)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in corpus]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


LONG = ["漢" * 70_000, "-" * 50_000, "ab" * 30_000, "x" * 64, "x" * 65, "é" * 65, "#" + "0" * 64]


@pytest.mark.parametrize("head", [3, 10**5])
def test_long_words_go_by_their_digest(spark, head):
    rows = [(i, f"{w} and {w}") for i, w in enumerate(LONG)] + [(20 + i, LONG[1]) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    library = Tokenizer.from_file(BYTE)
    want = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(tuple, counts.count_tokens(frame, BYTE, head=head).collect())) == want
    known = counts.with_pieces(counts.vocabulary(frame, BYTE), BYTE)
    assert max(map(len, counts.frequent(known, head))) <= counts.NAME + 1


def test_long_words_are_not_remembered():
    encoder = tokenfile.Encoder(WORD)
    library = Tokenizer.from_file(WORD)
    ids, offsets = encoder.encode(Texts(pa.array(LONG)), 2)
    for text, a, b in zip(LONG, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert encoder.known and max(map(len, encoder.known)) <= tokenfile.LONGEST


NASTY = [*"aZsSt19.,!-_<>|'éÉßİıſ×÷ŉǅÿĀɏɐɿʰªµ²¡漢… K\u212b\u0308\u0331\u0307\u0338\u00a0\u0085\x1c\x00\x7fHI", "'S", "'re", "<|endoftext|>", "<|ENDOFTEXT|>", "\u2003"]


def test_parts_of_words_are_cut_as_the_library_cuts_them():
    dice, library = random.Random(4), Tokenizer.from_file(WORD)
    texts = ["".join(dice.choices(NASTY, k=dice.randrange(12))) for _ in range(6000)]
    texts += [a + b + c for a in "aA.1é" for b in NASTY for c in "aA.1é"]
    encoder = tokenfile.Encoder(WORD)
    for again in range(2):
        ids, offsets = encoder.encode(Texts(pa.array(texts)), 2)
        for text, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], (again, text)


def test_the_library_gets_parts_once_whatever_stands_beside_them():
    encoder = tokenfile.Encoder(WORD)
    encoder.encode(Texts(pa.array(["Naïve word, WORD.", None, "(word) naïve... don't 12"])), 2)
    assert set(encoder.known) == {w.encode() for w in ("naïve", "word", ",", ".", "...", "(", ")", "don't", "1", "2")}


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_only_known_ways_of_cutting_are_done_here(path):
    encoder = tokenfile.Encoder(path)
    words = ["Word,word", "x1", "don't", "naïve."]
    library = Tokenizer.from_file(path)
    ids, offsets = encoder.encode(Texts(pa.array(words)), 2)
    for text, a, b in zip(words, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert (b"Word,word" in encoder.known) == (path == BYTE)


def test_rows_of_one_key_are_dealt_by_text(spark, tmp_path):
    dice = random.Random(2)
    rows = [(5, f"{dice.randrange(10**6)} tail") for _ in range(4000)] + [(5, None), (5, ""), (4, "b"), (6, "a")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if there were much to write
    try:
        tokenfile.write(spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "ids"), WORD, end=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tokens = tokenfile.read(spark, str(tmp_path / "ids"))
    assert tokens.select("part").distinct().count() > 1
    got = [(r["doc_id"], r["n"]) for r in tokenfile.with_start(tokens, tokens).orderBy("start").collect()]
    library = Tokenizer.from_file(WORD)
    texts = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    assert got == [(i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in texts]


def test_token_counts_of_nothing(no_docs):
    assert counts.count_tokens(no_docs, BYTE).collect() == []


def test_pre_tokens_are_the_librarys():
    library = Tokenizer.from_file(BYTE)
    dice, alphabet = random.Random(2), "ab'sé1٣ \n\t\u00a0\u2003日Ⅷ\u0301.!_ԥ\U0001f600"
    for _ in range(300):
        text = "".join(dice.choice(alphabet) for _ in range(dice.randrange(40)))
        want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert counts.pre_tokens(text, BYTE) == want
        chunks = Texts(pa.array([text, "", text]))
        cut = [counts.pre_tokens(chunks.bytes[a:b].tobytes().decode(), BYTE) for a, b in zip(*counts._chunks(chunks))]
        assert [t for c in cut for t in c] == want * 2


def test_sampled_pieces_decode_to_the_text(docs, corpus):
    tokens = sampling.encode(docs, PIECE, alpha=0.3, seed=7)
    got = sampling.decode(tokens, PIECE).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(((i, t or "") for i, t in corpus), key=repr)
    again = sampling.encode(docs.repartition(5), PIECE, alpha=0.3, seed=7).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(((r["doc_id"], r["ids"]) for r in got), key=repr)
    other = sampling.encode(docs, PIECE, alpha=0.3, seed=8).collect()
    assert sorted(map(tuple, other), key=repr) != sorted(map(tuple, again), key=repr)


def test_decoding_where_it_was_drawn(docs, corpus):
    tokens = sampling.encode(docs, PIECE, alpha=0.3, seed=7, decoded="back")
    assert "MapInArrow" in (plan := tokens._jdf.queryExecution().executedPlan().toString()) and plan.count("MapInArrow") == 1
    got = tokens.collect()
    apart = {(r["doc_id"], r["text"], tuple(r["ids"])) for r in sampling.decode(sampling.encode(docs, PIECE, alpha=0.3, seed=7), PIECE).collect()}
    assert {(r["doc_id"], r["back"], tuple(r["ids"])) for r in got} == apart
    assert sorted((r["back"] for r in got)) == sorted(t or "" for _, t in corpus)


def test_no_key_is_no_text(spark):
    text = "the same words of both rows " * 20
    rows = spark.createDataFrame([(None, text), ("None", text), ("", text)], "doc_id string, text string")
    drawn = {r["doc_id"]: tuple(r["ids"]) for r in sampling.encode(rows, PIECE, alpha=0.1).collect()}
    assert len(set(drawn.values())) == 3


def test_sampling_of_much_text_stays_small():
    """Twenty megabytes in one batch, and a long text without spaces, are encoded and decoded in bounded parts."""
    import tracemalloc

    words = sampling.vocabulary(PIECE)
    dice = random.Random(1)
    body = " ".join("".join(dice.choice("abcdeéß日") for _ in range(dice.randrange(1, 9))) for _ in range(400))
    batch = pa.record_batch([pa.array([body] * 8000), pa.array(range(8000))], ["text", "doc_id"])
    assert batch.nbytes > 20 << 20
    tracemalloc.start()
    rows = 0
    for part in sampling.pieces(iter([batch]), "text", sampling.BATCH_BYTES):
        ids, offsets = sampling.encode_texts(Texts(part.column(0)), sampling.row_keys(part.column(1), 0), words, 1.0)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        for some in sampling._by_ids(pa.record_batch([lists], ["ids"]), 0):
            back = sampling.decode_lists(some.column(0), words)
            assert back.unique().to_pylist() == [body]
            rows += len(back)
        if rows > 3000:
            break
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20
    endless = "".join(dice.choice("abcdeé日x1") for _ in range(150_000))
    ids, offsets = sampling.encode_texts(Texts(pa.array([endless])), np.ones(1, np.uint64), words, 1.0)
    assert sampling.decode_lists(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), words).to_pylist() == [endless]


def test_segmentations_are_drawn_by_their_weight():
    words, alpha, n = sampling.vocabulary(PIECE), 0.4, 20_000
    lattice = sampling.Lattice(words, [" hello"], alpha)
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn, count = lattice.draw(np.zeros(n, np.int64), sampling.mix(keys))
    ends = np.cumsum(count)
    seen: dict[tuple, int] = {}
    for a, b in zip(ends - count, ends):
        seen[tuple(drawn[a:b].tolist())] = seen.get(tuple(drawn[a:b].tolist()), 0) + 1
    pieces = {r: i for i, r in enumerate(words.raw) if words.length[i]}

    def ways(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in pieces:
                yield from ((pieces[rest[:k]], *w) for w in ways(rest[k:]))

    weight = {w: float(np.exp(-alpha * words.log_rank[list(w)].sum())) for w in ways(b" hello")}
    total = sum(weight.values())
    assert set(seen) <= set(weight)
    for way, value in weight.items():
        expected = n * value / total
        assert abs(seen.get(way, 0) - expected) <= 5 * expected**0.5 + 5


def test_sampling_of_nothing(no_docs):
    assert sampling.decode(sampling.encode(no_docs, PIECE), PIECE).collect() == []


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_decontamination_is_exact(spark):
    """All pairs within the budget are found and no others, items of any length."""
    dice, letters = random.Random(4), "abcdefgh "
    benchmark = [(n, "".join(dice.choice(letters) for _ in range(size)).strip() or "a") for n, size in enumerate((9, 13, 14, 15, 16, 30, 45, 80, 120, 300))]
    benchmark += [(90, None), (None, "x" * 40), (91, ""), (92, "tiny")]
    texts = []
    for _, item in benchmark[:10]:
        for k in range(9):
            body = list(item)
            for _ in range(k):
                at = dice.randrange(len(body))
                body[at] = dice.choice(["", "#", body[at] + "#"])
            texts.append("".join(dice.choice(letters) for _ in range(60)) + " " + "".join(body).upper() + "\n" + "z" * dice.randrange(30))
    texts += [None, "", "TINY", "tiny words", benchmark[3][1] + " " + benchmark[3][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("hits", F.lit("own"))
    got = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in decontam.find(docs, items(spark, benchmark)).collect()}
    for i, text in enumerate(texts):
        normal = " ".join((text or "").lower().split()).encode()
        want = set()
        for n, item in benchmark:
            body = " ".join((item or "").split()).encode()
            if n is None or not body:
                continue
            if len(body) < decontam.Q:
                want |= {n} if body == normal else set()
            elif edits(body, normal) <= int(decontam.RATE * len(body)):
                want.add(n)
        assert got[i] == want, (i, text)


def test_one_edit_of_short_items(spark):
    found = decontam.find(spark.createDataFrame([(1, "xx abcdefghijkm yy"), (2, "abcdefgh jklmno"), (3, "xx abcdefgijkm yy")], "doc_id bigint, text string"), items(spark, [(1, "abcdefghijklm"), (2, "abcdefghijklmno")]))
    assert {r["doc_id"]: [tuple(h) for h in r["hits"]] for r in found.collect()} == {1: [(1, 1)], 2: [(1, 1), (2, 1)], 3: []}


def test_a_repeated_character_costs_no_memory():
    """A ruled line of a megabyte against an item with blanks to fill in."""
    import tracemalloc

    item = "fill in: " + "_" * 200 + " and then sign"
    block = decontam.index(np.array([7]), pa.array([item]))
    texts = decontam.normal(pa.array(["x" + "_" * 1_000_000, "-_" * 20_000, item.replace("and", "amd"), "_" * 150]))
    tracemalloc.start()
    found = decontam.search(texts, block)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert found == [(2, 7, 1)]


def test_random_runs_against_all_edits():
    """Texts and items of very few letters, where grams repeat, against edit distances."""
    dice = random.Random(9)
    for trial in range(40):
        bench = ["".join(dice.choice("aab") * dice.randrange(1, 9) for _ in range(dice.randrange(2, 14)))[: dice.randrange(9, 60)] for _ in range(4)]
        bench = [b for b in bench if len(b) >= decontam.Q]
        bodies = []
        for _ in range(6):
            body = list(dice.choice(bench))
            for _ in range(dice.randrange(6)):
                at = dice.randrange(len(body))
                body[at] = dice.choice(["", "c", body[at] * 2])
            bodies.append("a" * dice.randrange(30) + "".join(body) + "b" * dice.randrange(30))
        got = {(r, i) for r, i, _ in decontam.search(decontam.normal(pa.array(bodies)), decontam.index(np.arange(len(bench)), pa.array(bench)))}
        want = {(r, i) for r, t in enumerate(bodies) for i, b in enumerate(bench) if edits(b.encode(), t.encode()) <= int(decontam.RATE * len(b))}
        assert got == want, trial


def test_decontamination_edges(spark, docs, no_docs, monkeypatch):
    long_item = " ".join(f"token{n}" for n in range(200))
    benchmark = items(spark, [(1, long_item), (1, "another text of the same item")])
    holder = spark.createDataFrame([(1, "x " + long_item[700:1300] + " y"), (None, "Another  text\tof the SAME item"), (None, None)], "doc_id bigint, text string")
    for limit in (decontam.BLOCK_BYTES, 1000):  # in one block and in several
        monkeypatch.setattr(decontam, "BLOCK_BYTES", limit)
        assert [[h["item_id"] for h in r["hits"]] for r in decontam.find(holder, benchmark).collect()] == [[1], [1], []]
    assert decontam.find(no_docs, benchmark).collect() == []
    assert all(r["found"] == [] for r in decontam.find(docs, items(spark, []), hits="found").collect())


def test_fit_reaches_the_optimum():
    """The penalised likelihood of a cumulative-link model, written out, and its slopes by differences."""
    dice = np.random.default_rng(4)
    n, width, l2 = 400, 5, 0.02
    has = dice.random((n, width)) < 0.4
    latent = has @ np.array([2.0, -1.5, 0.7, 0.0, 0.3]) + dice.logistic(size=n)
    grade = np.digitize(latent, [-0.5, 0.4, 1.6])
    text, column = np.nonzero(has)

    def loss(values):
        weights, raw = values[:width], values[width:]
        cuts = np.concatenate([[-np.inf], [raw[0], raw[0] + np.exp(raw[1]), raw[0] + np.exp(raw[1]) + np.exp(raw[2])], [np.inf]])
        score = has @ weights
        chance = 1 / (1 + np.exp(-(cuts[grade + 1] - score))) - 1 / (1 + np.exp(-(cuts[grade] - score)))
        return -np.log(chance).mean() + l2 / 2 * (weights**2).sum()

    def slopes(f, values, step=1e-5):
        return np.array([(f(values + step * e) - f(values - step * e)) / (2 * step) for e in np.eye(len(values))])

    best = np.append(np.zeros(width), [-1.0, 0.0, 0.0])  # Newton's steps, by differences
    for _ in range(30):
        curve = np.array([slopes(lambda v, i=i: slopes(loss, v, 1e-4)[i], best, 1e-4) for i in range(len(best))])
        best = best - np.linalg.solve(curve + 1e-6 * np.eye(len(best)), slopes(loss, best))
    assert np.abs(slopes(loss, best)).max() < 1e-6
    weights, cuts = ordinal.fit_weights(text, column, grade, width, 4, steps=2000, l2=l2)
    found = np.concatenate([weights, [cuts[0]], np.log(np.diff(cuts))])
    assert np.abs(slopes(loss, found)).max() < 1e-3 and loss(found) - loss(best) < 1e-5
    assert np.abs(found - best).max() < 0.02


def test_classifier_on_held_out_ratings(spark):
    from tierwalk.llm.queries import graded, table

    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents").union(table(spark, "/root/testdata/sf0.1", "documents").where("doc_id >= 1000 AND doc_id < 4000"))
    ratings = graded(table(spark, "/root/testdata/sf0.1", "labels")).where("doc_id >= 1000 AND doc_id < 4000")
    docs = docs.where("doc_id >= 1000")
    model = ordinal.fit(docs, ratings.where("doc_id % 4 <> 0"), n_grades=3)
    assert np.all(np.diff(model.thresholds) > 0)
    held = ordinal.score(docs, model).join(ratings.where("doc_id % 4 = 0"), "doc_id").select("grade", "expected_grade", "p_ge_1", "p_ge_2").toPandas()
    assert ((held.p_ge_2 >= 0.5) == (held.grade == 2)).mean() > 0.94
    assert (held.p_ge_1 >= held.p_ge_2).all() and held.groupby("grade").expected_grade.mean().is_monotonic_increasing


def test_classifier_counts_a_repeated_id_once(spark):
    rows = [(i, f"{'good fine' if i % 3 else 'bad poor'} text number{i % 7}") for i in range(60)]
    ratings = spark.createDataFrame([(i, 2 if i % 3 else i % 2) for i in range(60)], "doc_id bigint, grade int")
    once, often = (
        ordinal.fit(spark.createDataFrame(r, "doc_id bigint, text string"), ratings, n_grades=3, z=1.0) for r in (rows, rows + rows[:1] * 300)
    )
    assert len(once.features) and np.array_equal(once.features, often.features)
    assert np.allclose(once.thresholds, often.thresholds) and np.allclose(once.weights, often.weights)


def test_classifier_edges(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, grade int")
    model = ordinal.fit(docs, none, n_grades=3)
    scored = ordinal.score(docs, model, prefix="_").collect()
    assert len(scored) == docs.count() and all(r["_p_ge_2"] == 1 for r in scored)
    odd = spark.createDataFrame([(11, 2), (11, 2), (12, None), (None, 1), (999, 1), (7, 5)], "doc_id bigint, grade int")
    assert len(ordinal.score(docs, ordinal.fit(docs, odd, n_grades=3)).collect()) == docs.count()
    assert ordinal.score(no_docs, model).collect() == []
