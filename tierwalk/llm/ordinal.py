"""Quality classifier: cumulative-link regression on graded ratings over hashed text.

A text's features are the distinct words in it (lower case, without punctuation at the ends), their
beginnings of four to six characters, and how large a share of its words has each of a few shapes; all are
hashed to 62 bits. One weight per feature gives a score s, shared by all grades, and ordered thresholds
give P(grade >= k) = sigmoid(s - threshold[k]). Expected grade and tail probabilities follow.

Training looks at a bounded sample of the ratings (``sample`` rows, those whose id hashes lowest). Features
are screened on it by Spark: kept are those whose share of texts differs between the texts
below and from a grade by more than ``z`` standard errors, at most ``most`` of them. The ratings of
the sample on those features are few enough for the driver, where weights and thresholds are fitted.

Defined results: a null or empty text has no features and scores 0; a null id is scored like any
other; repeated rows get equal scores; ratings without a grade, or of texts that are not there, are ignored, repeated ratings
all count; a rating of an id that several rows have is one of a single text, the one that hashes lowest; without any rating every text gets the top grade; texts of any length are read whole; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.batches import Texts, Words, pieces
from tierwalk.workspace import Workspace

#: Ratings that training looks at, features it keeps, and the standard errors a feature needs.
SAMPLE, MOST, Z = 20_000, 20_000, 5.0

_SHAPES = (
    re.compile(r"[^\w\s]{2,}$"),  # a run of punctuation at the end
    re.compile(r"[^a-zß-öø-ÿ]*[A-ZÀ-ÖØ-Þ]{2,}[^a-zß-öø-ÿ]*$"),  # capitals only
    re.compile(r"\W+$"),  # punctuation only
    re.compile(r".*\d"),
    re.compile(r".*(.)\1\1"),
    re.compile(r".{25,}"),
    re.compile(r"https?:|www\."),
    re.compile(r"[<>{}\[\]=/\\@#|]"),
)
_STRIP = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»„“”¿¡"
_MASK = (1 << 62) - 1


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) & _MASK


_SHARES = np.array([[_hash(f"shape {s} {b}") for b in range(9)] for s in range(len(_SHAPES) + 2)], np.int64)


def _word_features(word: str) -> tuple[list[int], list[bool]]:
    plain = word.lower().strip(_STRIP)
    out = [_hash("w " + plain)] + [_hash(f"p{n} " + plain[:n]) for n in (4, 5, 6) if len(plain) > n] if plain else []
    return out, [bool(s.match(word)) for s in _SHAPES]


def text_features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of a batch, each once, ordered."""
    words = Words(texts)
    codes, distinct = words.coded()
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    features: list[int] = []
    ends, shapes = np.zeros(len(distinct) + 1, np.int64), np.zeros((len(distinct), len(_SHAPES)), bool)
    for i, word in enumerate(distinct.to_pylist()):
        found, shapes[i] = _word_features(word.decode())
        features += found
        ends[i + 1] = len(features)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    n_words = np.bincount(owner, minlength=len(texts))
    pairs = np.unique(owner * len(distinct) + codes)
    text, code = np.divmod(pairs, len(distinct))
    width = ends[code + 1] - ends[code]
    at = np.repeat(ends[code] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
    out_text, out_feature = [np.repeat(text, width)], [np.asarray(features, np.int64)[at]]
    again = np.zeros(len(codes), bool)  # the word before, once more
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    distinct_words = np.bincount(text, minlength=len(texts))
    counts = [np.bincount(owner, shapes[codes, s], len(texts)) for s in range(len(_SHAPES))]
    counts += [np.bincount(owner, again, len(texts)), n_words - distinct_words]
    some = np.flatnonzero(n_words)
    for s, count in enumerate(counts):
        bucket = np.ceil(8 * count[some] / n_words[some]).astype(np.int64)
        out_text.append(some)
        out_feature.append(_SHARES[s, bucket])
    text, feature = np.concatenate(out_text), np.concatenate(out_feature)
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    new = np.append(True, (text[1:] != text[:-1]) | (feature[1:] != feature[:-1]))
    return text[new], feature[new]


@dataclass(frozen=True)
class Model:
    """weights of features (ascending); P(grade >= k + 1) = sigmoid(score - thresholds[k])."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: Texts) -> np.ndarray:
        """P(grade >= k) for k from 1, a row per text."""
        text, feature = text_features(texts)
        score = np.zeros(len(texts))
        if len(self.features) and len(feature):
            at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
            known = self.features[at] == feature
            score = np.bincount(text[known], self.weights[at[known]], len(texts))
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_weights(
    text: np.ndarray, column: np.ndarray, grade: np.ndarray, n_columns: int, n_grades: int, steps: int = 300, l2: float = 2e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood, by full-batch Adam.

    The first threshold and the logarithms of the gaps between them are free, so they stay ordered.
    """
    n = len(grade)
    weights, raw = np.zeros(n_columns), np.zeros(n_grades - 1)
    share = np.cumsum(np.bincount(grade, minlength=n_grades))[:-1] / n
    start = np.log((share + 1e-3) / (1 - share + 1e-3))
    raw[0], raw[1:] = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    moments = [np.zeros((2, len(weights))), np.zeros((2, len(raw)))]
    for step in range(1, steps + 1):
        gaps = np.exp(raw[1:])
        cuts = np.append(raw[0], raw[0] + np.cumsum(gaps))
        score = np.bincount(text, weights[column], n)
        padded = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = padded[grade + 1] - score, padded[grade] - score
        high, low = _sigmoid(upper), _sigmoid(lower)
        chance = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) * np.isfinite(upper), low * (1 - low) * np.isfinite(lower)
        d_score = (d_high - d_low) / chance / n  # of the negative log-likelihood
        d_cut = np.zeros(n_grades + 1)
        np.add.at(d_cut, grade + 1, -d_high / chance / n)
        np.add.at(d_cut, grade, d_low / chance / n)
        d_cut = d_cut[1:-1]
        d_raw = np.append(d_cut.sum(), [d_cut[k:].sum() * gaps[k - 1] for k in range(1, len(cuts))])
        d_weights = np.bincount(column, d_score[text], n_columns) + l2 * weights
        for value, slope, m in ((weights, d_weights, moments[0]), (raw, d_raw, moments[1])):
            m[0] += 0.1 * (slope - m[0])
            m[1] += 0.001 * (slope**2 - m[1])
            value -= 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
    return weights, np.append(raw[0], raw[0] + np.cumsum(np.exp(raw[1:])))


def fit(
    docs: DataFrame,
    ratings: DataFrame,
    n_grades: int,
    sample: int = SAMPLE,
    most: int = MOST,
    z: float = Z,
    key: str = "doc_id",
    text: str = "text",
) -> Model:
    """Train on ratings (key, grade: 0 to n_grades - 1) of texts in docs."""
    spark = docs.sparkSession
    space = Workspace(spark, "ordinal")
    drawn = (
        ratings.select(F.col(key).alias("_id"), F.col("grade").cast("int").alias("grade"))
        .where(F.col("_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
        .orderBy(F.xxhash64("_id"), "_id", "grade")
        .limit(sample)
    )
    drawn, _ = space.save(drawn, "drawn")
    # At most ``sample`` short rows, so safe to broadcast.
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(drawn.select("_id").distinct()), "_id", "left_semi")
    # One text per id, or a repeated id would outweigh the others and outgrow the sample.
    one = F.min(F.struct(F.col("text").isNull().alias("void"), F.xxhash64("text").alias("hash"), "text"))
    texts = texts.groupBy("_id").agg(one.alias("one")).select("_id", "one.text").join(F.broadcast(drawn), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows, feature = text_features(Texts(batch.column(0)))
            offsets = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.record_batch(
                [batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature))], ["grade", "features"]
            )

    rated, n = space.save(texts.select("text", "grade").mapInArrow(run, "grade int, features array<bigint>"), "rated")
    if not n:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(n_grades - 1, -np.inf))
    sizes = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    seen = rated.select("grade", F.explode("features").alias("feature")).groupBy("feature").agg(
        *(F.count(F.when(F.col("grade") == g, 1)).alias(f"n{g}") for g in range(n_grades))
    )
    strength = []
    for cut in range(1, n_grades):
        below, above = (sum(sizes.get(g, 0) for g in side) for side in (range(cut), range(cut, n_grades)))
        if below and above:
            low = sum((F.col(f"n{g}") for g in range(cut)), F.lit(0.0))
            pooled = sum((F.col(f"n{g}") for g in range(n_grades)), F.lit(0.0)) / n
            spread = F.sqrt(pooled * (1 - pooled) * (below * above / n) + 1e-9)
            strength.append(F.abs(low - pooled * below) / spread)
    if not strength:  # one grade only: the thresholds alone say so
        return Model(np.zeros(0, np.int64), np.zeros(0), fit_weights(*(np.zeros(0, np.int64),) * 2, np.full(n, max(sizes)), 0, n_grades)[1])
    total = sum((F.col(f"n{g}") for g in range(n_grades)), F.lit(0))
    best = F.greatest(*strength) if len(strength) > 1 else strength[0]
    kept = (
        seen.where(total >= 5).select("feature", best.alias("strength")).where(F.col("strength") > z)
        .orderBy(F.desc("strength"), "feature").limit(most)
    )
    features = np.sort(kept.select("feature").toArrow().column(0).to_numpy().astype(np.int64))
    shared = spark.sparkContext.broadcast(features)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            offsets = np.searchsorted(owner[hit], np.arange(len(lists) + 1)).astype(np.int32)
            columns = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[hit].astype(np.int32)))
            yield pa.record_batch([batch.column(0), columns], ["grade", "columns"])

    rows = rated.mapInArrow(screen, "grade int, columns array<int>").toArrow().combine_chunks()
    lists = rows.column(1).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    weights, cuts = fit_weights(
        owner, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), rows.column(0).to_numpy().astype(np.int64), len(features), n_grades
    )
    return Model(features, weights, cuts)


def score(docs: DataFrame, model: Model, prefix: str = "", text: str = "text") -> DataFrame:
    """All rows and columns, with expected_grade and p_ge_1, p_ge_2 ... (names after ``prefix``; columns of these names are replaced)."""
    tails = [f"{prefix}p_ge_{k + 1}" for k in range(len(model.thresholds))]
    names = [f"{prefix}expected_grade", *tails]
    docs = docs.drop(*names)
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            out = shared.value.tails(Texts(batch.column(at)))
            for name, values in zip(names, [out.sum(axis=1), *out.T], strict=True):
                batch = batch.append_column(name, pa.array(values))
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, fields + "".join(f", `{n}` double" for n in names))
