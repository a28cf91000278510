"""Toxicity: misspelled terms of a learned lexicon, weighed by the words around them.

The lexicon is learned from labelled texts. An entry is a word, or a stem that words begin with, that occurs in a clearly
larger share of the toxic than of the other texts; of entries that begin alike only the strongest stays. The entries form tries by
how many edits their length allows, and all distinct words of a batch go down them together as Levenshtein
automata (``automaton``), so misspelled terms are found whether or not training saw them.

A word found has the weight of evidence (log-odds) of its own spelling where training saw it, drawn towards that of its entry at that
number of edits, and that towards the entry's own, less for each edit: a common word that merely resembles an entry counts for nothing.
The window of ``WINDOW`` words on both sides scales it: words inside quotation marks, and those that a reporting word stands
near, are mentioned rather than used and count less; an unquoted word near one of address counts more. A text's sum of these,
also by length, the distinct entries and the largest single weight go into a logistic regression.

Training looks at ``sample`` labels at most, those whose ids hash lowest, and at one text of each; near copies, those with the same least
hash of three words, count as one text, toxic if one of them is, or every rare word of a text copied often would look toxic. It keeps ``most`` entries at most. Counts
are made by Spark; the driver sees the entries, the spellings that several texts of the sample share, and five numbers per text of the sample.

Defined results: a null or empty text has no words; a null id is scored like any other; repeated rows get equal scores; an id with
several labels is toxic if one of them says so; labels other than 0 and 1, and of texts that are not there, are ignored; without toxic or
without other labels every score is the share of toxic ones (0 without labels); texts of any length are read whole; all columns are
kept, and those named like the results replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.automaton import Letters, Node, build, intersect
from tierwalk.llm.batches import Texts, Words, pieces
from tierwalk.llm.batches import windows as three_words
from tierwalk.workspace import Workspace

#: Labels that training looks at, entries it keeps, texts and share of the toxic texts an entry needs, and standard errors and odds it needs.
SAMPLE, MOST, SUPPORT, SHARE, Z, ODDS = 20_000, 2_000, 5, 0.01, 5.0, 3.0
#: Letters of the shortest and longest stem, and of the longest word that can be an entry.
SHORTEST, LONGEST, WORD = 3, 10, 24
#: What one edit leaves of an entry's weight, and texts that a prior weight is worth.
PER_EDIT, PRIOR = 0.6, 2.0
#: Words on each side of a word that make its window, and the factors of the window.
WINDOW, QUOTED, REPORTED, ADDRESSED = 5, 0.2, 0.5, 1.2

OPENING, CLOSING = "\"'“„«‹‘‚”", "\"'”“»›’‘"
TRIM = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»‹›„“”‘’‚¿¡…"
#: Words of the four languages that report what others say, and words that address someone.
REPORTING = frozenset(
    "say says said saying tell told call called calls write wrote written quote quoted quotes term word slur insult article"
    " sagt sagte schrieb nannte genannt zitat zitiert wort begriff"
    " dit disait écrit appelé appelle cité citation mot terme"
    " dice dijo escribió llamó llamado cita citó palabra término".split()
)
ADDRESSING = frozenset("you your you're youre u du dein dich ihr euch tu toi ton vous votre eres tú usted vosotros".split())
_RUN = re.compile(r"([a-z])\1{2,}")
_RUNS = "|".join(f"{c}{{3}}" for c in "abcdefghijklmnopqrstuvwxyz")
_OPENS, _CLOSES = f"^[{OPENING}]", f"[{CLOSING}][.,;:!?]*$"


def budget(letters: str, stem: bool) -> int:
    """Edits that an entry allows."""
    n = len(letters)
    if stem:
        return 0 if n < 6 else 1
    return 0 if n < 4 else 1 if n < 8 else 2


class Vocabulary:
    """The distinct words of a batch in plain form (lower case, without marks at the ends, runs of a letter as one), and what they are."""

    def __init__(self, words: Words):
        self.codes, distinct = words.coded()
        raw = distinct.cast(pa.string())
        self.plain = pc.utf8_trim(pc.utf8_lower(raw), TRIM)
        runs = np.flatnonzero(pc.match_substring_regex(self.plain, _RUNS).to_numpy(zero_copy_only=False))
        if len(runs):
            mask = np.zeros(len(raw), bool)
            mask[runs] = True
            short = [_RUN.sub(r"\1", w) for w in self.plain.take(pa.array(runs)).to_pylist()]
            self.plain = pc.replace_with_mask(self.plain, pa.array(mask), pa.array(short, pa.string()))
        self.opens, self.closes = (pc.match_substring_regex(raw, p).to_numpy(zero_copy_only=False) for p in (_OPENS, _CLOSES))
        self.reports, self.addresses = (
            pc.is_in(self.plain, pa.array(sorted(some))).to_numpy(zero_copy_only=False) for some in (REPORTING, ADDRESSING)
        )


def windows(words: Words, known: Vocabulary, hits: np.ndarray) -> np.ndarray:
    """The factor of the window around each of some words (places among all words of the batch)."""
    n = len(known.codes)
    place = np.arange(n)
    first = words.first[np.searchsorted(words.first, hits, side="right") - 1]
    last = words.first[np.searchsorted(words.first, hits, side="right")] - 1
    low, high = np.maximum(hits - WINDOW, first), np.minimum(hits + WINDOW, last)
    opens, closes = known.opens[known.codes], known.closes[known.codes]
    opened = np.maximum.accumulate(np.where(opens, place, -1))[hits]
    closed = np.append(-1, np.maximum.accumulate(np.where(closes, place, -1)))[hits]  # before the word
    shuts = np.minimum.accumulate(np.where(closes, place, n)[::-1])[::-1][hits]
    quoted = (opened >= low) & (opened > closed) & (shuts <= high)
    # A mark that may open or close shut the quotation before only if that was open; one word in marks does both.
    factor = np.where(quoted, QUOTED, 1.0)
    for flag, scale, only in ((known.reports, REPORTED, None), (known.addresses, ADDRESSED, ~quoted)):
        sums = np.append(0, np.cumsum(flag[known.codes]))
        near = sums[high + 1] > sums[low]
        factor *= np.where(near if only is None else near & only, scale, 1.0)
    return factor


@dataclass
class Model:
    """entries: (letters, is it a stem); by_edits and by_form: weights; the regression over standardised sums."""

    entries: list[tuple[str, bool]] = field(default_factory=list)
    by_edits: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    by_form: dict[str, float] = field(default_factory=dict)
    shift: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scale: np.ndarray = field(default_factory=lambda: np.ones(4))
    beta: np.ndarray = field(default_factory=lambda: np.zeros(5))
    share: float = 0.0
    tries: list[tuple[int, Node]] | None = None

    def matches(self, plain: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, entry, edits): the entry of least edits for each word that has one."""
        if self.tries is None:
            by_budget: dict[int, list] = {}
            for i, (letters, stem) in enumerate(self.entries):
                by_budget.setdefault(budget(letters, stem), []).append((i, letters, stem))
            self.tries = [(k, build(some)) for k, some in sorted(by_budget.items())]
        longest = max((len(e) for e, _ in self.entries), default=0)
        if not self.tries:
            return (np.zeros(0, np.int64),) * 3
        letters = Letters(plain, longest, max(k for k, _ in self.tries))
        found = [intersect(trie, letters, k) for k, trie in self.tries]
        word, entry, edits = (np.concatenate(c) for c in zip(*found, strict=True))
        weight = self.by_edits[entry, edits] if len(self.by_edits) else np.zeros(len(word))
        order = np.lexsort((entry, -weight, edits, word))
        word, entry, edits = word[order], entry[order], edits[order]
        best = np.append(True, word[1:] != word[:-1])[: len(word)]
        return word[best], entry[best], edits[best].astype(np.int64)

    def features(self, texts: Texts) -> np.ndarray:
        """A row per text: log of the sum of weights, the same per thousand words, log of distinct entries, largest weight."""
        words = Words(texts)
        out = np.zeros((len(texts), 4))
        if not len(words) or not self.entries:
            return out
        known = Vocabulary(words)
        word, entry, edits = self.matches(known.plain)
        weight, which = np.zeros(len(known.plain)), np.zeros(len(known.plain), np.int64)
        forms = known.plain.take(pa.array(word)).to_pylist()
        weight[word] = [self.by_form.get(f, self.by_edits[e, k]) for f, e, k in zip(forms, entry.tolist(), edits.tolist(), strict=True)]
        which[word] = entry
        hits = np.flatnonzero(weight[known.codes] > 0)
        if not len(hits):
            return out
        code = known.codes[hits]
        row = np.searchsorted(words.first, hits, side="right") - 1
        value = weight[code] * windows(words, known, hits)
        total = np.bincount(row, value, len(texts))
        out[:, 0] = np.log1p(total)
        out[:, 1] = np.log1p(1000 * total / np.maximum(np.diff(words.first), 50))
        pairs = np.unique(row * len(self.entries) + which[code])
        out[:, 2] = np.log1p(np.bincount(pairs // len(self.entries), minlength=len(texts)))
        np.maximum.at(out[:, 3], row, value)
        return out

    def scores(self, texts: Texts) -> np.ndarray:
        if not self.entries:
            return np.full(len(texts), self.share)
        x = (self.features(texts) - self.shift) / self.scale
        return _sigmoid(self.beta[0] + x @ self.beta[1:])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Intercept and weights that maximise the penalised likelihood (Newton); the intercept is free."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-9] + [l2] * (x.shape[1] - 1))
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        slope = x.T @ (y - p) - penalty @ beta
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, slope)
        beta += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return beta


def strongest(found: list[tuple[float, str, bool]], most: int) -> list[tuple[str, bool]]:
    """Of (strength, letters, is it a stem) those that are the strongest of all that begin alike; the longer one of equals."""
    kept: dict[str, bool] = {}
    inner: set[str] = set()  # beginnings of what is kept
    for _, letters, stem in sorted(found, key=lambda f: (-f[0], -len(f[1]), f[2], f[1])):
        begins = [letters[:n] for n in range(1, len(letters) + 1)]
        covered = any(kept.get(b, False) for b in begins) or letters in kept
        if covered or (stem and letters in inner):
            continue
        kept[letters] = stem
        inner.update(begins)
        if len(kept) == most:
            break
    return sorted(kept.items())


def _weight(toxic: float, clean: float, n_toxic: int, n_clean: int, prior: float) -> float:
    """Log-odds of toxic where something is seen, against the overall odds; PRIOR texts say what ``prior`` says."""
    odds = math.log(n_toxic / n_clean)
    share = 1 / (1 + math.exp(-(prior + odds)))
    return math.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share))) - odds


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Model:
    """Train on labels (key, label: 0 or 1) of texts in docs."""
    space = Workspace(docs.sparkSession, "toxicity")
    drawn = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("toxic"))
    drawn, _ = space.save(drawn.orderBy(F.xxhash64("_id"), "_id").limit(sample), "drawn")
    # At most ``sample`` short rows, so safe to broadcast.
    near = F.broadcast(drawn)
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(near, "_id")
    one = F.min(F.struct(F.col("text").isNull().alias("void"), F.xxhash64("text").alias("hash"), "text", "toxic"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield batch.append_column("sign", pa.array(_signatures(Texts(batch.column(0))).view(np.int64)))

    signed = texts.groupBy("_id").agg(one.alias("one")).select("one.text", "one.toxic").mapInArrow(sign, "text string, toxic int, sign bigint")
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    texts, n = space.save(signed.groupBy("sign").agg(first, F.max("toxic").alias("toxic")).select("text", "toxic"), "texts")
    n_toxic = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0))).first()[0]
    n_clean = n - n_toxic
    if not n_toxic or not n_clean:
        return Model(share=n_toxic / n if n else 0.0)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield _counted(_candidates(Texts(batch.column(0)), batch.column(1).to_numpy()))

    seen = texts.mapInArrow(candidates, _COUNTED).groupBy("letters", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    pooled = (F.col("toxic") + F.col("clean")) / n
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / n_clean) + 1e-12)
    share_toxic, share_clean = F.col("toxic") / n_toxic, (F.col("clean") + 0.5) / n_clean
    strength = ((share_toxic - F.col("clean") / n_clean) / spread).alias("strength")
    clear = seen.where((F.col("toxic") >= max(SUPPORT, SHARE * n_toxic)) & (share_toxic >= ODDS * share_clean)).select("letters", "kind", strength)
    # Stems of one word go as one, so ten times as many as are kept.
    best = clear.where(F.col("strength") >= Z).orderBy(F.desc("strength"), F.desc(F.length("letters")), "kind", "letters").limit(10 * most).collect()
    model = Model(strongest([(r.strength, r.letters, r.kind == 1) for r in best], most), share=n_toxic / n)
    if not model.entries:
        return model
    return _weighed(texts, model, n_toxic, n_clean)


def _weighed(texts: DataFrame, model: Model, n_toxic: int, n_clean: int) -> Model:
    """The model with weights of its entries and the spellings seen, and the regression on top."""
    plain = texts.sparkSession.sparkContext.broadcast(model)

    def spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield _counted(_spellings(Texts(batch.column(0)), batch.column(1).to_numpy(), plain.value))

    # kind: entry * 3 + edits
    forms = texts.mapInArrow(spellings, _COUNTED).groupBy("letters", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    pooled = forms.groupBy("kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    sums = {r.kind: (r.toxic, r.clean) for r in pooled}
    model.by_edits = np.zeros((len(model.entries), 3))
    for i in range(len(model.entries)):
        prior = 0.0
        for k in range(3):
            toxic, clean = sums.get(3 * i + k, (0, 0))
            model.by_edits[i, k] = _weight(toxic, clean, n_toxic, n_clean, prior)
            prior = PER_EDIT ** (k + 1) * max(model.by_edits[i, 0], 0.0)
    for r in forms.where(F.col("toxic") + F.col("clean") >= 3).collect():
        model.by_form[r.letters] = _weight(r.toxic, r.clean, n_toxic, n_clean, float(model.by_edits[r.kind // 3, r.kind % 3]))
    weighed = texts.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = weighed.value.features(Texts(batch.column(0)))
            yield pa.record_batch([batch.column(1), *map(pa.array, x.T)], ["toxic", "a", "b", "c", "d"])

    rows = texts.mapInArrow(measure, "toxic int, a double, b double, c double, d double").toArrow()
    x = np.column_stack([rows.column(i).to_numpy() for i in range(1, 5)])
    # Sums do not depend on the order in which the rows arrive.
    order = np.lexsort((*x.T, rows.column(0).to_numpy()))
    x, y = x[order], rows.column(0).to_numpy()[order].astype(float)
    model.shift, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.beta = fit_logistic((x - model.shift) / model.scale, y)
    return model


_COUNTED = "letters string, kind int, toxic bigint, clean bigint"


def _counted(counts: Counter) -> pa.RecordBatch:
    """From a count per (letters, kind, label)."""
    both: dict[tuple, list[int]] = {}
    for (letters, kind, toxic), n in counts.items():
        both.setdefault((letters, kind), [0, 0])[0 if toxic else 1] += n
    columns = [[k[0] for k in both], [k[1] for k in both], [v[0] for v in both.values()], [v[1] for v in both.values()]]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["letters", "kind", "toxic", "clean"])


def _held(texts: Texts) -> tuple[pa.Array, Iterator[np.ndarray]]:
    """The plain words of a batch, and for each text the numbers of those it holds."""
    words = Words(texts)
    known = Vocabulary(words)
    return known.plain, (np.unique(known.codes[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True))


def _signatures(texts: Texts) -> np.ndarray:
    """The least hash of three words in a row of each text; of fewer words, that of all."""
    words = Words(texts)
    hashed, count = words.hashed(), np.diff(words.first)
    out = np.zeros(len(texts), np.uint64)
    long = np.flatnonzero(count >= 3)
    if len(long):
        runs = np.append(three_words(hashed, 3), np.iinfo(np.uint64).max)
        bounds = np.stack([words.first[long], words.first[long + 1] - 2], axis=1).ravel()
        out[long] = np.minimum.reduceat(runs, bounds)[::2]
    for n in np.flatnonzero((count > 0) & (count < 3)):
        out[n] = np.bitwise_xor.reduce(hashed[words.first[n] : words.first[n + 1]])
    return out


def _candidates(texts: Texts, toxic: np.ndarray) -> Counter:
    """Texts per word (kind 0) and stem (kind 1), and label."""
    out: Counter = Counter()
    known, held = _held(texts)
    plain = known.to_pylist()
    for label, codes in zip(toxic.tolist(), held, strict=True):
        mine = {plain[c] for c in codes.tolist()}
        out.update((w, 0, label) for w in mine if 1 < len(w) <= WORD)
        stems = {w[:n] for w in mine for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)}
        out.update((s, 1, label) for s in stems)
    return out


def _spellings(texts: Texts, toxic: np.ndarray, model: Model) -> Counter:
    """Texts per spelling of an entry, with the entry and its edits, and label."""
    out: Counter = Counter()
    known, held = _held(texts)
    word, entry, edits = model.matches(known)
    plain = known.to_pylist()
    kind = dict(zip(word.tolist(), (3 * entry + edits).tolist(), strict=True))
    for label, codes in zip(toxic.tolist(), held, strict=True):
        out.update({(plain[c], kind[c], label) for c in codes.tolist() if c in kind})
    return out


def score(docs: DataFrame, model: Model, prefix: str = "", text: str = "text") -> DataFrame:
    """All rows and columns, with ``score``: the chance that a text is toxic (the name after ``prefix``)."""
    name = f"{prefix}score"
    docs = docs.drop(name)
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            yield batch.append_column(name, pa.array(shared.value.scores(Texts(batch.column(at)))))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{name}` double")
