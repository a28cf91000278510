"""Filter interaction audit: what each of a few filters removes, alone, in any order, and on average over all orders.

Filters remove a document when it fails them, so all that matters of a document is which filters it
fails. ``outcomes`` finds that in one pass over the texts and counts documents per part and set of failed filters.

``audit`` takes these counts. A coalition S of filters removes v(S) documents: those that fail one of S. The 2**k
values of a part give everything else. A step of an order removes v(before + filter) - v(before). The potential of the
removal game (Hart and Mas-Colell) is P(empty) = 0 and P(S) = (v(S) + sum of P(S - i) over i in S) / |S|, computed over
all coalitions by size; a filter's Shapley value is P(all) - P(all - filter). All is kept in integers, times k!.

Copies of a text are counted by its SHA-256: repeated rows collapse first, then each (text, part) is one row with its
count and its least key, so a text that a third of all rows hold is a few rows when its least key is looked up.

Defined results: a null text is empty; a null part is the empty string; a row without a key copies nothing, is no
original and has no labels; of several labels of a key the worst counts for toxic and the best for good; labels without a
document are ignored; repeated rows count one by one and, having equal keys, are no copies of each other; other columns are
ignored; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = r"[ \t-\r]+"
#: Parts whose rows are written at a time: k! * k rows each.
PARTS = 64


def failures(text: Column, words: Column) -> list[Column]:
    """Conditions A to D on a text that is not null and its words; True fails."""
    n_words = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n_words < 50,
        100 * F.size(F.array_distinct(words)).cast("bigint") < 65 * n_words.cast("bigint"),
        100 * capitals.cast("bigint") > 5 * F.length(text).cast("bigint"),
        text.rlike("[#$%&*|]"),
    ]


def outcomes(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """(part, failed, n, good, toxic): documents per part and set of failed filters, bit i for filter i (copies are last)."""
    body = F.coalesce(F.col(text), F.lit("")).alias("_text")
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), body)
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", SPACES), ""))
    conditions = failures(F.col("_text"), F.col("_words"))
    failed = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    rows = rows.select("_id", "part", failed.alias("failed"), F.unhex(F.sha2("_text", 256)).alias("digest"))
    rows = rows.groupBy("digest", "part", "_id", "failed").agg(F.count(F.lit(1)).alias("n"))

    marks = {m: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(m) for m, c in (("good", "quality"), ("toxic", "toxic"))}
    rated = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(*marks.values())
    rows = rows.join(rated, "_id", "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in marks})

    named = F.col("_id").isNotNull()
    texts = rows.groupBy("digest", "part", "failed", *marks).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("unnamed"),
        F.min(F.when(named, F.struct("_id", "n"))).alias("first"),
    )
    # The only step that brings a text's rows together: at most one per part and labels.
    least = F.min("first._id").over(Window.partitionBy("digest"))
    original = F.col("unnamed") + F.when(F.col("first._id") == least, F.col("first.n")).otherwise(0)
    texts = texts.withColumn("original", F.coalesce(original, F.col("unnamed")))
    copy = 1 << len(conditions)
    both = F.array(
        F.struct(F.col("failed"), F.col("original").alias("n")),
        F.struct(F.col("failed").bitwiseOR(copy).alias("failed"), (F.col("n") - F.col("original")).alias("n")),
    )
    cells = texts.select("part", *marks, F.explode(both).alias("cell")).select("part", *marks, "cell.failed", "cell.n")
    return cells.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), *(F.sum(F.when(F.col(m), F.col("n")).otherwise(0)).alias(m) for m in marks)
    )


def coalition_values(exact: np.ndarray) -> np.ndarray:
    """v(S) per row and coalition, from counts per exact set of failed filters."""
    inside = exact.copy()  # sums over subsets
    size = exact.shape[1]
    bit = 1
    while bit < size:
        with_bit = (np.arange(size) & bit) > 0
        inside[:, with_bit] += inside[:, np.flatnonzero(with_bit) - bit]
        bit *= 2
    # Untouched by S are those that fail filters outside S only.
    return exact.sum(axis=1, keepdims=True) - inside[:, ::-1]


def potentials(value: np.ndarray, players: int) -> np.ndarray:
    """players! times the potential per row and coalition; the divisions leave no remainder."""
    out = np.zeros_like(value)
    scale = math.factorial(players)
    for coalition in sorted(range(1, 1 << players), key=lambda s: s.bit_count()):
        members = [1 << i for i in range(players) if coalition >> i & 1]
        out[:, coalition] = (scale * value[:, coalition] + sum(out[:, coalition - m] for m in members)) // len(members)
    return out


def audit(counted: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Per part, order of all filters and step: documents kept, removed and lost here, and the filter's Shapley value times k!.

    counted: (part, failed, n, good, toxic) as ``outcomes`` gives them; names: a letter per filter, by bit, ten at most.
    """
    players = len(names)
    size = 1 << players
    measures = ("n", "good", "toxic")
    cells = (F.array(*(F.sum(F.when(F.col("failed") == s, F.col(m)).otherwise(0)) for s in range(size))).alias(m) for m in measures)
    parts = counted.groupBy("part").agg(*cells)

    orders = list(itertools.permutations(range(players)))
    labels = ["".join(names[i] for i in order) for order in orders]
    player = np.array(orders)  # by order and step
    now = np.cumsum(1 << player, axis=1)
    before = now - (1 << player)
    player, now, before = player.ravel(), now.ravel(), before.ravel()
    everyone = size - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PARTS):
                some = batch.slice(a, PARTS)
                exact = [np.stack(some.column(m).to_numpy(zero_copy_only=False)).astype(np.int64) for m in measures]
                value, good, toxic = map(coalition_values, exact)
                potential = potentials(value, players)
                shapley = potential[:, [everyone]] - potential[:, [everyone - (1 << i) for i in range(players)]]
                removed = value[:, now] - value[:, before]
                columns = [
                    exact[0].sum(axis=1, keepdims=True) - value[:, now],
                    removed,
                    value[:, 1 << player] - removed,
                    value[:, [everyone]] - value[:, everyone - (1 << player)],
                    good[:, now] - good[:, before],
                    toxic[:, now] - toxic[:, before],
                    shapley[:, player],
                ]
                n = len(exact[0])
                keys = [
                    some.column("part").take(pa.array(np.repeat(np.arange(n), len(player)))),
                    pa.array(np.repeat(np.array(labels, object), players)).take(pa.array(np.tile(np.arange(len(player)), n))),
                    pa.array(np.tile(np.arange(len(player), dtype=np.int32) % players + 1, n)),
                ]
                yield pa.record_batch([*keys, *(pa.array(c.ravel()) for c in columns)], names=[f.split(" ")[0] for f in fields])

    fields = ["part string", "filter_order string", "step int"]
    fields += [f"{c} bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    return parts.mapInArrow(run, ", ".join(fields))
