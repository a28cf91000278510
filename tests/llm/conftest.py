import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = "amber bolt crane delta ember flint grove haven inlet jewel knoll larch maple north ocean pearl quartz river stone timber".split()


def passage(seed: int, n: int) -> str:
    dice = random.Random(seed)
    return " ".join(dice.choice(WORDS) + str(dice.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text) rows with all that may go wrong in them."""
    a, b, c = passage(1, 120), passage(2, 60), passage(3, 45)
    words = a.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    chain = [b.split(" ")]
    for n in range(3):  # each is near the one before it
        chain.append([*chain[-1][: 10 * n + 5], f"step{n}", *chain[-1][10 * n + 6 :]])
    rows = [
        (11, a), (4, a.upper()), (7, near), (12, None), (13, ""), (14, " \t\n\x0b\x0c\r "), (None, a), (None, None),
        (15, c + "\n" + b), (16, passage(4, 30) + "\t" + c), (17, c + " " + c), (18, "one two"), (19, "ONE two"),
        (20, "Ünïcode … naïve\u00a0 日本語テキスト ▁ ▁▁ <|endoftext|> don't we'll  \u2003x"), (21, "x" * 400), (22, "y" + "x" * 399),
        (23, "the " * 300), (25, passage(9, 20000)), (30, b), (30, b), (31, "a"), (32, "\u0085 \u1680 end \u3000"),
    ]
    return rows + [(40 + n, " ".join(w)) for n, w in enumerate(chain)]


#: Columns of the operators' own, given to the input to see that nothing clashes.
CLASHES = "shard part row key token n hits kept kept_text n_words n_removed n_bytes id ids label component bands first value".split()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    base = spark.createDataFrame(corpus, "doc_id bigint, text string").coalesce(3)
    return base.select("*", *(F.lit(f"own {n}").alias(n) for n in CLASHES))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, kept string")
