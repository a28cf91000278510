"""Token counts without materialising ids.

Pieces are counted once per distinct pre-token of the whole corpus, and joined to each document's
pre-token frequencies. The frequent pre-tokens (a fixed number of them; long ones by their digest, so of bounded size) are
broadcast and meet the frequencies inside the task that reads the text; the rest are rare by
construction, so their (document, pre-token) rows are few and no join key is hot.

Defined results: a null text is empty; an empty text has 0 bytes and 0 tokens; a null doc_id stays
null; repeated rows give a row each; a text of any length is counted whole; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.batches import IS_SPACE, Texts, coded, pieces
from tierwalk.workspace import Workspace

#: Pre-tokens that are broadcast, and characters up to which one goes by itself; a longer one goes by its digest.
HEAD, NAME = 200_000, 64

# White space as the tokenizer's pattern knows it.
_SPACE = r"\t-\r \x85\xA0  -     　"
_PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+"
)
# Below this the character classes of the two libraries are the same (tested); above, the tokenizer itself cuts.
_OTHER = regex.compile(r"[^\x00-ɏ‐-‧]")


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(2)
def _special(path: str) -> regex.Pattern | None:
    added = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
    return regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None


def _cut(text: str, path: str) -> list[str]:
    """Pre-tokens of a text without special strings."""
    if _OTHER.search(text):
        return [text[a:b] for _, (a, b) in _tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]
    return _PATTERN.findall(text)


def pre_tokens(text: str, path: str) -> list[str]:
    """Pre-tokens of a text; a special string is one of its own."""
    special = _special(path)
    if special is None or not special.search(text):
        return _cut(text, path)
    out = []
    for i, part in enumerate(special.split(text)):
        out += [part] if i % 2 else _cut(part, path)
    return out


def _chunks(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of chunks: each is white space and the run of other characters after it.

    A white space character after any other always begins a pre-token, so chunks
    can be cut into pre-tokens one by one.
    """
    data = texts.bytes
    space = IS_SPACE[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:-1] = space[1:] & ~space[:-1]
    at = np.flatnonzero(begins)
    last = data[at - 1] if len(at) else at
    doubt = at[last >= 0x80]
    if len(doubt):
        a, b, c = data[doubt - 1], data[np.maximum(doubt - 2, 0)], data[np.maximum(doubt - 3, 0)]
        wide = (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (c == 0xE1) & (b == 0x9A) & (a == 0x80)
        wide |= (c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
        wide |= (c == 0xE2) & (b == 0x81) & (a == 0x9F) | (c == 0xE3) & (b == 0x80) & (a == 0x80)
        begins[doubt[wide]] = False
    begins[texts.offsets] = True
    bounds = np.flatnonzero(begins)
    start, stop = bounds[:-1], bounds[1:]
    return start, stop


def _batch_counts(texts: Texts, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text, pre-token, frequency) triples of a batch, and its distinct pre-tokens."""
    start, stop = _chunks(texts)
    codes, distinct = coded(texts.bytes, start, stop)
    owner = np.searchsorted(texts.offsets, start, side="right") - 1
    number: dict[str, int] = {}
    parts: list[int] = []
    ends = np.zeros(len(distinct) + 1, np.int64)
    for i, chunk in enumerate(distinct.to_pylist()):
        for token in pre_tokens(chunk.decode(), path):
            parts.append(number.setdefault(token, len(number)))
        ends[i + 1] = len(parts)
    pair, times = np.unique(owner * max(len(distinct), 1) + codes, return_counts=True)
    owner, codes = np.divmod(pair, max(len(distinct), 1))
    width = ends[codes + 1] - ends[codes]
    rows = np.repeat(np.arange(len(pair)), width)
    offset = np.arange(len(rows)) - np.repeat(np.cumsum(width) - width, width)
    token = np.asarray(parts, dtype=np.int64)[ends[codes][rows] + offset] if len(rows) else np.zeros(0, np.int64)
    return owner[rows], token, times[rows], list(number)


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Each distinct pre-token of all texts: (token, n), n its occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            _, token, times, names = _batch_counts(Texts(batch.column(0)), path)
            n = np.bincount(token, times, len(names)).astype(np.int64)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(n)], ["token", "n"])

    parts = docs.select(text).mapInArrow(count, "token string, n bigint")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def with_pieces(tokens: DataFrame, path: str) -> DataFrame:
    """Adds n_pieces: how many tokens the library makes of each pre-token."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _tokenizer(path).encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield batch.append_column("n_pieces", pa.array([len(x.ids) for x in made], pa.int64()))

    return tokens.mapInArrow(encode, "token string, n bigint, n_pieces bigint")


def _name(token: str) -> str:
    """A name of bounded length: the token, or something too long to be a short token."""
    return token if len(token) <= NAME else "#" + hashlib.sha256(token.encode()).hexdigest()


def frequent(known: DataFrame, head: int) -> dict[str, int]:
    """Pieces of the ``head`` most frequent pre-tokens, by name."""
    name = F.when(F.length("token") <= NAME, F.col("token")).otherwise(F.concat(F.lit("#"), F.sha2("token", 256)))
    named = known.select(name.alias("name"), "n", "n_pieces").orderBy(F.desc("n"), "name").limit(head)
    return dict(zip(*(c.to_pylist() for c in named.select("name", "n_pieces").toArrow().columns), strict=True))


def count_tokens(docs: DataFrame, path: str, head: int = HEAD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_bytes, n_tokens.

    ``docs`` has to be read in the same order each time a task is repeated, as files are.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "counts")
    known, _ = space.save(with_pieces(vocabulary(docs, path, text), path), "vocabulary")
    shared = spark.sparkContext.broadcast(frequent(known, head))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in pieces(batches, text):
            texts = Texts(batch.column(1))
            owner, token, times, names = _batch_counts(texts, path)
            pieces_of = np.fromiter((of.get(_name(x), -1) for x in names), np.int64, len(names))
            each = pieces_of[token]
            found = each >= 0
            sums = np.bincount(owner[found], (each * times)[found], len(texts)).astype(np.int64)
            rows = batch.column(0)
            yield pa.record_batch(
                [rows, batch.column(2), pa.nulls(len(rows), pa.string()), pa.array(sums), pa.array(np.diff(texts.offsets))],
                names=["row", "key", "token", "n", "n_bytes"],
            )
            rare = ~found
            words = pa.array(names, pa.string()).take(pa.array(token[rare]))
            rows = rows.take(pa.array(owner[rare]))
            nothing = pa.nulls(len(rows), batch.column(2).type)
            yield pa.record_batch(
                [rows, nothing, words, pa.array(times[rare]), pa.nulls(len(rows), pa.int64())],
                names=["row", "key", "token", "n", "n_bytes"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias(text), F.col(key).alias("key"))
    met, _ = space.save(
        rows.mapInArrow(meet, f"row bigint, key {kind}, token string, n bigint, n_bytes bigint"), "frequencies"
    )
    sums = met.where("token IS NULL").select("row", "key", "n", "n_bytes")
    rare = (
        met.where("token IS NOT NULL")
        .join(known.select("token", "n_pieces"), "token")
        .select("row", F.lit(None).cast(kind).alias("key"), (F.col("n") * F.col("n_pieces")).alias("n"), F.lit(0).alias("n_bytes"))
    )
    return (
        sums.unionByName(rare)
        .groupBy("row")
        .agg(F.max("key").alias(key), F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
        .drop("row")
    )
