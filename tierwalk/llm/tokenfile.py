"""Token-id files: documents encoded by the tokenizers library and kept as Parquet lists.

Layout: one row per document in ascending key order across files and within them, so a key range
touches few files, row groups and pages. ``ids`` is dictionary-encoded (a vocabulary fits a dictionary
page, so an id costs its bits); ``key``, ``part``, ``first`` and ``n`` rise slowly and are
delta-encoded. Row groups are small enough to be read alone, and the writer's page index lets a reader skip
pages within them. ``first`` counts the ids before a document in its own file; adding the totals of the files
before gives its place in the whole stream, without a pass over any ids.

Defined results: a null text is empty; an empty text has the end id only; rows of one key are
ordered by text (nulls first) and keep a row each; a null key comes first; other columns are
ignored; an empty table gives an empty file set.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierwalk.llm.batches import IS_SPACE, LOWER, Texts, Words, coded, pieces

#: Distinct parts whose ids a worker remembers from batch to batch and task to task, and the longest of them in bytes.
REMEMBERED, LONGEST = 300_000, 64

#: Bytes of text that are encoded at a time.
PIECE_BYTES = 4 << 20

#: Characters of a text by which rows of one key are dealt to different files.
DEALT = 64

#: Parts that go to the library at a time, the mark of a word end in the vocabulary, and how tokenizers that are known here cut words.
TOGETHER, WORD_END = 256, "</w>"
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Kinds of bytes: white space; letters (A-Z, a-z and, in two bytes, U+00C0 to U+027F); digits; other ASCII; what only the library can judge.
GAP, LETTER, DIGIT, OTHER, FOREIGN = range(5)
_KIND = np.full(256, FOREIGN, np.uint8)
_KIND[0x21:0x7F] = OTHER
_KIND[0x30:0x3A] = DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:0xC0] = _KIND[0xC3:0xCA] = LETTER
_KIND[ord("'")] = FOREIGN
_KIND[IS_SPACE] = GAP

#: Multiplication and division sign, and the letter that becomes two characters in lower case.
_NO_LETTERS = (0xC3, (0x97, 0xB7)), (0xC4, (0xB0,))


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _cuts_words(tokenizer) -> bool:
    """Whether it lower-cases and cuts words as ``_SPLIT`` does, and nothing else that differs from word to word."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return False
    normal, cut = (json.loads(step.__getstate__()) for step in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    steps = [n["type"] for n in normal.get("normalizers", [])]
    cuts = cut.get("pretokenizers", [{}])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and (normal["normalizers"][1]["pattern"], normal["normalizers"][1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": _SPLIT}, "Removed", True)
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
    )


def parts(words: Words, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in which A-Z of all but foreign words are lower case; start and stop of the parts; which bytes are of foreign words).

    A word is foreign if it holds a byte of that kind or a sign of two bytes that is no letter. It is one part. Parts of other words are runs of
    letters, single digits, and runs of other characters.
    """
    data = words.texts.bytes
    kind = kinds[data]
    for lead, tails in _NO_LETTERS:
        after = np.flatnonzero(data[:-1] == lead) + 1
        kind[after[np.isin(data[after], tails)]] = FOREIGN
    foreign = np.maximum.reduceat(kind, words.start) == FOREIGN
    foreign = np.repeat(np.append(False, foreign), np.diff(words.start, prepend=0, append=len(data)))
    inner = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    inner &= (kind[1:] != GAP) & (kind[:-1] != GAP) & ~foreign[1:]
    opens, shuts = np.zeros(len(data), bool), np.zeros(len(data) + 1, bool)
    opens[1:], shuts[1:-1] = inner, inner
    # A text may end and the next one begin without white space.
    opens[words.start] = shuts[words.stop] = True
    return np.where(foreign, data, LOWER[data]), np.flatnonzero(opens), np.flatnonzero(shuts), foreign


class Encoder:
    """Whole texts to ids, calling the library once per distinct part of the words of a batch.

    Right for tokenizers that never join characters across white space and drop it, so that a
    text's ids are those of its words one after another. If it lower-cases and cuts words as ``_SPLIT`` does, words of plain
    characters are cut here, and their parts go to the library many at a time: each ends with one mark of a word end. All other
    words, and all words of other tokenizers, go to it one by one as they are.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = _tokenizer(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.kinds = _KIND.copy() if _cuts_words(self.tokenizer) else np.where(IS_SPACE, GAP, FOREIGN).astype(np.uint8)
        # A special string is found before anything is cut, so words in which one may begin are left to the library.
        for token in self.tokenizer.get_added_tokens_decoder().values():
            self.kinds[token.content.encode()[0]] = FOREIGN

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array("i", x.ids).tobytes() for x in made]

    def _encoded_together(self, words: list[bytes]) -> list[bytes]:
        """Of parts, which hold one mark each."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out = []
        for group, data in zip(groups, self._encoded([b" ".join(g) for g in groups]), strict=True):
            stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(data, np.int32)]) + 1)).tolist()
            if len(stops) != len(group):  # not a vocabulary of this kind
                out += self._encoded(group)
                continue
            out += [data[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def _ids(self, distinct: list[bytes], alone: np.ndarray) -> list[bytes]:
        out = list(map(self.known.get, distinct))
        new = np.array([i for i, ids in enumerate(out) if ids is None], np.int64)
        for some, encoded in ((new[alone[new]], self._encoded), (new[~alone[new]], self._encoded_together)):
            some = some.tolist()
            for i, ids in zip(some, encoded([distinct[i] for i in some]), strict=True):
                out[i] = ids
        room = REMEMBERED - len(self.known)
        if room > 0:
            short = [i for i in new.tolist() if len(distinct[i]) <= LONGEST]
            self.known.update((distinct[i], out[i]) for i in short[:room])
        return out

    def encode(self, texts: Texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end``; offsets of the texts in them)."""
        words = Words(texts)
        if not len(words):
            return np.full(len(texts), end, np.int32), np.arange(len(texts) + 1)
        data, start, stop, foreign = parts(words, self.kinds)
        codes, distinct = coded(data, start, stop)
        alone = np.zeros(len(distinct), bool)
        alone[codes[foreign[start]]] = True
        ids = self._ids(distinct.to_numpy(zero_copy_only=False).tolist(), alone)
        # The end id is one more part, behind the last of each text.
        stops = np.searchsorted(start, texts.offsets[1:])
        codes = np.insert(codes, stops, len(ids))
        ids.append(np.int32(end).tobytes())
        taken = pa.array(ids, pa.large_binary()).take(pa.array(codes))
        place = np.frombuffer(taken.buffers()[1], np.int64)[: len(codes) + 1]
        offsets = np.append(0, place[stops + np.arange(1, len(texts) + 1)] // 4)
        return np.frombuffer(taken.buffers()[2], np.int32)[: offsets[-1]], offsets


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every row and write the files. One shuffle, of the texts, by ranges of the key and of how the text begins."""
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, first = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in pieces(batches, text, PIECE_BYTES):
            ids, offsets = encoder.encode(Texts(batch.column(1)), end)
            n = np.diff(offsets)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(first + offsets[:-1]),
                    pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ],
                [key, "part", "first", "n", "ids"],
            )
            first += int(offsets[-1])

    ordered = docs.select(key, text).repartitionByRange(key, F.substring(text, 1, DEALT)).sortWithinPartitions(key, text)
    writer = ordered.mapInArrow(encode, f"{key} {kind}, part int, first bigint, n int, ids array<int>").write
    for option, value in (
        ("compression", "zstd"),
        ("parquet.writer.version", "PARQUET_2_0"),
        ("parquet.block.size", 16 << 20),
        ("parquet.page.size", 256 << 10),
        ("parquet.dictionary.page.size", 2 << 20),
        ("parquet.enable.dictionary", "false"),
        ("parquet.enable.dictionary#ids.list.element", "true"),
    ):
        writer = writer.option(option, value)
    writer.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, part, first, n, ids; select columns and filter on the key to read only those pages."""
    return spark.read.parquet(path)


def with_start(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds start, the number of ids before a document in the whole stream, to rows read from ``tokens``.

    Reads no ids for it; the running total is over one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = tokens.groupBy("part").agg(F.max(F.col("first") + F.col("n")).alias("n_part"))
    bases = totals.select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("first")).drop("base")


def digest(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, part, first, n, n_tokens, ids_crc32) from the ids as they were read."""
    kind = tokens.schema[key].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            n = pa.array(np.diff(ends).astype(np.int64))
            yield pa.record_batch(
                [*batch.columns[:4], n, pa.array(crc, pa.int64())], [key, "part", "first", "n", "n_tokens", "ids_crc32"]
            )

    schema = f"{key} {kind}, part int, first bigint, n int, n_tokens bigint, ids_crc32 bigint"
    return tokens.select(key, "part", "first", "n", "ids").mapInArrow(check, schema)
