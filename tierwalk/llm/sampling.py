"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

No piece of the vocabulary holds a space after another character, so a text's lattice falls apart at every
space that follows another character. The chunks between are encoded on their own: the forward
pass (log-sums of the weights of all segmentations up to each position) runs once per distinct chunk of a batch,
for all of them at once, and the backward pass draws one segmentation per occurrence from exactly that
distribution. The draw at a position depends on the seed, the row's key and the position alone, so
a row gets the same pieces wherever and however often it is computed.

A segmentation weighs the product over its pieces of (rank + 2) ** -alpha, rank being a piece's place in the vocabulary.
Large alpha favours few and common pieces, alpha 0 draws all segmentations alike. Characters
without a piece become their UTF-8 bytes, also the character that stands for a space inside pieces, so
decoding gives back every text.

Defined results: a null text is empty and has no pieces; a null key is a key of its own; repeated
rows get the same pieces; nothing is normalised or cut; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from tierwalk.llm.anchors import ranges
from tierwalk.llm.batches import Texts, coded, mix, pieces

SPACE, MARK = " ", "▁"

#: Bytes of text that are encoded together, characters of distinct chunks whose lattices are held
#: at a time, at about three hundred bytes each, and pieces that are decoded together, at about two hundred.
BATCH_BYTES, LATTICE_CHARS, DECODED = 3 << 20, 200_000, 400_000


class Pieces:
    """The bytes of each piece, the mark as a space; all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.raw: list[bytes] = []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(MARK, SPACE).encode())
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.ends = np.append(0, np.cumsum([len(r) for r in self.raw]))


class Vocabulary(Pieces):
    """Pieces with their weights and an automaton that finds them in a text."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.byte_id = np.zeros(256, np.int64)
        self.length = np.zeros(self.size, np.int64)
        rank = np.zeros(self.size)
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
            elif self.raw[i]:
                text = piece.replace(MARK, SPACE)
                if SPACE in text.lstrip(SPACE):
                    raise ValueError(f"piece {i} holds a space after another character")
                self.automaton.add_word(text, i)
                self.length[i] = len(text)
            rank[i] = min(max(-model.get_score(i), 0.0), self.size)
        self.automaton.make_automaton()
        self.log_rank = np.log(rank + 2)
        self.byte_log_rank = float(np.log(self.size + 2))


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(2)
def piece_bytes(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """The lattices of distinct chunks, side by side; node = place between two characters of one chunk.

    edges: sorted by the node where they stop, with ``first`` their place by node; ``share`` the running
    probability of drawing them among the edges that stop at the same node.
    """

    def __init__(self, words: Vocabulary, chunks: list[str], alpha: float):
        text = "".join(chunks)
        size = np.fromiter((len(c) for c in chunks), np.int64, len(chunks))
        owner = np.repeat(np.arange(len(chunks), dtype=np.int32), size)
        self.start = np.cumsum(size) - size + np.arange(len(chunks))
        self.stop = self.start + size
        matches = np.fromiter(itertools.chain.from_iterable(words.automaton.iter(text)), np.int32).reshape(-1, 2)
        last, code = matches[:, 0], matches[:, 1]
        length = words.length[code]
        # A chunk may end in spaces, at the end of a text: pieces of spaces must not run on into the next chunk.
        within = last - length + 1 >= (np.cumsum(size) - size)[owner[last]]
        last, code, length = last[within], code[within], length[within]
        weight = -alpha * words.log_rank[code]
        alone = np.ones(len(text), bool)
        alone[last[length == 1]] = False
        alone = np.flatnonzero(alone)
        # Fallback characters are numbered behind the pieces.
        number: dict[str, int] = {}
        extra = [number.setdefault(text[i], len(number)) for i in alone.tolist()]
        encoded = [c.encode() for c in number]
        width = np.array([len(e) for e in encoded], np.int64)
        last = np.concatenate([last, alone])
        code = np.concatenate([code, words.size + np.asarray(extra, np.int64)])
        length = np.concatenate([length, np.ones(len(alone), np.int64)])
        weight = np.concatenate([weight, -alpha * words.byte_log_rank * width[np.asarray(extra, np.int64)]])
        stop = last + 1 + owner[last]
        # The automaton reports by place, the longest piece first; only fallback characters are out of place.
        order = np.argsort(stop, kind="stable") if len(alone) else slice(None)
        stop, code, weight, last = stop[order], code[order], weight[order], last[order]
        source = stop - length[order]
        nodes = len(text) + len(chunks)
        self.first = np.append(0, np.cumsum(np.bincount(stop, minlength=nodes)))
        # Forward: all chunks advance together, one character at a time.
        depth = stop - self.start[owner[last]]
        longest = int(size.max(initial=0))
        by_depth = np.argsort(depth.astype(np.uint16) if longest < 1 << 16 else depth, kind="stable")
        bounds = np.append(0, np.cumsum(np.bincount(depth, minlength=longest + 1)[1:]))
        total = np.zeros(nodes)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            at = by_depth[a:b]
            ends = stop[at]
            new = np.append(True, ends[1:] != ends[:-1])
            total[ends[new]] = np.logaddexp.reduceat(total[source[at]] + weight[at], np.flatnonzero(new))
        chance = np.exp(total[source] + weight - total[stop])
        running = np.cumsum(chance)
        base = np.append(0, running)[self.first[stop]]
        self.share = running - base
        self.share[self.first[stop + 1] - 1] = 2.0  # rounding never leaves a draw without an edge
        self.source, self.code = source, code
        # Ids of each code: one per piece, the bytes of a fallback character.
        self.width = np.append(np.ones(words.size, np.int64), width)
        self.begin = np.append(np.arange(words.size), words.size + np.cumsum(width) - width)
        data = np.frombuffer(b"".join(encoded), np.uint8)
        self.ids = np.append(np.arange(words.size), words.byte_id[data]).astype(np.int32)

    def draw(self, chunk: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the pieces of each occurrence in order, their number per occurrence)."""
        active, node, drawn = np.arange(len(chunk)), self.stop[chunk], []
        begin = self.start[chunk]
        while len(active):
            dice = mix(key[active] + (node - begin[active]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            dice = (dice >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[node]
            wrong = np.flatnonzero(dice >= self.share[edge])
            while len(wrong):
                edge[wrong] += 1
                wrong = wrong[dice[wrong] >= self.share[edge[wrong]]]
            drawn.append((active, self.code[edge]))
            node = self.source[edge]
            more = node > begin[active]
            active, node = active[more], node[more]
        count = np.zeros(len(chunk), np.int64)
        for who, _ in drawn:
            count[who] += 1
        ends = np.cumsum(count)
        out = np.zeros(int(count.sum()), np.int64)
        for step, (who, code) in enumerate(drawn):
            out[ends[who] - 1 - step] = code
        return out, count


def _prefixed(texts: Texts) -> Texts:
    """Each text but the empty ones with a space before it."""
    some = np.flatnonzero(np.diff(texts.offsets))
    out = Texts.__new__(Texts)
    out.bytes = np.insert(texts.bytes, texts.offsets[some], 32)
    out.offsets = texts.offsets + np.append(0, np.cumsum(np.diff(texts.offsets) > 0))
    return out


def encode_texts(texts: Texts, keys: np.ndarray, words: Vocabulary, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of the texts in them)."""
    texts = _prefixed(texts)
    data = texts.bytes
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
    begins[texts.offsets] = True
    bounds = np.flatnonzero(begins)
    start, stop = bounds[:-1], bounds[1:]
    codes, distinct = coded(data, start, stop)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    owner = np.searchsorted(texts.offsets, start, side="right") - 1
    place = mix(keys[owner] ^ mix((start - texts.offsets[owner]).astype(np.uint64) + np.uint64(1)))
    chunks = [c.decode() for c in distinct.to_pylist()]
    by_code = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(chunks)))
    size = np.cumsum([len(c) for c in chunks])
    n_ids, parts, at = np.zeros(len(codes), np.int64), [], 0
    while at < len(chunks):
        stop_at = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + LATTICE_CHARS, side="right")))
        mine = by_code[ends[at - 1] if at else 0 : ends[stop_at - 1]]
        lattice = Lattice(words, chunks[at:stop_at], alpha)
        drawn, count = lattice.draw(codes[mine] - at, place[mine])
        width = lattice.width[drawn]
        total = np.append(0, np.cumsum(width))
        begin = lattice.begin[drawn]
        ids = lattice.ids[np.repeat(begin - total[:-1], width) + np.arange(total[-1])]
        n_ids[mine] = np.diff(total[np.append(0, np.cumsum(count))])
        parts.append((mine, ids))
        at = stop_at
    total = np.append(0, np.cumsum(n_ids))
    out = np.zeros(total[-1], np.int32)
    for mine, ids in parts:
        out[ranges(total[mine], total[mine + 1])] = ids
    first = np.searchsorted(start, texts.offsets)  # first chunk of each text
    return out, total[first]


def row_keys(keys: pa.Array, seed: int) -> np.ndarray:
    """A hash of each key; none is a key of its own, whatever a text may say."""
    none = xxhash.xxh3_64_intdigest(b"\xff", seed)  # no text in UTF-8
    names = (none if k is None else xxhash.xxh3_64_intdigest(str(k), seed) for k in keys.to_pylist())
    return np.fromiter(names, np.uint64, len(keys))


def encode(
    docs: DataFrame, path: str, alpha: float = 1.0, seed: int = 0, key: str = "doc_id", text: str = "text", decoded: str | None = None
) -> DataFrame:
    """(key, ids: array<int>), a sampled segmentation of every row. No shuffle.

    With ``decoded`` also the text that the ids give back, under that name, decoded where they were drawn."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in pieces(batches, text, BATCH_BYTES):
            ids, offsets = encode_texts(Texts(batch.column(1)), row_keys(batch.column(0), seed), words, alpha)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            out = pa.record_batch([batch.column(0), lists], [key, "ids"])
            if decoded is None:
                yield out
            else:
                yield from (part.append_column(decoded, decode_lists(part.column(1), words)) for part in _by_ids(out, 1))

    text_field = f", `{decoded}` string" if decoded else ""
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>{text_field}")


def _by_ids(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``DECODED`` ids."""
    size = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + DECODED, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def decode_lists(lists: pa.ListArray, words: Pieces) -> pa.Array:
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    width = np.diff(words.ends)[ids]
    total = np.append(0, np.cumsum(width))
    data = words.flat[np.repeat(words.ends[:-1][ids] - total[:-1], width) + np.arange(total[-1])]
    pieces_before = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    offsets = total[pieces_before]
    some = np.diff(offsets) > 0  # drop the space that encoding put before the text
    data = np.delete(data, offsets[:-1][some])
    offsets = offsets - np.append(0, np.cumsum(some))
    return pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds text, the bytes of the pieces of ``ids``; exactly what was encoded."""

    at = tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = piece_bytes(path)
        for batch in batches:
            for part in _by_ids(batch, at):
                yield part.append_column("text", decode_lists(part.column(at), words))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{fields}, text string")
