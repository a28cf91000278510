"""Levenshtein automata as tables, and their intersection with a trie of terms for many words at once.

The automaton for at most k edits (insert, delete, replace, swap two neighbours) reads the letters of a path of the trie. Its state
says how many edits each of the 2 k + 1 nearest places of the word costs, and which swaps are half done; what a letter does
to a state depends only on where that letter occurs in the word near the current place. So one table serves every word and
every term: ``step[state, where the letter occurs]``. Words go down the trie together, and a branch is left as soon as no
word is within k edits of anything below it.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tierwalk.llm.batches import mix

DEAD = -1
#: Letters of an entry that are read for whole groups of words.
TOP = 3


@dataclass(frozen=True)
class Automaton:
    """step[state, mask] with bit b of mask for place (depth - edits - 1 + b) of the word; edits of a whole word and of
    its best beginning by state and letters left (between -edits and edits)."""

    edits: int
    step: np.ndarray
    whole: np.ndarray
    beginning: np.ndarray


@functools.lru_cache
def automaton(edits: int) -> Automaton:
    k, width, most = edits, 2 * edits + 1, edits + 1
    start = (tuple(o if o >= 0 else most for o in range(-k, k + 1)), (most,) * width)
    number, order, steps = {start: 0}, [start], []

    def after(state, mask):
        cost, swap = state
        hit = [mask >> b & 1 for b in range(width + 2)]  # hit[i + 1] for place i of cost
        new = []
        for i in range(width):
            best = min(cost[i] + (0 if hit[i + 1] else 1), cost[i + 1] + 1 if i + 1 < width else most)
            if hit[i]:
                best = min(best, swap[i])
            if i:
                best = min(best, new[i - 1] + 1)
            new.append(min(best, most))
        return tuple(new), tuple(min(c + 1, most) if hit[i + 2] else most for i, c in enumerate(cost))

    at = 0
    while at < len(order):
        row = []
        for mask in range(1 << (width + 2)):
            new = after(order[at], mask)
            if min(*new[0], *new[1]) > k:
                row.append(DEAD)
                continue
            if new not in number:
                number[new] = len(order)
                order.append(new)
            row.append(number[new])
        steps.append(row)
        at += 1
    whole = np.array([cost for cost, _ in order], np.int8)
    return Automaton(k, np.array(steps, np.int32), whole, np.minimum.accumulate(whole, axis=1))


@dataclass
class Node:
    below: dict[int, Node] = field(default_factory=dict)
    term: int | None = None  # an entry that is a whole word
    stem: int | None = None  # an entry that words begin with


def build(entries: list[tuple[int, str, bool]]) -> Node:
    """A trie of (number, letters, is it a stem)."""
    root = Node()
    for number, letters, stem in entries:
        node = root
        for c in letters:
            node = node.below.setdefault(ord(c), Node())
        if stem:
            node.stem = number
        else:
            node.term = number
    return root


class Letters:
    """Words as code points, a row per place, as many as the longest entry needs.

    Words that begin alike are in the same state for the first letters of an entry, so the walk starts from the
    distinct beginnings of ``TOP`` letters and what an automaton sees beyond them.
    """

    def __init__(self, words: pa.Array, longest: int, edits: int):
        words = pc.utf8_slice_codeunits(words, 0, longest + edits + 1) if len(words) else words
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        self.length, self.pad = size, edits + 1
        width = self.pad + longest + 2 * edits + 3
        by_word = np.zeros(len(size) * width, np.uint32)
        first = np.arange(len(size)) * width + self.pad
        by_word[np.arange(len(flat)) + np.repeat(first - np.cumsum(size) + size, size)] = flat
        self.codes = np.ascontiguousarray(by_word.reshape(len(size), width).T)

    def groups(self, edits: int) -> Groups:
        """Words that an automaton cannot tell apart in the first ``TOP`` letters of an entry."""
        key = np.zeros(len(self.length), np.uint64)
        for row in self.codes[self.pad : self.pad + TOP + edits + 1]:
            key = mix(key ^ row.astype(np.uint64)) + np.uint64(1)
        order = np.argsort(key)
        new = np.append(True, key[order][1:] != key[order][:-1])[: len(key)]
        return Groups(order, np.append(np.flatnonzero(new), len(key)))


@dataclass(frozen=True)
class Groups:
    order: np.ndarray
    first: np.ndarray

    def words(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words of some groups, the place of each one's group among them)."""
        width = self.first[groups + 1] - self.first[groups]
        at = np.repeat(self.first[groups] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
        return self.order[at], np.repeat(np.arange(len(groups)), width)


def intersect(root: Node, letters: Letters, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, entry, edits) for every entry within ``edits`` of a word, or of a beginning of it if the entry is a stem."""
    table = automaton(edits)
    groups = letters.groups(edits)
    sample = groups.order[groups.first[:-1]]
    # (node, depth, are these groups, groups or words, states)
    stack = [(root, 0, True, np.arange(len(sample)), np.zeros(len(sample), np.int32))]
    words, entries, costs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
    shift, width = letters.pad - edits - 1, 2 * edits + 3
    while stack:
        node, depth, grouped, who, state = stack.pop()
        if grouped and depth == TOP:
            who, number = groups.words(who)
            state, grouped = state[number], False
        at = sample[who] if grouped else who
        near = [letters.codes[shift + depth + b][at] for b in range(width)]
        for code, child in node.below.items():
            mask = np.zeros(len(at), np.uint8)
            for b, row in enumerate(near):
                mask |= (row == code).view(np.uint8) << np.uint8(b)
            new = table.step[state, mask]
            alive = np.flatnonzero(new >= 0)
            if not len(alive):
                continue
            some, new = who[alive], new[alive]
            for entry, cost, whole in ((child.term, table.whole, True), (child.stem, table.beginning, False)):
                if entry is None:
                    continue
                these, states = some, new
                if grouped:
                    these, number = groups.words(some)
                    states = new[number]
                left = letters.length[these] - depth - 1
                fits = (left >= -edits) & ((left <= edits) | (not whole))
                paid = cost[states, np.clip(left, -edits, edits) + edits]
                good = np.flatnonzero(fits & (paid <= edits))
                words.append(these[good])
                entries.append(np.full(len(good), entry))
                costs.append(paid[good])
            if child.below:
                stack.append((child, depth + 1, grouped, some, new))
    return np.concatenate(words), np.concatenate(entries), np.concatenate(costs)
