"""Weighted acyclic automata over words: n-grams with their counts.

A path from the start spells an n-gram, and the weights along it and of the state it ends in add up
to its count. Weights lie as near to the start as possible, so that equal endings are one state.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np

Path = tuple[tuple[bytes, ...], int]

_NOT_FINAL = -1


class _Open:
    """A state that may still change: arcs as [word, weight, target], the last one open as well."""

    __slots__ = ("arcs", "final")

    def __init__(self) -> None:
        self.arcs: list[list] = []
        self.final = _NOT_FINAL

    def push(self, weight: int) -> None:
        for arc in self.arcs:
            arc[1] += weight
        if self.final != _NOT_FINAL:
            self.final += weight


class Transducer:
    """States as (final weight, arcs); an arc is (word, weight, target). The start is the last."""

    def __init__(self, states: list[tuple]):
        self.states = states

    @classmethod
    def build(cls, paths: Iterable[Path]) -> Transducer:
        """From n-grams in ascending order, each once: states are closed as soon as no later n-gram
        can reach them, and one that equals an earlier one is not kept."""
        states: list[tuple] = []
        register: dict[tuple, int] = {}
        stack, last = [_Open()], ()

        def close(depth: int) -> None:
            while len(stack) > depth + 1:
                done = stack.pop()
                state = (done.final, tuple(map(tuple, done.arcs)))
                at = register.setdefault(state, len(states))
                if at == len(states):
                    states.append(state)
                stack[-1].arcs[-1][2] = at

        for words, count in paths:
            same = 0
            for a, b in zip(words, last, strict=False):
                if a != b:
                    break
                same += 1
            close(same)
            rest = count
            for k in range(same):
                arc = stack[k].arcs[-1]
                if arc[1] > rest:
                    stack[k + 1].push(arc[1] - rest)
                    arc[1] = rest
                rest -= arc[1]
            for word in words[same:]:
                stack[-1].arcs.append([word, rest, -1])
                stack.append(_Open())
                rest = 0
            stack[-1].final = rest
            last = words
        close(0)
        start = stack[0]
        states.append((start.final, tuple(map(tuple, start.arcs))))
        return cls(states)

    def paths(self) -> Iterator[Path]:
        """All n-grams in ascending order, with their counts."""
        todo: list[tuple] = [(len(self.states) - 1, (), 0)]
        while todo:
            at, words, weight = todo.pop()
            final, arcs = self.states[at]
            if final != _NOT_FINAL:
                yield words, weight + final
            for word, more, target in reversed(arcs):
                todo.append((target, (*words, word), weight + more))

    def compose(self, counts: Transducer) -> Iterator[Path]:
        """The n-grams that both hold, in ascending order, with their counts in ``counts``."""
        todo: list[tuple] = [(len(self.states) - 1, len(counts.states) - 1, (), 0)]
        while todo:
            at, other, words, weight = todo.pop()
            final, arcs = self.states[at]
            final_there, arcs_there = counts.states[other]
            if final != _NOT_FINAL and final_there != _NOT_FINAL:
                yield words, weight + final_there
            there = {arc[0]: arc for arc in arcs_there}
            for word, _, target in reversed(arcs):
                arc = there.get(word)
                if arc:
                    todo.append((target, arc[2], (*words, word), weight + arc[1]))

    def dump(self) -> bytes:
        """Arrays of numbers, and the distinct words at the end, sorted."""
        words = sorted({arc[0] for _, arcs in self.states for arc in arcs})
        number = {word: k for k, word in enumerate(words)}
        arcs = [(number[w], target, weight) for _, own in self.states for w, weight, target in own]
        sizes = [len(own) for _, own in self.states]
        table = np.array(arcs, "<i8").reshape(-1, 3)
        head = np.array([len(self.states), len(arcs)], "<i8")
        parts = [
            head, np.array([final for final, _ in self.states], "<i8"), np.array(sizes, "<i4"),
            table[:, 0].astype("<i4"), table[:, 1].astype("<i4"), table[:, 2].astype("<i8"),
        ]
        return b"".join([*(p.tobytes() for p in parts), b"\n".join(words)])

    @classmethod
    def load(cls, raw: bytes) -> Transducer:
        n, m = np.frombuffer(raw, "<i8", 2).tolist()
        at, columns = 16, []
        for kind, count in (("<i8", n), ("<i4", n), ("<i4", m), ("<i4", m), ("<i8", m)):
            column = np.frombuffer(raw, kind, count, at)
            at += column.nbytes
            columns.append(column.tolist())
        finals, sizes, labels, targets, weights = columns
        words = raw[at:].split(b"\n")
        arcs = list(zip([words[k] for k in labels], weights, targets, strict=True))
        ends = np.cumsum([0, *sizes]).tolist()
        return cls([(f, tuple(arcs[a:b])) for f, a, b in zip(finals, ends, ends[1:], strict=False)])


def union(transducers: Iterable[Transducer], least: int = 0) -> Transducer:
    """One transducer of all n-grams with the sums of their counts; only those of ``least`` or more."""
    merged = groupby(heapq.merge(*(t.paths() for t in transducers)), itemgetter(0))
    summed = ((words, sum(count for _, count in own)) for words, own in merged)
    return Transducer.build((words, count) for words, count in summed if count >= least)
