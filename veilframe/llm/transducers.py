"""Finite-state transducers over small alphabets: arcs, composition, and the best path of a weighted output."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Hashable, Iterable

State = Hashable


class Transducer:
    """arcs[state][symbol] has (output, next state) pairs; a symbol without arcs in a state ends the path there.

    Several start states, and several arcs of one symbol, make a transducer that guesses; only paths that end in a final
    state count.
    """

    def __init__(self, starts: Iterable[State], finals: Iterable[State], arcs: Iterable[tuple[State, str, str, State]]):
        self.starts, self.finals = tuple(starts), frozenset(finals)
        self.arcs: dict[State, dict[str, list[tuple[str, State]]]] = defaultdict(lambda: defaultdict(list))
        for state, symbol, output, following in arcs:
            self.arcs[state][symbol].append((output, following))

    def outputs(self, symbols: list[str]) -> set[tuple[str, ...]]:
        """Every output string of every path; for tests, as their number may double with each symbol."""
        ways = {((), s) for s in self.starts}
        for x in symbols:
            ways = {((*out, o), t) for out, s in ways for o, t in self.arcs[s][x]}
        return {out for out, s in ways if s in self.finals}

    def best(self, symbols: list[str], weights: list[float], value: Callable[[str], float]) -> tuple[float, tuple[str, ...]]:
        """The largest sum of weight * value(output) over all paths, and its output: a shortest path with costs negated.

        Of equal sums, the outputs that come first in order are taken.
        """
        ways = {s: (0.0, ()) for s in self.starts}
        for x, w in zip(symbols, weights):
            following: dict[State, tuple[float, tuple[str, ...]]] = {}
            for s, (total, out) in ways.items():
                for o, t in self.arcs[s][x]:
                    way = (total + w * value(o), (*out, o))
                    if t not in following or (-way[0], way[1]) < (-following[t][0], following[t][1]):
                        following[t] = way
            ways = following
        ends = [w for s, w in ways.items() if s in self.finals]
        return min(ends, key=lambda w: (-w[0], w[1])) if ends else (-math.inf, ())


def compose(a: Transducer, b: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The transducer that feeds a's outputs to b; its states are the pairs that can be reached."""
    alphabet = tuple(alphabet)
    starts = [(s, t) for s in a.starts for t in b.starts]
    arcs, seen, left = [], set(starts), list(starts)
    while left:
        s, t = left.pop()
        for x in alphabet:
            for middle, s2 in a.arcs[s][x]:
                for out, t2 in b.arcs[t][middle]:
                    arcs.append(((s, t), x, out, (s2, t2)))
                    if (s2, t2) not in seen:
                        seen.add((s2, t2))
                        left.append((s2, t2))
    return Transducer(starts, [(s, t) for s, t in seen if s in a.finals and t in b.finals], arcs)
