"""Minimal acyclic automata with numbered words, and the words within one error of another in a window of places."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a word's number is its place among them (a perfect hash).

    Built a word at a time: what no later word can change is frozen from its end, and states with one right language are one. A
    transition holds its target and how many words of the state come before those through it.
    """

    def __init__(self, words: Iterable[str]):
        self.final: list[bool] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.count: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[str, dict[str, int], list[bool]]] = [("", {}, [False])]
        last = ""

        def frozen(below: dict[str, int], final: bool) -> int:
            key = (final, *below.items())
            if (state := known.get(key)) is None:
                state = known[key] = len(self.next)
                before, to = int(final), {}
                for c, t in below.items():
                    to[c] = (t, before)
                    before += self.count[t]
                self.final.append(final)
                self.next.append(to)
                self.count.append(before)
            return state

        def freeze(depth: int) -> None:
            while len(path) > depth + 1:
                c, below, final = path.pop()
                path[-1][1][c] = frozen(below, final[0])

        for w in words:
            k = 0
            for a, b in zip(w, last, strict=False):
                if a != b:
                    break
                k += 1
            freeze(k)
            path += [(c, {}, [False]) for c in w[k:]]
            path[-1][2][0] = True
            last = w
        freeze(0)
        self.root = frozen(path[0][1], path[0][2][0])

    def number(self, word: str, state: int | None = None, at: int = 0) -> int:
        """The word's number, or -1; from a state on, with at words before it."""
        state = self.root if state is None else state
        for c in word:
            if (to := self.next[state].get(c)) is None:
                return -1
            state, more = to
            at += more
        return at if self.final[state] else -1

    def forward(self, u: str, a: int, b: int) -> Iterator[tuple[int, bool]]:
        """(number, longer) of the words that first differ from u at a place from a to b - 1, there by a replaced character or (longer) an inserted one."""
        state, at = self.root, 0
        for c in u[:a]:
            if (to := self.next[state].get(c)) is None:
                return
            state, at = to[0], at + to[1]
        for e in range(a, b):
            own = u[e] if e < len(u) else None
            for c, (t, more) in self.next[state].items():
                if c != own:
                    if own is not None and (k := self.number(u[e + 1 :], t, at + more)) >= 0:
                        yield k, False
                    if (k := self.number(u[e:], t, at + more)) >= 0:
                        yield k, True
            if own is None or (to := self.next[state].get(own)) is None:
                return
            state, at = to[0], at + to[1]

    def backward(self, u: str, a: int, b: int) -> Iterator[tuple[int, bool]]:
        """The same in an automaton of reversed words, for b up to the length of u; numbers are those of the reversed words."""
        r, n = u[::-1], len(u)
        state, at = self.root, 0
        for c in r[: n - b]:
            if (to := self.next[state].get(c)) is None:
                return
            state, at = to[0], at + to[1]
        for e in range(b - 1, a - 1, -1):
            own, rest = u[e], r[n - e :]
            for c, (t, more) in self.next[state].items():
                if c != own and (k := self.number(rest, t, at + more)) >= 0:
                    yield k, False
            if (to := self.next[state].get(own)) is None:
                return
            state, at = to[0], at + to[1]
            for c, (t, more) in self.next[state].items():
                if c != own and (k := self.number(rest, t, at + more)) >= 0:
                    yield k, True
