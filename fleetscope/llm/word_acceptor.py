"""A minimised acceptor of words, and its composition with a one-edit transducer and itself."""

from __future__ import annotations

from collections.abc import Iterator


class Acceptors:
    """Minimal acyclic acceptors that share their states."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        self._known: dict[tuple, int] = {}

    def add(self, words: list[str]) -> int:
        """The initial state of the acceptor of these words, which are distinct and in order."""
        root: tuple[dict[str, int], list[bool]] = ({}, [False])
        open_states = [root]
        before = ""
        for word in words:
            shared = 0
            while shared < min(len(before), len(word)) and before[shared] == word[shared]:
                shared += 1
            self._close(open_states, before, shared)
            for _ in word[shared:]:
                open_states.append(({}, [False]))
            open_states[-1][1][0] = True
            before = word
        self._close(open_states, before, 0)
        return self._state(*root)

    def _close(self, open_states: list, word: str, down_to: int) -> None:
        """States below this depth get no further words: each becomes the one state with its future."""
        while len(open_states) > down_to + 1:
            state = self._state(*open_states.pop())
            open_states[-1][0][word[len(open_states) - 1]] = state

    def _state(self, arcs: dict[str, int], final: list[bool]) -> int:
        key = (final[0], tuple(arcs.items()))
        at = self._known.get(key)
        if at is None:
            at = self._known[key] = len(self.next)
            self.next.append(arcs)
            self.final.append(final[0])
        return at

    def common(self, a: int, b: int, without: str = "") -> Iterator[str]:
        """What both states accept, but nothing that begins with ``without``."""
        stack = [(a, b, "")]
        while stack:
            a, b, read = stack.pop()
            if self.final[a] and self.final[b]:
                yield read
            other = self.next[b]
            for letter, state in self.next[a].items():
                if letter in other and (read or letter != without):
                    stack.append((state, other[letter], read + letter))


def one_edit_pairs(words: list[str], longer: list[str], width: int, open_end: bool) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart whose common start is shorter than ``width`` (of any length, if ``open_end``).

    Two of ``words``, all of one length, that differ by a replaced letter; or one of ``words`` and one of
    ``longer``, which has a letter more. The acceptor of ``words`` is composed with the transducer of one edit and the acceptor
    of either list: before the edit both sides read the same letters, at the edit they part, and after it they
    read the same again. The edit stands where the two first differ, so a pair is accepted once.
    """
    accept = Acceptors()
    start = accept.add(sorted(words))
    start_longer = accept.add(sorted(longer))
    stack = [(start, start_longer, "")]
    while stack:
        state, wide, read = stack.pop()
        arcs, wide_arcs = accept.next[state], accept.next[wide]
        letters = sorted(arcs)
        for i, a in enumerate(letters):
            for b in letters[i + 1:]:
                for rest in accept.common(arcs[a], arcs[b]):
                    yield read + a + rest, read + b + rest
        for extra, after in wide_arcs.items():
            for rest in accept.common(state, after, extra):
                yield read + rest, read + extra + rest
        if open_end or len(read) + 1 < width:
            # State 0 accepts nothing.
            stack.extend((arcs[a], wide_arcs.get(a, 0), read + a) for a in letters)
