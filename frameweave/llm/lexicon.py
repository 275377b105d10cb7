"""A minimal acyclic transducer: frequent words to token ids.

Words are byte strings.  States with the same continuations are one state
(shared suffixes), built from the sorted words in one pass.  Every arc carries
the number of words that come before it in its state, so the sum along a word's
path is the word's place in sorted order; the ids stand there.  The whole is one
flat file of 32-bit numbers that is memory-mapped by all workers of a machine.

File: magic, states, arcs, words, ids; then per state its first arc (one more at
the end) and whether a word ends there, per arc its byte, target and skip, per
word its first id (one more at the end), and the ids.
"""

from __future__ import annotations

import mmap
from array import array

MAGIC = 0x4D415431


class _Builder:
    """Incremental construction from sorted words (Daciuk et al. 2000)."""

    def __init__(self) -> None:
        self.final: list[bool] = [False]
        self.arcs: list[dict[int, int]] = [{}]
        self.known: dict[tuple, int] = {}
        self.path: list[tuple[int, int, int]] = []  # parent, byte, child not yet shared
        self.last = b""

    def add(self, word: bytes) -> None:
        common = 0
        for x, y in zip(word, self.last):
            if x != y:
                break
            common += 1
        self._share(common)
        at = self.path[-1][2] if self.path else 0
        for byte in word[common:]:
            self.final.append(False)
            self.arcs.append({})
            new = len(self.final) - 1
            self.arcs[at][byte] = new
            self.path.append((at, byte, new))
            at = new
        self.final[at] = True
        self.last = word

    def _share(self, down_to: int) -> None:
        while len(self.path) > down_to:
            parent, byte, child = self.path.pop()
            sign = (self.final[child], tuple(sorted(self.arcs[child].items())))
            same = self.known.setdefault(sign, child)
            self.arcs[parent][byte] = same

    def done(self) -> None:
        self._share(0)


def build(entries: dict[bytes, list[int]]) -> bytes:
    """The file's content for words with their ids (any number of ids a word, the empty word excluded)."""
    words = sorted(w for w in entries if w)
    b = _Builder()
    for w in words:
        b.add(w)
    b.done()
    order, seen, stack = [], set(), [0]
    while stack:
        s = stack.pop()
        if s not in seen:
            seen.add(s)
            order.append(s)
            stack.extend(b.arcs[s].values())
    number = {s: i for i, s in enumerate(order)}
    count: dict[int, int] = {}

    def below(state: int) -> int:
        todo = [state]
        while todo:
            s = todo[-1]
            open_ = [t for t in b.arcs[s].values() if t not in count]
            if open_:
                todo.extend(open_)
            else:
                todo.pop()
                count[s] = int(b.final[s]) + sum(count[t] for t in b.arcs[s].values())
        return count[state]

    below(0)
    first, final, label, target, skip = array("i"), array("i"), array("i"), array("i"), array("i")
    for s in order:
        first.append(len(label))
        final.append(int(b.final[s]))
        before = int(b.final[s])
        for byte, t in sorted(b.arcs[s].items()):
            label.append(byte)
            target.append(number[t])
            skip.append(before)
            before += count[t]
    first.append(len(label))
    starts, ids = array("i", [0]), array("i")
    for w in words:
        ids.extend(entries[w])
        starts.append(len(ids))
    head = array("i", [MAGIC, len(order), len(label), len(words), len(ids)])
    return b"".join(a.tobytes() for a in (head, first, final, label, target, skip, starts, ids))


class Lexicon:
    """Read access to a built file: ``lookup(word)`` gives the ids or None."""

    def __init__(self, data) -> None:
        v = memoryview(data).cast("i")
        if v[0] != MAGIC:
            raise ValueError("not a lexicon")
        n, m, w, k = v[1], v[2], v[3], v[4]
        at = 5
        parts = []
        for size in (n + 1, n, m, m, m, w + 1, k):
            parts.append(v[at : at + size])
            at += size
        self.first, self.final, self.label, self.target, self.skip, self.starts, self.ids = parts
        self.states, self.arcs, self.words = n, m, w

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, word: bytes) -> list[int] | None:
        first, label, s, place = self.first, self.label, 0, 0
        for byte in word:
            lo, hi = first[s], first[s + 1]
            while lo < hi:
                mid = (lo + hi) >> 1
                if label[mid] < byte:
                    lo = mid + 1
                else:
                    hi = mid
            if lo >= first[s + 1] or label[lo] != byte:
                return None
            place += self.skip[lo]
            s = self.target[lo]
        if not self.final[s] or not word:
            return None
        return self.ids[self.starts[place] : self.starts[place + 1]].tolist()
