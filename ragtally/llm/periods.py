"""Suffix automaton with link-cut access (operator 12): runs of a word sequence.

A state of the automaton stands for the strings that end at the same places; its suffix link leads to the longest
shorter suffix that ends elsewhere too.  The tree of suffix links is kept as preferred paths, each a splay tree
(ordered by depth) whose root carries a colour: the last place at which the path's strings ended.  When word i is
appended, the path from its state to the root is accessed: each segment of one colour e holds suffixes, the longest of
length h, that ended at e before, so the words i-e back are repeated: with q = i - e and h >= q the last h + q words
have period q, which is their smallest.  Segments long enough are extended to both sides to the full run; then the
whole path takes colour i.  The number of segments met is O(n log n) in all.

A run of length n >= LEAST_LENGTH and n >= EXPONENT * q has, at its end, a suffix of n - q >= GRAM words that ended q
before.  So states of strings shorter than GRAM are never accessed, and only stretches of a text whose GRAM-word
strings recur near enough (:func:`stretches`) are appended at all; both leave out nothing.
"""

from __future__ import annotations

import numpy as np

LEAST_LENGTH = 24
EXPONENT = 3
#: Least length of the repeated part of a run: (EXPONENT - 1) / EXPONENT of its least length.
GRAM = LEAST_LENGTH * (EXPONENT - 1) // EXPONENT

_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))  # odd mixing constants


class _Automaton:
    """Suffix automaton of a growing sequence; :meth:`append` gives the recoloured segments."""

    def __init__(self) -> None:
        # state 0 is none, state 1 the root (the empty string)
        self.length, self.link, self.next = [0, 0], [0, 0], [{}, {}]
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.whole = 1

    def _state(self, length: int, follow: dict) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append(follow)
        for a in (self.left, self.right, self.up):
            a.append(0)
        self.colour.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        """Make x the root of its path's splay tree; the colour moves along."""
        left, right, up, colour = self.left, self.right, self.up, self.colour
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            turns = (x,)
            if g and (left[g] == p or right[g] == p):
                turns = (p, x) if (left[g] == p) == (left[p] == x) else (x, x)
            for y in turns:
                p = up[y]
                g = up[p]
                if left[p] == y:
                    c = right[y]
                    left[p], right[y] = c, p
                else:
                    c = left[y]
                    right[p], left[y] = c, p
                if c:
                    up[c] = p
                if g and left[g] == p:
                    left[g] = y
                elif g and right[g] == p:
                    right[g] = y
                else:
                    colour[y] = colour[p]
                up[y], up[p] = g, y

    def _grow(self, word) -> int:
        """State of the whole sequence after the word, its link set."""
        length, link, follow = self.length, self.link, self.next
        now = self._state(length[self.whole] + 1, {})
        p = self.whole
        self.whole = now
        while p and word not in follow[p]:
            follow[p][word] = now
            p = link[p]
        if not p:
            link[now] = 1
            return now
        q = follow[p][word]
        if length[q] != length[p] + 1:
            clone = self._state(length[p] + 1, dict(follow[q]))
            link[clone], link[q] = link[q], clone
            while p and follow[p].get(word) == q:
                follow[p][word] = clone
                p = link[p]
            # the clone's strings ended where q's did: it joins q's path, right above q
            self._splay(q)
            if above := self.left[q]:
                self.left[clone], self.up[above] = above, clone
            self.left[q], self.up[clone] = clone, q
            q = clone
        link[now] = q
        return now

    def append(self, word, i: int, least: int) -> list[tuple[int, int]]:
        """Append word i; the segments (last end, greatest length) of suffixes of `least` words or more that ended before."""
        last = self._grow(word)
        right, up, colour, length = self.right, self.up, self.colour, self.length
        u = up[last] = self.link[last]
        met = []
        while length[u] >= least:
            self._splay(u)
            met.append((colour[u], length[u]))
            if below := right[u]:
                colour[below] = colour[u]
            right[u] = last
            last, u = u, up[u]
        colour[last] = i
        return met


def _agree(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words ids[a], ids[a + step], ... equal ids[b], ids[b + step], ... (b < a) before one differs or the text ends."""
    most = len(ids) - a if step > 0 else b + 1
    done, size = 0, 32
    while done < most:
        k = min(size, most - done)
        if step > 0:
            same = ids[a + done:a + done + k] == ids[b + done:b + done + k]
        else:
            same = (ids[a - done - k + 1:a - done + 1] == ids[b - done - k + 1:b - done + 1])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, size = done + k, size * 2
    return done


def runs_within(ids: np.ndarray, lo: int, hi: int, least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of ids that lie in [lo, hi): smallest period q, at least max(least, exponent * q) long,
    extended to the full sequence."""
    gram = -(-least * (exponent - 1) // exponent)
    automaton, reached, found = _Automaton(), {}, []
    for i, word in enumerate(ids[lo:hi].tolist(), lo):
        for end, size in automaton.append(word, i, gram):
            q = i - end
            if size >= (exponent - 1) * q and size + q >= least and reached.get(q, -1) < i:
                start = i - size - q + 1
                start -= _agree(ids, start - 1 + q, start - 1, -1)
                reached[q] = i + _agree(ids, i + 1, i + 1 - q, 1)
                found.append((start, reached[q] - start + 1, q))
    return found


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Disjoint parts [lo, hi) of a text outside which no run lies.

    Within a run of period q every GRAM-word string that ends q + GRAM - 1 or more words after its start ended at most
    q words before as well.  So a run needs consecutive ends of recurring strings, 2q - GRAM + 1 or more of them, one
    with a distance of at most q."""
    n = len(words) - GRAM + 1
    if n < 2:
        return []
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)  # compared within this text only
    width = 1
    while width < GRAM:  # strings of twice the words; the last step overlaps if GRAM is no power of two
        step = min(width, GRAM - width)
        h = (h[:len(h) - step] * _MULTIPLY[0]) ^ (h[step:] + (h[:len(h) - step] >> np.uint64(29)))
        h = (h ^ (h >> np.uint64(32))) * _MULTIPLY[1]
        width += step
    order = np.argsort(h, kind="stable")
    again = h[order[1:]] == h[order[:-1]]
    if not again.any():
        return []
    back = np.zeros(n, dtype=np.int64)  # distance to the last place of the same string, 0 if there is none
    back[order[1:][again]] = (order[1:] - order[:-1])[again]
    recurs = np.flatnonzero(back)
    new = np.concatenate(([True], np.diff(recurs) > 1))
    first = recurs[new]
    last = recurs[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(recurs) - 1]))]
    near = np.minimum.reduceat(back[recurs], np.flatnonzero(new))
    widest = (last - first + 1 + GRAM - 1) // 2  # the greatest period that a run here can have
    out: list[tuple[int, int]] = []
    for a, b, q in zip(first[near <= widest].tolist(), last[near <= widest].tolist(), widest[near <= widest].tolist(), strict=True):
        lo, hi = max(0, a - q), b + GRAM
        if out and lo <= out[-1][1]:
            lo = out.pop()[0]
        out.append((lo, hi))
    return out


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text's words, by start, then period."""
    parts = stretches(words)
    if not parts:
        return []
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    return sorted(r for lo, hi in parts for r in runs_within(ids, lo, hi))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not gone]
