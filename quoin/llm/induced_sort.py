"""Suffix sorting in external memory by recursive induction, with common prefixes.

A suffix is *S* if it is smaller than its successor, else *L*; an S suffix after an L one is *LMS*.  One level does this:

1. every LMS suffix sends the tuple (symbols up to the next LMS, position) through a queue; equal symbol strings get
   equal names, in sorted order, and neighbouring names what they have in common at the beginning;
2. if names repeat, the string of names is sorted by recursion, which ranks the LMS suffixes (a third of all, or fewer)
   and hands back what neighbours have in common, in bytes;
3. every suffix sends (symbols up to the next LMS, rank of what follows, position) through a queue: the order in which
   the tuples come out is induced from the ranks of the LMS suffixes, and is the suffix array.  What neighbours have in
   common is read off their symbols, or, if these are equal, is induced from the common prefixes of the LMS suffixes
   that follow: the least between their ranks.

A symbol carries its suffix's type in its lowest bit, so a string that ends at an LMS is never the start of another.
Strings longer than a tuple's word are ranked in turns, each from the ranks that the turn before gave to the rests.

The queues keep RUN tuples in memory; more are written as sorted runs to an unlinked scratch file of the one task that
sorts (as Spark's own sorter spills) and come back by a block-wise multiway merge.  Nothing stays after the task.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples (24 bytes each) that a queue holds in memory.
RUN = 400_000
BLOCK = 65_536


def _dense(values):
    """Dense ranks from 0."""
    order = np.argsort(values)
    at = values[order]
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.concatenate([[0], np.cumsum(at[1:] != at[:-1])]) if len(at) else 0
    return out


def _order(key, rank):
    """The order of (key, rank); ranks are under 2**31.  Only keys that tie are sorted again."""
    order = np.argsort(key)
    at = key[order]
    same = at[1:] == at[:-1]
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    if len(tied):
        group = np.concatenate([[0], np.cumsum(~same)])[tied]
        order[tied] = order[tied][np.argsort(group << 31 | rank[order[tied]])]
    return order


class TupleQueue:
    """A priority queue of (key, rank, position): push blocks, then pop blocks in order."""

    def __init__(self, run: int = RUN):
        self.run, self.held, self.size = run, [], 0
        self.file, self.runs = None, []

    def push(self, key, rank, position) -> None:
        for at in range(0, len(key), self.run):
            part = np.stack([key[at : at + self.run], rank[at : at + self.run], position[at : at + self.run]], axis=1).astype(np.int64, copy=False)
            if self.size and self.size + len(part) > self.run:
                self._spill()
            self.held.append(part)
            self.size += len(part)

    def _sorted(self):
        rows = np.concatenate(self.held) if len(self.held) != 1 else self.held[0]
        self.held, self.size = [], 0
        return rows[_order(rows[:, 0], rows[:, 1])]

    def _spill(self) -> None:
        rows = self._sorted()
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        self.runs.append((self.file.tell(), len(rows)))
        rows.tofile(self.file)

    def pop(self):
        """Blocks of rows in the order of (key, rank)."""
        if not self.runs:
            if self.held:
                yield self._sorted()
            return
        if self.held:
            self._spill()
        heads = [np.zeros((0, 3), dtype=np.int64) for _ in self.runs]
        left = [list(r) for r in self.runs]
        while True:
            for i, (at, n) in enumerate(left):
                if not len(heads[i]) and n:
                    take = min(n, BLOCK)
                    self.file.seek(at)
                    heads[i] = np.fromfile(self.file, dtype=np.int64, count=3 * take).reshape(-1, 3)
                    left[i] = [at + 24 * take, n - take]
            if not any(len(h) for h in heads):
                self.file.close()
                return
            # Nothing unread is smaller than the least of the last rows in memory.
            bound = min((h[-1, 0], h[-1, 1]) for i, h in enumerate(heads) if len(h))
            out = []
            for i, h in enumerate(heads):
                if len(h):
                    low = np.searchsorted(h[:, 0], bound[0], "left")
                    high = np.searchsorted(h[:, 0], bound[0], "right")
                    n = low + np.searchsorted(h[low:high, 1], bound[1], "right")
                    out.append(h[:n])
                    heads[i] = h[n:]
            rows = np.concatenate(out)
            yield rows[_order(rows[:, 0], rows[:, 1])]


def _types(text):
    """True where a suffix is S; the last symbol is the only smallest one."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    rising = text[change] < text[change + 1]
    out = np.ones(n, dtype=bool)
    out[:-1] = np.repeat(rising, np.diff(np.concatenate([[-1], change])))
    return out


def _keys(symbols, next_lms, at, width: int, bits: int):
    """The first `width` symbols from each position up to its next LMS, which is included, in one word."""
    key = np.zeros(len(at), dtype=np.int64)
    last = len(symbols) - 1
    for k in range(width):
        inside = at + k <= next_lms
        key = (key << bits) | np.where(inside, symbols[np.minimum(at + k, last)], 0)
    return key


class LeastBetween:
    """Least of the values after one index up to another, by tables of stretches of doubling length."""

    def __init__(self, values):
        self.tables = [np.asarray(values)]
        while 2 << len(self.tables) - 1 <= len(values):
            last, half = self.tables[-1], 1 << len(self.tables) - 1
            self.tables.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low, high):
        """min(values[low + 1 .. high]) for arrays low < high."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.tables[k]
            out[at] = np.minimum(table[low[at] + 1], table[high[at] - (1 << int(k)) + 1])
        return out


def _runs_left(text):
    """How many equal symbols there are from each position on."""
    n = len(text)
    last = np.concatenate([np.flatnonzero(text[:-1] != text[1:]), [n - 1]])
    return last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1


def suffix_array(text, run: int = RUN, limit: int | None = None, place=None, inside=None):
    """(order, common) of an integer array whose last symbol is its only smallest; at least 0.

    order: positions of the sorted suffixes.  common: what each has in common with the one before it, `limit` at most.
    It is counted in places: `place` of each position (by default its index); inside(a, b) is what two different symbols
    have in common at their beginning (by default nothing).
    """
    text = np.asarray(text, dtype=np.int64)
    n = len(text)
    place = np.arange(n) if place is None else place
    limit = n + int(place[-1]) + 1 if limit is None else limit
    inside = inside or (lambda a, b: np.zeros(len(a), dtype=np.int64))
    if n <= 2:
        return np.arange(n)[::-1].copy(), np.zeros(n, dtype=np.int64) if n < 2 else np.array([0, min(limit, int(inside(text[1:], text[:1])[0]))])
    small = _types(text)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    symbols = 2 * text + small
    bits = int(symbols.max()).bit_length() + 1
    width = 62 // bits
    everywhere = np.arange(n)
    # The first LMS after each position; the last symbol stands for its own.
    ahead = np.concatenate([lms, [n - 1]])[np.minimum(np.searchsorted(lms, everywhere, "right"), len(lms))]
    keys = _keys(symbols, ahead, everywhere, width, bits)
    # A longer string goes on in a second word that starts with this one's last symbol, so each word's end is plain.
    step = width - 1
    turns = np.maximum((ahead - everywhere + step - 1) // step, 1)
    left = _runs_left(text)

    def differ_at(a, b, at):
        """Places in common of suffixes a and b, whose symbols with types are equal before `at` and differ there."""
        x, y = a + at, b + at
        same = text[x] == text[y]  # but for the type: one run of them ends before or goes up where the other goes down
        more = np.where(same, np.minimum(left[x], left[y]), 0)
        x, y = x + more, y + more
        return np.minimum(limit, place[x] - place[a] + inside(text[x], text[y]))

    def words_differ(a, b):
        """The first of the width symbols in which the different words of a and b differ."""
        top = np.frexp((keys[a] ^ keys[b]).astype(np.float64))[1] - 1
        top -= (keys[a] ^ keys[b]) < (np.int64(1) << top)  # a float may round up
        return width - 1 - top // bits

    def names_of(positions, follow):
        """Dense ranks of (key, follow) over positions in the queue's order, and a position of each rank."""
        queue, rank, first = TupleQueue(run), np.zeros(n, dtype=np.int64), []
        queue.push(keys[positions], follow[positions], positions)
        last, name = None, -1
        for rows in queue.pop():
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
            if last is not None:
                new[0] = tuple(rows[0, :2]) != last
            names = name + np.cumsum(new)
            rank[rows[:, 2]] = names
            first.append(rows[new, 2])
            name, last = int(names[-1]), tuple(rows[-1, :2])
        return rank, np.concatenate(first)

    def follow_of(base):
        """What a tuple's word is followed by: base at the next LMS, or the rank of the rest, a turn shorter."""
        follow = np.zeros(n, dtype=np.int64)
        near = turns == 1
        follow[near] = base[ahead[near]]
        far = np.flatnonzero(~near)
        if not len(far):
            return follow
        # Strings of several words: ranks of the rests by doubling; after k rounds a rank covers 2**k words.
        some = np.unique(np.concatenate([far, far + step]))
        spot = np.zeros(n, dtype=np.int64)
        spot[some] = np.arange(len(some))
        over = len(some)
        jump = np.where(near[some], over, spot[np.minimum(some + step, n - 1)])
        rank = np.append(_dense(_dense(keys[some]) << 31 | np.where(near[some], follow[some], 0)) + 1, 0)
        jump = np.append(jump, over)
        while (jump[:-1] != over).any():
            rank[:-1] = _dense(rank[:-1] << 31 | rank[jump[:-1]]) + 1
            jump = jump[jump]
        follow[far] = rank[spot[far + step]]
        return follow

    def common_of(a, b, tail):
        """Places in common of suffixes a and b; tail(a, b) if both are equal up to and with their next LMS."""
        out = np.zeros(len(a), dtype=np.int64)
        offset = np.zeros(len(a), dtype=np.int64)  # symbols of whole words, but for the last
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_] + offset[open_], b[open_] + offset[open_]
            other = keys[x] != keys[y]
            at = open_[other]
            out[at] = differ_at(a[at], b[at], offset[at] + words_differ(x[other], y[other]))
            ends = ~other & (turns[x] == 1)
            at = open_[ends]
            if len(at):
                out[at] = np.minimum(limit, place[ahead[x[ends]]] - place[a[at]] + tail(ahead[x[ends]], ahead[y[ends]]))
            more = ~other & ~ends
            open_ = open_[more]
            offset[open_] += step
            full = place[a[open_] + offset[open_]] - place[a[open_]] >= limit
            out[open_[full]] = limit
            open_ = open_[~full]
        return out

    nothing = follow_of(np.zeros(n, dtype=np.int64))
    names, first = names_of(lms, nothing)
    reduced = names[lms]
    # What neighbouring names have in common: the words differ somewhere, so their tails are never asked for.
    of_names = np.concatenate([[0], common_of(first[:-1], first[1:], lambda x, y: np.zeros(len(x), dtype=np.int64))])
    between = LeastBetween(of_names)
    if len(first) == len(lms):
        sorted_lms, of_lms = first, of_names
    else:
        order, of_lms = suffix_array(reduced, run, limit, place[lms], lambda a, b: between(np.minimum(a, b), np.maximum(a, b)))
        sorted_lms = lms[order]
    rank = np.zeros(n, dtype=np.int64)
    rank[sorted_lms] = np.arange(len(lms))
    least = LeastBetween(of_lms)
    follow = follow_of(rank + 1)
    follow[n - 1] = 0
    queue = TupleQueue(run)
    queue.push(keys, follow, everywhere)
    out, common, last = [], [], None
    for rows in queue.pop():
        now = rows[:, 2]
        before = now[:-1] if last is None else np.concatenate([last, now[:-1]])
        shared = common_of(before, now[len(now) - len(before) :], lambda x, y: least(rank[x], rank[y]))
        common.append(shared if last is not None else np.concatenate([[0], shared]))
        out.append(now)
        last = now[-1:]
    return np.concatenate(out), np.concatenate(common)


def repeated_starts(strings: list[bytes], length: int, run: int = RUN) -> list:
    """For each string a boolean array: whether the `length` bytes from this start also start anywhere else here."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    # 0 ends the text, 1 ends a string, bytes follow; `data` has the bytes themselves.
    data = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    text = data.astype(np.int64) + 2
    text[begins + sizes] = 1
    ends = np.repeat(begins + sizes, sizes + 1)
    order, common = suffix_array(np.concatenate([text, [0]]), run, length)
    # Of neighbours that share `length` bytes both are repeated, if both have them before the ends of their strings.
    left = np.append(ends, 0)[order] - order
    good = (common[1:] >= length) & (left[1:] >= length) & (left[:-1] >= length)
    found = np.zeros(len(text) + 1, dtype=bool)
    found[order[1:][good]] = True
    found[order[:-1][good]] = True
    return [found[b : b + max(0, s - length + 1)] for b, s in zip(begins, sizes)]
