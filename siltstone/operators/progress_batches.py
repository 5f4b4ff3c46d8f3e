"""R2 over many reviews at once: what `Partial` tells after each chunk, from the places of quotes, brackets and commas in a batch's bytes.

All marks of a batch are found in one look-up, and every step after it is an
array operation over them: which are inside strings, how deep each stands,
which strings are keys, where findings begin and end. A row then looks up what
was before its end. Text counts as bytes, as every mark is ASCII.

Reviews that hold what needs the parser itself are told as such and are read by
it: a backslash outside strings, one within a key or a word that counts, and an
empty key of a finding.
"""

from __future__ import annotations

import numpy as np

QUOTE, BACKSLASH, OBJECT, ARRAY, CLOSE, COMMA, COLON = range(1, 8)
#: Bytes that must follow the text, as words are compared by 16 bytes at once.
PADDING = 24
NEVER = np.iinfo(np.int64).max
_KIND = np.zeros(256, np.uint8)
for _kind, _chars in ((QUOTE, b'"'), (BACKSLASH, b"\\"), (OBJECT, b"{"), (ARRAY, b"["), (CLOSE, b"}]"), (COMMA, b","), (COLON, b":")):
    _KIND[list(_chars)] = _kind
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _codes(data: np.ndarray, start: np.ndarray, length: np.ndarray, known: dict[str, int], other: int) -> np.ndarray:
    """The code of the known word (16 bytes at most) that stands at each place in this length."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    head, tail = eight[start] & _FIRST[np.minimum(length, 8)], eight[start + 8] & _FIRST[np.clip(length - 8, 0, 8)]
    out = np.full(len(start), other, np.int64)
    for word, code in known.items():
        raw = word.encode().ljust(16, b"\0")
        out[(length == len(word)) & (head == np.uint64(int.from_bytes(raw[:8], "little"))) & (tail == np.uint64(int.from_bytes(raw[8:], "little")))] = code
    return out


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums before each place, and of all."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values.astype(np.int64), out=out[1:])
    return out


def _at(values: np.ndarray, i: np.ndarray, other: int) -> np.ndarray:
    """values[i], and the other for -1."""
    return np.append(values, np.array([other], values.dtype))[i]


def _last(where: np.ndarray) -> np.ndarray:
    """The last place up to each at which it holds, or -1."""
    return np.maximum.accumulate(np.where(where, np.arange(len(where)), -1))


class Reviews:
    """Reviews that follow each other in `data`, which ends in PADDING zeros: `offsets` of their chunks (one more than chunks), `first` chunk of each. `special` says which need the parser."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: np.ndarray, categories: dict[str, int], severities: dict[str, int], default: int):
        self.data, self.ends, self.first = data, offsets[1:], first
        begin, self.stop = offsets[first], np.append(offsets[first[1:]], offsets[-1])
        self.special = np.zeros(len(first), bool)
        pos = np.flatnonzero(_KIND[data[: offsets[-1]]])
        kind = _KIND[data[pos]]
        head = np.searchsorted(pos, begin)
        sizes = np.diff(np.append(head, len(pos)))
        review = np.repeat(np.arange(len(first)), sizes)
        quote, slash = _unescaped(pos, kind, review), kind == BACKSLASH
        within = np.append(False, np.logical_xor.accumulate(quote))
        inside = within[:-1] ^ np.repeat(within[head], sizes)
        self.special[review[slash & ~inside]] = True
        self._structure(pos, kind, review, head, (kind >= OBJECT) & ~inside)
        self._strings(pos, review, np.append(head[1:], len(pos)), quote, slash, inside)
        self._findings()
        self._values({"category": categories, "severity": severities}, {"category": 0, "severity": default})

    def _structure(self, pos, kind, review, head, outside) -> None:
        """Marks outside strings, with the depth after each; where each review is done."""
        s = np.flatnonzero(outside)
        self.s_before = _sums(outside)
        self.s_pos, self.s_kind, self.s_review, self.s_head = pos[s], kind[s], review[s], self.s_before[head]
        self.up, down = (self.s_kind == OBJECT) | (self.s_kind == ARRAY), self.s_kind == CLOSE
        moved = _sums(self.up.astype(np.int64) - down)
        self.depth = moved[1:] - moved[self.s_head][self.s_review]
        over = np.flatnonzero(down & (self.depth <= 0))[::-1]
        self.done = np.full(len(self.first), NEVER)
        self.done[self.s_review[over]] = self.s_pos[over]  # from the last to the first, which stays
        self.third = _last(self.up & (self.depth == 3))
        self.in_object = self.s_kind[self.third] == OBJECT

    def _strings(self, pos, review, tail, quote, slash, inside) -> None:
        """Strings at depth 1, and at depth 3 within objects: their text, the mark before them, whether they are keys."""
        q = np.flatnonzero(quote)
        opens = np.flatnonzero(~inside[q])
        o = q[opens]
        c = np.append(q, -1)[opens + 1]
        r, j = review[o], self.s_before[o] - 1
        near = np.flatnonzero(j >= self.s_head[r])
        depth = self.depth[j[near]]
        near = near[((depth == 1) | ((depth == 3) & self.in_object[j[near]])) & (pos[o[near]] < self.done[r[near]])]
        o, c, self.r, self.j = o[near], c[near], r[near], j[near]
        self.closed = (c >= 0) & (c < tail[self.r])
        self.start, self.to = pos[o] + 1, np.where(self.closed, _at(pos, c, 0), self.stop[self.r])
        slashes = _sums(slash)
        self.slashed = slashes[np.where(self.closed, c, tail[self.r])] > slashes[o]
        self.d, before = self.depth[self.j], self.s_kind[self.j]
        self.is_key = (before == OBJECT) | (before == COMMA)
        self.special[self.r[self.is_key & self.slashed]] = True

    def _findings(self) -> None:
        root = np.flatnonzero(self.is_key & (self.d == 1) & self.closed)
        named = _codes(self.data, self.start[root], self.to[root] - self.start[root], {"findings": 1}, 0)
        second = np.flatnonzero(self.up & (self.depth == 2))
        x = np.searchsorted(self.to[root], self.s_pos[second]) - 1
        listed = (self.s_kind[second] == ARRAY) & (_at(self.r[root], x, -1) == self.s_review[second]) & (_at(named, x, 0) == 1)
        f = np.flatnonzero((self.s_kind == OBJECT) & (self.depth == 3) & (self.s_pos < self.done[self.s_review]))
        self.f = f = f[_at(listed, np.searchsorted(second, f) - 1, 0)]
        self.f_pos, self.f_review = self.s_pos[f], self.s_review[f]
        ends = np.flatnonzero((self.s_kind == CLOSE) & (self.depth == 2))
        y = np.searchsorted(ends, f)
        self.f_end = np.where(np.append(self.s_review[ends], -1)[y] == self.f_review, np.append(self.s_pos[ends], NEVER)[y], self.stop[self.f_review])

    def _values(self, known: dict[str, dict[str, int]], other: dict[str, int]) -> None:
        """The words that count, by field: where they are, whose, and their codes; and the codes that findings have when they end."""
        reset = _last((self.depth == 3) & ((self.s_kind == COMMA) | (self.s_kind == OBJECT)))
        keys = np.flatnonzero(self.is_key & (self.d == 3) & self.closed)
        self.special[self.r[keys[self.to[keys] == self.start[keys]]]] = True
        names = _codes(self.data, self.start[keys], self.to[keys] - self.start[keys], {n: i for i, n in enumerate(known)}, -1)
        found = np.zeros(len(self.s_pos), bool)
        found[self.f] = True
        v = np.flatnonzero(~self.is_key & (self.d == 3))
        v = v[found[self.third[self.j[v]]]]
        k = np.searchsorted(keys, v) - 1
        field = np.where(_at(self.j[keys], k, -1) == reset[self.j[v]], _at(names, k, -1), -1)
        self.special[self.r[v[self.slashed[v] & (field >= 0)]]] = True
        self.words, self.final = {}, {}
        for i, name in enumerate(known):
            w = v[field == i]
            start, to, owner = self.start[w], self.to[w], np.searchsorted(self.f, self.j[w], "right") - 1
            codes = _codes(self.data, start, to - start, known[name], other[name])
            self.words[name] = start, to, owner, codes, known[name], other[name]
            z = np.searchsorted(start, self.f_end, "right") - 1
            self.final[name] = np.where(_at(owner, z, -1) == np.arange(len(self.f)), _at(codes, z, 0), other[name])

    def _standing(self, name: str, rows: np.ndarray, finding: np.ndarray) -> np.ndarray:
        """The code of the open finding's word at the end of each row, a word being written as far as it is there."""
        start, to, owner, codes, known, other = self.words[name]
        ends = self.ends[rows]
        x = np.searchsorted(start, ends, "right") - 1
        mine = _at(owner, x, -1) == finding
        out = np.where(mine, _at(codes, x, 0), other)
        cut = np.flatnonzero(mine & (_at(to, x, 0) >= ends))
        out[cut] = _codes(self.data, start[x[cut]], ends[cut] - start[x[cut]], known, other)
        return out

    def told(self) -> tuple[np.ndarray, ...]:
        """After each chunk: findings, complete ones, deduction, findings by category 1 to 3, done."""
        n = len(self.ends)
        review = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, n)))
        base = np.searchsorted(self.f_review, np.arange(len(self.first)))[review]
        started = np.searchsorted(self.f_pos, self.ends) - base
        complete = np.maximum(np.searchsorted(self.f_end, self.ends) - base, 0)  # one without an end stops where the next review begins
        open_ = np.flatnonzero(started > complete)
        finding = (base + started - 1)[open_]

        def summed(final, standing):
            sums = _sums(final)
            out = sums[base + complete] - sums[base]
            out[open_] += standing
            return out

        category = self._standing("category", open_, finding)
        deduction = summed(self.final["severity"], self._standing("severity", open_, finding))
        return started, complete, deduction, *(summed(self.final["category"] == c, category == c) for c in (1, 2, 3)), self.done[review] < self.ends


def _unescaped(pos, kind, review) -> np.ndarray:
    """Quotes without an odd number of backslashes before them."""
    quote, at = kind == QUOTE, np.flatnonzero(kind == BACKSLASH)
    if len(at):
        run = np.arange(len(at))
        new = np.ones(len(at), bool)
        new[1:] = (pos[at[1:]] != pos[at[:-1]] + 1) | (review[at[1:]] != review[at[:-1]])
        after = at[(run - np.maximum.accumulate(np.where(new, run, 0))) % 2 == 0] + 1
        after = after[after < len(pos)]
        quote[after[(pos[after] == pos[after - 1] + 1) & (review[after] == review[after - 1])]] = False
    return quote
