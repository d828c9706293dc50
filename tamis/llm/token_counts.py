"""Token counts that follow edits.

A text's pre-tokens lie in leaves of LEAF each, under a segment tree whose nodes hold the characters and tokens below
them. An edit descends to its leaf by characters, and the text is split anew from a boundary that the edit cannot have
moved until a boundary of the old text is met again; only those pre-tokens are encoded, and the sums on the paths above
the touched leaves are updated. Whether a match of the pattern ends at a boundary depends on CONTEXT characters beyond it
at most (but for runs of white space, which end within one more), so a pre-token that ends CONTEXT before the edit stands.

Counts come from the merge replay of bpe.py, once for all texts of a window.

Defined results: a null or empty text has no tokens; an edit outside a text or overlapping another raises; repeated rows
are counted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import PATTERN, Encoder, Vocabulary, replay

LEAF, CONTEXT = 64, 2


class Pieces:
    """Counts of single pre-tokens, remembered."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            raw = piece.encode()
            n = 1 if raw in self.v.ranks else self._few(raw) if len(raw) < 80 else int(replay(self.v, [raw])[1][0])
            if len(self.known) > 200_000:
                self.known = {}
            self.known[piece] = n
        return n

    def _few(self, raw: bytes) -> int:
        parts, ranks = [raw[i : i + 1] for i in range(len(raw))], self.v.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts)


class TokenTree:
    def __init__(self, text: str, count: Pieces, pattern: str = PATTERN, lengths: list | None = None, tokens: list | None = None):
        """lengths and tokens of the pre-tokens, if they are known, spare splitting and encoding the text."""
        self.scan, self.count, self.rescanned = regex.compile(pattern).finditer, count, 0
        if lengths is None:
            pieces = [m[0] for m in self.scan(text)]
            lengths, tokens = [len(p) for p in pieces], [count(p) for p in pieces]
        self._build(text, lengths, tokens)

    def _build(self, text: str, lengths: list, tokens: list) -> None:
        n = max(1, -(-len(lengths) // LEAF))
        self.size = 1 << (n - 1).bit_length()
        self.texts, self.lengths, self.tokens, at = [""] * self.size, [[] for _ in range(self.size)], [[] for _ in range(self.size)], 0
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for i in range(n):
            self.lengths[i], self.tokens[i] = lengths[i * LEAF : (i + 1) * LEAF], tokens[i * LEAF : (i + 1) * LEAF]
            to = at + sum(self.lengths[i])
            self.texts[i], at = text[at:to], to
            self.chars[self.size + i], self.sums[self.size + i] = len(self.texts[i]), sum(self.tokens[i])
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.texts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf that holds character at, or the last one with text; where it begins)."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if at >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def _set(self, leaf: int, text: str, lengths: list, tokens: list) -> None:
        self.texts[leaf], self.lengths[leaf], self.tokens[leaf] = text, lengths, tokens
        node = leaf + self.size
        self.chars[node], self.sums[node] = len(text), sum(tokens)
        while node > 1:
            node //= 2
            self.chars[node], self.sums[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, stop: int, put: str) -> None:
        """Replaces the characters from start to stop."""
        if not 0 <= start <= stop <= self.length:
            raise ValueError(f"an edit of {start} to {stop} in a text of {self.length}")
        left, begin = self._leaf(max(0, start - CONTEXT))
        keep, p = 0, begin
        for n in self.lengths[left]:
            if p + n > start - CONTEXT:
                break
            p += n
            keep += 1
        # white space before the edit may have been cut one short of its end, and depends on all of its run
        while keep and self.texts[left][p - begin - 1].isspace():
            keep -= 1
            p -= self.lengths[left][keep]
        if not keep and left and self._blank_before(left):
            before = left - 1
            while before and not self.lengths[before]:
                before -= 1
            self._merge(before, left)
            return self.edit(start, stop, put)
        right, end_of = self._leaf(max(start, stop - 1))
        end_of += self.chars[self.size + right]
        head = self._slice(left, begin, p, start) + put
        while True:
            tail = self._slice(*self._leaf(stop), stop, end_of) if stop < end_of else ""
            done = end_of == self.length
            found = self._resync(head, tail, stop, left, right, begin, done)
            if found is not None:
                break
            right += 1
            while right < self.size - 1 and not self.lengths[right]:
                right += 1
            end_of = self._end(right)
        lengths, tokens, text, rest = found
        self.rescanned += sum(lengths)
        own = self.texts[left][: p - begin], self.lengths[left][:keep], self.tokens[left][:keep]
        if right == left:
            self._set(left, own[0] + text + rest[0], own[1] + lengths + rest[1], own[2] + tokens + rest[2])
        else:
            self._set(left, own[0] + text, own[1] + lengths, own[2] + tokens)
            for i in range(left + 1, right):
                if self.lengths[i]:
                    self._set(i, "", [], [])
            self._set(right, *rest)
        if len(self.lengths[left]) > 8 * LEAF:
            self._build(self.text(), [n for x in self.lengths for n in x], [n for x in self.tokens for n in x])

    def _blank_before(self, leaf: int) -> bool:
        for i in range(leaf - 1, -1, -1):
            if self.texts[i]:
                return True
        return False

    def _merge(self, into: int, leaf: int) -> None:
        text, lengths, tokens = self.texts[leaf], self.lengths[leaf], self.tokens[leaf]
        self._set(leaf, "", [], [])
        self._set(into, self.texts[into] + text, self.lengths[into] + lengths, self.tokens[into] + tokens)

    def _end(self, leaf: int) -> int:
        node, end = leaf + self.size, self.chars[leaf + self.size]
        while node > 1:
            if node & 1:
                end += self.chars[node - 1]
            node //= 2
        return end

    def _slice(self, leaf: int, begin: int, start: int, stop: int) -> str:
        out = []
        while begin < stop and leaf < self.size:
            text = self.texts[leaf]
            out.append(text[max(0, start - begin) : stop - begin])
            begin += len(text)
            leaf += 1
        return "".join(out)

    def _resync(self, head: str, tail: str, stop: int, left: int, right: int, begin: int, done: bool):
        """New pre-tokens of head + tail up to an old boundary at or after stop: lengths, counts, their text, what is left of the right leaf."""
        text, old = head + tail, {}
        at = self._end(right) - self.chars[self.size + right]
        for i, n in enumerate(self.lengths[right]):
            if at >= stop:
                old[at] = i
            at += n
        lengths, tokens, q = [], [], 0
        for m in self.scan(text):
            if not done and m.end() > len(text) - CONTEXT - 1:
                return None
            if q >= len(head) and (i := old.get(stop + q - len(head))) is not None:
                rest = self.lengths[right][i:]
                return lengths, tokens, text[:q], (self.texts[right][-sum(rest) :], rest, self.tokens[right][i:])
            lengths.append(m.end() - q)
            tokens.append(self.count(m[0]))
            q = m.end()
        return (lengths, tokens, text, ("", [], [])) if done else None


#: An e-mail address; its first part is taken whole, so long runs without an @ are read once.
EMAIL = regex.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++(?<=\.[A-Za-z]{2,9})")
DIGITS = regex.compile(r"[0-9]{6,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """What a cleaning pass changes: later copies of a line go, addresses and long numbers are masked. Sorted, without overlaps."""
    seen, gone, at = set(), [], 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            gone.append((at - 1, at + len(line), ""))
        seen.add(line)
        at += len(line) + 1
    masks = sorted([(m.start(), m.end(), "[email]") for m in EMAIL.finditer(text)] + [(m.start(), m.end(), "0") for m in DIGITS.finditer(text)])
    out, g, last = [], 0, 0
    for e in masks:
        while g < len(gone) and gone[g][0] < e[1]:
            out.append(gone[g])
            last = gone[g][1]
            g += 1
        if e[0] >= last:
            out.append(e)
            last = e[1]
    return sorted(out + gone[g:])


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    for start, stop, put in reversed(edits):
        text = text[:start] + put + text[stop:]
    return text


def count_edited(docs: DataFrame, path: str, edits=cleaning_edits, id_col: str = "doc_id", pattern: str = PATTERN) -> DataFrame:
    """id, n_tokens, n_edits, n_tokens_edited, chars_rescanned. edits: text -> sorted (start, stop, put) without overlaps."""

    def run(batches):
        e = Encoder(path, pattern)
        pieces = Pieces(e.v)
        length = np.zeros(0, np.int32)
        for b, rows in e.windows(batches):
            if len(length) != len(e.count):
                length = np.fromiter(map(len, e.index), np.int32, len(e.index))[: len(e.count)]
            out = []
            for x, w in zip(b.column(1), rows):
                text, tokens = x.as_py() or "", e.count[w]
                n = int(tokens.sum())
                todo = edits(text)
                if not todo:
                    out.append((n, 0, n, 0))
                    continue
                tree = TokenTree(text, pieces, pattern, length[w].tolist(), tokens.tolist())
                for start, stop, put in reversed(todo):
                    tree.edit(start, stop, put)
                out.append((n, len(todo), tree.total, tree.rescanned))
            cols = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[:, i]) for i in range(4))], names=[id_col, "n_tokens", "n_edits", "n_tokens_edited", "chars_rescanned"])

    own = docs.select(id_col, "text")
    return own.mapInArrow(run, f"{id_col} {own.schema[id_col].dataType.simpleString()}, n_tokens long, n_edits long, n_tokens_edited long, chars_rescanned long")
