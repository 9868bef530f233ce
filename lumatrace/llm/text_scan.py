"""Passages and counts of many texts at once, on arrays of code points.

The texts of a chunk lie end to end in one array; characters are classed by table,
words, lines and passages are index ranges and every count is a sum over a range.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np

LEAST_WORDS, MOST_WORDS = 30, 60
#: a line without words that is longer stands alone
LONE = 2000
CHUNK = 500_000
SPACE, WORD, DIGIT, SIGN, BREAK, BULLET, CLOSER, END = (1 << i for i in range(8))
#: Characters that end a line, begin a list item, stand behind a closing sign, close a sentence.
BREAKS, BULLETS, CLOSERS, ENDS = "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029", "-*•+", "\"'”’»)]", ".!?…。"
#: a reference to a file inside a line counts as one word; the rest of its length is kept as a character of no class
PATH = re.compile(r"(?<=[^\s][ ])(?:\b[A-Za-z]:)?(?:/[^\s/,;|:]+){2,}")
FILL = "\ufdd0"
_BASE = 0x9E3779B97F4A7C15 | 1


def _class(ch: str) -> int:
    if ch == FILL:
        return 0
    space, word = ch.isspace(), ch.isalnum() or ch == "_"
    out = SPACE * space | WORD * word | DIGIT * ch.isdecimal() | SIGN * (ch == "_" or not (space or word))
    return out | BREAK * (ch in BREAKS) | BULLET * (ch in BULLETS) | CLOSER * (ch in CLOSERS) | END * (ch in ENDS)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    chars = [chr(i) for i in range(0x10000)]
    lower = [ord(x) if len(x := ch.lower()) == 1 else i for i, ch in enumerate(chars)]
    return np.array([_class(ch) for ch in chars], dtype=np.uint8), np.array(lower, dtype=np.uint32)


@functools.cache
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(_BASE))]), dtype=np.uint64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _classes(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower-case form of each code point."""
    kinds, lower = _tables()
    small = np.minimum(cp, 0xFFFF)
    out, low = kinds[small], lower[small]
    far = np.flatnonzero(cp > 0xFFFF)
    if len(far):
        each, at = np.unique(cp[far], return_inverse=True)
        out[far] = np.array([_class(chr(x)) for x in each], dtype=np.uint8)[at]
        low[far] = np.array([ord(x) if len(x := chr(y).lower()) == 1 else y for y in each], dtype=np.uint32)[at]
    return out, low


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (b.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


def word_number(word: str) -> int:
    """Number of a lower-case word, as :class:`Chunk` has it for the words of texts."""
    _, low = _classes(_points(word))
    with np.errstate(over="ignore"):
        return int(((low.astype(np.uint64) + np.uint64(1)) * _powers(max(1, len(low)))).sum(dtype=np.uint64)) if len(low) else 0


class Chunk:
    """Texts laid end to end, each followed by a line break, cut into words, lines and passages."""

    def __init__(self, texts: Sequence[str]) -> None:
        laid = [PATH.sub(lambda m: "file" + FILL * (len(m.group()) - 4), x) if "/" in x else x for x in texts]
        self.cp = _points("\n".join(laid) + "\n")
        self.kind, self.low = _classes(self.cp)
        self.text_at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in laid])])[:-1]
        self._words()
        self._lines()
        self._passages()

    def _has(self, bit: int) -> np.ndarray:
        return (self.kind & bit) != 0

    def _words(self) -> None:
        """Runs of word characters; two runs with an apostrophe between them are one word."""
        edge = np.diff(np.concatenate([[0], self._has(WORD).view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start) > 1:
            mark = self.cp[end[:-1]]
            near = (start[1:] - end[:-1] == 1) & ((mark == 0x27) | (mark == 0x2019))
            at = np.arange(len(near))
            turn = at - np.maximum.accumulate(np.where(near, -1, at))  # place in a row of such pairs
            joined = near & (turn % 2 == 1)
            start, end = start[np.append(True, ~joined)], end[np.append(~joined, True)]
        self.word_at, self.word_end = start, end

    def word_numbers(self) -> np.ndarray:
        """A number for each word, equal for equal words in lower case: its characters as digits to an odd base."""
        at, end, n = self.word_at, self.word_end, len(self.cp)
        if not len(at):
            return np.zeros(0, dtype=np.uint64)
        longest = int((end - at).max())
        place = np.arange(at[0], n, dtype=np.int32 if n < 1 << 31 else np.int64)
        place -= np.repeat(at, np.diff(np.append(at, n))).astype(place.dtype)
        np.minimum(place, longest - 1, out=place)  # what lies behind a word is left out below
        with np.errstate(over="ignore"):
            digits = (self.low[at[0] :].astype(np.uint64) + np.uint64(1)) * _powers(1 << int(longest - 1).bit_length())[place]
            return np.add.reduceat(digits, np.stack([at, end], axis=1).ravel() - at[0])[::2]

    def _lines(self) -> None:
        """Lines that are not blank: their ranges, words, kinds, and whether they are list items or closed."""
        ends = np.flatnonzero(self._has(BREAK))
        starts = np.concatenate([[0], ends[:-1] + 1])
        solid = np.flatnonzero(~self._has(SPACE))
        first = np.searchsorted(solid, starts)
        filled = np.searchsorted(solid, ends) > first
        a, b = starts[filled], ends[filled]
        self.line_at, self.line_end = a, b
        self.line_text = np.searchsorted(self.text_at, a, side="right") - 1
        self.line_words = np.searchsorted(self.word_at, b) - np.searchsorted(self.word_at, a)
        if not len(a):
            self.line_kind, self.line_listed, self.line_closed = (np.zeros(0, dtype=t) for t in (np.int8, bool, bool))
            return
        head, tail = solid[first[filled]], solid[np.searchsorted(solid, b) - 1]
        # 1 list item: an indent, or a bullet or number and a blank
        after = self._has(SPACE)[head + 1] & (head + 1 < b)
        item = (head - a >= 2) | (self._has(BULLET)[head] & after)
        number = np.flatnonzero(self._has(DIGIT)[head] & ~item)
        if len(number):
            other = np.flatnonzero(~self._has(DIGIT))
            stop = other[np.searchsorted(other, head[number])]
            item[number] = np.isin(self.cp[stop], (0x2E, 0x29)) & self._has(SPACE)[stop + 1 - (stop + 1 == len(self.cp))] & (stop + 1 < b[number])
        # 2 mostly other signs
        signs = self.sums(self._has(SIGN | DIGIT), a, b)
        self.line_kind = np.where(signs > 0.25 * (b - a), 2, item.astype(np.int8))
        self.line_listed = item | self._columns(a, b, tail)
        last = tail.copy()
        while len(at := np.flatnonzero(self._has(CLOSER)[last] & (last > a))):
            last[at] -= 1
        self.line_closed = self._has(END)[last]

    def _columns(self, a: np.ndarray, b: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Lines with a tab, a bar between blanks, or three blanks and more between words."""
        space, inner = self._has(SPACE), self._has(SPACE) & ~self._has(BREAK)
        mark = self.cp == 0x09
        bar = np.flatnonzero((self.cp[1:-1] == 0x7C) & inner[:-2] & inner[2:]) + 1
        mark[bar] = True
        gap = np.flatnonzero(~space[:-3] & inner[1:-2] & inner[2:-1] & inner[3:]) if len(space) > 3 else np.zeros(0, dtype=int)
        if len(gap):
            line = np.searchsorted(a, gap, side="right") - 1
            mark[gap[(line >= 0) & (gap < tail[line])]] = True
        return self.sums(mark, a, b) > 0

    @staticmethod
    def sums(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of flags in each of the ranges, which do not overlap and end before the last place."""
        if not len(a):
            return np.zeros(0, dtype=np.int64)
        return np.add.reduceat(flags, np.stack([a, b], axis=1).ravel(), dtype=np.int64)[::2]

    def _passages(self) -> None:
        """Neighbouring lines of one kind up to about LEAST_WORDS words; long lines cut at MOST_WORDS."""
        text, words, kinds, at, end = (x.tolist() for x in (self.line_text, self.line_words, self.line_kind, self.line_at, self.line_end))
        out: list[tuple[int, int, int, int]] = []  # start, end, first line, one past the last line; a later part of a line has none
        held, n, kind = -1, 0, -1  # first line held, its words so far
        for i, w in enumerate(words):
            if held >= 0 and text[i] != text[held]:
                out.append((at[held], end[i - 1], held, i))
                held = -1
            k = kind if held >= 0 and w <= 4 else kinds[i]  # a very short line is of the kind of what stands before it
            long = w > MOST_WORDS + LEAST_WORDS
            lone = w == 0 and end[i] - at[i] > LONE
            if held >= 0 and (k != kind or n >= LEAST_WORDS or long or lone):
                out.append((at[held], end[i - 1], held, i))
                held = -1
            kind = k
            if long:
                first = int(np.searchsorted(self.word_at, at[i]))
                cuts = [at[i], *self.word_at[first + MOST_WORDS : first + w - LEAST_WORDS : MOST_WORDS].tolist(), end[i]]
                out += [(x, y, i, i + (j == 0)) for j, (x, y) in enumerate(zip(cuts, cuts[1:]))]
            elif lone:
                out.append((at[i], end[i], i, i + 1))
            else:
                if held < 0:
                    held, n = i, 0
                n += max(1, w)
        if held >= 0:
            out.append((at[held], end[-1], held, len(words)))
        a, b, first, stop = (np.array(x, dtype=np.int64) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 4
        self.at, self.end, self.first_line, self.stop_line = a, b, first, stop
        self.text = np.searchsorted(self.text_at, a, side="right") - 1


@dataclass
class Lexicon:
    """Common words of languages by number: in which languages each is common and in which it shows a clause."""

    languages: list[str]
    numbers: np.ndarray
    common: np.ndarray  # word, language
    clause: np.ndarray

    @classmethod
    def of(cls, words: Mapping[str, frozenset[str]], joining: Mapping[str, frozenset[str]]) -> Lexicon:
        languages = list(words)
        each = {w: word_number(w) for w in sorted(frozenset().union(*words.values()))}
        order = sorted(each, key=each.__getitem__)
        common = np.array([[w in words[c] for c in languages] for w in order], dtype=bool).reshape(len(order), len(languages))
        clause = np.array([[w in words[c] and w not in joining.get(c, ()) for c in languages] for w in order], dtype=bool).reshape(len(order), len(languages))
        return cls(languages, np.array([each[w] for w in order], dtype=np.uint64), common, clause)


def chunks(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters together; a longer text is a range of its own."""
    first, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(x) + 1
    if size:
        yield first, len(texts)


def passages(text: str) -> list[str]:
    """The passages of one text as they stand in it."""
    c = Chunk([text])
    return [text[a:b] for a, b in zip(c.at.tolist(), c.end.tolist())]


def passage_counts(texts: Sequence[str], declared: Sequence[str], lexicon: Lexicon) -> dict[str, np.ndarray]:
    """One entry for each passage of each text: its text's place, language, and counts.

    ``chars words common clause letters signs digits solid distinct`` are of the passage,
    ``fresh`` its words that no earlier passage of the text has, ``listed closed lines`` its lines;
    ``own_listed own_closed own_lines`` count a line that was cut in its first part only.
    """
    c = Chunk(texts)
    a, b, n = c.at, c.end, len(c.at)
    whole = c.stop_line - c.first_line
    lines = np.maximum(whole, 1)
    t0, t1 = np.searchsorted(c.word_at, a), np.searchsorted(c.word_at, b)

    def of_words(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
        return total[t1] - total[t0]

    def of_lines(flags: np.ndarray, last: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[last] - total[c.first_line]

    number = c.word_numbers()
    if len(lexicon.numbers):
        place = np.minimum(np.searchsorted(lexicon.numbers, number), len(lexicon.numbers) - 1)
        known = lexicon.numbers[place] == number
        hits = of_words(lexicon.common[place] & known[:, None])
        shown = of_words(lexicon.clause[place] & known[:, None])
    else:
        hits = shown = np.zeros((n, max(1, len(lexicon.languages))), dtype=np.int64)
    code = {x: i for i, x in enumerate(lexicon.languages)}
    said = np.array([code.get(x, -1) for x in declared], dtype=np.int64)[c.text] if n else np.zeros(0, dtype=np.int64)
    best = hits.max(axis=1, initial=0)
    rows = np.arange(n)
    chosen = np.where((said >= 0) & (hits[rows, np.maximum(said, 0)] == best), said, hits.argmax(axis=1) if n else 0)
    holder = np.searchsorted(a, c.word_at, side="right") - 1
    once = np.unique(_mixed(number, holder), return_index=True)[1]
    first = np.unique(_mixed(number, c.text[holder] if n else holder), return_index=True)[1]
    return {
        "text": c.text, "language": chosen, "chars": c.sums(~c._has(BREAK), a, b) + lines - 1, "words": t1 - t0,
        "common": best, "clause": shown[rows, chosen], "letters": of_words(c.word_end - c.word_at),
        "signs": c.sums(c._has(SIGN), a, b), "digits": c.sums(c._has(DIGIT), a, b), "solid": c.sums(~c._has(SPACE) & (c.kind != 0), a, b),
        "distinct": np.bincount(holder[once], minlength=n), "fresh": np.bincount(holder[first], minlength=n),
        "listed": of_lines(c.line_listed, c.first_line + lines), "closed": of_lines(c.line_closed, c.first_line + lines), "lines": lines,
        "own_listed": of_lines(c.line_listed, c.stop_line), "own_closed": of_lines(c.line_closed, c.stop_line), "own_lines": whole,
    }
