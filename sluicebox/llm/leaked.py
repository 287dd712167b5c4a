"""Held-out passages inside corpus pages, by CGK embedding, bit-sampling LSH and an exact check of the edits.

A page is first read column by column and its letters are folded, so that breaks, spaces, case,
punctuation and the usual misreadings are gone. From each word on, a window of letters goes on a
random walk (CGK): at step t the letter under the pointer is put out, and a random bit of (t, letter)
tells whether the pointer moves on. Few edits of the window change few letters of the walk, in
Hamming distance. A passage's windows are as long as half of a leak is there, so that one of them
stands whole on either side of an advert. LSH tables, each on a sample of the steps of one of several
walks, bring together the windows of pages and of passages; tables are added until planted leaks with
misread letters meet at the wanted recall. Where the windows of a passage that meet a page span enough
of it, the letters themselves are aligned, the edits of the alignment are counted exactly, and the
passage's consecutive words are counted.

The passages go to the tasks as folded letters in broadcast blocks of bounded bytes; the corpus is read
once for all blocks, in batches, and not shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Steps of a walk by window size (it reads about half as many letters), and steps sampled for a table's key.
SIZES = {64: 12, 32: 11, 16: 8}
#: Tables by walk and size, and walks at most.
TABLES, MOST_WALKS = 3, 8
#: Share of planted leaks that are to meet, share of their letters that are edited, and how many are planted.
RECALL, MISREAD, PLANTED = 0.99, 0.05, 400
#: Letters between the first and last window that met on about one diagonal, for the pair to be checked; how far diagonals may differ.
SPREAD, DRIFT = 12, 24
#: Windows that must meet where they don't do so on one diagonal.
MANY = 4
#: Letters of a seed of the alignment, and of a gap between seeds without an advert.
SEED, GAP = 7, 16
#: One in so many letters of the shortest leak must begin a seed that stands on about one diagonal.
SEEDED = 4
#: Letters that an advert must have on either side, and letters that may be lost beside it.
FIRM, TORN = 14, 4
#: Share of a leak's letters that may be edited, adverts aside.
EDITED = 0.3
#: Consecutive words that make a leak.
WORDS = 16
#: Bytes of passages in one block (its tables take about fifteen times as much), and in all blocks that go out at once.
BLOCK_BYTES, PASS_BYTES = 8_000_000, 240_000_000
#: Bytes of pages that a task holds while it goes through several blocks.
HELD_BYTES = 32_000_000
#: Letters of text handled at once.
BATCH_CHARS = 3_000_000

#: Letters that are misread for one another, each group folded to its first.
_ALIKE = ("aeoc04", "bhk8", "tsf5", "nu", "vry", "gq9", "li1")
#: Pairs of letters misread as one, and that one; applied in this order, after i and 1 have become l.
_PAIRS = ((b"rn", b"m"), (b"nn", b"m"), (b"ln", b"m"), (b"cl", b"d"), (b"vv", b"w"), (b"ll", b"u"))
_GONE = 255


def _byte_tables() -> tuple[bytes, bytes, bytes]:
    first, second = bytearray(range(256)), bytearray(range(256))
    for code in range(65, 91):
        first[code] = code + 32
    for mark in "iI1|":
        first[ord(mark)] = ord("l")
    for group in _ALIKE:
        for letter in group:
            second[ord(letter)] = ord(group[0])
    kept = {0, 10, 32, ord("|"), *range(48, 58), *range(65, 91), *range(97, 123)}
    return bytes(first), bytes(c for c in range(256) if c not in kept), bytes(second)


_FIRST, _DROPPED, _SECOND = _byte_tables()


@lru_cache(maxsize=None)
def _wide_table() -> np.ndarray:
    """Byte of each code point: ASCII as above, letters of other scripts without case and marks in 128 to 254, the rest gone.

    Letters of the Latin script beyond ASCII are gone too: wrong decodings and scanners change them first.
    """
    table = np.full(0x30000, _GONE, np.uint8)
    table[:128] = [_GONE if code in _DROPPED else _FIRST[code] for code in range(128)]
    for code in range(128, 0x10000):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Zs":
            table[code] = 32
        elif kind[0] == "L" and not unicodedata.name(char, "").startswith(("LATIN", "FULLWIDTH LATIN", "MODIFIER", "FEMININE", "MASCULINE")):
            table[code] = 128 + ord(unicodedata.normalize("NFKD", char.casefold())[0]) % 127
    rest = np.arange(0x10000, 0x30000)
    table[0x10000:] = np.where((rest < 0x1F000) | (rest >= 0x20000), 128 + rest % 127, _GONE)  # emoji are no letters
    return table


_IDEOGRAPHS = re.compile("([぀-ヿ㐀-鿿\U00020000-\U0002fa1f])")
_MIXED = re.compile(rb"[a-z\x80-\xff]*(?:[a-z][\x80-\xff]|[\x80-\xff][a-z])[a-z\x80-\xff]*")


def _one_script(word: re.Match[bytes]) -> bytes:
    """A word of two scripts without the letters of the rarer one, which are misread or wrongly decoded."""
    plain = bytes(c for c in word[0] if c < 128)
    return plain if 2 * len(plain) >= len(word[0]) else bytes(c for c in word[0] if c >= 128)


def fold(text: str) -> bytes:
    """Letters and ASCII digits folded to bytes; spaces, line ends and NULs stay, everything else is gone.

    A letter of a script without spaces is a word of its own.
    """
    if text.isascii():
        data = text.encode().translate(_FIRST, _DROPPED)
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if codes.max() >= 0x3040:
            codes = np.frombuffer(_IDEOGRAPHS.sub(r" \1 ", text).encode("utf-32-le", "surrogatepass"), np.uint32)
        mapped = _wide_table()[np.minimum(codes, 0x2FFFF)]
        data = mapped[mapped != _GONE].tobytes()
        if not data.isascii():
            data = _MIXED.sub(_one_script, data)
    for pair, one in _PAIRS:
        data = data.replace(pair, one)
    return data.translate(_SECOND)


_WIDE = re.compile(r"\S {3,}\S")
_SEGMENT = re.compile(r"\S+(?: {1,2}\S+)*")


def read_columns(text: str, left: list[int] | None) -> list[list[str]]:
    """Lines of each column. ``left`` has the left edge of each line's box, if known.

    Columns printed into one line are told by wide gaps at the same places of several lines; columns
    whose lines take turns, by their left edges.
    """
    lines = text.replace("\0", " ").split("\n")
    if "   " in text and sum(1 for line in lines if "   " in line and _WIDE.search(line)) >= 3:
        found = [(m.start(), m[0]) for line in lines for m in _SEGMENT.finditer(line)]
        starts = sorted(start for start, _ in found)
        cuts = [b for a, b in zip(starts, starts[1:]) if b - a > 6]
        columns: list[list[str]] = [[] for _ in range(len(cuts) + 1)]
        for (_, segment), at in zip(found, np.searchsorted(cuts, [s for s, _ in found], "right").tolist()):
            columns[at].append(segment)
        return columns
    if left and len(left) == len(lines):
        edges = sorted(set(left))
        cuts = [b for a, b in zip(edges, edges[1:]) if b - a > 60]
        if cuts:
            columns = [[] for _ in range(len(cuts) + 1)]
            for line, at in zip(lines, np.searchsorted(cuts, left, "right").tolist()):
                columns[at].append(line)
            return columns
    return [lines]


@dataclass
class Letters:
    """Folded texts in one row of letters, a NUL after each column; where words begin, and where the lines and texts."""

    data: np.ndarray
    words: np.ndarray
    line: np.ndarray
    text: np.ndarray


def lay_out(folded: list[bytes]) -> Letters:
    raw = np.frombuffer(b"\0".join([*folded, b""]), np.uint8)
    blank = (raw == 32) | (raw == 10)
    kept = ~blank
    place = np.cumsum(kept, dtype=np.int32) - 1
    opens = kept & (raw != 0)
    opens[1:] &= ~kept[:-1] | (raw[:-1] == 0)
    lengths = np.fromiter(map(len, folded), np.int64, len(folded)) + 1
    owner = np.repeat(np.arange(len(folded), dtype=np.int32), lengths)
    return Letters(raw[kept], place[opens], np.cumsum(raw == 10, dtype=np.int32)[kept], owner[kept])


class Scheme:
    """The random bits of the walks, and the steps that each table of a window size samples."""

    def __init__(self, walks: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (MOST_WALKS, max(SIZES), 256)).astype(np.int32)[:walks]
        self.moves[:, :, 0] = 0  # a column's end is never passed
        self.samples = [
            [(size, set(rng.choice(size, sampled, replace=False).tolist())) for size, sampled in SIZES.items() for _ in range(TABLES)] for _ in range(walks)
        ]

    def keys(self, data: np.ndarray, begins: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(size, key of each window) of each table whose size is asked for."""
        for moves, tables in zip(self.moves, self.samples):
            at = begins.astype(np.int32)
            own = [(size, steps, np.full(len(begins), 1, np.uint64)) for size, steps in tables if size in sizes]
            for step in range(max(sizes, default=0)):
                letter = data[at]
                for _, steps, key in own:
                    if step in steps:
                        key *= np.uint64(0x9E3779B97F4A7C15)
                        key += letter
                at += moves[step][letter]
            for size, _, key in own:
                key ^= key >> np.uint64(29)
                key *= np.uint64(0xBF58476D1CE4E5B9)
                yield size, (key >> np.uint64(32)).astype(np.uint32)


def _grams(data: np.ndarray) -> np.ndarray:
    """SEED letters from each place on as one number."""
    if len(data) < SEED:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(data) - SEED + 1, np.uint64)
    for i in range(SEED):
        out = (out << np.uint64(8)) | data[i : len(out) + i]
    return out


def _marks_of(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int16)


class Passages:
    """Folded held-out passages with their LSH tables, held in arrays."""

    def __init__(self, ids: list, folded: list[bytes], scheme: Scheme, words: int = WORDS) -> None:
        self.ids, self.scheme, self.least = ids, scheme, words
        self.letters = lay_out(folded)
        self.begin = np.searchsorted(self.letters.text, np.arange(len(ids) + 1)).astype(np.int32)
        self.first_word = np.searchsorted(self.letters.words, self.begin)
        self._known: dict[int, tuple] = {}
        starts = self.letters.words
        count = len(starts)
        # a window has half the words of a leak; one that begins nearer to the passage's end is covered by those before it
        after = np.arange(count) + max(1, words // 2)
        last = self.first_word[1:][self.letters.text[starts]] if count else starts
        ends = np.append(starts, 0)[np.minimum(after, count)]
        ends = np.where(after < last, ends, self.begin[1:][self.letters.text[starts]] - 1 if count else ends)
        size = np.where(after <= last, min(SIZES), 0)
        for known in sorted(SIZES):
            size[(2 * (ends - starts) >= known) & (after <= last)] = known
        self.sizes = set(size.tolist()) - {0}
        self.tables = []
        for own, key in scheme.keys(self.letters.data, starts, self.sizes):
            chosen = np.flatnonzero(size == own)
            chosen = chosen[np.argsort(key[chosen], kind="stable")]
            marks = np.zeros(1 << 20, bool)
            marks[key[chosen] >> np.uint32(12)] = True
            self.tables.append((marks, key[chosen], starts[chosen].astype(np.int32)))

    def nbytes(self) -> int:
        return sum(a.nbytes for table in self.tables for a in table) + self.letters.data.nbytes * 9

    def meetings(self, page: Letters) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of the pairs whose windows met in a table over enough of the item."""
        found = [np.zeros((3, 0), np.int64)]
        for (marks, keys, places), (_, key) in zip(self.tables, self.scheme.keys(page.data, page.words, self.sizes)):
            maybe = np.flatnonzero(marks[key >> np.uint32(12)])
            low, high = np.searchsorted(keys, key[maybe]), np.searchsorted(keys, key[maybe], "right")
            times = high - low
            window = np.repeat(page.words[maybe], times)
            met = np.arange(int(times.sum())) + np.repeat(low - (np.cumsum(times) - times), times)
            item_place = places[met]
            item = self.letters.text[item_place]
            at = item_place - self.begin[item]
            found.append(np.stack([page.text[window].astype(np.int64) * len(self.ids) + item, window.astype(np.int64) - at, at.astype(np.int64)]))
        pair, diagonal, at = np.concatenate(found, axis=1)
        if not len(pair):
            return pair, pair
        chosen = np.unique(np.concatenate([self._in_a_row(pair, diagonal, at), self._in_all(pair, at)]))
        return chosen // len(self.ids), chosen % len(self.ids)

    def _in_a_row(self, pair: np.ndarray, diagonal: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pairs whose windows met over SPREAD letters of the item, on about one diagonal."""
        by = np.lexsort((diagonal, pair))
        pair, diagonal, at = pair[by], diagonal[by], at[by]
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(diagonal) > DRIFT)]))
        # a passage whose leaks may be no longer than that is checked on any meeting
        spread = np.minimum(SPREAD, np.maximum(self._least_letters()[pair[cuts] % len(self.ids)] // 4 - 4, 0))
        return pair[cuts[np.maximum.reduceat(at, cuts) - np.minimum.reduceat(at, cuts) >= spread]]

    def _in_all(self, pair: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pairs of which MANY windows met over half of the shortest leak, wherever in the column."""
        by = np.lexsort((at, pair))
        pair, at = pair[by], at[by]
        fresh = np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(at) != 0)])
        pair, at = pair[fresh], at[fresh]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(pair) != 0]))
        ends = np.append(cuts[1:], len(pair)) - 1
        return pair[cuts[(ends - cuts + 1 >= MANY) & (2 * (at[ends] - at[cuts]) >= self._least_letters()[pair[cuts] % len(self.ids)])]]

    @lru_cache(maxsize=1)  # noqa: B019
    def _least_letters(self) -> np.ndarray:
        """Letters of the shortest leak of each passage."""
        out = np.zeros(len(self.ids), np.int64)
        for item in range(len(self.ids)):
            ends = np.append(self.letters.words[self.first_word[item] : self.first_word[item + 1]], self.begin[item + 1] - 1)
            out[item] = (ends[self.least :] - ends[: -self.least]).min() if len(ends) > self.least else 0
        return out

    def _seeds(self, item: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Marks, sorted seeds and their places, and the letters of a passage."""
        if item not in self._known:
            if len(self._known) > 2000:
                self._known.clear()
            own = self.letters.data[self.begin[item] : self.begin[item + 1] - 1]
            grams = _grams(own)
            by = np.argsort(grams, kind="stable")
            marks = np.zeros(4096, bool)
            marks[_marks_of(grams)] = True
            self._known[item] = marks, grams[by], by, own.tobytes()
        return self._known[item]

    def longest(self, item: int, text: bytes, line: np.ndarray, grams: np.ndarray, gram_marks: np.ndarray) -> int:
        """Most consecutive words of the passage that stand in the column, misreadings and adverts between its lines aside."""
        marks, seeds, places, passage = self._seeds(item)
        j = np.flatnonzero(marks[gram_marks])
        low, high = np.searchsorted(seeds, grams[j]), np.searchsorted(seeds, grams[j], "right")
        times = high - low
        i = places[np.arange(int(times.sum())) + np.repeat(low - (np.cumsum(times) - times), times)]
        shortest = int(self._least_letters()[item])
        shift = np.repeat(j, times) - i
        inside = np.sort(shift)
        # half a leak, or a line of it, has a share of its seeds on about one diagonal
        if not len(i) or SEEDED * (np.searchsorted(inside, inside + DRIFT, "right") - np.arange(len(i))).max() < shortest:
            return 0
        by = np.lexsort((i, shift))
        i, shift = i[by], shift[by]
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(shift) != 0) | (np.diff(i) > SEED)]))
        first, last = i[cuts], i[np.append(cuts[1:], len(i)) - 1] + SEED
        parts = sorted(zip(first.tolist(), last.tolist(), (first + shift[cuts]).tolist(), (last + shift[cuts]).tolist()))
        # the best chain of parts: where each reaches back to in the passage, and the part before it
        start: list[int] = []
        before: list[int] = []
        longest = 0
        for n, (a, b, c, d) in enumerate(parts):
            begin, back = a, -1
            for m in range(n - 1, -1, -1):
                a2, b2, c2, d2 = parts[m]
                if start[m] < begin and b2 > a - GAP and b2 < b and d2 < d and c2 < c and _joined(passage, text, line, parts[m], parts[n]) is not None:
                    begin, back = start[m], m
            start.append(begin)
            before.append(back)
            # at either end a stretch may follow
            if 2 * (b - begin) >= shortest:
                longest = max(longest, self._verified(item, passage, text, line, parts, before, n))
        return longest

    def _verified(self, item: int, passage: bytes, text: bytes, line: np.ndarray, parts: list, before: list[int], n: int) -> int:
        """Words of the chain that ends with part n, or 0 if its letters have too many edits."""
        edits, end = 0, n
        while before[n] >= 0:
            edits += _joined(passage, text, line, parts[before[n]], parts[n])
            n = before[n]
        (a, _, c, _), (_, b, _, d) = parts[n], parts[end]
        ahead, ahead_edits = _stretch(passage[:a][::-1], text[:c][::-1])
        beyond, beyond_edits = _stretch(passage[b:], text[d:])
        edits += ahead_edits + beyond_edits
        return self._words(item, a - ahead, b + beyond) if edits <= EDITED * (b + beyond - a + ahead) else 0

    def _words(self, item: int, begin: int, end: int) -> int:
        starts = self.letters.words[self.first_word[item] : self.first_word[item + 1]] - self.begin[item]
        ends = np.append(starts[1:], self.begin[item + 1] - 1 - self.begin[item])
        return int(((starts >= begin - 1) & (ends <= end + 1)).sum())


def _joined(passage: bytes, text: bytes, line: np.ndarray, before: tuple[int, int, int, int], after: tuple[int, int, int, int]) -> int | None:
    """Edits of the gap between two parts, if it is misreading or an advert between lines, of any length; None if neither."""
    (a1, i1, _, j1), (i2, b2, j2, _) = before, after
    lost, extra = i2 - i1, j2 - j1
    if abs(lost - extra) <= 4 and extra <= GAP:
        if (over := -min(lost, extra)) > 0:  # the parts overlap by a few letters
            i1, j1 = i1 - over, j1 - over
        size = max(i2 - i1, j2 - j1)
        edits = edit_distance(passage[i1:i2], text[j1:j2])
        return edits if edits <= max(2, (2 * size + 3) // 5) else None
    firm = i1 - a1 >= FIRM and b2 - i2 >= FIRM
    if not (firm and abs(lost) <= TORN and lost < extra):
        return None
    # the advert begins where a line ends and ends where one begins, but for a few letters that agree by chance
    opens = line[min(j1 + TORN, len(line) - 1)] > line[max(j1 - 3, 0)]
    closes = line[min(j2 + 2, len(line) - 1)] > line[max(j2 - TORN - 1, 0)]
    return abs(lost) if opens and closes else None


def edit_distance(a: bytes, b: bytes) -> int:
    """Levenshtein distance, all rows of a column at once in the bits of one number."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = whole, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        rise, fall = minus | ~(diagonal | plus), plus & diagonal
        score += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1) | 1, fall << 1
        plus, minus = (fall | ~(diagonal | rise)) & whole, rise & diagonal & whole
    return score


#: How far the score of a stretch may fall below its best: a match is worth 1, an edit costs 2.
DROP, COST = 5, 2


def _stretch(a: bytes, b: bytes) -> tuple[int, int]:
    """(letters, edits): the beginning of ``a`` that best matches a beginning of ``b``, by all alignments within DROP of the best."""
    best, reach, edits = 0, 0, 0
    row = {j: (-COST * j, j) for j in range(min(len(b), (DROP - 1) // COST) + 1)}  # place in b: score, edits
    for i, letter in enumerate(a, 1):
        fresh: dict[int, tuple[int, int]] = {}
        low, j = min(row), 0
        j = low
        while j <= len(b) and (j <= max(row) + 1 or j - 1 in fresh):
            options = []
            if j in row:
                options.append((row[j][0] - COST, row[j][1] + 1))
            if j - 1 in row:
                same = b[j - 1] == letter
                options.append((row[j - 1][0] + 1, row[j - 1][1]) if same else (row[j - 1][0] - COST, row[j - 1][1] + 1))
            if j - 1 in fresh:
                options.append((fresh[j - 1][0] - COST, fresh[j - 1][1] + 1))
            if options and (cell := max(options))[0] > best - DROP:
                fresh[j] = cell
            j += 1
        if not fresh:
            break
        row = fresh
        score, own = max(row.values(), key=lambda cell: cell[0])
        if score > best:
            best, reach, edits = score, i, own
    return reach, edits


def leaked_in(passages: Passages, texts: list[str | None], lefts: list[list[int] | None]) -> list[tuple[int, int, int]]:
    """(index of text, index of item, words) for each leak of at least the least number of words."""
    folded, owner = [], []
    for i, text in enumerate(texts):
        if text:
            for column in read_columns(text, lefts[i]):
                folded.append(fold("\n".join(column)))
                owner.append(i)
    if not folded or not passages.ids:
        return []
    page = lay_out(folded)
    column, item = passages.meetings(page)
    bounds = np.searchsorted(page.text, np.arange(len(folded) + 1))
    grams = _grams(page.data)
    marks = _marks_of(grams)
    found: dict[tuple[int, int], int] = {}
    for c, k in zip(column.tolist(), item.tolist()):
        a, b = int(bounds[c]), int(bounds[c + 1]) - 1
        last = max(a, b - SEED + 1)
        words = passages.longest(k, page.data[a:b].tobytes(), page.line[a:b], grams[a:last], marks[a:last])
        if words >= passages.least:
            found[owner[c], k] = max(words, found.get((owner[c], k), 0))
    return [(i, k, words) for (i, k), words in found.items()]


def fold_passage(text: str) -> bytes:
    return fold(text.replace("\0", " ").replace("\n", " "))


def planted_recall(folded: list[bytes], scheme: Scheme, words: int = WORDS, misread: float = MISREAD, planted: int = PLANTED, seed: int = 3) -> float:
    """Share of planted leaks of ``words`` words, their letters edited, whose windows meet their passage."""
    rng = np.random.default_rng(seed)
    long = [f for f in folded if len(f.split()) >= words]
    if not long:
        return 1.0
    chosen = [long[i] for i in rng.permutation(len(long))[:planted]]
    own = Passages(list(range(len(chosen))), chosen, scheme, words)
    alphabet = np.unique(own.letters.data[own.letters.data > 0])
    texts, owner = [], []
    for n in range(planted):
        item = n % len(chosen)
        split = chosen[item].split()
        at = int(rng.integers(0, len(split) - words + 1))
        span = [bytes(_edited(np.frombuffer(w, np.uint8), misread, alphabet, rng)) for w in split[at : at + words]]
        texts.append(b" ".join(span))
        owner.append(item)
    column, item = own.meetings(lay_out(texts))
    met = set(zip(column.tolist(), item.tolist()))
    return sum((n, k) in met for n, k in enumerate(owner)) / planted


def _edited(letters: np.ndarray, share: float, alphabet: np.ndarray, rng: np.random.Generator) -> list[int]:
    out = []
    for letter in letters.tolist():
        kind = rng.random() / share if share else 1.0
        if kind >= 1:
            out.append(letter)
        elif kind < 0.8:
            out.append(int(rng.choice(alphabet)))
        elif kind < 0.9:
            out.extend([letter, int(rng.choice(alphabet))])
    return out


def scheme_for(folded: list[bytes], words: int = WORDS, recall: float = RECALL, misread: float = MISREAD) -> Scheme:
    """The scheme of fewest walks at which planted leaks reach the recall."""
    for walks in range(1, MOST_WALKS + 1):
        scheme = Scheme(walks)
        if planted_recall(folded, scheme, words, misread) >= recall:
            break
    return scheme


def find_leaks(pages: DataFrame, page_id: str, text: str, boxes: str | None, items: DataFrame, item_id: str, passage: str, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(page_id, item_id, words): pages that hold at least ``words`` consecutive words of a passage.

    ``boxes`` names an array of structs with the field x, one for each line of text; without it, or
    where their numbers differ, lines are read in their order. Null and empty texts and passages leak
    nothing; passages of fewer words can't be found. Each pair comes once, so pages that repeat an id
    give it more than once. A passage that runs on from one column into the next counts in each by
    itself. ``recall`` is what planted leaks must reach; it is measured on at most PLANTED passages.
    """
    item_name = item_id if item_id != page_id else f"item_{item_id}"
    field, kind = T.StructField(item_name, items.schema[item_id].dataType), to_arrow_type(items.schema[item_id].dataType)
    chosen = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{passage}`").alias("p")).where("p IS NOT NULL AND i IS NOT NULL")
    passes = max(1, -(-int(chosen.agg(F.sum(F.octet_length("p"))).collect()[0][0] or 0) // PASS_BYTES))
    found = []
    for part in range(passes):
        own = [(row.i, fold_passage(row.p)) for row in chosen.where(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(passes)) == part).toLocalIterator()]
        scheme = scheme_for([f for _, f in own[:: max(1, len(own) // PLANTED)]], words, recall)
        context = pages.sparkSession.sparkContext
        found.append(_search(pages, page_id, text, boxes, [context.broadcast((*zip(*block), scheme, words)) for block in _blocks(own)], field, kind))
    return reduce(DataFrame.unionByName, found)


def _blocks(items: list[tuple[object, bytes]]) -> list[list[tuple[object, bytes]]]:
    blocks, held = [], BLOCK_BYTES
    for item in items:
        if held >= BLOCK_BYTES:
            blocks.append([])
            held = 0
        blocks[-1].append(item)
        held += len(item[1])
    return blocks


def _search(pages: DataFrame, page_id: str, text: str, boxes: str | None, blocks: list, item: T.StructField, kind: pa.DataType) -> DataFrame:
    """One pass over the pages for all blocks of passages; a task has one block's tables at a time."""
    schema = T.StructType([pages.schema[page_id], item, T.StructField("words", T.IntegerType())])

    def leaks(passages: Passages, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = max(1, int(batch.num_rows * BATCH_CHARS / max(batch.column(1).nbytes, 1)))
        for a in range(0, batch.num_rows, size):
            part = batch.slice(a, size)
            lefts: list[list[int] | None] = part.column(2).to_pylist() if boxes else [None] * part.num_rows
            if found := leaked_in(passages, part.column(1).to_pylist(), lefts):
                page, which, count = zip(*found)
                ids = pa.array([passages.ids[k] for k in which], kind)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(page)), ids, pa.array(count, pa.int32())], names=schema.names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(blocks) == 1:
            passages = Passages(*blocks[0].value)
            for batch in batches:
                yield from leaks(passages, batch)
            return
        held, size = [], 0
        for batch in batches if blocks else ():
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from every(held)
                held, size = [], 0
        yield from every(held)

    def every(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks if held else ():
            passages = Passages(*block.value)
            for batch in held:
                yield from leaks(passages, batch)

    left = [F.transform(F.col(f"`{boxes}`"), lambda b: b["x"]).alias("left")] if boxes else []
    return pages.select(F.col(f"`{page_id}`"), F.col(f"`{text}`").alias("t"), *left).where("t <> ''").mapInArrow(search, schema)
