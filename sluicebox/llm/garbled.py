"""Text decoded with the wrong character encoding: found and undone by a hidden Markov model.

The states are one for clean text and one for each way a text can have gone wrong (bytes of one
encoding read as another). Each state emits a character given the one before it; what the clean state
emits is counted over the whole corpus, and what a garbled state emits follows from the same counts
put through its two encodings. The most likely states of a line label its characters, and each
garbled span gets its state's inverse.

Lines that no state could win are told beforehand from a bound on what each of their words could
gain; the bounds of words are kept, so the model itself runs over few lines. Only counts are shuffled:
pairs of neighbouring characters, of which a corpus has no more however long it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOST = "�"
#: Log probability, per character, of entering any garbled state and of leaving it.
ENTER, LEAVE = -8.0, -3.0
#: Share of each emission that knows nothing of the character before: misreadings and specks fall anywhere.
STRAY = 0.03
#: The same for entering a state that the page has already met with EVIDENCE characters.
AGAIN, EVIDENCE = -4.0, 4
#: Share of a restored line's neighbours that clean lines must have, and how often they must have them.
LIKELY, SEEN = 0.5, 2
#: Pairs of characters for which smoothing and SEEN hold as they are; for a longer corpus they grow in proportion.
#: Some garbled lines always count as clean: against a fixed smoothing all like them would come to seem so.
MASS = 1_700_000
#: Characters of a line that are labelled together, and characters on either side that they are seen with.
LONG_LINE, OVERLAP = 2000, 200
#: Words whose bounds a worker keeps.
KEPT_WORDS = 300_000

#: Fixed values: (encoding of the bytes, encoding they were read as, how often in a row).
PAIRS = (
    ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1250", 1), ("utf-8", "cp1251", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1),
    ("utf-8", "mac-roman", 1), ("utf-8", "iso8859-15", 1), ("utf-8", "iso8859-2", 1), ("utf-8", "koi8-r", 1), ("utf-8", "cp866", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2),
    ("cp1252", "mac-roman", 1), ("cp1252", "cp437", 1), ("cp1252", "cp850", 1), ("cp1252", "cp1250", 1), ("cp1252", "cp1251", 1),
    ("mac-roman", "cp1252", 1), ("cp437", "cp1252", 1), ("cp850", "cp1252", 1),
    ("iso8859-2", "cp1252", 1), ("cp1250", "cp1252", 1), ("iso8859-2", "cp1250", 1), ("cp1250", "iso8859-2", 1), ("cp852", "cp1252", 1), ("cp852", "cp1250", 1),
    ("cp1251", "cp1252", 1), ("cp1251", "koi8-r", 1), ("cp1251", "cp866", 1), ("koi8-r", "cp1251", 1), ("koi8-r", "cp1252", 1), ("koi8-r", "cp866", 1), ("cp866", "cp1251", 1), ("cp866", "cp1252", 1),
)
#: Marks that dust leaves on a scan.
SPECKS = frozenset("°·•")
_PLAINER = str.maketrans({"’": "'", "‘": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "—": "-", "–": "-", "‐": "-", "‑": "-", "…": "...", "★": "*", **dict.fromkeys("─═├┤╔╗╚╝", "-"), **dict.fromkeys("│║", "|")})


class Codec:
    """A single-byte encoding as tables; bytes it leaves undefined are the control characters of that number."""

    def __init__(self, name: str) -> None:
        self.chars = []
        for byte in range(256):
            try:
                self.chars.append(bytes([byte]).decode(name))
            except UnicodeDecodeError:
                self.chars.append(chr(byte))
        self.bytes = {c: b for b, c in reversed(list(enumerate(self.chars)))}

    def read(self, data: bytes) -> str:
        return "".join(map(self.chars.__getitem__, data))

    def write(self, text: str) -> bytes:
        return bytes(map(self.bytes.__getitem__, text))


_CODECS = {name: Codec(name) for pair in PAIRS for name in pair[:2] if name != "utf-8"}


def _sure_sequences() -> tuple[re.Pattern[str], re.Pattern[str]]:
    """UTF-8 sequences of two or three bytes as single-byte encodings read them, such as no text has: not of letters alone.

    The first pattern is of how all of them begin, and quicker.
    """
    options, leads, tails = set(), set(), set()
    for right, wrong, _ in PAIRS:
        if right != "utf-8":
            continue
        chars = _CODECS[wrong].chars
        lead, long, tail = chars[0xC2:0xE0], chars[0xE0:0xF0], chars[0x80:0xC0]
        leads.update(lead, long)
        tails.update(tail)
        # frames of adverts are made of the same boxes
        signs = {name: [c for c in own if not c.isalpha() and not "\u2500" <= c <= "\u257f"] for name, own in (("lead", lead), ("tail", tail))}
        boxes = [c for c in lead if "\u2500" <= c <= "\u257f"]
        plain = [c for c in tail if not "\u2500" <= c <= "\u257f"]
        for first, then in ((lead, signs["tail"]), (signs["lead"], tail), (boxes, plain)):
            if first and then:
                options.add(f"[{re.escape(''.join(first))}][{re.escape(''.join(then))}]")
        if signs["tail"]:
            options.add(f"[{re.escape(''.join(long))}][{re.escape(''.join(signs['tail']))}][{re.escape(''.join(tail))}]")
    begin = "".join(f"[{re.escape(''.join(sorted(c)))}]" for c in (leads, tails))
    return re.compile(begin), re.compile("|".join(sorted(options)))


_MAYBE, _SURE = _sure_sequences()


def _plainer(char: str, known: dict[str, int]) -> str:
    """What stands for a character that an encoding lacks."""
    return "".join(c if c in known else "?" for c in char.translate(_PLAINER))


class _Table(dict):
    """Character to what is read for it, filled as characters come up."""

    def __init__(self, right: str, wrong: str) -> None:
        super().__init__()
        self.write, self.read = _CODECS[right].bytes, _CODECS[wrong].chars

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = char if char in self.write else _plainer(char, self.write)
        self[code] = "".join(self.read[self.write[c]] for c in plain)
        return self[code]


@lru_cache(maxsize=None)
def _table(right: str, wrong: str) -> dict[int, str]:
    if right == "utf-8":
        return dict(enumerate(_CODECS[wrong].chars))
    return _Table(right, wrong)


def garble(text: str, pair: tuple[str, str, int]) -> str:
    """What becomes of a text by the pair; characters that the encoding lacks become plainer ones."""
    right, wrong, times = pair
    for _ in range(times):
        if right == "utf-8":
            text = text.encode("utf-8", "replace").decode("latin-1")
        text = text.translate(_table(right, wrong))
    return text


def ungarble(text: str, pair: tuple[str, str, int]) -> str:
    """The inverse, as far as the bytes allow; what can't be undone stays."""
    right, wrong, times = pair
    codec = _CODECS[wrong]
    for _ in range(times):
        out, run = [], []

        def settle() -> None:
            if right != "utf-8":
                out.append(_CODECS[right].read(bytes(run)))
            else:
                data = bytes(run)
                while data:
                    try:
                        out.append(data.decode("utf-8"))
                        break
                    except UnicodeDecodeError as fault:
                        out.append(data[: fault.start].decode("utf-8"))
                        out.append(codec.read(data[fault.start : fault.end]))
                        data = data[fault.end :]
            run.clear()

        for char in text:
            byte = codec.bytes.get(char)
            if byte is None:
                settle()
                out.append(char)
            else:
                run.append(byte)
        settle()
        text = "".join(out)
    return text


def _ascii_class(code: int) -> int:
    char = chr(code)
    return 0 if char.isspace() else 1 if char.islower() else 2 if char.isupper() else 3 if char.isdigit() else 4


_ASCII_CLASS = np.array([_ascii_class(c) for c in range(128)], np.int32)
_CLASSES = 6  # five of ASCII, and one for characters that no state knows


@dataclass
class Model:
    """Symbols of characters, and for each pair of symbols the log emission of the second in every state (clean first)."""

    symbol: np.ndarray
    emission: np.ndarray
    pairs: tuple[tuple[str, str, int], ...]
    enter: np.ndarray
    #: Characters of clean lines beside ASCII, and pairs of neighbours of which one is such.
    chars: frozenset[str]
    neighbours: frozenset[str]

    def symbols(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.symbol[np.minimum(codes, len(self.symbol) - 1)]


def _folded(text: str) -> str:
    return "".join(" " if c.isspace() else c for c in text.casefold())


def _neighbours(text: str) -> list[str]:
    """Pairs of neighbouring characters of which one is beside ASCII, without case; lost characters aside."""
    folded = _folded(f" {text} ")
    return [a + b for a, b in zip(folded, folded[1:]) if (a > "\x7f" or b > "\x7f") and LOST not in (a, b)]


#: A pair of neighbouring characters as one number: code of the first times this, and code of the second.
_BASE = 1 << 21
#: Numbers up to this are counted in an array, others by sorting.
_DENSE = 1 << 22


@dataclass
class Pairs:
    """How often each pair of neighbouring characters stands in lines, whose ends count as line ends."""

    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, lines: list[str]) -> Pairs:
        codes = np.frombuffer("\n".join(["", *lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        met = np.zeros(int(codes.max()) + 1, bool)
        met[codes] = True
        own = np.flatnonzero(met)
        if len(own) ** 2 > _DENSE:
            codes = codes.astype(np.int64)
            return cls(*np.unique(codes[:-1] * _BASE + codes[1:], return_counts=True)) if lines else cls.none()
        place = np.cumsum(met) - 1
        seen = place[codes]
        counts = np.bincount(seen[:-1] * len(own) + seen[1:], minlength=1)
        at = np.flatnonzero(counts)
        return cls(own[at // len(own)] * _BASE + own[at % len(own)], counts[at]) if lines else cls.none()

    @classmethod
    def none(cls) -> Pairs:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def plus(self, other: Pairs, times: int = 1) -> Pairs:
        keys, at = np.unique(np.concatenate([self.keys, other.keys]), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, np.concatenate([self.counts, times * other.counts]))
        return Pairs(keys[counts != 0], counts[counts != 0])

    def at_most(self, mass: float) -> Pairs:
        """All pairs in the same shares, their counts scaled down where they are more than ``mass`` together."""
        return Pairs(self.keys, self.counts * min(1.0, mass / max(int(self.counts.sum()), 1)))

    def mapped(self, to: Callable[[str], str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, count) of the pairs, by code, of the lines put through ``to`` character by character."""
        first, second = self.keys // _BASE, self.keys % _BASE
        own, at = np.unique(np.concatenate([first, second]), return_inverse=True)
        often = np.bincount(at[: len(first)], weights=self.counts, minlength=len(own))
        made = [[ord(c) for c in to(chr(code))] for code in own.tolist()]
        head, tail = np.array([m[0] for m in made], np.int64), np.array([m[-1] for m in made], np.int64)
        within = [(a, b, n) for m, n in zip(made, often.tolist()) for a, b in zip(m, m[1:])]
        inner = np.array(within, np.float64).reshape(-1, 3)
        return (
            np.concatenate([tail[at[: len(first)]], inner[:, 0].astype(np.int64)]),
            np.concatenate([head[at[len(first) :]], inner[:, 1].astype(np.int64)]),
            np.concatenate([self.counts, inner[:, 2]]),
        )


def _emissions(follows: tuple[np.ndarray, np.ndarray, np.ndarray], symbol: np.ndarray, known: np.ndarray, floor: float) -> np.ndarray:
    """Log probability of each symbol after each, backed off to the symbol alone."""
    count = int(symbol.max()) + 1
    first, second = (symbol[np.minimum(codes, 0xFFFF)] for codes in follows[:2])
    pairs = np.bincount(first.astype(np.int64) * count + second, weights=follows[2], minlength=count * count).reshape(count, count).astype(np.float64)
    single = pairs.sum(1)
    single[symbol[ord("\n")]] += 1  # the last line end, which nothing follows
    single[known] += 0.2
    single = single / single.sum() * (1 - floor * count) + floor
    after = (pairs + 2.0 * single[None, :]) / (pairs.sum(1, keepdims=True) + 2.0)
    return np.log((1 - STRAY) * after + STRAY * single[None, :])


#: What a pass over the lines gives: pairs of characters, and how many lines have each state as their commonest.
_Labelled = tuple[Pairs, np.ndarray]


def train(texts: list[str], pairs: tuple[tuple[str, str, int], ...] = PAIRS, rounds: int = 3, floor: float = 1e-7) -> Model:
    """A model from pages of the corpus, most of which are clean.

    What is clean is learned from the pages: first all lines count as clean but those with sequences that
    only wrong decodings make, then those of them that the model itself so labels. No alphabet is given.
    """
    return _learned(_may_be_clean(texts), lambda model: _labelled(model, texts, {}), pairs, rounds, floor)


def _lines(texts: list[str | None]) -> tuple[list[str], list[int]]:
    """Lines beside ASCII, and the number of each one's page."""
    found = [(line, page) for page, text in enumerate(texts) if text and not text.isascii() for line in text.split("\n") if not line.isascii()]
    return [line for line, _ in found], [page for _, page in found]


def _may_be_clean(texts: list[str | None]) -> Pairs:
    return Pairs.of(_unsure(_lines(texts)[0]))


def _unsure(lines: list[str]) -> list[str]:
    """Lines that may be clean: without a lost character, or a sequence that only wrong decodings make."""
    return [line for line in lines if LOST not in line and not (_MAYBE.search(line) and _SURE.search(line))]


def _labelled(model: Model, texts: list[str | None], known: dict[str, tuple[float, np.ndarray]]) -> _Labelled:
    """Pairs of the lines that might be clean and aren't, and the commonest states of all that aren't."""
    lines, pages = _lines(texts)
    labels = label_lines(model, lines, known)
    _look_again(model, lines, pages, labels)
    found = [(line, label) for line, label in zip(lines, labels) if label is not None]
    states = np.array([np.bincount(label[label > 0]).argmax() for _, label in found], np.int64)
    return Pairs.of(_unsure([line for line, _ in found])), np.bincount(states, minlength=len(model.enter))


def _learned(unsure: Pairs, labelled: Callable[[Model], _Labelled], pairs: tuple[tuple[str, str, int], ...], rounds: int, floor: float) -> Model:
    """The model that counts of all lines lead to, in so many rounds."""
    model = _fit(unsure, pairs, floor)
    for last in range(rounds - 1, -1, -1):
        garbled, states = labelled(model)
        if last:
            model = _fit(unsure.plus(garbled, -1), pairs, floor)
        met = states[1:] + 2.0
        model.enter[1:] = ENTER + np.log(met / met.sum())
    return model


def _fit(clean: Pairs, pairs: tuple[tuple[str, str, int], ...], floor: float) -> Model:
    clean = clean.at_most(MASS)
    plain = clean.mapped(str)
    codes = np.unique(np.concatenate([*plain[:2], [ord("\n")]]))
    symbol = np.full(0x10000, _CLASSES - 1, np.int32)
    symbol[:128] = _ASCII_CLASS
    # garbled text has no other characters than these
    high = {ord(c) for pair in pairs for c in _CODECS[pair[1]].chars[128:]} | {ord(LOST)}
    own = np.array(sorted(c for c in high if 127 < c < 0xFFFF))
    symbol[own] = np.arange(_CLASSES, _CLASSES + len(own))
    # other characters of clean lines, of which there may be any number, are told apart by their kind
    others = [c for c in codes.tolist() if 127 < c < 0xFFFF and c not in high]
    kinds = sorted({unicodedata.category(chr(c)) for c in others})
    symbol[others] = [_CLASSES + len(own) + kinds.index(unicodedata.category(chr(c))) for c in others]
    clean_own = np.unique(symbol[np.minimum(codes, 0xFFFF)])
    tables = [_emissions(plain, symbol, clean_own[clean_own >= _CLASSES], floor / 10)]
    for pair in pairs:
        known = symbol[[ord(c) for c in _CODECS[pair[1]].chars[128:]]]
        tables.append(_emissions(clean.mapped(lambda c, pair=pair: garble(c, pair)), symbol, np.unique(known), floor))
    # a lost character is as likely as not within lost text, and floors elsewhere
    lost = tables[0].copy()
    at = int(symbol[ord(LOST)])
    lost[:, at] = np.log(0.1)
    lost[at, :] = np.maximum(lost[at, :], np.log(0.02))
    lost[at, at] = np.log(0.3)
    count = len(tables[0])
    emission = np.stack([*tables, lost], axis=-1).reshape(count * count, -1).astype(np.float32)
    enter = np.full(emission.shape[1], ENTER - np.log(len(pairs) + 1), np.float32)
    enter[0] = 0
    chars: Counter[str] = Counter()
    for code, n in zip(plain[0].tolist(), plain[2].tolist()):
        chars[chr(code)] += n
    counted: Counter[str] = Counter()
    for a, b, n in zip(*(x.tolist() for x in clean.mapped(_folded))):
        if (a > 127 or b > 127) and ord(LOST) not in (a, b):
            counted[chr(a) + chr(b)] += n
    return Model(symbol, emission, pairs, enter, frozenset(c for c, n in chars.items() if n >= SEEN and c > "\x7f" and c != LOST), frozenset(p for p, n in counted.items() if n >= SEEN))


def _gains(model: Model, words: list[str]) -> np.ndarray:
    """For each word, the most that each garbled state could gain over clean on it."""
    seen = model.symbols(" " + " ".join(words) + " ")
    count = int(np.sqrt(len(model.emission)))
    steps = model.emission[seen[:-1].astype(np.int64) * count + seen[1:]]
    gain = np.maximum(steps[:, 1:] - steps[:, :1], 0)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return np.add.reduceat(gain, np.cumsum(lengths) - lengths, axis=0)


def _viterbi(model: Model, lines: list[str], enter: list[np.ndarray] | None = None) -> list[np.ndarray | None]:
    """State of each character of each line; None for a line that is clean throughout. ``enter`` may differ by line."""
    pieces, owners = [], []
    for i, line in enumerate(lines):
        own = [line] if len(line) <= LONG_LINE else _overlapping(line)
        pieces.extend(own)
        owners.extend([i] * len(own))
    found = _label_pieces(model, pieces, enter and [enter[i] for i in owners])
    if len(pieces) == len(lines):
        return found
    by_line: list[list] = [[] for _ in lines]
    for i, label in zip(owners, found):
        by_line[i].append(label)
    return [own[0] if len(own) == 1 else _put_together(len(line), own) for line, own in zip(lines, by_line)]


def _label_pieces(model: Model, lines: list[str], enter: list[np.ndarray] | None) -> list[np.ndarray | None]:
    """``_viterbi`` of lines that are labelled at once."""
    count, states = int(np.sqrt(len(model.emission))), model.emission.shape[1]
    out: list[np.ndarray | None] = [None] * len(lines)
    by_length = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    begin = 0
    while begin < len(by_length):
        longest = len(lines[by_length[min(begin + 511, len(by_length) - 1)]])
        size = max(1, min(512, 3_000_000 // max(1, longest * states)))
        part = by_length[begin : begin + size]
        begin += size
        width = len(lines[part[-1]]) + 1
        seen = np.zeros((len(part), width + 1), np.int64)
        lengths = np.array([len(lines[i]) for i in part])
        for row, i in enumerate(part):
            seen[row, 1 : 1 + lengths[row]] = model.symbols(lines[i])
        opened = np.repeat(model.enter[None, :], len(part), 0) if enter is None else np.stack([enter[i] for i in part])
        score = opened.copy()
        jumped = np.zeros((width, len(part), states), bool)
        best_at = np.zeros((width, len(part)), np.int16)
        for t in range(width):
            left = score + LEAVE
            left[:, 0] = score[:, 0]
            best = left.argmax(1)
            top = left[np.arange(len(part)), best][:, None] + opened
            jump = top > score
            jumped[t], best_at[t] = jump, best
            score = np.maximum(score, top) + model.emission[seen[:, t] * count + seen[:, t + 1]]
            if t and t % 64 == 0:
                score -= score.max(1, keepdims=True)
            # past the end of a line only the padding follows, alike for all states
            over = t >= lengths + 1
            if over.any():
                score[over] = score_end[over]
            score_end = score.copy()
        state = score.argmax(1)
        path = np.zeros((len(part), width), np.int16)
        rows = np.arange(len(part))
        for t in range(width - 1, -1, -1):
            inside = t < lengths + 1
            path[inside, t] = state[inside]
            step = jumped[t, rows, state] & inside
            state = np.where(step, best_at[t], state)
        for row, i in enumerate(part):
            own = path[row, : lengths[row]]
            if own.any():
                out[i] = own
    return out


def label_lines(model: Model, lines: list[str], known: dict[str, tuple[float, np.ndarray]] | None = None) -> list[np.ndarray | None]:
    """State of each character of each line, 0 for clean; None for a line that is clean throughout."""
    known = {} if known is None else known
    if len(known) > KEPT_WORDS:
        known.clear()
    words = [[w for w in line.split(" ") if not w.isascii()] for line in lines]
    fresh = list({w: None for own in words for w in own if w not in known})
    for a in range(0, len(fresh), 20_000):
        part = fresh[a : a + 20_000]
        gains = _gains(model, part)
        known.update(zip(part, zip(gains.max(1).tolist(), gains)))
    out: list[np.ndarray | None] = [None] * len(lines)
    # the sum over words of what any state gains tells most lines, and the sums by state the others
    least = -float(model.enter[1:].max()) - 0.01
    maybe = [i for i, own in enumerate(words) if own and sum([known[w][0] for w in own]) > least]
    suspect = [i for i in maybe if (sum(known[w][1] for w in words[i]) + model.enter[1:]).max() > 0]
    for i, label in zip(suspect, _viterbi(model, [lines[i] for i in suspect])):
        out[i] = label
    return out


def _look_again(model: Model, lines: list[str], pages: list[int], labels: list[np.ndarray | None]) -> None:
    """Label anew, in place, the lines of pages that have met a garbled state: there it is likelier."""
    met: dict[int, np.ndarray] = {}
    for page, line, label in zip(pages, lines, labels):
        if label is not None:
            high = label[[c > "\x7f" for c in line]]
            met[page] = met.get(page, 0) + np.bincount(high[high > 0], minlength=len(model.enter))
    enters = {page: np.where(count >= EVIDENCE, np.maximum(model.enter, AGAIN), model.enter) for page, count in met.items() if (count >= EVIDENCE).any()}
    for enter in enters.values():
        enter[0] = 0
    again = [i for i, page in enumerate(pages) if page in enters]
    for i, label in zip(again, _viterbi(model, [lines[i] for i in again], [enters[pages[i]] for i in again])):
        labels[i] = label


def _plausible(model: Model, text: str) -> bool:
    return model.chars.issuperset(c for c in text if c > "\x7f")


def _inverse(model: Model, span: str, pair: tuple[str, str, int]) -> str:
    """The inverse of a state, or of one akin to it that alone gives clean characters."""
    better = ungarble(span, pair)
    if not _plausible(model, better):
        for other in model.pairs:
            if other[::2] == pair[::2] and (tried := ungarble(span, other)) != span and _plausible(model, tried):
                return tried
    return better


def _is_speck(model: Model, span: str, better: str) -> bool:
    """Whether one or two characters labelled garbled may be specks: what they stand for is nothing, or nothing clean, or a speck beside a Cyrillic letter."""
    return (
        better == span or not _plausible(model, better) or ("\u0400" <= next(c for c in span if c > "\x7f") <= "\u04ff" and all(c in SPECKS for c in better if c > "\x7f"))
    )


def restore_line(model: Model, line: str, label: np.ndarray) -> tuple[str, int]:
    """The line with each garbled span put through its state's inverse, and its number of garbled characters.

    Lost characters stay. One or two characters that may be specks don't count, and stay. So do all
    but the lost ones where the restored line is no likelier text than the line: where its neighbours
    beside ASCII aren't those of clean lines (LIKELY). Text of a language that the corpus lacks stays as it is.
    """
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [len(line)]])
    parts, kept, hits, lost = [], [], 0, 0
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        span, state = line[a:b], int(label[a])
        high = sum(c > "\x7f" for c in span) if state else 0
        better = span
        if high and state > len(model.pairs):
            lost += span.count(LOST)
        elif high:
            tried = _inverse(model, span, model.pairs[state - 1])
            if high > 2 or not _is_speck(model, span, tried):
                better = tried
                hits += high
        parts.append(better)
        kept.append(span)
    restored = "".join(parts)
    if hits and not likelier(model, restored, line):
        return line, lost
    return restored, hits + lost


def likelier(model: Model, restored: str, line: str) -> bool:
    """Whether most neighbours of the restored line are such as clean lines have, and no fewer than those of the line. Known signs may stand anywhere."""

    def share(text: str) -> float:
        own = _neighbours(text)
        known = sum(p in model.neighbours or all(c < "\x7f" or (not c.isalpha() and c in model.chars) for c in p) for p in own)
        return known / max(len(own), 1)

    return restored.isascii() or (share(restored) >= LIKELY and share(restored) >= share(line))


def train_on(df: DataFrame, text: str, rounds: int = 3, floor: float = 1e-7) -> Model:
    """``train`` on all documents: each round is a pass over them, and counts alone go to the driver."""
    pages = df.select(F.col(f"`{text}`").alias("t")).where(F.octet_length("t") > F.length("t"))
    (unsure,) = _tallied(pages, lambda: lambda texts: (_may_be_clean(texts),), 1)

    def labelled(model: Model) -> _Labelled:
        def start() -> Callable[[list[str]], tuple[Pairs, Pairs]]:
            known: dict[str, tuple[float, np.ndarray]] = {}

            def of(texts: list[str]) -> tuple[Pairs, Pairs]:
                garbled, states = _labelled(model, texts, known)
                return garbled, Pairs(np.arange(len(states)), states)

            return of

        garbled, states = _tallied(pages, start, 2)
        return garbled, np.bincount(states.keys, weights=states.counts, minlength=len(model.enter))

    return _learned(unsure, labelled, PAIRS, rounds, floor)


def _tallied(pages: DataFrame, start: Callable[[], Callable[[list[str]], tuple[Pairs, ...]]], kinds: int) -> list[Pairs]:
    """Sums over all pages of what the function that ``start`` gives each task makes of some of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, of = [Pairs.none()] * kinds, start()
        for batch in batches:
            sums = [a.plus(b) for a, b in zip(sums, of(batch.column(0).to_pylist()))]
        for kind, own in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.keys), kind, np.int32)), pa.array(own.keys), pa.array(own.counts)], names=["kind", "key", "n"])

    # partial sums meet by key; one row for each pair of characters there is goes to the driver
    found = pages.mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, key, n = (found.column(c).to_numpy() for c in ("kind", "key", "n"))
    out = []
    for k in range(kinds):
        order = np.argsort(key[kind == k])
        out.append(Pairs(key[kind == k][order], n[kind == k][order]))
    return out


def _pieces(page: str) -> list[str]:
    """The page in lines, each with its line end."""
    lines = [line + "\n" for line in page.split("\n")]
    lines[-1] = lines[-1][:-1]
    return lines


def _overlapping(line: str) -> list[str]:
    """An overlong line in pieces, each with OVERLAP characters of its neighbours on either side."""
    return [line[max(0, a - OVERLAP) : a + LONG_LINE + OVERLAP] for a in range(0, len(line), LONG_LINE)]


def _put_together(length: int, labels: list[np.ndarray | None]) -> np.ndarray | None:
    """The states of an overlong line from those of its pieces, each for its own middle."""
    if all(label is None for label in labels):
        return None
    whole = np.zeros(length, np.int16)
    for a, label in zip(range(0, length, LONG_LINE), labels):
        if label is not None:
            own = label[min(a, OVERLAP) :][:LONG_LINE]
            whole[a : a + len(own)] = own
    return whole


def restore_garbled(df: DataFrame, text: str, model: Model, garbled: str = "garbled_chars", lost: str = "lost_chars", restored: str = "restored") -> DataFrame:
    """``df`` with the number of garbled characters, those of them that are lost, and the restored text.

    Clean, empty and null texts have 0 and 0, and are given as they are. Only characters beside ASCII
    count as garbled. ``restored`` may be "" to leave the text out. Input columns named like outputs are replaced.
    """
    outputs = [garbled, lost, *([restored] if restored else [])]
    kept = [f for f in df.schema.fields if f.name not in outputs]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(garbled, T.IntegerType()), T.StructField(lost, T.IntegerType()), *([T.StructField(restored, T.StringType())] if restored else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, np.ndarray]] = {}
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            lines, owner = [], []
            for i, page in enumerate(texts):
                if page and not page.isascii():
                    for j, line in enumerate(_pieces(page)):
                        if not line.isascii():
                            lines.append(line)
                            owner.append((i, j))
            counts, losses, changed = [0] * len(texts), [0] * len(texts), {}
            labels = label_lines(model, lines, known)
            _look_again(model, lines, [i for i, _ in owner], labels)
            for (i, j), line, label in zip(owner, lines, labels):
                if label is None:
                    continue
                better, hit = restore_line(model, line, label)
                if not hit:
                    continue
                counts[i] += hit
                losses[i] += line.count(LOST)
                if restored:
                    changed.setdefault(i, {})[j] = better
            arrays = [*batch.columns, pa.array(counts, pa.int32()), pa.array(losses, pa.int32())]
            if restored:
                for i, by_line in changed.items():
                    texts[i] = "".join(by_line.get(j, line) for j, line in enumerate(_pieces(texts[i])))
                arrays.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)
