"""Whole texts to token ids of a byte-level BPE vocabulary, by replaying its merges over a block of the corpus.

All distinct words of a block lie in one symbol array. An inverted index leads from the rank of a
token pair to the positions where it stands; merges are applied in rank order, each to all its
positions at once, and only the pairs with touched neighbours are entered anew. The ids of the words
are then gathered back into texts. Blocks are bounded by their characters, so memory is bounded; a
worker keeps the ids of words it has met, up to a bound, and encodes only new ones. Nothing is
shuffled.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions.ragged import span_index

#: Characters of text in one block, and words whose ids a worker keeps between blocks.
BLOCK_CHARS = 12_000_000
KEPT_WORDS = 400_000

#: The code points that Unicode calls white space.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _char_class(codes: list[int]) -> str:
    """The inside of a regex character class of the sorted code points."""
    out, start = [], None
    for i, code in enumerate(codes):
        if start is None:
            start = code
        if i + 1 == len(codes) or codes[i + 1] != code + 1:
            out.append(f"\\U{start:08x}-\\U{code:08x}" if code > start else f"\\U{code:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern[str]:
    """The public splitting pattern of byte-level BPE, with Unicode's letters, numbers and white space spelled out."""
    kinds: dict[str, list[int]] = {"L": [], "N": []}
    for code in range(sys.maxunicode + 1):
        if (kind := unicodedata.category(chr(code))[0]) in kinds:
            kinds[kind].append(code)
    letters, numbers, space = _char_class(kinds["L"]), _char_class(kinds["N"]), _char_class(sorted(WHITE_SPACE))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the bytes, as vocabularies of this kind write them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The vocabulary as arrays: ids of single bytes, and the merges by rank."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, np.int64)
        for letter, byte in _byte_alphabet().items():
            self.byte_ids[byte] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = int(max(vocab.values())) + 2
        code = self.left * self.width + self.right
        self.order = np.argsort(code, kind="stable")
        self.codes = code[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1 where it is no merge."""
        code = left * self.width + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.order[at], -1)


@lru_cache(maxsize=2)
def load_merges(path: str) -> Merges:
    return Merges(path)


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and how many each word has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    # every word is followed by a stop, so neighbours never reach over
    ends = np.cumsum(lengths + 1)
    symbols = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
    symbols[span_index(ends - lengths - 1, lengths)] = merges.byte_ids[raw]
    total = len(symbols)
    after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
    waiting: dict[int, list[np.ndarray]] = {}

    def enter(positions: np.ndarray) -> None:
        ranks = merges.ranks(symbols[positions], symbols[after[positions]])
        real = ranks >= 0
        ranks, positions = ranks[real], positions[real]
        if len(ranks) > 8:
            by = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[by], positions[by]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
                waiting.setdefault(rank, []).append(part)
        else:
            for i, rank in enumerate(ranks.tolist()):
                waiting.setdefault(rank, []).append(positions[i : i + 1])

    if total:
        enter(np.flatnonzero(symbols[:-1] >= 0))
    for rank in range(len(merges.made)):
        if (parts := waiting.pop(rank, None)) is None:
            continue
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        left, right = merges.left[rank], merges.right[rank]
        if left == right:
            at = np.unique(at)
        nxt = after[at]
        live = (symbols[at] == left) & (symbols[nxt] == right)
        at, nxt = at[live], nxt[live]
        if left == right and len(at) > 1:
            # a run of one symbol merges from its left end, two by two
            linked = np.concatenate([[False], at[1:] == nxt[:-1]])
            start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
            keep = (np.arange(len(at)) - start) % 2 == 0
            at, nxt = at[keep], nxt[keep]
        if not len(at):
            continue
        symbols[at], symbols[nxt] = merges.made[rank], -2
        far = after[nxt]
        after[at] = far
        before[far] = at
        prior = before[at]
        prior = prior[prior >= 0]
        enter(np.concatenate([at, prior[symbols[prior] >= 0]]))
    live = symbols >= 0
    return symbols[live].astype(np.int32), np.add.reduceat(live, ends - lengths - 1).astype(np.int64) if len(words) else lengths


class Encoder:
    """Ids of texts; remembers the ids of words between blocks, up to KEPT_WORDS."""

    def __init__(self, path: str) -> None:
        self.merges, self.split = load_merges(path), word_pattern().findall
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.place) > KEPT_WORDS:
            self.forget()
        place = self.place
        known = len(place)
        placed, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            words = self.split(text)
            counts[i] = len(words)
            placed.append(np.fromiter([place.setdefault(w, len(place)) for w in words], np.int32, len(words)))
        fresh = list(place)[known:]
        if fresh:
            ids, sizes = replay([w.encode("utf-8", "surrogatepass") for w in fresh], self.merges)
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        if not placed:
            return np.zeros(0, np.int32), counts
        words = np.concatenate(placed)
        starts = np.cumsum(self.sizes) - self.sizes
        lengths = self.sizes[words]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        of_text = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[span_index(starts[words], lengths)], np.diff(ends[of_text])


def encode_corpus(df: DataFrame, text: str, vocabulary: str, output: str = "ids", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` without ``text`` but with ``output``, an array of int: the token ids of the text, without special tokens.

    Strings of special tokens in a text are ordinary text. A null or empty text has no ids: an empty
    array. ``vocabulary`` is the path of a tokenizer JSON file that every worker can read. An input
    column named like ``output`` is replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in (text, output)]
    schema = T.StructType([*kept, T.StructField(output, T.ArrayType(T.IntegerType(), False), False)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, chars = Encoder(vocabulary), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, counts = encoder([t for batch in held for t in batch.column(len(kept)).to_pylist()])
            done_rows = done_ids = 0
            for batch in held:
                own = counts[done_rows : done_rows + batch.num_rows]
                offsets = np.concatenate([[0], np.cumsum(own)]).astype(np.int32)
                values = pa.array(ids[done_ids : done_ids + offsets[-1]], pa.int32())
                listed = pa.ListArray.from_arrays(pa.array(offsets), values, type=pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], listed], names=schema.names)
                done_rows, done_ids = done_rows + batch.num_rows, done_ids + int(offsets[-1])

        for batch in batches:
            held.append(batch)
            chars += batch.column(len(kept)).nbytes
            if chars >= block_chars:
                yield from flush()
                held, chars = [], 0
        if held:
            yield from flush()

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`")).mapInArrow(encode, schema)
