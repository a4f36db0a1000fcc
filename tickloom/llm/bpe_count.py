"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are emitted.

A pre-token starts as one symbol per byte. The adjacent pair of lowest rank is popped again and again,
leftmost first; the count is the initial symbols less the merges made. Counts of chunks between spaces
and line breaks are remembered per worker in a table of bounded size.

Defined results: a null or empty text has no tokens. Special strings inside a text count as one token
each, as the library does by default. A text of any length is counted whole. Extra columns are ignored,
whatever their names; repeated rows are counted each; a null doc_id stays one. An empty table has an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, tidy, utf8

REMEMBERED = 300_000
LIMIT = 2048


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merger:
    """Ranks of merges over integer symbols, read from a ``tokenizers`` file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        chars = byte_symbols()
        self.inner = [vocab[chars[b]] for b in range(256)]
        self.last = [vocab[chars[b] + end] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))))
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {"": 0}

    def merged(self, symbols: list[int]) -> int:
        """How many symbols are left."""
        n, ranks = len(symbols), self.ranks
        heap = [(*r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1])))]
        if not heap:
            return n
        heap = [(rank, i, a, b, new) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # an entry from before a merge
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if r := ranks.get((new, symbols[k])):
                    heapq.heappush(heap, (r[0], i, new, symbols[k], r[1]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], new))):
                heapq.heappush(heap, (r[0], h, symbols[h], new, r[1]))
        return left

    def word(self, text: str) -> int:
        if (n := self.words.get(text)) is None:
            data = text.encode()
            n = self.merged([*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]])
            if len(self.words) < REMEMBERED:
                self.words[text] = n
        return n

    def plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return sum(map(self.word, self.pattern.findall(text)))

    def chunk(self, text: str) -> int:
        if "<" in text and (found := self.special.findall(text)):
            n = len(found) + sum(map(self.plain, self.special.split(text)))
        else:
            n = self.plain(text)
        if len(self.chunks) < REMEMBERED:
            self.chunks[text] = n
        return n

    def count(self, text: str) -> int:
        known, total = self.chunks.get, 0
        for piece in text.replace("\n", " ").split(" "):
            n = known(piece)
            total += self.chunk(piece) if n is None else n
        return total


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; one pass, no shuffle."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for batch in chunks(batches):
            text = batch.column(1)
            n_bytes = utf8(text)[1]
            n = [m.count(t) if t else 0 for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes[1:] - n_bytes[:-1]), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
