"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

Texts are cut into blocks of tokens, stored with a vocabulary of their own. Counts are exchanged order by
order as packed arrays: a block sends its distinct words, then its distinct word pairs, then its distinct
triples, to the parts of the count tables, which add up what all blocks sent and answer in the same order.
The answers, the tables of the model as far as the block needs them, are stored by block in the shared
folder. An n-gram belongs to the part of its context, so that a part holds what the weight of a context
needs; contexts that are very frequent are dealt by n-gram instead, and their sums, which add up, are put
together afterwards. An n-gram whose context has no table is not sent. Nor is one whose context no other block
has, as the answers tell: the block then holds all that training has after it, and counts that itself. Only of
how many such n-grams have which count the parts are told.

A token's probability is found by recursion from the longest context: the discounted relative frequency of
its n-gram if training has it, else the context's backoff weight times the token's probability after the
context without its first word, which is that itself if training lacks the context; and for the word alone
its discounted relative frequency, or the mass that all seen words leave if training lacks the word. A
context of two words or more that training has less often than ``least_context`` counts as lacking, as n-grams
below a cutoff do in Katz's method; probabilities still sum to one. By default it is 1, which keeps every context.
A text's first tokens have the contexts that there are, from a mark of the beginning on. Discounts are
Good-Turing's up to a count of 5, and absolute ones where those are not between 0 and 1. Where nothing
would be left for unseen words, frequencies are taken of one token more.

Defined results: a null or empty text is its end token alone. Repeated rows count each. A null doc_id
is trained on. With no training token at all every token has probability 1. A text of any length is read
whole; a block holds it with others or alone. An empty table has an empty result. Extra columns are ignored.
Words are told apart by 64-bit hashes, contexts within a part by 48 bits, and words after a context by 32.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, Words, chunks, freed, mixed, tidy, utf8
from .scratch import scratch_path, shrunk, written

END, BOS = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
#: What is sent of hashes of contexts, and of last words.
CONTEXT, WORD = U(0xFFFFFFFFFFFF0000), U(0xFFFFFFFF00000000)
CUTOFF = 5
ORDER = 3
#: How often training must have a context of two words or more for it to have a table.
LEAST_CONTEXT = 1
BLOCK_TOKENS = 1_000_000
PART_TOKENS = 1_500_000
#: Contexts with at least this part of all tokens are dealt by n-gram; there can only be so many.
FREQUENT = 256
ANSWER = "g long, block long, part int, blob binary, stats array<long>, context long, seen double"


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte planes: the high bytes of small numbers compress to nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()


def squeezed(data: bytes | None) -> bytes | None:
    """Entropy coding makes counts small, which the shuffle's own codec does not do."""
    return data and zstandard.ZstdCompressor(level=1).compress(data)


def spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Discounts(NamedTuple):
    """The factor of each count up to the cutoff; of larger counts it is 1."""

    factor: np.ndarray

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        """n[r]: how many types have count r, for r from 0 to CUTOFF + 1."""
        out = np.ones(CUTOFF + 2)
        out[0] = 0
        d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        tail = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
        for r in range(1, CUTOFF + 1):
            turing = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
            out[r] = turing if 0 < turing < 1 else (r - d) / r
        return cls(out)

    def apply(self, count: np.ndarray) -> np.ndarray:
        return self.factor[np.minimum(count, CUTOFF + 1)] * count


class Unigrams(NamedTuple):
    discounts: Discounts
    total: int
    types: int
    unknown: float
    scale: float

    @classmethod
    def of(cls, total: int, types: int, n: list[int]) -> Unigrams:
        d = Discounts.of(n)
        cut = sum(n[r] * r * (1 - d.factor[r]) for r in range(1, CUTOFF + 1))
        if not total:
            return cls(d, 0, 0, 1.0, 0.0)
        return cls(d, total, types, cut / total, 1 / total) if cut > 0 else cls(d, total, types, 1 / (total + 1), 1 / (total + 1))

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discounts.apply(count) * self.scale, self.unknown)


def gram_hashes(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their contexts and the first bits of those of their last words."""
    return mixed(contexts + mixed(words ^ END))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, the place of each value among them, and where some occurrence of each is: what
    np.unique tells, in less memory."""
    order = np.argsort(values)
    values = values[order]
    new = np.empty(len(values), bool)
    new[:1], new[1:] = True, values[1:] != values[:-1]
    place = np.cumsum(new, dtype=np.int32 if len(values) < 1 << 31 else np.int64)
    place -= 1
    inverse = np.empty_like(place)
    inverse[order] = place
    return values[new], inverse, order[new]


def among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which values are among a few sorted ones."""
    return few[np.minimum(np.searchsorted(few, values), len(few) - 1)] == values if len(few) else np.zeros(len(values), bool)


class Grams(NamedTuple):
    """Distinct n-grams of a block in the order of the parts. Of each: the place of its context among the n-grams one
    shorter (or the words), the hash of its context and its own, the place of what it ends with without its first word,
    and what is sent of its last word's hash. ``of_token`` has the place of each token's n-gram, -1 for none. Places take
    32 bits, as a block has less tokens than that."""

    context: np.ndarray
    hashes: np.ndarray
    own: np.ndarray
    shorter: np.ndarray
    word: np.ndarray
    of_token: np.ndarray
    cut: np.ndarray


class Block:
    """Tokens of some documents; ``vocab`` is sorted, ``ids`` are places in it, ``begins`` each text's first token."""

    def __init__(self, row: dict):
        self.g, self.block = row["g"], row["block"]
        self.doc_ids, self.held = row["doc_ids"], np.frombuffer(row["held"], bool)
        self.vocab, self.ids = np.frombuffer(row["vocab"], U), np.frombuffer(row["ids"], np.int32)
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.lengths, self.begins = lengths, np.cumsum(lengths) - lengths
        self.trained = np.repeat(~self.held, lengths)

    def words(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vocabulary by part, and where each part begins."""
        return _dealt((mixed(self.vocab) % U(parts)).astype(np.int64), parts)

    def pairs(self, parts: int, frequent: np.ndarray) -> Grams:
        """Word pairs; the context of a text's first token is its beginning, whose place is behind the vocabulary."""
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.begins] = len(self.vocab)
        return self._grams(before, self.ids, np.append(self.vocab, BOS), self.ids, np.ones(len(self.ids), bool), parts, frequent)

    def longer(self, shorter: Grams, parts: int, frequent: np.ndarray) -> Grams:
        """N-grams one longer than the given ones: two of those that overlap."""
        use = shorter.of_token >= 0
        use[1:] &= use[:-1].copy()
        use[self.begins] = False
        before = np.empty_like(shorter.of_token)
        before[1:] = shorter.of_token[:-1]
        return self._grams(before, shorter.of_token, shorter.own, self.ids, use, parts, frequent)

    def _grams(self, context: np.ndarray, shorter: np.ndarray, hashes: np.ndarray, words: np.ndarray, use: np.ndarray, parts: int, frequent: np.ndarray) -> Grams:
        # What is not needed any more goes at once, since a block's arrays are what a worker's memory is taken by.
        n = int(shorter.max()) + 1 if len(shorter) else 1
        keys = context[use].astype(np.int64)
        keys *= n
        keys += shorter[use]
        keys, inverse, some = distinct(keys)
        word = (self.vocab[words[use][some]] >> U(32)).astype("<u4")
        context, shorter = (keys // n).astype(np.int32), (keys % n).astype(np.int32)
        del keys, some
        h = hashes[context]
        h &= CONTEXT
        own = gram_hashes(h, word.astype(U) << U(32))
        part = (mixed(h) % U(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
        often = among(h, frequent)
        part[often] = own[often] % U(parts)
        # An n-gram's place follows its part and then its context. Sorting 16 bits takes no comparisons.
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        of_token = np.full(len(use), -1, np.int32)
        of_token[use] = place[inverse]
        del place, inverse
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        return Grams(context[order], h[order], own[order], shorter[order], word[order], of_token, cut)


def _dealt(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)


def blocks(docs: DataFrame) -> DataFrame:
    """The documents' tokens in blocks; the rows of a block are large, and few."""
    schema = "g long, block long, n_tokens long, doc_ids array<long>, held binary, lengths binary, vocab binary, ids binary"

    def row(seq: int, parts: list) -> pa.RecordBatch:
        ids, held, lengths, tokens = zip(*parts, strict=True)
        vocab, places = np.unique(np.concatenate(tokens), return_inverse=True)
        g = TaskContext.get().partitionId()
        values = [[g], [(g << 24) + seq], [len(places)], [sum(ids, [])], [np.concatenate(held).tobytes()], [np.concatenate(lengths).tobytes()], [vocab.tobytes()], [places.astype(np.uint32).tobytes()]]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["g", "block", "n_tokens", "doc_ids", "held", "lengths", "vocab", "ids"])

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, seq = [], 0, 0
        for batch in chunks(batches):
            w = Words(*utf8(batch.column(1)))
            n = batch.num_rows
            tokens = np.full(len(w.starts) + n, END)
            tokens[np.arange(len(w.starts)) + w.doc] = w.hashes()
            parts.append((batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False), np.diff(w.off) + 1, tokens))
            held += len(tokens)
            if held >= BLOCK_TOKENS:
                yield row(seq, parts)
                parts, held, seq = [], 0, seq + 1
        if parts:
            yield row(seq, parts)

    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))
    return flagged.mapInArrow(rows, schema)


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.float64()]
    rows = [(*r[:3], squeezed(r[3]), *r[4:]) for r in rows]
    names = ["g", "block", "part", "blob", "stats", "context", "seen"]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    rows = [(*r[:3], squeezed(r[3])) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["g", "block", "part", "blob"])


def _histogram(count: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(count, CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2].tolist()


def send_words(table: DataFrame, parts: int) -> DataFrame:
    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r)
                order, cut = b.words(parts)
                seen = np.bincount(b.ids[b.trained], minlength=len(b.vocab))
                every = np.bincount(b.ids, minlength=len(b.vocab))
                sent = [(b.g, b.block, p, b.vocab[o].tobytes() + planes(seen[o]) + planes(every[o])) for p in range(parts) if len(o := order[cut[p] : cut[p + 1]])]
                yield _sent(sent)

    return table.mapInArrow(rows, "g long, block long, part int, blob binary")


def add_words(least: int):
    """What a part answers: each block's words' training counts, and whether other blocks have them; statistics; the words
    that are frequent."""

    def answer(key, table):
        words, seen, every, sizes = [], [], [], []
        for blob in map(spread, table.column("blob").to_pylist()):
            n = len(blob) // 16
            words.append(np.frombuffer(blob, U, n))
            seen.append(unplaned(blob, n, 8 * n))
            every.append(unplaned(blob, n, 12 * n))
            sizes.append(n)
        types, inverse = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(inverse, np.concatenate(seen)).astype(np.int64)
        shared = np.bincount(inverse) > 1
        often = types[np.bincount(inverse, np.concatenate(every)) >= least]
        out, at = [], 0
        for g, block, n in zip(table.column("g").to_pylist(), table.column("block").to_pylist(), sizes, strict=True):
            own = inverse[at : at + n]
            out.append((g, block, key[0].as_py(), planes(count[own]) + np.packbits(shared[own]).tobytes(), None, None, None))
            at += n
        out.append((None, None, key[0].as_py(), None, [int(count.sum()), int((count > 0).sum()), *_histogram(count)], None, None))
        out += [(None, None, None, None, None, w, None) for w in often.view(np.int64).tolist()]
        return _answers(out)

    return answer


class Answers:
    """The answers to blocks, read from the shared folder, one block's at a time."""

    def __init__(self, uri: str):
        self.uri = uri

    def of(self, b: Block) -> dict[int, bytes]:
        store, path = fs.FileSystem.from_uri(f"{self.uri}/g={b.g}")
        own = pq.read_table(path, filesystem=store, columns=["part", "blob"], filters=[("block", "==", b.block)], partitioning=None)
        return dict(zip(own.column("part").to_pylist(), map(spread, own.column("blob").to_pylist()), strict=True))


def flags(data: bytes, n: int, at: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool)


def word_counts(b: Block, answers: Answers, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts in training, and whether other blocks have the word; the mark of the beginning is in all of them."""
    out, shared, got = np.zeros(len(b.vocab) + 1, np.int64), np.ones(len(b.vocab) + 1, bool), answers.of(b)
    order, cut = b.words(parts)
    for p in range(parts):
        if n := cut[p + 1] - cut[p]:
            own = order[cut[p] : cut[p + 1]]
            out[own], shared[own] = unplaned(got[p], n), flags(got[p], n, 4 * n)
    return out, shared


class Table(NamedTuple):
    """What is known of one order: where its answers are, its discounts, its frequent contexts, and of each of those the
    size that its frequencies are taken of and its backoff weight."""

    at: str
    discounts: Discounts
    frequent: np.ndarray
    whole: dict[int, tuple[int, float]]


class Known:
    """Of one order in a block: its n-grams, their counts in training, the sizes of their contexts, the probability of
    their last words, and whether other blocks have them."""

    def __init__(self, grams: Grams | None, count: np.ndarray, size: np.ndarray | None, p: np.ndarray, shared: np.ndarray):
        self.grams, self.count, self.size, self.p, self.shared = grams, count, size, p, shared


def sizes_of(total: np.ndarray, types: np.ndarray) -> np.ndarray:
    """What frequencies after contexts are taken of: their counts, and one token more where no seen n-gram has a count up
    to the cutoff, so that none gives anything away."""
    return total + ((types.sum(0) == 0) & (total > 0))


def backoff(size: np.ndarray, types: np.ndarray, alone: np.ndarray, discounts: Discounts) -> np.ndarray:
    """Backoff weights of seen contexts, from their sizes, the numbers of types of each count up to the cutoff, and the
    probability that their seen words have without them."""
    rest = sum((types[r - 1] * r * (1 - discounts.factor[r]) for r in range(1, CUTOFF + 1)), np.zeros(len(size)))
    return np.where(types.sum(0) == 0, 1.0, rest) / np.maximum(size, 1) / np.maximum(1 - alone, 1e-300)


def known_words(b: Block, answers: Answers, parts: int, unigrams: Unigrams) -> Known:
    count, shared = word_counts(b, answers, parts)
    return Known(None, count, None, unigrams.probability(count), shared)


def known_grams(b: Block, grams: Grams, shorter: Known, table: Table, parts: int, least_context: int) -> Known:
    """The answers to a block's n-grams, put together with what is known of the shorter ones."""
    n = len(grams.context)
    count, size, weight, shared = np.zeros(n, np.uint32), np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
    sent = _sent_grams(grams, shorter, least_context)
    got = Answers(table.at).of(b) if len(sent) else {}
    for p in range(parts):
        own = sent[np.searchsorted(sent, grams.cut[p]) : np.searchsorted(sent, grams.cut[p + 1])]
        if not len(own):
            continue
        runs = _runs(grams.context[own])
        m, q, each = len(own), len(runs) - 1, np.diff(runs)
        blob = got[p]
        count[own] = unplaned(blob, m)
        of_run = unplaned(blob, q, 4 * m).astype(np.int64)
        size[own] = np.repeat(of_run, each)
        open_ = open_runs(count[own], runs, of_run)
        k, at, w = int(open_.sum()), 4 * m + 4 * q, np.ones(q)
        types = np.array([unplaned(blob, k, at + 4 * k * r) for r in range(CUTOFF)]).astype(np.int64)
        w[open_] = backoff(of_run[open_], types, np.frombuffer(blob, np.float64, k, at + 4 * k * CUTOFF), table.discounts)
        weight[own] = np.repeat(w, each)
        if len(blob) > (at := at + 4 * k * CUTOFF + 8 * k):
            shared[own] = flags(blob, m, at)
    own, seen = own_grams(b, grams, shorter, least_context)
    if len(own):
        contexts, of, _ = distinct(grams.context[own])
        total, has, q = np.bincount(of, seen).astype(np.int64), seen > 0, len(contexts)
        types = np.array([np.bincount(of[seen == r], minlength=q) for r in range(1, CUTOFF + 1)])
        alone, sizes = np.bincount(of[has], shorter.p[grams.shorter[own[has]]], q), sizes_of(total, types)
        count[own], size[own] = seen, sizes[of]
        weight[own] = np.where(total > 0, backoff(sizes, types, alone, table.discounts), 1.0)[of]
    if len(often := np.flatnonzero(among(grams.hashes, table.frequent) & shorter.shared[grams.context])):
        which = np.searchsorted(table.frequent, grams.hashes[often])
        whole = [table.whole.get(int(h), (0, 1.0)) for h in table.frequent.view(np.int64)]
        size[often], weight[often] = np.array([x[0] for x in whole])[which], np.array([x[1] for x in whole])[which]
    p = shorter.p[grams.shorter]
    p *= weight
    has = np.flatnonzero(count)
    p[has] = table.discounts.apply(count[has]) / np.maximum(size[has], 1)
    return Known(grams, count, size, p, shared)


def open_runs(count: np.ndarray, runs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Contexts that training has, but not with every word: those whose backoff weights are asked for."""
    return (np.minimum.reduceat(count, runs[:-1]) == 0) & (size > 0) if len(count) else np.zeros(0, bool)


def _had(grams: Grams, shorter: Known, least_context: int) -> np.ndarray:
    """Which n-grams have a context with a table: one that training has, if of two words or more often enough. The mark
    of the beginning, behind the words, always has."""
    if shorter.grams is None:
        return (shorter.count[grams.context] > 0) | (grams.context == len(shorter.count) - 1)
    return shorter.count[grams.context] >= least_context


def _sent_grams(grams: Grams, shorter: Known, least_context: int) -> np.ndarray:
    """Places of the n-grams that are sent: those whose context has a table that other blocks need too."""
    return np.flatnonzero(_had(grams, shorter, least_context) & shorter.shared[grams.context])


def own_grams(b: Block, grams: Grams, shorter: Known, least_context: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the other n-grams whose context has a table, and their counts in training, which are the block's."""
    own = np.flatnonzero(_had(grams, shorter, least_context) & ~shorter.shared[grams.context])
    return own, seen_grams(b, grams)[own]


def seen_grams(b: Block, grams: Grams) -> np.ndarray:
    """How often the block's training texts have its n-grams."""
    tokens = grams.of_token[b.trained]
    return np.bincount(tokens[tokens >= 0], minlength=len(grams.context))


def all_known(b: Block, words_at: str, parts: int, unigrams: Unigrams, tables: list[Table], least_context: int) -> Iterator[Known]:
    """What is known of a block, from words to the longest n-grams that have tables; one order is only held until the
    next but one is made."""
    last = known_words(b, Answers(words_at), parts, unigrams)
    yield last
    for t in tables:
        last = known_grams(b, _next(b, last, parts, t.frequent), last, t, parts, least_context)
        yield last


def _next(b: Block, last: Known, parts: int, frequent: np.ndarray) -> Grams:
    return b.pairs(parts, frequent) if last.grams is None else b.longer(last.grams, parts, frequent)


def send_grams(table: DataFrame, parts: int, words_at: str, unigrams: Unigrams, tables: list[Table], frequent: np.ndarray, least_context: int) -> DataFrame:
    """The n-grams one longer than those that have tables, packed by block and part. What is known of the n-grams they
    end with is told by the blocks whose training texts have them."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r)
                for shorter in all_known(b, words_at, parts, unigrams, tables, least_context):
                    pass  # the last is wanted
                grams, sent = _next(b, shorter, parts, frequent), []
                use, seen = _sent_grams(grams, shorter, least_context), seen_grams(b, grams)
                unsent = _histogram(own_grams(b, grams, shorter, least_context)[1])
                for p in range(parts):
                    own = use[np.searchsorted(use, grams.cut[p]) : np.searchsorted(use, grams.cut[p + 1])]
                    if not len(own):
                        continue
                    runs = _runs(grams.context[own])
                    heads, ends = own[runs[:-1]], grams.shorter[own]
                    h, had = grams.hashes[heads], seen[own] > 0
                    blob = [np.array([len(own), len(heads), *unsent], np.int64).tobytes(), planes(h >> U(32)), (h >> U(16)).astype("<u2").tobytes(), planes(np.diff(runs)), grams.word[own].tobytes(), planes(seen[own]), planes(shorter.count[ends[had]])]
                    if shorter.size is not None:  # one for each context, as all its n-grams end after the same words
                        blob.append(planes(shorter.size[grams.shorter[heads[np.logical_or.reduceat(had, runs[:-1])]]]))
                    sent.append((b.g, b.block, p, b"".join(blob)))
                    unsent = [0] * len(unsent)  # told once
                if any(unsent):
                    sent.append((b.g, b.block, b.block % parts, np.array([0, 0, *unsent], np.int64).tobytes()))
                if sent:
                    yield _sent(sent)

    return table.mapInArrow(rows, "g long, block long, part int, blob binary")


def _received(blobs: list[bytes], sized: bool) -> tuple:
    contexts, lengths, words, seen, known, sizes, shapes, unsent = [], [], [], [], [], [], [], np.zeros(CUTOFF + 2, np.int64)
    for blob in map(spread, blobs):
        m, q = np.frombuffer(blob, np.int64, 2).tolist()
        unsent += np.frombuffer(blob, np.int64, CUTOFF + 2, 16)
        at = 16 + 8 * (CUTOFF + 2)
        high = unplaned(blob, q, at).astype(U)
        contexts.append(high << U(32) | np.frombuffer(blob, "<u2", q, at := at + 4 * q).astype(U) << U(16))
        lengths.append(unplaned(blob, q, at := at + 2 * q))
        words.append(np.frombuffer(blob, "<u4", m, at := at + 4 * q).astype(U) << U(32))
        seen.append(unplaned(blob, m, at := at + 4 * m))
        had, of_run = seen[-1] > 0, np.repeat(np.arange(q), lengths[-1])
        n = int(had.sum())
        known.append(np.zeros(m, np.uint32))
        known[-1][had] = unplaned(blob, n, at := at + 4 * m)
        sizes.append(np.zeros(q if sized else 0, np.uint32))
        if sized:
            with_seen = np.unique(of_run[had])
            sizes[-1][with_seen] = unplaned(blob, len(with_seen), at + 4 * n)
        shapes.append((m, q))
    return *(np.concatenate(x) for x in (contexts, lengths, words, seen, known, sizes)), shapes, unsent


def add_grams(unigrams: Unigrams, shorter: Discounts | None, frequent: np.ndarray, least: int, longest: bool):
    """What a part answers: each block's n-grams' counts, the sizes of their contexts, and of contexts that training has
    without some word the types of each count up to the cutoff and the probability of the seen words without them, and
    unless they are the longest, whether other blocks have the n-grams; statistics, also of n-grams that are not sent; sums of frequent contexts; and n-grams that are frequent themselves. shorter: discounts of n-grams one
    shorter, None if those are words."""

    def answer(key, table):
        freed()
        contexts, lengths, words, seen, known, sizes, shapes, unsent = _received(table.column("blob").to_pylist(), shorter is not None)
        types, of_run, _ = distinct(contexts)
        of_entry = np.repeat(of_run, lengths)
        own_hashes = gram_hashes(types[of_entry], words)
        del contexts, words
        grams, inverse, _ = distinct(own_hashes)
        del own_hashes
        first = np.empty(len(grams), np.int64)  # some occurrence in training of each that has one
        first[inverse[seen > 0]] = np.flatnonzero(seen)
        count, shared = np.bincount(inverse, seen).astype(np.int64), np.bincount(inverse) > 1
        has = first[count > 0]
        where, c = of_entry[has], count[count > 0]
        total = np.bincount(where, c, len(types)).astype(np.int64)
        of_count = np.array([np.bincount(where[c == r], minlength=len(types)) for r in range(1, CUTOFF + 1)])
        less = unigrams.probability(known[has].astype(np.int64)) if shorter is None else shorter.apply(known[has]) / np.maximum(np.repeat(sizes, lengths)[has], 1)
        alone, size = np.bincount(where, less, len(types)), sizes_of(total, of_count)
        out, at, run, part = [], 0, 0, key[0].as_py()
        for g, block, (m, q) in zip(table.column("g").to_pylist(), table.column("block").to_pylist(), shapes, strict=True):
            own, ids = of_run[run : run + q], inverse[at : at + m]
            n = count[ids]
            open_ = own[open_runs(n, np.concatenate(([0], np.cumsum(lengths[run : run + q], dtype=np.int64))), size[own])]
            out.append((g, block, part, b"".join([planes(n), planes(size[own]), *(planes(x[open_]) for x in of_count), alone[open_].tobytes(), b"" if longest else np.packbits(shared[ids]).tobytes()]), None, None, None))
            at, run = at + m, run + q
        out.append((None, None, part, None, (_histogram(count) + unsent).tolist(), None, None))
        for k in np.flatnonzero(among(types, frequent)).tolist():
            out.append((None, None, part, None, [int(total[k]), *(int(x[k]) for x in of_count)], int(types[k].view(np.int64)), float(alone[k])))
        out += [(None, None, part, None, None, h, None) for h in grams[count >= least].view(np.int64).tolist()]
        return _answers(out)

    return answer


def _stored(answers: DataFrame, name: str) -> str:
    """Answers in one folder for each scan task of the blocks; those to a block are written by one task, and statistics
    by the tasks that their parts fall to."""
    uri = scratch_path(answers.sparkSession, name)
    deal = F.when(F.col("g").isNull(), F.col("part"))
    answers.repartition("g", "block", deal).write.partitionBy("g").option("compression", "zstd").parquet(uri)
    return uri


def score(docs: DataFrame, order: int = ORDER, least_context: int = LEAST_CONTEXT) -> DataFrame:
    """Trains on the documents whose crc32(doc_id) mod 5 is not 1, and scores all."""
    spark = docs.sparkSession
    table = written(blocks(docs), "blocks")
    tokens = table.agg(F.sum("n_tokens")).first()[0] or 0
    parts, least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART_TOKENS)), max(1, tokens // FREQUENT)

    words_at = _stored(send_words(table, parts).groupBy("part").applyInArrow(add_words(least), ANSWER), "words")
    said = spark.read.schema(ANSWER).parquet(words_at).where("g is null")
    sums = _summed(said, CUTOFF + 4)
    unigrams = Unigrams.of(sums[0], sums[1], sums[2:])
    frequent, tables = np.unique(np.append(_frequent(said), BOS) & CONTEXT), []
    for n in range(2, order + 1):
        shrunk(spark)
        sent = send_grams(table, parts, words_at, unigrams, tables, frequent, least_context)
        at = _stored(sent.groupBy("part").applyInArrow(add_grams(unigrams, tables[-1].discounts if tables else None, frequent, least, n == order), ANSWER), f"grams{n}")
        said = spark.read.schema(ANSWER).parquet(at).where("g is null")
        discounts = Discounts.of(_summed(said.where("context is null"), CUTOFF + 2))
        tables.append(Table(at, discounts, frequent, _whole(said, discounts)))
        frequent = np.unique(_frequent(said.where("stats is null")) & CONTEXT)
    shrunk(spark)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r)
                yield _scores(b, all_known(b, words_at, parts, unigrams, tables, least_context), unigrams)

    return table.mapInArrow(rows, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _frequent(said: DataFrame) -> np.ndarray:
    """Hashes of frequent words or n-grams, at most FREQUENT."""
    rows = said.where("context is not null").select("context").distinct().collect()
    return np.sort(np.array([r["context"] for r in rows], np.int64).view(U))


def _whole(said: DataFrame, discounts: Discounts) -> dict[int, tuple[int, float]]:
    """Of each frequent context its size and backoff weight, from what its n-grams' parts have summed."""
    sums = said.where("context is not null and stats is not null").groupBy("context").agg(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(CUTOFF + 1)), F.sum("seen").alias("seen")).collect()
    out = {}
    for r in sums:
        total, types = np.array([r["s0"]]), np.array([[r[f"s{k}"]] for k in range(1, CUTOFF + 1)])
        size = sizes_of(total, types)
        out[r["context"]] = (int(size[0]), float(backoff(size, types, np.array([r["seen"]]), discounts)[0]) if total[0] else 1.0)
    return out


def _summed(said: DataFrame, n: int) -> list[int]:
    row = said.where("stats is not null").agg(*(F.sum(F.col("stats")[k]) for k in range(n))).first()
    return [x or 0 for x in row]


def _scores(b: Block, known: Iterator[Known], unigrams: Unigrams) -> pa.RecordBatch:
    k = next(known)
    words, p = k.count, k.p[b.ids]
    for k in known:
        longer = k.grams.of_token >= 0
        p[longer] = k.p[k.grams.of_token[longer]]
    base = np.log10((words[:-1] + 0.5) / (unigrams.total + 0.5 * (unigrams.types + 1)))
    add, n = np.add.reduceat, len(b.lengths)
    columns = [b.doc_ids, b.held, b.lengths, add((words[b.ids] > 0).astype(np.int64), b.begins), np.full(n, unigrams.total), add(base[b.ids], b.begins), add(np.log10(p), b.begins)]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
