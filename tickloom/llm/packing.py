"""Packing by best-fit decreasing into windows of fixed length.

Overlong documents are first cut into full windows and one rest. Best fit decreasing depends on the
lengths alone, so it is planned on their histogram, which has ``window`` entries whatever the input:
a segment tree indexed by remaining capacity finds the tightest open windows, and windows that were
filled alike are kept as one group with a count. The plan gives each (length, rank) its sequence and
offset; pieces get their ranks within a length by salted counting, so no length is gathered in a task.

Defined results: a null or empty text is the end identifier alone. Repeated rows are packed each. A null
doc_id is one like others. A text of any length is encoded whole and cut into windows. Pieces of one length
are alike to the plan; which of them goes where follows a hash and then doc_id, start and checksum, so
that reruns agree. An empty table has no pieces. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import chunks, tidy
from .bpe_count import byte_symbols
from .scratch import shrunk, written

WINDOW = 2048
END_ID = 1
REMEMBERED = 150_000
#: Pieces that one task ranks at most, if all are of one length.
RANKED = 500_000
#: The fast engine's pattern runs out of stack in runs of blanks that are far longer than this.
LONG_BLANK = re.compile(r"\s{10000}")
#: How byte-level vocabularies of this family split a text (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Ids of texts as little-endian bytes. Byte-level BPE splits before a space that a character
    follows, so chunks between single spaces are encoded alone and remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in byte_symbols().items()}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in specials}
        # The ids of this vocabulary are in the order of its merges, so that they serve as ranks.
        self.fast = tiktoken.Encoding("window", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.known: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        if len(text) >= 10_000 and LONG_BLANK.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode(text, allowed_special="all") if "<" in text else self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def chunk(self, piece: str) -> bytes | None:
        """The ids of a space and the chunk; of a chunk that starts with a line break, without the space. None: not separable."""
        body = piece[1:] if piece[:1] == "\n" else piece
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        ids = self.whole(piece if body is not piece else " " + piece)
        if len(self.known) < REMEMBERED:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        pieces = text.replace("\n", " \n").split(" ")
        first = pieces[0]
        if not first or first[0].isspace() or first[-1].isspace():
            return self.whole(text)
        known, out = self.known, [self.whole(first)]
        for piece in pieces[1:]:
            ids = known.get(piece) or self.chunk(piece)
            if ids is None:
                return self.whole(text)
            out.append(ids)
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def cut(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """The pieces of every document: full windows and a rest."""

    @tidy
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        encoder, end = _encoders[vocabulary], np.array([END_ID], "<u4").tobytes()
        for batch in chunks(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (encoder.encode(text) if text else b"") + end
                n = len(ids) // 4
                rows += [(doc_id, at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


class CapacityTree:
    """A segment tree over remaining capacities; finds the smallest open one that is large enough."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = self.size + capacity
        while at:
            self.open[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        at = self.size + least
        if self.open[at]:
            return least
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, first sequence, pieces of it per sequence, offset of the first)."""
    tree, groups = CapacityTree(window), {}  # remaining capacity -> [(count, parts)]

    def put(capacity: int, count: int, parts: tuple) -> None:
        if count:
            groups.setdefault(capacity, []).append((count, parts))
            tree.add(capacity, count)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each, count, parts, room = window // length, left, (), window
            else:
                count, parts = groups[room].pop()
                tree.add(room, -count)
                each = room // length
            full, some = min(count, left // each), 0
            put(room - each * length, full, (*parts, (length, each)))
            left -= full * each
            if left and left < each and full < count:
                some = 1
                put(room - left * length, 1, (*parts, (length, left)))
                left = 0
            if parts:
                put(room, count - full - some, parts)
    out, used, sequence = [], {}, 0
    for room in sorted(groups):
        for count, parts in groups[room]:
            offset = 0
            for length, each in parts:
                first = used.get(length, 0)
                used[length] = first + count * each
                out.append((length, first, used[length], sequence, each, offset))
                offset += each * length
            sequence += count
    return out


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """Every piece with its sequence and offset."""
    spark = docs.sparkSession
    shrunk(spark)
    pieces = written(cut(docs, vocabulary, window), "pieces")
    salts = max(8, -(-pieces.count() // RANKED))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    steps = spark.createDataFrame(plan(histogram, window), "length long, lo long, hi long, first_sequence long, each long, first_offset long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # at most window * salts rows
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")).cast("long"))
    ranked = ranked.join(counts, ["length", "salt"]).withColumn("r", F.col("r") - 1 + F.col("base"))
    s = steps.withColumnRenamed("length", "step_length")
    # The histogram's size bounds the plan: a few steps for each length.
    placed = ranked.join(F.broadcast(s), (F.col("length") == F.col("step_length")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    k = F.col("r") - F.col("lo")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.expr("(r - lo) div each")).alias("sequence_id"),
        (F.col("first_offset") + (k % F.col("each")) * F.col("length")).alias("offset"),
    )
