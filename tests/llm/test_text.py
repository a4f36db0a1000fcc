"""Scoring, counting, packing and rules against plain Python."""

import hashlib
import math
import random
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import bpe_count, fingerprint, katz, packing, quality

from .conftest import lower, prose, table, words

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_strings(n):
    r = random.Random(5)
    alphabet = "aA zZ\n\t'sS 09²½é É İΣσς ñ中文 \x1c\x85  &#$.,!?ǅ̈é"
    return ["".join(r.choice(alphabet) if r.random() < 0.96 else r.choice(["<|endoftext|>", "<|startoftext|>", "  ", "\r\n"]) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_counts_equal_the_library(spark, odd, odd_rows, empty):
    t, m = Tokenizer.from_file(WORDS), bpe_count.merger(WORDS)
    assert all(m.count(s) == len(t.encode(s, add_special_tokens=False).ids) for s in odd_strings(3000))
    got = sorted(bpe_count.count_tokens(odd, WORDS).collect())
    want = sorted((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x, _ in odd_rows)
    assert list(map(tuple, got)) == want and bpe_count.count_tokens(empty, WORDS).count() == 0


def test_packing_is_a_round_trip(spark, odd, odd_rows, empty):
    t, e = Tokenizer.from_file(BYTES), packing.Encoder(BYTES)
    assert all(np.frombuffer(e.encode(s) if s else b"", "<u4").tolist() == t.encode(s, add_special_tokens=False).ids for s in odd_strings(3000))
    pieces = packing.pack(odd, BYTES).collect()
    ids = {}
    for i, x, _ in odd_rows:
        ids.setdefault(i, []).append([*(t.encode(x, add_special_tokens=False).ids if x else []), 1])
    by = {}
    for p in pieces:
        part = ids[p.doc_id][0][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id][0]) and p.length == len(part) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(p.length for p in pieces) == sum(len(y) for x in ids.values() for y in x)
    assert sorted(by) == list(range(len(by))) and packing.pack(empty, BYTES).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    histogram = Counter(r.randint(1, 64) for _ in range(r.randint(1, 400)))
    rooms = []
    for length in sorted(histogram.elements(), reverse=True):
        fit = [x for x in rooms if x >= length]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 64) - length)
    sequences = Counter()
    for length, lo, hi, first, each, _ in packing.plan(dict(histogram), 64):
        for k in range(hi - lo):
            sequences[first + k // each] += length
    assert sorted(64 - x for x in sequences.values()) == sorted(rooms)


def rules(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rules(spark, odd, odd_rows, empty):
    more = [(100, "a b c d e f g h " * 3, "a"), (101, "#$%\nab\nab\n\nab \n ", "a"), (102, "q " * 40, "a"), (103, "a b c d e f g h i a b c d e f g h", "b")]
    docs = table(spark, odd_rows + more)
    got = sorted(tuple(r)[:6] for r in quality.judge(docs, quality.Model(None)).collect())
    assert got == sorted((i, *rules(t)) for i, t, _ in odd_rows + more)
    for r in quality.judge(docs, quality.Model(None)).collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.judge(empty, quality.Model(None)).count() == 0
    kept = quality.filter_documents(docs, quality.Model(None))
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in quality.judge(docs, quality.Model(None)).collect())


def test_classifier(spark, sf_dir):
    """Trained on half of the labels it agrees with the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    wrong = sum((r.p_good >= quality.KEEP_AT) != (r.quality == 1) for r in rows)
    assert len(rows) > 100 and wrong <= 0.06 * len(rows)
    assert quality.train(docs, labels.where("quality = 1")).weights is None and quality.train(docs, labels.where("false")).weights is None


def katz_by_hand(rows, order, least_context):
    """Scores of every text by recursion over dictionaries, and checks that probabilities of all words sum to one."""
    tokens = [[*words(lower(t)), None] for _, t, _ in rows]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _, _ in rows]
    counts = [Counter() for _ in range(order + 1)]  # by order; keys (context, word)
    for x, use in zip(tokens, train, strict=True):
        y = ["<s>", *x]
        if use:
            for k, w in enumerate(x):
                counts[1][(), w] += 1
                for n in range(2, order + 1):
                    if k + 2 - n >= 0:
                        counts[n][tuple(y[k + 2 - n : k + 1]), w] += 1
    for n in range(3, order + 1):  # contexts below the cutoff have no n-grams
        counts[n] = Counter({(v, w): c for (v, w), c in counts[n].items() if counts[n - 1][v[:-1], v[-1]] >= least_context})
    factor = [None] + [katz.Discounts.of([sum(v == r for v in c.values()) for r in range(7)]).factor for c in counts[1:]]
    one = {w: c for (_, w), c in counts[1].items()}
    n_tokens = sum(one.values())
    p1 = {w: factor[1][min(c, 6)] * c / n_tokens for w, c in one.items()}
    unknown = 1 - sum(p1.values())
    seen = [None, None] + [{} for _ in range(2, order + 1)]
    for n in range(2, order + 1):
        for (v, w), c in counts[n].items():
            seen[n].setdefault(v, {})[w] = c
    weights = {}

    def weight(v):
        if v not in weights:
            own, f = seen[len(v) + 1][v], factor[len(v) + 1]
            size, rest = sum(own.values()), sum((1 - f[min(c, 6)]) * c for c in own.values())
            size, rest = (size, rest) if rest > 1e-12 else (size + 1, 1)
            weights[v] = size, rest / size / (1 - sum(p(v[1:], x) for x in own))
        return weights[v]

    def p(v, w):
        if not v:
            return p1.get(w, unknown)
        own = seen[len(v) + 1].get(v)
        if own is None:
            return p(v[1:], w)
        size, rest = weight(v)
        return factor[len(v) + 1][min(own[w], 6)] * own[w] / size if w in own else rest * p(v[1:], w)

    vocabulary = [*one, "<an unknown word>"]
    for n in range(2, order + 1):
        for v in list(seen[n])[:20]:
            assert sum(p(v, w) for w in vocabulary) == pytest.approx(1)
    out = []
    for (i, _, _), x, use in zip(rows, tokens, train, strict=True):
        y = ["<s>", *x]
        base = sum(math.log10((one.get(w, 0) + 0.5) / (n_tokens + 0.5 * (len(one) + 1))) for w in x)
        out.append((i, not use, len(x), sum(w in one for w in x), n_tokens, base, sum(math.log10(p(tuple(y[max(0, k + 2 - order) : k + 1]), w)) for k, w in enumerate(x))))
    return out


@pytest.mark.parametrize(("order", "least_context"), [(1, 1), (2, 2), (3, 1), (3, 2), (4, 2)])
def test_katz(spark, odd, odd_rows, empty, monkeypatch, order, least_context):
    more = [(600 + k, "a b c d " * k + "e f a b " * (k % 4), "a") for k in range(1, 12)]  # contexts of many counts
    want = sorted(katz_by_hand(odd_rows + more, order, least_context))
    docs = odd.union(table(odd.sparkSession, more))
    for block in (katz.BLOCK_TOKENS, 500):
        monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
        got = sorted(map(tuple, katz.score(docs.repartition(3), order, least_context).collect()))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert [g[5:] for g in got] == [pytest.approx(w[5:], rel=1e-9) for w in want]
    if (order, least_context) == (katz.ORDER, katz.LEAST_CONTEXT):
        assert katz.score(empty).count() == 0
        assert katz.score(odd.where("doc_id is null")).count() == 0


def test_katz_keeps_every_context_by_default(spark, odd, odd_rows, monkeypatch):
    """Also contexts that training has once, whether one block has them or several, with words in common or not."""
    rows = odd_rows + [(700 + k, f"once{k // 2} then{k // 2} last{k} {prose(k // 3, 9)} the end", "a") for k in range(40)]
    docs = odd.union(table(spark, rows[len(odd_rows) :]))
    for block, order in ((50, katz.ORDER), (katz.BLOCK_TOKENS, katz.ORDER), (50, 4)):
        monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
        got = sorted(map(tuple, katz.score(docs.repartition(3), order).collect()))
        want = sorted(katz_by_hand(rows, order, 1))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert [g[5:] for g in got] == [pytest.approx(w[5:], rel=1e-9) for w in want]


def test_katz_takes_little_memory_for_a_block():
    """Of its n-grams and what they are made by, in a block without repeats that are worth mentioning."""
    n, r = 200_000, np.random.default_rng(1)
    vocab = np.sort(r.integers(1, 1 << 63, 50_000).astype(np.uint64))
    lengths = np.full(n // 500, 500)
    row = {"g": 0, "block": 0, "doc_ids": list(range(len(lengths))), "held": np.zeros(len(lengths), bool).tobytes(), "vocab": vocab.tobytes()}
    b = katz.Block(row | {"ids": r.integers(0, len(vocab), n).astype(np.uint32).tobytes(), "lengths": lengths.tobytes()})
    few = np.zeros(0, np.uint64)
    tracemalloc.start()
    pairs = b.pairs(12, few)
    longer = b.longer(pairs, 12, few)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs.context) > 0.9 * n and len(longer.context) > 0.9 * n
    assert most < 120 * n


def test_katz_without_training(spark):
    """Of documents that all are held out every token has probability 1."""
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 1][:5]
    got = katz.score(table(spark, [(k, "a b c a b", "a") for k in held])).collect()
    assert all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in got) and len(got) == 5


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints(spark, odd, odd_rows, empty):
    rows = {}
    for i, t, _ in odd_rows:
        rows[i] = t or ""
    ids = sorted(rows)
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == len(odd_rows)
    prints = {}
    for r in got:
        text = rows[r.doc_id]
        after = text if r.doc_id == 8 and prints.get("seen 8") else rows[ids[ids.index(r.doc_id) - 1]]
        if r.doc_id != 8:  # a repeated row is the next document of its copy
            k = len(text) // 3
            edited = text[: len(text) - k] + after[:k]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
            a, b = shingles(text), shingles(edited)
            if len(a) > 2000:
                assert r.near_edited == pytest.approx(len(a & b) / len(a | b), abs=0.05)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and (r.fingerprint == "") == (not words(text))
    assert fingerprint.fingerprints(empty).count() == 0 and fingerprint.fingerprints(odd.limit(1)).count() == 1


def test_next_documents_of_far_ids(spark):
    """Ids that span more than a long holds, dense ones beside them, a null one, and extra columns."""
    ids = [-(1 << 62) - 5, *range(3000), (1 << 62) + 5, None]
    docs = spark.createDataFrame([(i, f"text of document {i} alone", "x", 1) for i in ids], "doc_id long, text string, range string, own int")
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs.repartition(5)).collect()}
    order = [None, *sorted(i for i in ids if i is not None)]
    for k, i in enumerate(order):
        text, after = (f"text of document {x} alone" for x in (i, order[k - 1]))
        cut = len(text) // 3
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()
    ranges = [r["count"] for r in fingerprint.in_ranges(docs).groupBy("range").count().collect()]
    assert max(ranges) <= 2 * fingerprint.RANGE_ROWS and len(ranges) >= 3


def test_likeness_error(spark):
    """Against the exact Jaccard of the same shingles, over all documents of a corpus; a sketch holds what its fraction says."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    ids, errors = sorted(text), []
    for r in fingerprint.fingerprints(docs).collect():
        t, after = text[r.doc_id], text[ids[ids.index(r.doc_id) - 1]]
        k = len(t) // 3
        a, b, c = map(shingles, (t, t[: len(t) - k] + after[:k], after))
        jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        errors.append((len(a), abs(r.near_edited - jaccard(a, b)), abs(r.near_next - jaccard(a, c))))
        kept = r.fingerprint.split()
        assert kept == sorted(kept, key=lambda x: int(x, 16) - (int(x, 16) >> 63 << 64)) and (bool(kept) == bool(a))
        if len(a) > 400:
            assert 0.15 < len(kept) / len(a) < 0.35
    e = np.array(errors)
    assert e[:, 1].mean() < 0.06 and e[:, 2].mean() < 0.01 and e[e[:, 0] > 150, 1].mean() < 0.04 and np.percentile(e[:, 1], 95) < 0.17


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    a, b = "".join(f"w{k} " for k in range(4000)), "".join(f"w{k} " for k in range(3000, 3400))
    r = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    r = r.select(fingerprint.containment(F.col("b"), F.col("a")).alias("c"), fingerprint.likeness(fingerprint.merged(F.col("a"), F.col("b")), F.col("a")).alias("l")).first()
    assert r.c == 1 and r.l == 1
