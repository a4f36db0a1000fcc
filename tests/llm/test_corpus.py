"""Near copies, lines, mixing, licences and archives against plain Python."""

import gc
import hashlib
import itertools
import math
import random
import subprocess
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import components, license_scan, line_dedup, mixing, ngram_join, packing, quality, queries, scratch, warc

from .conftest import lower, prose, table, words


def joined(links, nodes):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def shingles(text):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["class"]: r.component for r in components.component_labels(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == joined(chain, {x for p in chain if p[0] != p[1] for x in p})
    assert components.component_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def by_hand(rows):
    sets = {}
    for i, t, _ in rows:
        sets[i] = shingles(t)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, joined(links, sets), links


@pytest.fixture(scope="module")
def near_rows():
    """A large group of near copies of one text, in which each also differs from some others by too much."""
    rows, base = [], prose(11, 150).split(" ")
    for k in range(60):
        w = list(base)
        for j in range(k % 7):
            w[(7 * k + 20 * j) % 150] = f"n{k}x{j}"
        rows.append((1000 + k, " ".join(w), "a"))
    passage = prose(12, 55)
    return rows + [(2000 + k, prose(300 + k, 30) + " " + passage + " " + prose(400 + k, 30), "b") for k in range(40)]


def test_ngram_join(spark, odd_rows, near_rows, empty):
    rows = odd_rows + near_rows
    sets, want, links = by_hand(rows)
    got = ngram_join.ngram_components(table(spark, rows)).collect()
    assert len(got) == len(rows) and links
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), want[i]) for i in sets}
    assert ngram_join.ngram_components(empty).count() == 0
    kept = ngram_join.keep_first(table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if want[i] == i) and kept.columns == empty.columns


def test_ngram_join_with_frequent_shingles(spark, near_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 1 << 40)
    monkeypatch.setattr(ngram_join, "TRIE_SETS", 8)
    sets, want, _ = by_hand(near_rows)
    got = ngram_join.ngram_components(table(spark, near_rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_ngram_join_at_the_threshold(spark):
    """Pairs at exactly 0.8: n and m shingles, 4j of them shared, n + m = 9j."""
    rows, seed = [], 5000
    sizes = [(9, 9), (18, 18), (27, 27), (45, 45), (17, 19), (13, 14), (22, 23), (4, 5), (8, 10), (32, 40), (40, 41), (63, 72)] + [(9, 9)] * 30 + [(18, 18)] * 30
    for n, m in sizes:
        k = 4 * (n + m) // 9
        common = prose(seed, k + 4)
        for i, size in enumerate((n, m)):
            rows.append((seed + i, " ".join([common, *(f"u{seed}x{i}x{j}" for j in range(size - k))]), "a"))
        seed += 10
    _, want, links = by_hand(rows)
    assert len(links) == len(sizes)
    got = ngram_join.ngram_components(table(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_ngram_join_over_a_row_without_doc_id(spark):
    """Two documents that are linked only by way of a row whose doc_id is null."""
    w = prose(31, 104).split(" ")
    changed = lambda *at: " ".join("new" if i in at else x for i, x in enumerate(w))
    rows = [(1, changed(10, 30), "a"), (None, " ".join(w), "a"), (2, changed(60, 80), "a"), (3, prose(32, 50), "b"), (None, prose(33, 50), "b")]
    got = ngram_join.ngram_components(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (2, 1), (3, 3)]


def test_tries_find_all_links():
    import numpy as np

    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 60, 90, dtype=np.uint64)
    sets = [np.sort(np.unique(np.concatenate([base[r.random(90) < 0.9], r.integers(0, 1 << 60, 6, dtype=np.uint64)]))) for _ in range(60)]
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    want = joined([(i, j) for i in range(60) for j in range(i) if near(sets[i], sets[j])], range(60))
    links = ngram_join.trie_links(sets, list(range(60)))
    assert joined(links, range(60)) == want and all(near(sets[a], sets[b]) for a, b in links)


def distance(a, b):
    """Edits between two strings, a column of the table in the bits of one number at a time."""
    if not a or not b:
        return len(a) + len(b)
    places, every, last = {}, (1 << len(a)) - 1, 1 << (len(a) - 1)
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    up, down, n = every, 0, len(a)
    for y in b:
        eq = places.get(y, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(zero | up) & every, up & zero
        n += bool(more & last) - bool(less & last)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(zero | more)) & every, more & zero & every
    return n


def test_distance():
    def plainly(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert distance(a, b) == plainly(a, b)


def alike(a, b):
    longer = max(len(a), len(b))
    return abs(len(a) - len(b)) <= 0.2 * longer + 1e-9 and distance(a, b) <= 0.2 * longer + 1e-9


def normal(line):
    return " ".join(w for w in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if w)


def left_by_hand(rows):
    """{doc_id: text} after line dedup, every pair of lines compared. Rows that share a doc_id have one text here."""
    norm = {(i, place): x for i, t, *_ in rows for place, line in enumerate((t or "").split("\n")) if (x := normal(line))}
    first = {}
    for k in sorted(norm):
        first.setdefault(norm[k], k)
    lines = sorted(first.values())
    group = joined([(a, b) for a in lines for b in lines if a < b and alike(norm[a], norm[b])], lines)
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in norm or group[first[norm[i, p]]] == (i, p)) for i, t, *_ in rows}


def test_line_dedup(spark, empty):
    """Every pair of lines is compared here; null and empty texts, lines of marks alone, repeated rows and lines, very
    long lines, columns whose names the operator uses."""
    long = prose(21, 140)
    edited = long.replace(" a", " b", 1)
    rows = [(1, "Alpha beta!\nGamma delta.\n\n--\nunique one", "a"), (2, "gamma   DELTA\nother line\nother line", "a"), (3, long, "b"), (4, "x\n" + edited, "b"), (5, None, "c"), (6, "", None), (7, "--\n\n", "c"), (8, "alpha beta", "c"), (8, "alpha beta", "c"), (9, prose(22, 300) + "\n" + prose(23, 40_000), "c"), (10, "unique oni\ngamna delta", "d")]
    docs = table(spark, rows).withColumnsRenamed({"class": "of", "n": "of_version", "token": "places", "size": "version", "line": "d", "target": "kept", "copy": "of version"})
    want = left_by_hand(rows)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    for r in out.collect():
        assert r.text == want[r.doc_id] and r.d == "c" and r.of == "a"
    digested = {(r.doc_id, r.n_lines, r.n_kept, r.kept_sha256) for r in line_dedup.digest(docs).collect()}
    count = lambda t: len(t.split("\n")) if t else 0
    assert digested == {(i, count(t), count(want[i]), None if t is None else hashlib.sha256(want[i].encode()).hexdigest()) for i, t, _ in rows}
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.digest(empty).count() == 0


def test_lines_of_a_crowded_key(spark):
    """A passage in very many lines that are otherwise unlike, some of which have a near copy."""
    passage, rows, pairs = prose(800, 18), [], 0
    for k in range(140):
        w = prose(2000 + k, 30).split(" ")
        rows.append((k, " ".join([*w[:10], passage, *w[10:]]), "a"))
        if k % 7 == 0:
            rows.append((1000 + k, " ".join([*w[:10], passage, *w[10:29], "changed"]), "a"))
            pairs += 1
    want = left_by_hand(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got == want and sum(not t for t in want.values()) == pairs


def test_lines_without_a_rare_key(spark):
    """Every run of words is in more lines than are compared at once; some lines have a copy with another word."""
    part = [[prose(5000 + 20 * p + v, 8) for v in range(9)] for p in range(4)]
    between = [prose(5900 + p, 5) for p in range(3)]
    rows, copies = [], 0
    for i, j, k in itertools.product(range(9), repeat=3):
        parts = [part[p][v] for p, v in enumerate((i, j, k, (i + j + k) % 9))]
        line = " ".join(x for pair in itertools.zip_longest(parts, between, fillvalue="") for x in pair).strip()
        n = len(rows)
        rows.append((n, line, "a"))
        if n % 18 == 0:
            w = line.split(" ")
            rows.append((10_000 + n, " ".join([*w[:20], "hhh", *w[21:]]), "a"))
            copies += 1
    assert all(not alike(rows[0][1], x) for _, x, _ in rows[2:])
    short = [(20_000 + k, f"{prose(7000 + k, 2)} same words here again now {prose(7500 + k, 3)}", "a") for k in range(100)]
    short += [(30_000 + k, x + "s", "a") for k, (_, x, _) in enumerate(short[::9])]
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, rows + short)).collect()}
    assert {i for i, x in left.items() if not x} == {i for i, _, _ in rows + short if 10_000 <= i < 20_000 or i >= 30_000}
    assert copies >= 40


def test_the_line_stage_leaves_no_crowd_out(spark):
    """Lines of four parts, each of which very many lines have; the copies of some have another word."""
    part = [[prose(6000 + 20 * p + v, 8) for v in range(9)] for p in range(4)]
    lines = [" ".join(f"{part[p][v]} {prose(6900 + p, 5)}" for p, v in enumerate((i, j, k, (i + j + k) % 9))) for i, j, k in itertools.product(range(9), repeat=3)]
    copies = [" ".join([*w[:20], "hhh", *w[21:]]) for w in (x.split(" ") for x in lines[::18])]
    rows = [(k, x, "a") for k, x in enumerate(lines)] + [(10_000 + k, x, "a") for k, x in enumerate(copies)]
    left = corpus_pipeline.without_repeated_lines(spark, table(spark, rows), "").collect()
    assert {r.doc_id for r in left if not r.text} == {i for i, _, _ in rows if i >= 10_000}


def test_crowds_write_only_what_may_be_alike(spark, monkeypatch):
    """Short lines with the same words in them and long ones with the same passage, some with a near copy: of a crowd no
    more pairs are written than there are lines, and all copies are found."""
    passage, rows = prose(820, 18), []
    for k in range(100):
        w = prose(2400 + k, 30).split(" ")
        rows.append((k, " ".join([*w[:10], passage, *w[10:]]), "a"))
        rows.append((1000 + k, f"{prose(7700 + k, 2)} same words here again now {prose(7900 + k, 3)}", "a"))
        if k % 9 == 0:
            rows.append((10_000 + k, " ".join([*w[:6], "changed", *w[7:10], passage, *w[10:29]]), "a"))
            rows.append((20_000 + k, rows[-2][1] + "s", "a"))
    crowds, found = [], line_dedup.crowded_pairs

    def spied(marked, labels, texts):
        # No two lines are in one group yet, so that all pairs of the crowd are looked at.
        apart = line_dedup.pointed(found(marked, labels.where("false"), texts))
        crowds.append((marked.select("line").distinct().count(), {(r.a, r.b) for r in apart.collect()}, {r.line: r.norm for r in texts.collect()}))
        return found(marked, labels, texts)

    monkeypatch.setattr(line_dedup, "crowded_pairs", spied)
    left = {r.doc_id for r in line_dedup.dedup_lines(table(spark, rows)).collect() if not r.text}
    assert left == {i for i, _, _ in rows if i >= 10_000}
    (lines, pairs, norm), = crowds
    want = {(a, b) for a, b in itertools.combinations(sorted(norm), 2) if alike(norm[a], norm[b])}
    assert lines >= 200 and len(want) == 24 and want <= pairs and len(pairs) <= lines


def test_lines_of_a_crowd_meet_once(spark, monkeypatch):
    """Long lines that share a passage, and most rare pairs of words with their near copies: the join of a crowd makes one
    row for two lines, however many of these they share."""
    passage, rows = prose(840, 18), []
    for k in range(30):
        w = prose(2600 + k, 30).split(" ")
        rows += [(5 * k + v, " ".join([*w[: 5 * v], f"other{v}", *w[5 * v + 1 :], passage]), "a") for v in range(5)]
    docs = table(spark, rows)
    texts = line_dedup.pointed(line_dedup._texts(docs, line_dedup.occurrences(docs).select("line", "doc_id", "version", "place")))
    crowd = texts.select(F.lit(1).alias("key"), "line", "words", "size", "sim", F.col("line").alias("component"))
    made, found = [], line_dedup._meetings

    def spied(rows, by, also, like):
        out = found(rows, by, also, like)
        if "parity0" in also:
            made.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "_meetings", spied)
    none = spark.createDataFrame([], "line long, component long")
    assert line_dedup.crowded_pairs(crowd, none, texts).count() == 30 * 10 == made[0]
    monkeypatch.setattr(line_dedup, "EARLIER", 0)  # every key that two lines share
    assert line_dedup.crowded_pairs(crowd, none, texts).count() == 30 * 10 < made[1] / 5


def test_words_of_one_component_bring_no_places(spark, monkeypatch):
    """Near copies that are joined already share most rare pairs of words, with each other alone: in a crowd these are not
    looked at, and copies that are still apart are all found."""
    passage, rows = prose(860, 18), []
    for k in range(30):
        w = prose(2800 + k, 30).split(" ")
        rows += [(5 * k + v, " ".join([*w[: 5 * v], f"other{v}", *w[5 * v + 1 :], passage]), "a") for v in range(5)]
    docs = table(spark, rows)
    texts = line_dedup.pointed(line_dedup._texts(docs, line_dedup.occurrences(docs).select("line", "doc_id", "version", "place")))
    line = {r.norm: r.line for r in texts.collect()}
    group = [[line[normal(t)] for _, t, _ in rows[5 * k : 5 * k + 5]] for k in range(30)]
    labels = spark.createDataFrame([(x, min(g)) for g in group[:20] for x in g], "line long, component long")
    crowd = texts.select(F.lit(1).alias("key"), "line", "words", "size", "sim", F.col("line").alias("component"))
    dealt, found = [], line_dedup._dealt

    def spied(rows, also, like):
        dealt.extend(r.line for r in rows.select("line").collect() if "parity0" in also)
        return found(rows, also, like)

    monkeypatch.setattr(line_dedup, "_dealt", spied)
    pairs = {(r.a, r.b) for r in line_dedup.crowded_pairs(crowd, labels, texts).collect()}
    assert pairs == {(min(x), max(x)) for g in group[20:] for x in itertools.combinations(g, 2)}
    assert set(dealt) == {x for g in group[20:] for x in g}


def test_pairs_that_last(spark):
    """Held against all edits of like lines: the pairs that are looked at never all change, and one less might."""
    r, cases = random.Random(4), []
    for words in [w for w in range(12, 34) for _ in range(12)]:
        at = [i for i in range(words - 1) if r.random() < r.choice((0.3, 0.6, 0.9))] or [0]
        cases.append((len(cases), words, r.sample(at, len(at))))
    ordered = spark.createDataFrame(cases, "id int, words int, places array<int>").withColumn("all", F.transform("places", lambda at: F.struct(at.alias("at"))))
    got = {x.id: x.n for x in ordered.select("id", line_dedup.lasting(F.col("words"), F.col("all")).alias("n")).collect()}

    def lasts(words, chosen):
        for more in range(words):
            if (edits := (words + more) // 4) < more:
                continue
            twos, open_ = 0, False
            for i in range(words - 1):
                twos, open_ = twos + (i in chosen and open_), i in chosen and not open_
            if len(chosen) <= edits + min(edits - more, twos):
                return False
        return True

    most = 0
    for k, words, places in cases:
        others = set(range(words - 1)) - set(places)
        least = next(n for n in range(len(places) + 1) if lasts(words, others | set(places[:n])))
        most += max(0, 2 * ((words + 1) // 4) + 1 - len(others))
        assert lasts(words, others | set(places[: got[k]])) and least <= got[k] <= least + 1
    assert sum(got.values()) < 0.8 * most


def test_scattered_rare_words_spare_places(spark, monkeypatch):
    """Lines of phrases that many lines have, each line in an order of its own: most edits change but one of the pairs of
    words between phrases, which no other line has, so that only near copies are looked at. All copies are found."""
    r, phrases = random.Random(5), [prose(8800 + k, 2) for k in range(400)]
    rows = [(k, [x for phrase in r.sample(phrases, 30) for x in phrase.split(" ")], "a") for k in range(50)]
    rows += [(1000 + k, [*w[:20], "changed", *w[21:40], "again", *w[41:]], "a") for k, w, _ in rows[:10]]
    rows = [(k, " ".join(w), "a") for k, w, _ in rows]
    docs = table(spark, rows)
    texts = line_dedup.pointed(line_dedup._texts(docs, line_dedup.occurrences(docs).select("line", "doc_id", "version", "place")))
    line = {r.norm: r.line for r in texts.collect()}
    crowd = texts.select(F.lit(1).alias("key"), "line", "words", "size", "sim", F.col("line").alias("component"))
    dealt, found = [], line_dedup._dealt

    def spied(rows, also, like):
        dealt.extend(r.line for r in rows.select("line").collect() if "parity0" in also)
        return found(rows, also, like)

    monkeypatch.setattr(line_dedup, "_dealt", spied)
    pairs = {(r.a, r.b) for r in line_dedup.crowded_pairs(crowd, spark.createDataFrame([], "line long, component long"), texts).collect()}
    of = {k: line[normal(t)] for k, t, _ in rows}
    copies = [of[k] for k in of if k >= 1000 or k < 10]
    assert {(min(x), max(x)) for x in ((of[k], of[1000 + k]) for k in range(10))} <= pairs
    assert set(copies) <= set(dealt) and len(set(dealt)) < 35


def test_texts_are_looked_up_in_parts(spark, monkeypatch, tmp_path):
    """Lines are looked up of a part of the documents at a time, each once though rows repeat, and when the documents are
    sent for the last time no table of lines is left on disk."""
    rows = [(k, f"{prose(8000 + k // 2, 20)} {k}\n{prose(8100 + k, 15)}", "a") for k in range(60)] + [(None, prose(8000, 20), "a")]
    docs = table(spark, rows + rows[:9])
    made, found = [], line_dedup._texts

    def spied(part, wanted):
        out = found(part, wanted)
        made.append({r.line for r in out.collect()})
        assert len(made[-1]) == out.count() == wanted.count()
        return out

    monkeypatch.setattr(line_dedup, "_texts", spied)
    monkeypatch.setattr(line_dedup, "PART_LINES", 10)
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    out = line_dedup.dedup_lines(docs)
    assert len(made) == line_dedup.TEXT_PARTS and sum(map(len, made)) == len(set().union(*made)) >= 60
    assert not {x.name.split("-")[0] for x in tmp_path.iterdir()} & {"occurrences", "texts", "keyed", "pairs", "symbols"}
    left = {r.doc_id: r.text for r in out.collect()}
    assert left == {i: prose(8000, 20) if i is None else t if i % 2 == 0 and i else t.split("\n")[1] for i, t, _ in rows}


def test_lines_are_sent_where_there_are_others(spark, monkeypatch):
    """Of a crowd's key a line is only sent to lengths at which there are lines of another component."""
    size = [20, 21, 200, 205, 2000, 2100, 9000]  # the two of 200 are in one component
    rows = [(1, k, 10, n, 0, {3: 2}.get(k, k)) for k, n in enumerate(size)] + [(2, 10 + k, 10, 50, 0, 10 + k) for k in range(5)]
    rows = spark.createDataFrame(rows, "key long, line long, words int, size int, sim long, component long")
    sent, found = [], line_dedup._meetings

    def spied(dealt, *how):
        sent.extend((r.line, x.band, x.salt) for r in dealt.collect() for x in r.to)
        return found(dealt, *how)

    monkeypatch.setattr(line_dedup, "_meetings", spied)
    monkeypatch.setattr(line_dedup, "TASK_LINES", 2)
    pairs = {(r.a, r.b) for r in line_dedup._dealt(rows, (), None).collect()}
    assert pairs == {(0, 1), (4, 5)} | set(itertools.combinations(range(10, 15), 2))
    assert {x for x, _, _ in sent} == {1, 5, *range(10, 15)}  # the shorter lines of a pair stay in their own bands
    assert sorted(x[2] for x in sent if x[0] == 10) == [0, 1, 2]  # five lines are dealt to three tasks


def test_lines_of_a_small_crowd_are_sent_once(spark, monkeypatch):
    """Whatever their lengths, if a task may hold all lines of the key."""
    rows = [(1, k, 10, 100 + 2 * k, 0, k % 3) for k in range(40)] + [(2, 50 + k, 10, 50 + 60 * k, 0, k) for k in range(5)]
    frame = spark.createDataFrame(rows, "key long, line long, words int, size int, sim long, component long")
    sent, found = [], line_dedup._meetings

    def spied(dealt, *how):
        sent.append([len(r.to) for r in dealt.collect()])
        return found(dealt, *how)

    monkeypatch.setattr(line_dedup, "_meetings", spied)
    pairs = {(r.a, r.b) for r in line_dedup._dealt(frame, (), None).collect()}
    want = {(x[1], y[1]) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and x[5] != y[5] and abs(x[3] - y[3]) <= max(x[3], y[3]) * 2 // 10}
    assert pairs == want and len(want) > 100 and set(sent[0]) == {0, 1}
    monkeypatch.setattr(line_dedup, "TASK_LINES", 3)
    assert {(r.a, r.b) for r in line_dedup._dealt(frame, (), None).collect()} == want and max(sent[1]) > 2


def test_copies_are_compared_with_the_smallest_first(spark, monkeypatch):
    """Of a group of copies any two are a pair: most are in one component before they are compared. Pairs that only
    later lines are in are compared as well."""
    pairs = [*itertools.combinations(range(12), 2), (20, 21), (20, 22), (21, 22)]
    compared = []

    def verified(pairs, texts):
        compared.append({(r.a, r.b) for r in pairs.collect()})
        return pairs.where("a != 20")

    monkeypatch.setattr(line_dedup, "verified", verified)
    labels = spark.createDataFrame([(5, 5), (30, 5)], "line long, component long")
    got = {r.line: r.component for r in line_dedup.labels_with(spark.createDataFrame(pairs, "a long, b long"), labels, None).collect()}
    assert got == dict.fromkeys([*range(12), 30], 0) | {21: 21, 22: 21}
    assert compared == [{*((0, k) for k in range(1, 12)), (20, 21), (20, 22)}, {(21, 22)}]


def test_more_links_join_components(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "line long, component long")
    more = spark.createDataFrame([(2, 6), (7, 9), (11, 12), (8, 9)], "a long, b long")
    assert {tuple(r) for r in components.joined_labels(labels, more).collect()} == {(1, 1), (2, 1), (5, 1), (6, 1), (7, 7), (8, 7), (9, 7), (11, 11), (12, 11)}
    assert components.joined_labels(labels, more.where("a = b")) is labels


def test_lists_of_scratch_files_go_with_their_tables(spark):
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def held():
        gc.collect()
        shown = subprocess.run(["jmap", "-histo:live", str(pid)], capture_output=True, text=True, check=True).stdout
        return sum(int(x.split()[1]) for x in shown.splitlines() if "LocatedFileStatus" in x)

    before, managed = held(), spark.conf.get(scratch.CACHES_LISTS)
    for _ in range(3):
        assert scratch.pointed(spark.range(100).repartition(100)).count() == 100
    assert held() - before < 100 and spark.conf.get(scratch.CACHES_LISTS) == managed
    cached = [spark.read.parquet(scratch.pointed(spark.range(100).repartition(100)).scratch_at) for _ in range(2)]
    assert held() - before >= 200 and len(cached) == 2  # it is counted rightly


def test_heaps_are_collected_before_python_workers_start(spark, odd):
    """By tasks, so on executors, whose heaps else stay as large as earlier steps made them."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(x.getCollectionCount() for x in beans if "Old" in x.getName() or "MarkSweep" in x.getName())
    labels = spark.createDataFrame([(k, k % 2) for k in range(20, 50)], "doc_id long, quality int")
    before = whole()
    assert quality.train(odd, labels).weights is not None
    assert whole() - before >= 3  # the driver at both ends, and the tasks
    before = whole()
    assert packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json")).count() >= odd.count()
    assert whole() - before >= 2


def test_line_recall(spark, sf_dir):
    """Of all pairs of lines that share a pair of words that is not very common and are alike, nine in ten are in one
    group; lines in one group are joined by pairs that are alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = {}
    for d in docs.select("doc_id", "text").collect():
        for k, line in enumerate((d.text or "").split("\n")):
            if 15 <= len(x := normal(line)) <= 600:
                place.setdefault(x, (d.doc_id, k))
    at = {}
    for x in place:
        w = x.split(" ")
        for pair in set(zip(w, w[1:], strict=False)):
            at.setdefault(pair, []).append(x)
    pairs = {(a, b) for held in at.values() if len(held) <= 40 for a in held for b in held if a < b and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b))}
    links = [(a, b) for a, b in pairs if alike(a, b)]
    found, labels = line_dedup.line_groups(docs)
    component = {(r.doc_id, r.place): r.component or r.line for r in found.join(labels, "line", "left").collect()}
    together = sum(component[place[a]] == component[place[b]] for a, b in links)
    assert len(links) >= 30 and together >= 0.9 * len(links)


def test_line_dedup_finds_a_replaced_word(spark):
    """Lines of 6 to 65 words, each beside a copy in which one word is another."""
    rows, pairs = [], 0
    for n in range(6, 66):
        w = prose(9000 + n, n).split(" ")
        at = min((k for k in range(n) if len(w[k]) <= 4), key=lambda k: abs(k - n // 2))
        other = [*w[:at], "zzzz"[: len(w[at])], *w[at + 1 :]]
        x, y = " ".join(w), " ".join(other)
        assert distance(x, y) <= 0.2 * len(x)
        rows += [(2 * n, x, "a"), (2 * n + 1, y, "a")]
        pairs += 1
    left = sum(r.text != "" for r in line_dedup.dedup_lines(table(spark, rows)).collect())
    assert pairs <= left <= 1.05 * pairs


def test_simhash_lanes(spark):
    """Lines of few, many and very many words are counted in lanes of other widths; all give the same bits."""
    texts = [(k, prose(k, n)) for k, n in enumerate((1, 2, 127, 128, 300, 33_000))]
    rows = spark.createDataFrame(texts, "k int, t string").select("k", F.split("t", " ").alias("w"))
    rows = rows.select("k", line_dedup.simhash(F.col("w")).alias("s"), F.transform("w", lambda w: F.xxhash64(w)).alias("h")).collect()
    for r in rows:
        n = len(r.h)
        want = sum((2 * sum(x >> b & 1 for x in r.h) > n) << b for b in range(64))
        assert r.s & (1 << 64) - 1 == want


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("many", [True, False])
def test_mixing(spark, odd_rows, empty, many):
    rows = [(i, prose(i, 20 + i % 90), ["a", "b", None, "Ä", "z"][0 if i % 3 == 0 else i % 5]) for i in range(600)] if many else odd_rows
    docs = table(spark, rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = targets_by_hand(dict(sizes))
    got = mixing.mix(docs).collect()
    text = {i: (t, s) for i, t, s in rows}
    taken = Counter()
    for r in got:
        t, s = text[r.doc_id]
        assert r.size == len(words(t)) and r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == len(rows)
    if many:
        assert all(taken[s] == pytest.approx(want[s], rel=0.01) for s in want)
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).collect())) == sorted(map(tuple, got))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def scanned_by_hand(files):
    """{doc_id: (license, origin, cosine, licence_dir)} by plain Python, files as (doc_id, path, text)."""
    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    df, n = Counter(w for _, _, t in files for w in set(split(t))), len(files)
    models = [(name, Counter(split(t))) for name, t in license_scan.template_texts()]
    telling = {w for _, m in models for w in m if df[w] <= n * license_scan.TELLING + license_scan.TELLING_FILES}
    vector = lambda c: {w: k * (math.log((n + 1) / (df[w] + 1)) + 1) for w, k in c.items()}
    models = [(name, vector(m)) for name, m in models]

    def best(text):
        v = vector(Counter(split(text)))
        size = lambda x: math.sqrt(sum(y * y for y in x.values()))
        scored = [(-round(sum(v[w] * x for w, x in m.items() if w in v) / size(v) / size(m), 9), name) for name, m in models]
        return min(s for s in scored) if scored else None

    own, declared, out = {}, {}, {}
    parent = lambda p: (p or "").rpartition("/")[0]
    for i, path, text in files:
        lines = (text or "").split("\n")
        places = [k for k, x in enumerate(lines) if len(set(split(x)) & telling) >= 2]
        blocks = []
        for k in places:
            if blocks and k - blocks[-1][-1] <= 2:
                blocks[-1].append(k)
            else:
                blocks.append([k])
        parts = [(2, lines[k]) for k in places] + [(1, "\n".join(lines[k] for k in b)) for b in blocks] + ([(0, text)] if places else [])
        hits = [(scope, *best(t)) for scope, t in parts]
        hits = [h for h in hits if h[1] <= -license_scan.LEAST_COSINE]
        if hits:
            scope, c, name = min(hits)
            own[i] = (name, scope == 0, -c)
            if own[i][1]:
                declared.setdefault(parent(path), []).append((c, name))
    for i, path, _ in files:
        if i in own:
            name, is_file, c = own[i]
            out[i] = (name, "file" if is_file else "header", c, parent(path) if is_file else None)
            continue
        d = parent(path)
        while d not in declared and d:
            d = parent(d)
        out[i] = (min(declared[d])[1], "inherited", -min(declared[d])[0], d) if d in declared else (None, "none", None, None)
    return out


def test_license_scan(spark, empty):
    """Texts and notices that are not the templates word for word, in comments and between other lines; ties between
    templates and between licence files; nulls, empty and very long texts, repeated rows, clashing names."""
    mit = "\n".join(["Copyright (c) 2020 Some Author", "", *(license_scan.MIT.replace(", to deal", ",\nto deal").replace("rights to use", "rights\nto use").split("\n")), license_scan.WARRANTY])
    notice = "\n".join("# " + x for x in license_scan.APACHE.replace("; ", ";\n").replace("License. ", "License.\n").split("\n"))
    bsd = f"{license_scan.BSD}\n{license_scan.BSD_THIRD}\n\n{license_scan.BSD_END}"
    code = "\n".join(prose(700 + k, 12) for k in range(40))
    gpl = license_scan.GPL.format("General", "3").replace(". ", ".\n")
    files = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x", code), (3, "a/b/y", notice + "\n" + code), (4, "z/q", prose(9, 40)), (5, "LICENSE", "BSD 3-Clause License\n\n" + bsd), (6, "a/b/d/LICENSE", gpl), (7, "a/b/d/COPYING", "Licensed under the Apache License, Version 2.0"),
        (8, "a/b/d/e/f", None), (9, None, ""), (10, "a/w", "licenses are discussed here at length, without any grant or name of one"), (11, "s/t", "// SPDX-License-Identifier: MIT\n" + code), (12, "s/u", code + "\nSPDX-License-Identifier: BSD-2-Clause\n\n\nThe MIT License (MIT)"),
        (13, "s/long", " ".join(["word"] * 60_000) + "\n" + notice), (14, "k/LICENSE", "Mozilla Public License Version 2.0"), (15, "k/LICENSE.old", "Apache License Version 2.0, January 2004"), (16, "k/m", code), (17, "p/x", "This is free software as in freedom, and the license of it is the GNU General Public License version 2 or so"),
    ]
    rows = [(i, p, t, "x", "y", "z", 1) for i, p, t in files] + [(2, "a/b/c/x", code, "x", "y", "z", 1)]
    table_ = spark.createDataFrame(rows, "doc_id long, path string, text string, license string, unit string, of string, version int")
    got = {r.doc_id: (r.license, r.origin, r.cosine, r.licence_dir) for r in license_scan.scan(table_).collect()}
    want = scanned_by_hand(files + [files[1]])
    assert {i: x[:2] + x[3:] for i, x in got.items()} == {i: x[:2] + x[3:] for i, x in want.items()}
    assert {i: x[2] for i, x in got.items()} == {i: pytest.approx(x[2], abs=1e-8) if x[2] else x[2] for i, x in want.items()}
    assert [got[k][:2] for k in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [("MIT", "file"), ("MIT", "inherited"), ("Apache-2.0", "header"), ("BSD-3-Clause", "inherited"), ("BSD-3-Clause", "file"), ("GPL-3.0", "file"), ("Apache-2.0", "file"), (got[8][0], "inherited"), ("BSD-3-Clause", "inherited")]
    assert got[11][0] == "MIT" and got[16][3] == "k" and got[1][2] < 1 and got[7][2] <= 1
    assert license_scan.scan(table_).count() == len(rows) and license_scan.scan(table_.where("false")).count() == 0


def test_licenses_that_most_files_have(spark):
    """Notices of one licence in nine files of ten, whose words are common that way; as a block, as a line, and as a whole
    file of lines that hold little each."""
    notice = "\n".join("# " + x for x in license_scan.APACHE.replace("; ", ";\n").replace("License. ", "License.\n").split("\n"))
    rows = [(k, f"a/{k}/x", f"{notice}\n\n\n{prose(k, 60)}") for k in range(150)]
    rows += [(200 + k, f"b/{k}/x", f"{prose(300 + k, 20)}\n// Licensed under the Apache License, Version 2.0\n{prose(500 + k, 20)}") for k in range(40)]
    words_ = license_scan.APACHE.split(" ")
    rows += [(300 + k, f"c/{k}/x", "\n".join(" ".join(words_[i : i + 3]) for i in range(0, len(words_), 3))) for k in range(5)]
    rows += [(400 + k, f"d/{k}/x", f"the use of the work in {prose(600 + k, 30)}") for k in range(20)]
    got = {r.doc_id: (r.license, r.origin) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    # Short texts after a notice leave the whole near enough to be a licence file.
    assert {got[i][0] for i in got if i < 400} == {"Apache-2.0"}
    assert {got[i] for i in got if i >= 400} == {(None, "none")}


def test_only_texts_that_may_reach_a_license_are_weighed(spark, monkeypatch):
    """Long texts that hold a notice, and copies of them, have no words of theirs looked up, and every text near enough to a template has."""
    notice = "# " + license_scan.APACHE
    rows = [(k, f"a/{k % 7}/{k}", f"{notice}\n{prose(5000 + k // 2, 600)}") for k in range(40)]
    rows += [(100 + k, f"b/{k}", f"{notice} {prose(6000 + k, 2 * k)}") for k in range(40)]
    rows += [(200 + k, f"c/{k}", prose(7000 + k % 3, 50)) for k in range(20)]
    weighed, best = [], license_scan.best_templates

    def spied(found, *of):
        weighed.append({r.unit for r in found.collect()})
        return best(found, *of)

    def everything(found, *of):
        every.append({r.unit for r in found.collect()})
        wanted.append({r.unit for r in best(found, *of).collect()})
        return reaching(found, *of)

    every, wanted, reaching = [], [], license_scan.reaching
    monkeypatch.setattr(license_scan, "best_templates", spied)
    monkeypatch.setattr(license_scan, "reaching", everything)
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert all(got[k] == "Apache-2.0" for k in [*range(40), 100])
    assert wanted[0] <= weighed[0] and len(every[0]) - len(weighed[0]) >= 20 and len(wanted[0]) >= 2


def test_archives(spark, sf_dir):
    schema = "page_id long, url string, html string, key string, at long"
    rows = [(1, "http://a.b/\\x\ty", "x" * 2000), (2, None, "x" * 2000), (2, None, "x" * 2000), (None, "http://É.b", None), (-5, "nourl", "é" * 600), (7, "http://u@a.b:80/q#f", "é" * 600), (8, "http://a.b/", "short"), (9, "http://a.b/", "short"), (10, "http://a.b/", "\r\n\r\n" * 400)]
    rows += [(100 + k, "http://one.host/page", f"page {k} " * 200) for k in range(1500)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], schema)
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=repr)
    c = duckdb.connect()
    frame = pages.toPandas()  # noqa: F841
    want = sorted(c.sql(queries.ORACLES["op4_warc"].replace("from pages", "from frame")).fetchall(), key=repr)
    assert got == want and sum(r[3] == "revisit" for r in got) == 2 and warc.round_trip(pages.where("false")).count() == 0


def test_records():
    data = warc.record(-3, "http://a/", b"payload \r\n\r\n", "ab" * 20, None)
    fields, http, payload = warc.parsed(data)
    assert payload == b"payload \r\n\r\n" and warc.page_of(fields["WARC-Record-ID"]) == -3 and fields["WARC-Type"] == "response"
    fields, http, payload = warc.parsed(warc.record(4, "http://a/", b"payload", "ab" * 20, 9))
    assert payload == b"" and b"Content-Length: 7" in http and warc.page_of(fields["WARC-Refers-To"]) == 9


def test_oracle_of_the_join(spark, near_rows):
    c = duckdb.connect()
    docs = table(spark, near_rows)
    frame = docs.toPandas()  # noqa: F841
    want = sorted(c.sql(queries.ORACLES["op2_ngram_join"].replace("from documents", "from frame")).fetchall())
    assert want == sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect())


@pytest.fixture(scope="module")
def corpus(spark, odd_rows, tmp_path_factory):
    """Odd documents, near copies and shared lines, with labels, as a folder of tables."""
    base, rows = prose(61, 90), [r for r in odd_rows if r[0] != 8]
    for k in range(6):
        w = base.split(" ")
        w[3 * k] = "swapped"
        rows.append((300 + k, " ".join(w) + "\n" + prose(70 + k, 15), "ab"[k % 2]))
    rows += [(400 + k, "\n".join([prose(90, 14), prose(80 + k, 60), prose(91 + k % 2, 11)]), "c") for k in range(8)]
    again = prose(62, 120).split(" ")  # the same words in lines of other lengths, which are unlike
    rows += [(450 + n, "\n".join(" ".join(again[k : k + n]) for k in range(0, 120, n)), "b") for n in (20, 40)] + [(449, " ".join(again), "a")]
    rows += [(500 + k, "buy now " * 30 if k % 2 else " ".join(["$$$ win"] * 15 + prose(600 + k, 30).split(" ")), "d") for k in range(24)]
    at = tmp_path_factory.mktemp("corpus")
    table(spark, rows).withColumnRenamed("class", "d").write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i < 500), 0) for i, t, _ in rows if i and i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_pipeline(spark, corpus):
    """Every stage on what the one before kept, held against plain Python; the documents' columns stay as they are."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tickloom.llm import quality
    from tickloom.llm.arrays import Words, utf8

    from .test_text import rules

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    held = lambda df: [tuple(r) for r in df.select("doc_id", "text", "source").collect()]

    def step(name):
        nonlocal docs
        before, after = held(docs), stages[name](spark, docs, corpus)
        assert after.columns == names
        docs = spark.createDataFrame(after.collect(), docs.schema)
        return before, held(docs)

    model = quality.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    before, after = step("quality rules")
    kept = set()
    for i, t, _ in before:
        n, _, _, _, again = rules(t)
        if n >= 20 and 100 * again <= 30 * n and model.probability(Words(*utf8(pa.array([t]))))[0] >= quality.KEEP_AT:
            kept.add(i)
    assert {i for i, _, _ in after} == kept and not any(i and i >= 500 for i in kept) and sum(20 <= (i or 0) < 450 for i in kept) >= 35

    before, after = step("line dedup")
    want = left_by_hand(before)
    assert sorted(after, key=repr) == sorted(((i, want[i], s) for i, _, s in before), key=repr) and sum(a != b for a, b in zip(sorted(before), sorted(after), strict=True)) >= 8

    before, after = step("n-gram join")
    _, component, links = by_hand(before)
    assert links and sorted(i for i, _, _ in after) == sorted(i for i in component if component[i] == i)

    before, after = step("mixing")
    sizes, taken, copies = Counter(), Counter(), Counter(i for i, _, _ in after)
    for _, t, s in before:
        sizes[s] += len(words(t))
    for _, t, s in after:
        taken[s] += len(words(t))
    aims, largest = targets_by_hand(dict(sizes)), max(len(words(t)) for _, t, _ in before)
    assert set(after) <= set(before) and max(copies.values()) <= 3 and all(abs(taken[s] - aims[s]) <= largest for s in aims)

    pieces = stages["packing"](spark, docs, corpus).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    each = Counter(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _ in held(docs))
    assert Counter(r.doc_tokens for r in pieces if r.start == 0) == each and sum(r.length for r in pieces) == sum(k * n for k, n in each.items())

    got = corpus_pipeline.run(spark, corpus)
    assert Counter(map(tuple, got.select("doc_id", "start", "length", "ids_crc32").collect())) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)


def test_pipeline_of_an_empty_table(spark, corpus, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
