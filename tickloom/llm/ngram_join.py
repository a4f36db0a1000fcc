"""Exact Jaccard join of word n-gram sets by tries over globally ordered sets.

A document's set is its distinct n-word shingles as 64-bit hashes. Documents with equal sets form one
class. All sets are ordered alike, rare shingles first: by the level (a power of two) of a count, then by
hash. Counts are kept in a table of 2**22 buckets of shingles, to which a scan adds what several classes
of a block of documents hold; any table gives an order that all sets share, and so a right result. Two
sets can only reach the threshold if they share one of their first ``n - ceil(0.8 n) + 1`` shingles, so
only those are dealt out, packed as arrays.

Candidates are compared in tries: sets are inserted along their order, a probe carries the overlap of
the shared path into the branches, and a subtree is left as soon as what remains of the probe and of
its sets cannot reach the overlap that is asked for, or once all of it is known to be in the probe's
own component. A first round compares each set with one hub per shared shingle, and with what falls into
the same trie. The second round makes the result exact: it compares all that share a shingle and are still in
different components, pair by pair if they are of like sizes and at most 64 share the shingle, and else those
outside the largest component with all, block by block. So large groups of copies are not compared pair by pair.

Defined results: lower-cased A-Z, words ``[^\\x20\\x09-\\x0D]+``; fewer than n words are one shingle;
null, empty or blank texts have an empty set and are linked with nothing. Repeated rows are rows of
one class. A null doc_id stays a row of its own class and takes the class's component. Texts of any
length are read whole, a row at a time if need be. An empty table has an empty result. Extra columns
are ignored or, in ``keep_first``, carried along whatever their names. Classes are told apart by 64 bits of a digest, and shingles by 64-bit hashes: at 10**9
different texts the odds of any confusion of classes are about 3 %.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, Words, chunks, freed, shingle_sets, tidy, utf8
from .components import component_labels
from .joins import attached
from .scratch import pointed, released, shrunk, written

N = 5
#: The threshold as a fraction of integers: 100 * intersection >= 80 * union.
PERCENT = 80
#: Shingles that are counted, and dealt out, at a time within a task.
BLOCK = 1_000_000
#: Buckets of shingles by their first bits, whose counts order them.
BUCKET_BITS = 22
#: At most so many frequent buckets: one must have at least this part of all shingles.
FREQUENT = 1 << 18
#: Sets that can be linked are of the same or neighbouring bands of sizes, each so many times as wide as the one before.
BAND = 1.26
#: Sets in one trie.
TRIE_SETS = 256
#: Classes with one shingle of which single pairs are looked at; more are compared in blocks.
CROWD = 64
#: Bits of the filter that tells a scan which documents are candidates; more candidates only let more rows pass it.
FILTER_BITS = 1 << 25


def prefix_length(n: np.ndarray | int):
    return n - -(-n * PERCENT // 100) + 1


def ceil_div(x: str, y: int) -> str:
    """SQL for the ceiling of x / y where x >= 0; Spark's div drops the fraction, so that negated operands give the floor."""
    return f"((({x}) + {y - 1}) div {y})"


def _sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return shingle_sets(Words(*utf8(batch.column(1))), n)[0]


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=8).digest()


def _class_id(s: np.ndarray) -> int:
    return int.from_bytes(_digest(s), "little", signed=True)


def _blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list[np.ndarray], list[int]]]:
    """doc_ids, sets and classes of rows with up to about BLOCK shingles."""
    ids, sets, classes, held = [], [], [], 0
    for batch in chunks(batches):
        new = _sets(batch, n)
        ids += batch.column(0).to_pylist()
        sets += new
        classes += [_class_id(s) for s in new]
        held += sum(map(len, new))
        if held >= BLOCK:
            yield ids, sets, classes
            ids, sets, classes, held = [], [], [], 0
    if ids:
        yield ids, sets, classes


def _distinct(sets: list[np.ndarray], classes: list[int]) -> dict[int, np.ndarray]:
    return {c: s for c, s in zip(classes, sets, strict=True) if len(s)}


def buckets_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U(64 - BUCKET_BITS)).astype(np.int32)


def describe(docs: DataFrame, n: int = N) -> DataFrame:
    """Rows (doc_id, n_shingles, class) of documents, and rows (bucket, df) of shingles that a block holds in several classes."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, none = ["doc_id", "n_shingles", "class", "bucket", "df"], lambda k, kind: pa.nulls(k, kind)
        for ids, sets, classes in _blocks(batches, n):
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), none(k, pa.int32()), none(k, pa.int64())], names)
            keys = np.concatenate([*_distinct(sets, classes).values(), np.zeros(0, U)])
            del sets
            keys.sort()
            same = keys[1:] == keys[:-1]
            counts = np.bincount(buckets_of(keys[1:][same]), minlength=1)  # occurrences but the first
            del keys, same
            full = np.flatnonzero(counts)
            for at in range(0, len(full), 100_000):
                some = full[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([none(len(some), pa.int64()), none(len(some), pa.int64()), none(len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_shingles long, class long, bucket int, df long")


class Order:
    """The global order: by the level of a shingle's bucket, then by hash. ``frequent`` is the least level that counts as frequent."""

    def __init__(self, buckets: np.ndarray, counts: np.ndarray, least: int):
        self.levels = np.zeros(1 << BUCKET_BITS, np.uint8)
        self.levels[buckets] = self.level(counts)
        self.frequent = int(self.level(np.array([max(least, 2)]))[0])

    @staticmethod
    def level(counts: np.ndarray) -> np.ndarray:
        return np.log2(np.maximum(counts, 1)).astype(np.uint8)

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The set in this order, and how many of it are infrequent. ``s`` is sorted by hash."""
        levels = self.levels[buckets_of(s)]
        return s[np.argsort(levels, kind="stable")], int((levels < self.frequent).sum())


def postings(docs: DataFrame, order, parts: int, n: int = N) -> DataFrame:
    """The first shingles of every class of a block, packed by part: infrequent ones are dealt by shingle, which
    few classes can share, frequent ones by class."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        for _, sets, classes in _blocks(batches, n):
            tokens, owners, sizes, often = [], [], [], []
            for c, s in _distinct(sets, classes).items():
                ranked, few = o.sort(s)
                p = int(prefix_length(len(s)))
                tokens.append(ranked[:p])
                often.append(np.arange(p) >= few)
                owners.append(np.full(p, c, np.int64))
                sizes.append(np.full(p, len(s), np.int32))
            if not tokens:
                continue
            t, c, z, f = (np.concatenate(x) for x in (tokens, owners, sizes, often))
            part = np.where(f, parts + c.view(U) % U(parts), t % U(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[by], np.arange(2 * parts + 1))
            t, c, z = t[by], c[by], z[by]
            full = np.flatnonzero(cut[1:] > cut[:-1])
            blobs = [b"".join(x[cut[p] : cut[p + 1]].tobytes() for x in (t, c, z)) for p in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(full >= parts), pa.array(blobs, pa.binary())], ["part", "frequent", "blob"])

    return docs.select("doc_id", "text").mapInArrow(rows, "part int, frequent boolean, blob binary")


def _shared(key, table):
    """Of one part, the postings of shingles that several classes have; of frequent shingles, all."""
    freed()
    t, c, z = [], [], []
    for blob in table.column("blob").to_pylist():
        m = len(blob) // 20
        t.append(np.frombuffer(blob, U, m))
        c.append(np.frombuffer(blob, np.int64, m, 8 * m))
        z.append(np.frombuffer(blob, np.int32, m, 16 * m))
    t, c, z = np.concatenate(t), np.concatenate(c), np.concatenate(z)
    frequent = table.column("frequent")[0].as_py()
    if not frequent:
        t, c, z = _repeated(np.argsort(t), t, c, z)
    t, c, z = (x[by] for by in [np.lexsort((c, t))] for x in (t, c, z))
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])  # blocks may hold copies of one class
    t, c, z = t[fresh], c[fresh], z[fresh]
    if not frequent:
        t, c, z = _repeated(np.arange(len(t)), t, c, z)
    return pa.table({"token": t.view(np.int64), "class": c, "n": z.astype(np.int64)})


def _repeated(by: np.ndarray, t: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """What belongs to values of t that occur twice or more; ``by`` sorts t."""
    keep = np.zeros(len(t), bool)
    same = t[by[1:]] == t[by[:-1]]
    keep[1:] |= same
    keep[:-1] |= same
    return tuple(x[by][keep] for x in (t, *more))


class Trie:
    """Path-compressed trie of ordered sets. A node holds a run of shingles as ranks of the group's order."""

    __slots__ = ("children", "component", "large", "run", "sets", "small")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.sets = run, {}, []
        self.small, self.large, self.component = 1 << 60, 0, None  # sizes below; the component if all sets share one


def _insert(root: Trie, s: np.ndarray, member: int, component: int) -> None:
    node, at, size = root, 0, len(s)
    while True:
        node.component = component if node.small > node.large or node.component == component else None
        node.small, node.large = min(node.small, size), max(node.large, size)
        if at == size:
            node.sets.append(member)
            return
        child = node.children.get(s[at])
        if child is None:
            child = node.children[s[at]] = Trie(s[at:])
            at = size
        else:
            m = min(len(child.run), size - at)
            differ = np.flatnonzero(child.run[:m] != s[at : at + m])
            m = int(differ[0]) if len(differ) else m
            if m < len(child.run):  # split the run
                lower = Trie(child.run[m:])
                lower.children, lower.sets, lower.small, lower.large, lower.component = child.children, child.sets, child.small, child.large, child.component
                child.run, child.children, child.sets = child.run[:m], {lower.run[0]: lower}, []
            at += m
        node = child


def _needed(a: int, b: int) -> int:
    """The least intersection of sets of these sizes that reaches the threshold."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _probe(root: Trie, s: np.ndarray, has: np.ndarray, find, own: int, sizes: list[int]) -> list[int]:
    """Members that reach the threshold with s, one at least for each other component that does. has: marks of s by rank."""
    found, size, stack = [], len(s), [(root, 0, 0)]
    while stack:
        node, overlap, depth = stack.pop()
        if node.component is not None and find(node.component) == find(own):
            continue
        run = node.run
        if len(run):
            overlap += int(has[run].sum())
            depth += len(run)
        low = max(node.small, -(-size * PERCENT // 100))  # sizes that can reach the threshold at all
        if low > node.large or low * PERCENT > size * 100:
            continue
        rest = size - int(np.searchsorted(s, run[-1], "right")) if len(run) else size
        if overlap + min(rest, node.large - depth) < _needed(size, low):
            continue
        found += [m for m in node.sets if overlap >= _needed(size, sizes[m])]
        stack += [(child, overlap, depth) for child in node.children.values()]
    return found


def trie_links(sets: list[np.ndarray], components: list[int]) -> list[tuple[int, int]]:
    """Links (by position) among the sets that connect all that reach the threshold. Sets share one order."""
    order = np.unique(np.concatenate([*sets, np.zeros(0, U)]))
    ranks = [np.searchsorted(order, s) for s in sets]
    root, has, links = Trie(np.zeros(0, np.int64)), np.zeros(len(order), bool), []
    parent = {c: c for c in components}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes = [len(r) for r in ranks]
    for i in np.argsort(sizes, kind="stable"):
        s = ranks[i]
        has[s] = True
        for j in _probe(root, s, has, find, components[i], sizes):
            if find(components[i]) != find(components[j]):
                parent[find(components[j])] = find(components[i])
                links.append((int(i), int(j)))
        has[s] = False
        _insert(root, s, int(i), components[i])
    return links


def _verify(key, table):
    """Links of one hub and some of its members."""
    sets = [np.frombuffer(x, U) for x in table.column("set").to_pylist()]
    classes, components = table.column("class").to_pylist(), table.column("component").to_pylist()
    links = trie_links(sets, components)
    return pa.table({"a": pa.array([classes[i] for i, _ in links], pa.int64()), "b": pa.array([classes[j] for _, j in links], pa.int64())})


def dealt_to_tries(candidates: DataFrame) -> DataFrame:
    """(hub, salt, class): hubs beside their members, those of many members in several tries."""
    size = candidates.groupBy("hub").agg(F.count("*").alias("m"))
    c = candidates.join(size, "hub").withColumn("salt", F.pmod(F.xxhash64("member"), F.expr(f"cast(ceil(m / {TRIE_SETS}) as long)")))
    return c.select("hub", "salt", F.col("member").alias("class")).union(c.select("hub", "salt", F.col("hub").alias("class")).distinct())


def linked(tries: DataFrame, docs: DataFrame, reps: DataFrame, labels: DataFrame, n: int = N) -> DataFrame:
    """Links (a, b) that connect all classes of a trie (hub, salt, class) that reach the threshold, each compared exactly."""
    spark = docs.sparkSession
    both = written(tries, "tries")
    # A class of rows without a doc_id has a null rep, which like every null has one hash and so a bit of its own.
    wanted = written(both.select("class").distinct().join(reps, "class").select("class", "rep"), "wanted")
    bits = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)).alias("bit")).groupBy(F.expr("bit div 32768").alias("page")).agg(F.collect_set(F.expr("cast(bit % 32768 as int)")).alias("bits"))
    filled = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in bits.toLocalIterator():  # at most FILTER_BITS numbers, a page at a time
        at = row["page"] * 32768 + np.array(row["bits"])
        np.bitwise_or.at(filled, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    held = spark.sparkContext.broadcast(filled)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            bit = batch.column(2).to_numpy()
            yield from _set_rows(batch.filter(pa.array((table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1)), n)

    scan = docs.select(F.col("doc_id").cast("long"), "text").withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))).mapInArrow(rows, "class long, set binary")
    sets = scan.groupBy("class").agg(F.first("set").alias("set"))  # repeated rows of one document
    full = both.join(sets, "class").join(labels, "class", "left").select("hub", "salt", "class", F.coalesce("component", "class").alias("component"), "set")
    return full.groupBy("hub", "salt").applyInArrow(_verify, "a long, b long")


def _set_rows(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(iter([batch])):
        sets = _sets(part, n)
        yield pa.RecordBatch.from_arrays([pa.array([_class_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "set"])


def _enough(pairs: DataFrame) -> DataFrame:
    """Pairs (hub, member) that can reach the threshold, of a row (hub, member, n, m) for each shingle that the
    first shingles of both hold. Of the set whose first shingles end earlier in the order, all that it has in
    common with the other lies among the shared first shingles or behind its own."""
    least = F.expr(f"{ceil_div(f'{PERCENT} * (n + m)', 100 + PERCENT)} - {ceil_div(f'{PERCENT} * greatest(n, m)', 100)} + 1")
    pairs = pairs.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * PERCENT)
    return pairs.groupBy("hub", "member", "n", "m").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("hub", "member")


def open_tokens(shared: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``shared`` with their components, and (token, m) of the tokens that several components hold, in m classes."""
    marked = shared.join(labels, "class", "left").select("token", "class", "n", F.coalesce("component", "class").alias("component"))
    return marked, pointed(marked.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo != hi").select("token", "m"))


def with_hubs(marked: DataFrame) -> DataFrame:
    """Rows of classes beside the hubs ``h`` of their tokens: of each token the class of the least hash."""
    hubs = marked.groupBy("token").agg(F.min_by(F.struct("class", "n"), F.xxhash64("class")).alias("h"))
    return marked.join(hubs, "token")


def hub_pairs(marked: DataFrame) -> DataFrame:
    """(hub, member) of every class and the hubs of its tokens."""
    pairs = with_hubs(marked).where(F.col("class") != F.col("h.class"))
    return _enough(pairs.select(F.col("h.class").alias("hub"), F.col("class").alias("member"), F.col("h.n").alias("n"), F.col("n").alias("m")))


def open_pairs(marked: DataFrame, tokens: DataFrame) -> DataFrame:
    """(hub, member) of classes that share a token of few classes, are of like sizes and in different components."""
    own = marked.join(tokens, "token").withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int"))
    o = own.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("class").alias("member"), F.col("n").alias("m"), F.col("component").alias("other"))
    pairs = own.join(o, ["token", "band"]).where(F.col("component") < F.col("other"))
    return _enough(pairs.select(F.col("class").alias("hub"), "member", "n", "m"))


def crowd_tries(marked: DataFrame, tokens: DataFrame) -> DataFrame:
    """(hub, salt, class) of the classes that share a token of many. All tokens of one hub make one crowd. Its classes
    outside its largest component are compared with all of it, in tries of one block of the former and one of the
    latter, so that a class is sent once for each block it is compared with and not for each class."""
    members = written(with_hubs(marked.join(tokens, "token")).select(F.col("h.class").alias("hub"), "class", "component").distinct(), "crowds")
    each = members.groupBy("hub", "component").agg(F.count("*").alias("k"))
    of_hub = each.groupBy("hub").agg(F.sum("k").alias("all"), F.max(F.struct("k", "component")).alias("top")).select("hub", "all", F.col("top.component").alias("largest"), (F.col("all") - F.col("top.k")).alias("others"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / TRIE_SETS)).cast("long")
    m = members.join(of_hub, "hub").withColumns({"rows": blocks("others"), "columns": blocks("all")})
    salt = lambda r, c: -(1 + r * F.lit(1 << 31) + c)
    own_row, own_column = F.pmod(F.xxhash64("class", F.lit(1)), F.col("rows")), F.pmod(F.xxhash64("class", F.lit(2)), F.col("columns"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    as_other = m.where("component != largest").select("hub", "class", own_row.alias("r"), every("columns").alias("c"))
    as_any = m.select("hub", "class", every("rows").alias("r"), own_column.alias("c"))
    return as_other.union(as_any).select("hub", salt(F.col("r"), F.col("c")).alias("salt"), "class").distinct()


def ngram_components(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_shingles, class and component_id (the smallest doc_id that links reach) of every document."""
    spark = docs.sparkSession
    shrunk(spark)
    described = written(describe(docs, n), "shingles")
    documents = described.where("class is not null").select("doc_id", "n_shingles", "class")
    classes = documents.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    p = F.col("n") - F.expr(ceil_div(f"{PERCENT} * n", 100)) + 1
    totals = classes.agg(F.sum("n").alias("shingles"), F.sum(p).alias("firsts")).first()
    least = max(16, -(-(totals["shingles"] or 0) // FREQUENT))
    table = described.where("bucket is not null").groupBy("bucket").agg(F.sum("df").alias("df")).where("df > 1").toArrow()  # at most 2**BUCKET_BITS rows
    order = spark.sparkContext.broadcast(Order(table.column("bucket").to_numpy(), table.column("df").to_numpy(), least))
    del table
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(totals["firsts"] or 0) // 1_000_000))
    dealt = postings(docs, order, parts, n)
    shared = written(dealt.groupBy("part").applyInArrow(_shared, "token long, class long, n long"), "shared")
    reps = classes.select("class", "rep")

    labels = spark.createDataFrame([], "class long, component long")
    links = written(linked(dealt_to_tries(hub_pairs(shared)), docs, reps, labels, n), "links")
    labels = component_labels(links)
    shrunk(spark)
    marked, open_ = open_tokens(shared, labels)
    tries = dealt_to_tries(written(open_pairs(marked, open_.where(F.col("m") <= CROWD).select("token")), "rest"))
    crowded = open_.where(F.col("m") > CROWD).select("token")
    if not crowded.isEmpty():
        tries = tries.union(crowd_tries(marked, crowded))
    links = links.union(written(linked(tries, docs, reps, labels, n), "links"))
    labels = component_labels(links)
    released(spark, shared)

    named = classes.join(labels, "class", "left").select("class", "rep", F.coalesce("component", "class").alias("component"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").select("class", "component_id")
    return documents.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), "doc_id").alias("component_id"), "class")


def keep_first(docs: DataFrame, n: int = N) -> DataFrame:
    """One document of each group stays, the one of the smallest doc_id; of rows that share a doc_id, one, by the
    smallest hash of its text. Rows whose doc_id is null stay."""
    found = written(ngram_components(docs, n).select("doc_id", "component_id"), "components")
    gone = found.where("component_id != doc_id").select("doc_id", F.lit(True).alias("gone"))
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(False).alias("gone"))
    told = pointed(gone.union(twice).groupBy("doc_id").agg(F.max("gone").alias("gone")))
    # The documents go into one column, so that none of their names can clash.
    rows = docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = attached(rows, told, "doc_id", "left").where(~F.coalesce("gone", F.lit(False)))
    once = rows.where("gone is null").select("d.*")
    if told.where("not gone").isEmpty():
        return once
    again = rows.where("gone is not null").groupBy("doc_id").agg(F.min_by("d", F.xxhash64("d.text")).alias("d")).select("d.*")
    return once.unionByName(again)
