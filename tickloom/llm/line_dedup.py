"""Line dedup: SimHash of normalised lines, shared runs of words, edit similarity, one occurrence per group.

A line is normalised to its lower-case words of letters and digits. Equal normalised lines are one line
from the start. Two lines are linked if their edit similarity, 1 - levenshtein / longer length over the
characters of the normalised lines, is at least 0.8, if they share a key, and if the 64-bit SimHashes of
their words differ in at most 15 bits (24 in lines of less than 16 words, any number in lines of up to
three).

Blocks of bits of a SimHash would be the keys by the book. They are not used: of like lines only about a
third differ in three bits or less, so that four blocks miss most of them, and blocks of a few bits, of
which like lines keep some, are shared by lines without end. The pigeonholes here are the words instead:
few edits leave some run of five words whole. Keys are the smallest six hashes of a line's 5-word shingles;
of lines of up to twelve words also the smallest four of 2-word shingles; of lines of up to three words
also the first and last two fifths of their characters, and one character more. The SimHash then spares
the comparison of lines that share little else. So does a first comparison by words, in which lines of 16
words or more may differ in a quarter of them. None of the three is exact; README states the recall.

Links make groups; of a group the occurrence of the smallest (doc_id, place in the document) stays, and
the others are cut from their documents.

Lines that share a key are not all compared: each line is first compared with the smallest line of its
key. Where a key's lines are then still in different groups, those of like lengths are compared with each
other if they are at most 64. Lines of more crowded keys, as passages make that many lines hold, get other
keys: the smallest of those of their shingles that at most 64 of these lines hold, of which the same is
asked. Lines of crowded keys that are then still in different groups are all compared: short ones with each
other, longer ones with those with which they share one of their rarest pairs of neighbouring words, as many as
lose none that the comparison by words lets pass, half of them and one more at most. So no key is too crowded. Only there can
the work grow with the square of a group, of short lines or of those that share half their words; what is written
are the pairs that pass, of short lines by their characters, of longer ones by the parities of their words.

SimHash counts bits in lanes of a 64-bit number: all lanes of one residue are added at once. Lines of 128
words and more are counted bit by bit.

Defined results: lines without a letter or digit stay and are linked with nothing. A null text stays
null; an empty one stays empty; an empty table has an empty result. Lines of any length are read whole.
Rows equal in doc_id and text are one document, whose lines are cut or kept in all of them; equal lines
of one document are repeated lines like others. A null doc_id orders before all others. Columns other
than doc_id and text are carried along untouched, whatever their names. Lines are told apart by 64-bit
hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import component_labels, joined_labels
from .joins import attached, is_small
from .scratch import pointed, released, written, written_in_parts

#: Bits by which the SimHashes of like lines differ at most: of lines of FEW_SURE words or more, and of shorter ones.
MAX_BITS, FEW_BITS = 15, 24
SIMILAR = 0.8
#: The part of its words that a line of FEW_SURE words or more may have changed.
WORD_SHARE, FEW_SURE = 0.25, 16
#: Lines with one key that are compared with each other; more need rarer shingles in common.
CROWD = 64
#: Of a key's lines those that a task holds against all others, where a crowd is compared.
TASK_LINES = 512
#: What is known of a line where pairs are looked for.
FACTS = ("line", "words", "size", "sim", "component")
#: Characters that stand for words, and pairs that a task compares.
SYMBOLS, PART_PAIRS = 50_000, 2_000
#: Parts of the documents whose lines are looked up at a time, at most, and the lines for which a part more is worth it.
TEXT_PARTS, PART_LINES = 4, 50_000
#: Numbers of 64 bits for the parities of a line's words.
LANES = 4
#: Of a line's pairs of words those just before one, by which lines that met there already are told.
EARLIER = 16
#: Lengths of like lines are in the same or neighbouring bands, each so many times as wide as the one before.
BAND = 1.26
#: Width of shingles, the most words of lines that have them, and how many of the smallest are keys.
SHINGLES = ((5, None, 6), (2, 12, 4))
#: Shingles that are left at least, on average, of which the smallest are searched.
LEFT = 10
#: Lines of up to so many words have keys of characters.
FEW_WORDS = 3


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shift(kind: str, x: Column, by: Column) -> Column:
    return F.call_function(kind, x, by)


def _zero() -> Column:
    return F.lit(0).cast("long")


def _in_lanes(hashes: Column) -> Column:
    """Bit b is set if it is set in more than half of up to 127 hashes. Eight lanes of eight bits count at once."""
    ones = F.lit(sum(1 << k for k in range(0, 64, 8)))
    wide, half = F.lit(sum(1 << k for k in range(0, 64, 16))), F.lit(sum(255 << k for k in range(0, 64, 16)))
    # A lane's top bit is set as soon as its count and this reach half the lane's range. Every second lane is
    # looked at, so that nothing runs over.
    extra = (F.lit(127) - F.floor(F.size(hashes) / 2)) * wide
    above = lambda x: F.shiftrightunsigned(x.bitwiseAND(half) + extra, 7).bitwiseAND(wide)

    def with_residue(out: Column, j: Column) -> Column:
        total = F.aggregate(hashes, _zero(), lambda a, h: a + _shift("shiftrightunsigned", h, j).bitwiseAND(ones))
        return out.bitwiseOR(let(total, lambda t: _shift("shiftleft", above(t).bitwiseOR(F.shiftleft(above(F.shiftrightunsigned(t, 8)), 8)), j)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), _zero(), with_residue)


def _bit_by_bit(hashes: Column) -> Column:
    """The same for any number of hashes."""
    def with_bit(out: Column, b: Column) -> Column:
        n = F.aggregate(hashes, _zero(), lambda a, h: a + _shift("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)))
        return out.bitwiseOR(F.when(n * 2 > F.size(hashes), _shift("shiftleft", F.lit(1).cast("long"), b)).otherwise(_zero()))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), _zero(), with_bit)


def simhash(words: Column) -> Column:
    """64-bit SimHash of words with equal weights."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < 128, _in_lanes(h)).otherwise(_bit_by_bit(h)))


def _runs_of(h: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words; fewer words are one run."""
    run = lambda i: F.xxhash64(F.lit(width), *(F.get(h, i + j) for j in range(width)))
    return F.when(F.size(h) < width, F.array(F.xxhash64(F.lit(width), h))).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - width), run))


def _shingles(h: Column, width: int) -> Column:
    """Hashes of runs of ``width`` words, those of long lines only below a part of all hashes that leaves ten to twenty on average."""
    every = _runs_of(h, width)
    halvings = F.floor(F.log2(F.size(h) / F.lit(LEFT))).cast("int")
    top = -_shift("shiftleft", _shift("shiftleft", F.lit(1).cast("long"), halvings - 1) - 1, 64 - halvings)
    return F.when(F.size(h) < 2 * LEFT, every).otherwise(let(top, lambda t: F.filter(every, lambda x: x < t)))


def _ends(words: Column) -> Column:
    """Keys of the first and last characters: an edit leaves those of one end, and lengths that differ by one share a key."""
    def keys(norm: Column) -> Column:
        size = F.floor(F.char_length(norm) * 0.4).cast("int")
        return F.array(*(F.xxhash64(F.lit(end), part) for more in (0, 1) for end, part in (("first", F.substring(norm, F.lit(1), size + more)), ("last", F.substring(norm, -(size + more), size + more)))))

    return let(F.array_join(words, " "), keys)


def line_keys(words: Column) -> Column:
    """Hashes of which lines that are alike share one."""
    none = F.array().cast("array<bigint>")

    def keys(h: Column) -> Column:
        least = (F.slice(F.sort_array(F.array_distinct(_shingles(h, width))), 1, k) for width, _, k in SHINGLES)
        return F.concat(*(x if most is None else F.when(F.size(h) <= most, x).otherwise(none) for x, (_, most, _) in zip(least, SHINGLES, strict=True)))

    shingles = let(F.transform(words, lambda w: F.xxhash64(w)), keys)
    return F.array_distinct(F.when(F.size(words) <= FEW_WORDS, F.concat(shingles, _ends(words))).otherwise(shingles))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, version, place, line, keys) of every line with a letter or digit; ``line`` is the normalised line's hash."""
    lines = _rows(docs).select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    # A generator, other than a projection, is not copied into the filters and columns that use its output.
    made = F.transform(F.array(words_of(F.col("raw"))), lambda w: F.struct(F.size(w).alias("n"), F.xxhash64(w).alias("line"), line_keys(w).alias("keys")))
    return lines.select("doc_id", "version", "place", F.inline(made)).where("n > 0").select("doc_id", "version", "place", "line", "keys")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines in ``wanted`` (line, doc_id, version, place), by going back to their documents: the normalised line,
    its SimHash, its number of words, the length of its longest word, and a text with a character for each word."""
    places = wanted.select("doc_id", "version", F.lit(None).cast("string").alias("text"), F.struct("place", "line").alias("at"))
    found = _rows(docs).select("doc_id", "version", "text", F.lit(None).cast(places.schema["at"].dataType).alias("at")).union(places)
    # Equal rows are one document, so that each line comes once.
    found = found.groupBy("doc_id", "version").agg(F.first("text", ignorenulls=True).alias("text"), F.collect_list("at").alias("at")).where(F.size("at") > 0)  # the places of one document
    found = found.select(F.explode(let(F.split("text", "\n"), lambda lines: F.transform("at", lambda a: F.struct(a["line"].alias("line"), F.get(lines, a["place"]).alias("raw"))))).alias("x"))
    # Symbols from U+0400 on, below the surrogates, by way of UTF-16.
    symbol = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(SYMBOLS)) + 0x400), 4, "0")
    facts = lambda w: F.struct(F.array_join(w, " ").alias("norm"), simhash(w).alias("sim"), F.size(w).alias("words"), F.array_max(F.transform(w, lambda x: F.char_length(x))).alias("widest"), F.decode(F.unhex(F.array_join(F.transform(w, symbol), "")), "UTF-16BE").alias("code"))
    made = F.transform(F.array(words_of(F.col("x.raw"))), facts)
    return found.select("x.line", F.inline(made)).select("line", "norm", "sim", "words", "widest", "code", F.char_length("norm").alias("size"))


def texts_in_parts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same, of a part of the documents at a time: what is sent of one part is gone before the next is sent, so that
    the documents are never all on disk again."""
    wanted = written(wanted, "first")
    parts = min(TEXT_PARTS, 1 + wanted.count() // PART_LINES)
    of = lambda df, k: df.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(parts)) == k) if parts > 1 else df
    return written_in_parts((_texts(of(docs, k), of(wanted, k)) for k in range(parts)), "texts")


def few_edits(longer: Column) -> Column:
    return F.floor(longer * (1 - SIMILAR) + 1e-9).cast("int")


def may_match(a: str, b: str) -> Column:
    """What the lengths and SimHashes (columns with these endings) of two lines allow."""
    words, bits = F.greatest(f"words{a}", f"words{b}"), F.bit_count(F.col(f"sim{a}").bitwiseXOR(F.col(f"sim{b}")))
    most = F.when(words >= FEW_SURE, MAX_BITS).when(words > FEW_WORDS, FEW_BITS).otherwise(64)
    return (F.abs(F.col(f"size{a}") - F.col(f"size{b}")) <= few_edits(F.greatest(f"size{a}", f"size{b}"))) & (bits <= most)


def _both(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines beside the columns that a table has for either."""
    of = lambda name: table.select(*(F.col(c).alias(name if c == "line" else f"{c}_{name}") for c in table.columns))
    return pairs.join(of("a"), "a").join(of("b"), "b")


def verified(pairs: DataFrame, texts: DataFrame, each: int = PART_PAIRS) -> DataFrame:
    """The pairs (a, b) of lines, whose SimHashes are near, whose normalised lines are similar enough.

    Words are edited first, which a character for each word makes short. Lines too many of whose words differ are
    given up; where so few differ that all their characters may, there are few enough edits; others are compared
    by character, in the band of the table that few edits can reach."""
    lev = lambda x, most: F.call_function("levenshtein", F.col(f"{x}_a"), F.col(f"{x}_b"), most)
    words = F.greatest("words_a", "words_b")
    changed = lev("code", F.when(words < FEW_SURE, words).otherwise(F.floor(words * WORD_SHARE).cast("int")))
    pairs = pointed(pairs)
    by_word = _both(_spread(pairs, each), _needed(texts.select("line", "words", "widest", "code", "size"), pairs)).withColumn("changed", changed).where("changed >= 0")
    few = few_edits(F.greatest("size_a", "size_b"))
    by_word = pointed(by_word.select("a", "b", few.alias("few"), (F.col("changed") * (F.greatest("widest_a", "widest_b") + 1) <= few).alias("sure")))
    unsure = by_word.where("not sure").select("a", "b", "few")
    unsure = _both(_spread(unsure, each), _needed(texts.select("line", "norm"), unsure))
    return by_word.where("sure").select("a", "b").union(unsure.where(lev("norm", F.col("few")) >= 0).select("a", "b"))


def _needed(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The table's rows of lines in pairs, where these are few; else all, as the join drops the others anyway."""
    lines = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct()
    return table.join(F.broadcast(lines), "line", "left_semi") if is_small(lines) else table


def _spread(pairs: DataFrame, each: int) -> DataFrame:
    """Pairs in as many partitions as their comparison is worth, whatever few bytes they are."""
    parts = pairs.count() // each
    return pairs.repartition(parts, "a", "b") if parts > 1 else pairs


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, line, hub) of the lines whose keys other lines have too; the hub is the smallest of them."""
    shared = pointed(keyed.groupBy("key").agg(F.min("line").alias("hub"), F.max("line").alias("last")).where("hub != last").select("key", "hub"))
    return written(attached(keyed, shared, "key").distinct(), "keyed")


def hub_pairs(own: DataFrame, sims: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(a, b) of every line and the hubs of its keys, without those that ``labels`` have in one component."""
    pairs = own.where("line != hub").select(F.col("hub").alias("a"), F.col("line").alias("b")).distinct()
    if labels is not None:
        pairs = apart(pairs, labels)
    return _both(pairs, sims).where(may_match("_a", "_b")).select("a", "b")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines that ``labels`` have not in one component."""
    for x in "ab":
        pairs = attached(pairs, labels.select(F.col("line").alias(x), F.col("component").alias(f"of_{x}")), x, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def labels_with(pairs: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Labels after those of the pairs (a, b) that are alike. Copies of one line bring a pair for any two of them: each line
    is compared with its smallest first, and then in the pairs that are still apart."""
    first = pointed(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    labels = joined_labels(labels, pointed(verified(first, texts)))
    rest = apart(pairs.join(first, ["a", "b"], "left_anti"), labels)
    return joined_labels(labels, pointed(verified(rest, texts)))


def marked_keys(own: DataFrame, sims: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of own with what is known of their lines, and (key, n) of the keys whose lines are in several components."""
    marked = attached(own.select("key", "line").join(sims, "line"), labels, "line", "left")
    marked = written(marked.select("key", "line", "words", "size", "sim", F.coalesce("component", "line").alias("component")), "marked")
    open_ = marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo != hi and n > 2")
    return marked, pointed(open_.select("key", "n"))


def open_pairs(marked: DataFrame, open_: DataFrame) -> DataFrame:
    """(a, b) of lines that share an open key of few lines, are in different components and of like lengths. Those of
    the other open keys are left to ``crowded_pairs``."""
    return _like_pairs(attached(marked, open_.where(F.col("n") <= CROWD).select("key"), "key"))


def _like_pairs(rows: DataFrame, by: tuple[str, ...] = ("key",), also: tuple[str, ...] = (), like=None) -> DataFrame:
    """(a, b) of all lines of the same key that are in different components and of like lengths. ``like`` is a further
    condition on the columns ``also``, which pairs that fail it need not be written for."""
    return _meetings(rows, by, also, like).distinct()


def _meetings(rows: DataFrame, by: tuple[str, ...], also: tuple[str, ...], like) -> DataFrame:
    """The same as often as two lines meet."""
    facts = (*FACTS, *also)
    # The longer line is in the band of the shorter one or the next.
    rest = rows if "salt" in by else rows.withColumn("band", _band())
    as_b = [F.col(c).alias(f"{c}_b") for c in facts]
    if "salt" in by:  # the places that ``_dealt`` found
        rest, other = rest.where("has_longer"), rows.where(F.size("to") > 0).select("key", *as_b, F.explode("to").alias("to")).select("key", "to.salt", "to.band", *(f"{c}_b" for c in facts))
    else:
        other = rest.select(*by, *as_b, F.explode(F.array(F.col("band") - 1, F.col("band"))).alias("band"))
    order = F.struct("size", "line") < F.struct("size_b", "line_b")
    pairs = rest.select(*by, "band", *facts).join(other, [*by, "band"]).where(order & (F.col("component") != F.col("component_b")) & may_match("", "_b") & (F.lit(True) if like is None else like))
    return pairs.select(F.least("line", "line_b").alias("a"), F.greatest("line", "line_b").alias("b"))


def _band() -> Column:
    return F.floor(F.log("size") / F.log(F.lit(BAND))).cast("int")


def _dealt(rows: DataFrame, also: tuple[str, ...], like: Column) -> DataFrame:
    """All pairs of a key's lines, however many, by as many tasks as they are worth. A line is only sent to bands of its
    key in which there are lines of other components; if the key has no more lines than a task may hold, all these are in
    one band, so that a line is sent once."""
    bands = rows.select("key", "component", _band().alias("band")).groupBy("key", "band").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    bands = bands.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(F.struct("band", "lo", "hi", F.ceil(F.col("n") / TASK_LINES).cast("int").alias("salts"))).alias("bands"), (F.sum("n") <= TASK_LINES).alias("one"))  # one for each band of lengths
    bands = pointed(bands.where("lo != hi").select("key", "bands", "one"))
    there = lambda x, steps: (x["band"] - _band()).isin(*steps) & ((x["lo"] != F.col("component")) | (x["hi"] != F.col("component")))
    of_band = F.filter("bands", lambda x: x["band"] == _band())[0]["salts"]
    to = F.flatten(F.transform(F.filter("bands", lambda x: there(x, (-1, 0))), lambda x: F.transform(F.sequence(F.lit(0), x["salts"] - 1), lambda k: F.struct(k.alias("salt"), x["band"].alias("band")))))
    # Of a key of few lines everything goes to salt 0 of band 0.
    once = F.slice(F.transform(to, lambda _: F.struct(F.lit(0).alias("salt"), F.lit(0).alias("band"))), 1, 1)
    dealt = attached(rows, bands, "key").withColumns({"salt": F.when(F.col("one"), F.lit(0)).otherwise(F.pmod(F.xxhash64("line", F.lit(3)), of_band).cast("int")), "band": F.when(F.col("one"), F.lit(0)).otherwise(_band()), "has_longer": F.exists("bands", lambda x: there(x, (0, 1))), "to": F.when(F.col("one"), once).otherwise(to)}).drop("bands", "one")
    return _like_pairs(dealt, ("key", "salt"), also, like)


def _parities(symbols: Column) -> list[Column]:
    """LANES numbers, of whose bits each is set if an odd number of symbols fall on it."""
    at = F.transform(symbols, lambda s: F.pmod(F.xxhash64(s, F.lit(5)), F.lit(64 * LANES)).cast("int"))
    bit = lambda x, lane: F.when(F.floor(x / 64) == lane, _shift("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)))).otherwise(_zero())
    of_lane = lambda lane: let(at, lambda xs: F.aggregate(xs, _zero(), lambda a, x: a.bitwiseXOR(bit(x, lane))))
    return [of_lane(lane) for lane in range(LANES)]


def few_words_differ() -> Column:
    """What the parities of two lines' words allow, if one has FEW_SURE words: a replaced word changes two bits at most,
    another edit one."""
    bits = sum((F.bit_count(F.col(f"parity{k}").bitwiseXOR(F.col(f"parity{k}_b"))) for k in range(LANES)), F.lit(0))
    words = F.greatest("words", "words_b")
    return (words >= FEW_SURE) & (bits <= 2 * F.floor(words * WORD_SHARE) - F.abs(F.col("words") - F.col("words_b")))


def lasting(words: Column, ordered: Column) -> Column:
    """How many of a line's pairs of neighbouring words in ``ordered`` (with their places ``at``) make, with all its pairs
    that are not there, a set of which a line like it has one.

    Like lines differ in k edits, up to WORD_SHARE of the longer one's words. One edit changes two pairs of a line only if
    they stand side by side; of a set with m such twos at most, none in two of them, k edits change k + min(k, m). If the
    other line has d words more, k is WORD_SHARE of these too, but d edits only add a word and change one pair: min(k - d, m)
    stands for min(k, m). Whatever d is, that is no more than the first number below (as k is at most a share of the words
    without rounding, where k - d = m), nor than the second."""
    there = F.transform(ordered, lambda x, i: F.struct(x["at"].alias("at"), (i + 1).alias("rank")))
    others = F.transform(F.array_except(F.sequence(F.lit(0), words - 2), F.transform(ordered, lambda x: x["at"])), lambda at: F.struct(at.alias("at"), F.lit(0).alias("rank")))
    ranks = F.transform(F.sort_array(F.concat(there, others)), lambda x: x["rank"])

    def lasts(of: Column, n: Column) -> Column:
        # The lowest bit says that the pair before is in the set and in no two; the others count twos.
        twos = F.shiftright(F.aggregate(of, F.lit(0), lambda v, r: F.when(r <= n, v + 1).otherwise(v.bitwiseAND(F.lit(-2)))), 1)
        changed = F.least((WORD_SHARE * words + (1 - 2 * WORD_SHARE) * twos) / (1 - WORD_SHARE), 2 * F.floor((words + 1) * WORD_SHARE))
        return words - 1 - F.size(ordered) + n > changed

    def halved(of: Column, x: Column) -> Column:
        middle = F.shiftright(x["lo"] + x["hi"], 1)
        lower, upper = F.struct(x["lo"].alias("lo"), middle.alias("hi")), F.struct(F.least(middle + 1, x["hi"]).alias("lo"), x["hi"].alias("hi"))
        return F.when(lasts(of, middle), lower).otherwise(upper)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ordered) + F.lit(1))).cast("int"))
    return let(ranks, lambda of: F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi")), lambda x, _: halved(of, x))["lo"])


def met_before() -> Column:
    """Whether two lines share one of the keys just before this one. Keys come in the same order for all lines, so that
    two lines have none before the first that they share."""
    return F.arrays_overlap("earlier", "earlier_b")


def crowded(marked: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows of the open keys of many lines."""
    return written(attached(marked, open_.where(F.col("n") > CROWD).select("key"), "key").select("key", *FACTS), "crowded")


def crowded_pairs(rows: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of all lines that share a key of many lines, are still in different components, and may be alike.

    Of lines of less than FEW_SURE words these are all pairs of a key, whose characters are compared where they meet.
    Of a longer line and one like it, up to k = WORD_SHARE of the longer one's words are edited, and each edit changes
    two pairs of neighbouring words at most, which stand side by side. So each line has one of the other's pairs among
    those of its own that so many edits cannot all change (``lasting``), in any order that is the same for all lines; the
    rarest come first. Like lines share many of these, and are written for the first alone. A pair of words whose lines
    are all in one component brings no candidate; in the order such pairs come before all others, so that each takes a
    place of its lines without being looked at."""
    now = attached(rows.drop("component"), labels, "line", "left").withColumn("component", F.coalesce("component", "line"))
    now = written(now.select("key", *FACTS).dropDuplicates(["key", "line"]), "now")
    still = pointed(now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key"))
    now = written(attached(now, still, "key"), "still")
    few = now.where(F.col("words") < FEW_SURE).select("key", *FACTS)
    norms = pointed(attached(texts.where(F.col("words") < FEW_SURE).select("line", "norm"), pointed(few.select("line").distinct()), "line"))
    near = F.call_function("levenshtein", F.col("norm"), F.col("norm_b"), few_edits(F.greatest("size", "size_b"))) >= 0
    short = _dealt(attached(few, norms, "line"), ("norm",), near)
    least = int(FEW_SURE * (1 - WORD_SHARE))  # words of a line that is like one of FEW_SURE
    lines = pointed(now.where(F.col("words") >= least).select(*FACTS).distinct())
    codes = attached(texts.where(F.col("words") >= least).select("line", "code"), pointed(lines.select("line", "component")), "line")
    # A generator's column of symbols is not made again for each that uses it.
    codes = written(codes.select("line", "component", F.explode(F.array(F.filter(F.split("code", ""), lambda x: x != ""))).alias("symbols")), "symbols")
    pairs = F.transform(F.sequence(F.lit(0), F.size("symbols") - 2), lambda i: F.xxhash64(F.get("symbols", i), F.get("symbols", i + 1)))
    held = codes.select("line", "component", F.posexplode(pairs).alias("at", "key"))
    often = pointed(held.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key", "n"))
    # A pair that no line of another component has brings no candidate, but takes a place; only the others are looked at.
    ordered = attached(held.select("line", "at", "key"), often, "key").groupBy("line").agg(F.sort_array(F.collect_list(F.struct("n", "key", "at"))).alias("all"))  # the pairs of one line
    ordered = ordered.join(lines.select("line", "words"), "line")
    first = F.slice("all", F.lit(1), lasting(F.col("words"), F.col("all")))
    # A generator again, so that the search is not made again for the filter.
    first = pointed(ordered.select("line", F.explode(F.array(F.array_distinct(first["key"]))).alias("keys")).where(F.size("keys") > 0))
    marks = pointed(attached(codes, pointed(first.select("line")), "line").select("line", *(p.alias(f"parity{k}") for k, p in enumerate(_parities(F.col("symbols"))))))
    released(rows.sparkSession, codes)
    also = tuple(f"parity{k}" for k in range(LANES))
    before = lambda i: F.slice("keys", F.greatest(i - EARLIER, F.lit(0)) + 1, F.least(i, F.lit(EARLIER)))
    places = F.transform("keys", lambda key, i: F.struct(key.alias("key"), before(i).alias("earlier")))
    found = attached(first, pointed(marks.join(lines, "line")), "line").select(*FACTS, *also, F.inline(places))
    found = written(found, "places")
    long = _dealt(found, (*also, "earlier"), few_words_differ() & ~met_before())
    out = pointed(short.union(long).distinct())
    released(rows.sparkSession, now, found)
    return out


def rare_keys(marked: DataFrame, open_: DataFrame, texts: DataFrame) -> DataFrame:
    """(line, key) of lines that share an open key of many lines: the smallest of their shingles that few of these
    lines hold; the others come after, where a line has less than its number of those."""
    width, _, most = SHINGLES[0]
    crowded = pointed(attached(marked, open_.where(F.col("n") > CROWD).select("key"), "key").select("line").distinct())
    every = F.array_distinct(let(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)), lambda h: _runs_of(h, width)))
    held = attached(texts.select("line", "norm"), crowded, "line").select("line", F.explode(every).alias("key"))
    held = written(held, "shingles")
    often = pointed(held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key", F.lit(True).alias("often")))
    ordered = attached(held, often, "key", "left").groupBy("line").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(False)).alias("often"), "key"))), 1, most).alias("least"))  # the shingles of one line
    out = pointed(ordered.select("line", F.explode("least.key").alias("key")))
    released(marked.sparkSession, held)
    return out


def line_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, place, line, keys) of all lines, and (line, component) of those that links join with others; the
    component is the smallest line that links reach."""
    spark = docs.sparkSession
    found = written(occurrences(docs), "occurrences")
    own = shared_keys(found.select("line", F.explode("keys").alias("key")))
    released(spark)
    wanted = pointed(own.select("line").distinct())
    first = attached(found, wanted, "line").groupBy("line").agg(F.min(F.struct("doc_id", "place", "version")).alias("first"))
    texts = texts_in_parts(docs, first.select("line", "first.*"))
    sims = written(texts.select("line", "words", "size", "sim"), "sims")
    released(spark, wanted)
    links = pointed(verified(hub_pairs(own, sims), texts))
    labels = component_labels(links, name="line")

    # Lines that share a key and are still apart.
    marked, open_ = marked_keys(own, sims, labels)
    pairs = open_pairs(marked, open_)
    crowds = [crowded(marked, open_)]
    released(spark, own)
    own = shared_keys(rare_keys(marked, open_, texts))
    labels = joined_labels(labels, pointed(verified(pairs.union(hub_pairs(own, sims, labels)).distinct(), texts)))
    released(spark, marked)
    marked, open_ = marked_keys(own, sims, labels)
    labels = joined_labels(labels, pointed(verified(open_pairs(marked, open_), texts)))
    # What is still apart in keys of many lines, of either round.
    crowds.append(crowded(marked, open_))
    rows = crowds[0].union(crowds[1])
    if not rows.isEmpty():
        labels = labels_with(crowded_pairs(rows, labels, texts), labels, texts)
    released(spark, marked, own, texts, sims, *crowds)
    return found, labels


def cuts(docs: DataFrame) -> DataFrame:
    """(doc_id, version, places): which lines of a document go."""
    every, labels = line_groups(docs)
    found = every.drop("keys")
    lines = attached(found, labels, "line", "left").select("doc_id", "version", "place", F.coalesce("component", "line").alias("component"))
    kept = lines.groupBy("component").agg(F.min(F.struct("doc_id", "place", "version")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("component", "kept")
    gone = lines.join(kept, "component").where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("place") == F.col("kept.place")) & (F.col("version") == F.col("kept.version"))))
    out = pointed(gone.groupBy("doc_id", "version").agg(F.array_distinct(F.collect_list("place")).alias("places")))
    # Nothing else is left on disk when the documents are sent.
    released(docs.sparkSession, every)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that are kept elsewhere."""
    # The documents go into one column, so that none of their names can clash.
    rows = docs.select(F.struct("*").alias("d"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("version"))
    c = cuts(docs).withColumnsRenamed({"doc_id": "of", "version": "of_version"})
    rows = attached(rows, c, rows["doc_id"].eqNullSafe(F.col("of")) & (rows["version"] == F.col("of_version")), "left")
    return rows.select(*(_without(F.col("d.text"), F.col("places")).alias("text") if name == "text" else F.col("d")[name].alias(name) for name in docs.columns))


def _without(text: Column, places: Column) -> Column:
    left = let(F.split(text, "\n"), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), lambda i: F.get(lines, i)), "\n"))
    return F.when(places.isNull(), text).otherwise(left)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, its lines before and after, and the SHA-256 of what is left of its text."""
    lines = F.coalesce(F.when(F.col("text") != "", F.size(F.split("text", "\n"))), F.lit(0)).cast("long")
    out = dedup_lines(docs.select("doc_id", "text", lines.alias("n_lines")))
    return out.select("doc_id", "n_lines", lines.alias("n_kept"), F.sha2("text", 256).alias("kept_sha256"))
