"""Mixing sources to target weights by entropy balancing.

Of all document rates that give every source its target of words, those of least relative entropy tilt
each document exponentially by its size: rate = exp(lambda * size / mean size), here at most 3. The
dual is convex with one multiplier for each source. Newton steps for all sources run together as one
aggregation over the histogram of sizes, inside brackets that every round cuts in sixteen, until the
targets are met. Rates are
then rounded into copies: a document gets one more copy if its fraction exceeds a hash of its doc_id
by more than a threshold of its source, which a radix search over the whole input sets so that the
words taken come near the target. Then, as long as that brings a source nearer, the one document that
does so best gets a copy more or less.

Sums of the Newton steps are decimals, so that runs agree whatever the order of the rows.

Defined results: a null text has size 0 and is taken once, at no words. A null source is a source,
ordered last. Repeated rows count each and get the same copies. An empty table stays empty. A null
doc_id is hashed as such. Documents that deserve a further copy alike, to the last of 30 bits, are taken or
left together; of documents that change a source's sum alike, the one with the smallest hash of its doc_id
is changed, and rows that share its doc_id with it. Texts of any length are counted whole. Extra columns
are ignored or, in ``mixed_documents``, carried along whatever their names. The table of sources, not of
documents, is ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import attached
from .scratch import pointed

MOST = 3  # times its own size that a source or a document is taken at most
WEIGHTS = 3  # weights 1, 2, 3, repeating
ROUNDS = 100
CUTS = 16  # parts of a bracket that a round looks at
EXACT = 1e-6
NEAR = 1e-4  # part of its target by which a source may be off before single documents are changed
DIGIT_BITS, DIGITS = 10, 3
WORDS = r"[^\x20\x09-\x0D]+"


def few(sources: DataFrame) -> DataFrame:
    """A table of a row for each source, written by one task."""
    return pointed(sources.coalesce(1))


def size_of(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def beside(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns that a table of few sources has for their source, null included."""
    t = table.select(F.col("source").alias("of source"), *(c for c in table.columns if c != "source" and c not in rows.columns))
    return attached(rows, t, F.col("source").eqNullSafe(F.col("of source")), how).drop("of source")


def targets(histogram: DataFrame) -> DataFrame:
    """(source, source_size, mean, least, target): shares by weight, filled up to the caps like vessels of water."""
    words = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    s = words.withColumn("w", ((F.row_number().over(named) - 1) % WEIGHTS + 1).cast("double")).withColumn("cap", MOST * F.col("source_size").cast("double"))
    # Sources reach their caps in the order of cap / weight; each sees the level at which the rest would stand.
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # The first that isn't filled sees the final level.
    s = s.withColumn("at", F.first(F.when(F.col("cap") / F.col("w") > F.col("level"), F.col("level")), ignorenulls=True).over(every))
    target = F.coalesce(F.least("cap", F.col("at") * F.col("w")), F.col("cap"))
    return s.select("source", "source_size", (F.col("source_size") / F.col("docs")).alias("mean"), F.col("least").cast("double").alias("least"), target.alias("target"))


def rate(size: Column, lam: Column, mean: Column) -> Column:
    """exp(lam * size / mean), at most MOST; 1 where there is nothing to tilt."""
    power = lam * size / mean
    return F.when((size == 0) | (mean == 0), F.lit(1.0)).when(power >= math.log(MOST), F.lit(float(MOST))).otherwise(F.exp(power))


def multipliers(histogram: DataFrame, aims: DataFrame) -> DataFrame:
    """The multiplier of each source, by Newton steps inside a bracket that every step narrows."""
    z = F.col("least") / F.col("mean")
    ratio = F.col("target") / F.col("source_size")
    some = (F.col("source_size") > 0) & (F.col("target") > 0)
    lo = F.when(some & (ratio < 1), F.ln(ratio) / z).otherwise(F.lit(0.0))
    hi = F.when(some & (ratio > 1), F.lit(math.log(MOST)) / z).otherwise(F.lit(0.0))
    state = aims.withColumn("lo", lo).withColumn("hi", hi)
    whole = ratio >= MOST * (1 - EXACT / 10)  # every document at its cap
    start = F.when(~some | (ratio == 1), F.lit(0.0)).when(whole, F.col("hi")).otherwise(F.greatest("lo", F.least("hi", F.ln(ratio))))
    state = few(state.withColumn("lam", start).withColumn("open", some & (ratio != 1) & ~whole))
    for _ in range(ROUNDS):
        if state.where("open").isEmpty():
            break
        words = lambda lam: F.sum((F.col("n") * F.col("size") * rate(F.col("size"), lam, F.col("mean"))).cast("decimal(30,8)")).cast("double")
        inner = [F.col("lo") + (F.col("hi") - F.col("lo")) * (k / CUTS) for k in range(1, CUTS)]
        r = rate(F.col("size"), F.col("lam"), F.col("mean"))
        slope = F.when(r < MOST, F.col("n") * F.col("size") * F.col("size") / F.col("mean") * r).otherwise(F.lit(0.0)).cast("decimal(34,6)")
        tilted = beside(histogram, state.where("open")).groupBy("source").agg(words(F.col("lam")).alias("f"), F.sum(slope).cast("double").alias("g"), *(words(x).alias(f"f{k}") for k, x in enumerate(inner)))
        s = beside(state, tilted, "left")
        points = [(F.col("lam"), F.col("f")), *((x, F.col(f"f{k}")) for k, x in enumerate(inner))]
        lo = F.greatest("lo", *(F.when(f < F.col("target"), x) for x, f in points))
        hi = F.least("hi", *(F.when(f > F.col("target"), x) for x, f in points))
        s = s.withColumns({"new_lo": lo, "new_hi": hi, "off": F.col("f") - F.col("target")})
        newton = F.when(F.col("g") > 0, F.col("lam") - F.col("off") / F.col("g"))
        inside = F.when((newton > F.col("new_lo")) & (newton < F.col("new_hi")), newton).otherwise((F.col("new_lo") + F.col("new_hi")) / 2)
        done = ~F.col("open") | (F.abs("off") <= F.col("target") * EXACT) | (F.col("new_hi") - F.col("new_lo") <= F.abs("lam") * 1e-12)
        state = few(s.select("source", "source_size", "mean", "least", "target", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), F.when(done, F.col("lam")).otherwise(inside).alias("lam"), (~done).alias("open")))
    else:
        raise ArithmeticError("the multipliers of some source have not converged")
    return state.select("source", "source_size", "mean", "target", "lam")


def _sorter(doc_id: Column, fraction: Column) -> Column:
    """How well a document deserves one more copy, as a number of DIGITS * DIGIT_BITS bits."""
    u = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(7)), 11) / F.lit(float(1 << 53))
    top = (1 << DIGITS * DIGIT_BITS) - 1
    return F.least(F.lit(top), F.floor((fraction - u + 1) / 2 * (top + 1))).cast("long")


def thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with ``least_key``: documents at or above it get one more copy."""
    rows = beside(sized, sources).select("source", "size", "target", rate(F.col("size"), F.col("lam"), F.col("mean")).alias("rate"), "doc_id")
    floor = F.floor("rate")
    rows = rows.where("size > 0").withColumn("key", _sorter(F.col("doc_id"), F.col("rate") - floor)).withColumn("whole", floor)
    sums = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("given"))
    state = beside(sources, sums, "left").select("source", "target", (F.col("target") - F.coalesce("given", F.lit(0))).alias("need"), F.lit(0).cast("long").alias("prefix"))
    state = few(state)
    rows = rows.where(F.col("whole") < MOST).select("source", "key", "size")
    for digit in range(DIGITS):
        low = (DIGITS - 1 - digit) * DIGIT_BITS
        own = beside(rows, state).where(F.shiftright("key", low + DIGIT_BITS) == F.col("prefix"))
        bins = own.groupBy("source", "need", "prefix", F.shiftright("key", low).alias("at")).agg(F.sum("size").alias("words"))
        above = Window.partitionBy("source").orderBy(F.col("at").desc())
        through = F.sum("words").over(above)
        last = digit == DIGITS - 1
        # The bin in which the need is met; the last digit's is taken whole if that comes nearer.
        reach = F.when(through - F.col("words") / 2 <= F.col("need"), F.col("at")) if last else F.when(through - F.col("words") <= F.col("need"), F.col("at"))
        found = bins.withColumn("through", through).withColumn("reach", reach).groupBy("source").agg(F.min("reach").alias("reach"), F.max("at").alias("top"), F.max(F.when(F.col("reach").isNotNull(), F.col("through") - F.col("words"))).alias("before"))
        joined = beside(state, found, "left")
        if last:
            nothing = (F.col("prefix") + 1) * (1 << DIGIT_BITS)
            state = joined.select("source", F.coalesce("reach", nothing).alias("least_key"))
        else:
            none = (F.col("prefix") + 1) * (1 << DIGIT_BITS) - 1
            state = few(joined.select("source", "target", (F.col("need") - F.coalesce("before", F.lit(0))).alias("need"), F.coalesce("reach", none).alias("prefix")))
    return few(beside(sources, state, "left").select("source", "source_size", "mean", "target", "lam", "least_key"))


def flipped(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with ``plus`` and ``minus``: single documents that get a copy more or less, as their size is what
    their source still lacks or has too much."""
    none = F.array().cast("array<bigint>")
    sources = few(sources.withColumn("plus", none).withColumn("minus", none))
    while True:  # each round brings a source nearer, by the document that brings it nearest
        rows = beside(sized, sources).withColumn("c", copies(F.col("doc_id"), F.col("size")))
        lack = few(rows.groupBy("source", "target").agg(F.sum(F.col("c") * F.col("size")).alias("taken")).select("source", "target", (F.col("target") - F.col("taken")).alias("lack")))
        rows = beside(rows, lack.where(F.abs("lack") > F.col("target") * NEAR)).where(~F.array_contains("plus", F.col("doc_id")) & ~F.array_contains("minus", F.col("doc_id")))
        can = F.col("doc_id").isNotNull() & ((F.col("lack") > 0) & (F.col("c") < MOST) | (F.col("lack") < 0) & (F.col("c") > 0))
        off = F.abs(F.abs("lack") - F.col("size"))
        best = rows.where(can & (off < F.abs("lack"))).groupBy("source", "lack").agg(F.min(F.struct(off.alias("off"), F.xxhash64("doc_id").alias("r"), "doc_id")).alias("b"))
        best = few(best)
        if best.isEmpty():
            return sources
        s = beside(sources, best.select("source", "lack", F.col("b.doc_id").alias("doc")), "left")
        one = F.array("doc")
        s = s.withColumn("plus", F.when(F.col("lack") > 0, F.concat("plus", one)).otherwise(F.col("plus"))).withColumn("minus", F.when(F.col("lack") < 0, F.concat("minus", one)).otherwise(F.col("minus")))
        sources = few(s.select(*sources.columns))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size) of every document, and the table of sources."""
    sized = pointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of().alias("size")))
    histogram = pointed(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = multipliers(histogram, targets(histogram))
    return sized, flipped(sized, thresholds(sized, sources))


def copies(doc_id: Column, size: Column) -> Column:
    """Copies of a document beside the columns of its source."""
    r = rate(size, F.col("lam"), F.col("mean"))
    more = (size > 0) & (F.floor(r) < MOST) & (_sorter(doc_id, r - F.floor(r)) >= F.col("least_key"))
    flips = F.coalesce(F.array_contains("plus", doc_id), F.lit(False)).cast("long") - F.coalesce(F.array_contains("minus", doc_id), F.lit(False)).cast("long")
    return F.floor(r) + F.coalesce(more, F.lit(False)).cast("long") + flips


def mix(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document."""
    sized, sources = plan(docs)
    return beside(sized, sources).select("doc_id", "size", "source_size", "target", (copies(F.col("doc_id"), F.col("size")) * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it, with their columns as they were."""
    _, sources = plan(docs)
    own = docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("doc_id"), "source", size_of().alias("size"))
    times = copies(F.col("doc_id"), F.col("size")).cast("int")
    return beside(own, sources).withColumn("copy", F.explode(F.array_repeat(F.lit(True), times))).select("d.*")
