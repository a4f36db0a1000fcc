"""Document fingerprints: every shingle hash below a fixed fraction of all hashes.

A sketch keeps the 64-bit hashes of a text's distinct 5-word shingles that lie in the lowest quarter of
all values, so that sketches of texts of any size can be merged by union and give unbiased containment
and likeness. A text none of whose hashes lies there keeps its smallest, lest short texts be alike for
want of hashes; likeness of texts of few shingles is coarse (README states the error).

Defined results: a null text is empty; a text without words has an empty fingerprint, and two of those
have likeness 1. Fewer words than five make one shingle. The next document is the one of the next
smaller doc_id, after the smallest the largest; rows that share a doc_id follow one another in the
order of a hash of their texts. A null doc_id comes before all others. A text of any length is read
whole. An empty table has an empty result, and a single document is its own next. Extra columns are
ignored, whatever their names. Documents are dealt out by ranges of doc_id that hold about as many each;
rows of one doc_id stay in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import attached
from .scratch import pointed

N = 5
FRACTION = 4
#: Documents that one range of doc_ids holds on average, up to a number of ranges; ranges are what a task sorts.
RANGE_ROWS, MOST_BITS = 1024, 16


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(text: Column, n: int = N) -> Column:
    """Hashes of the n-word shingles of a text, repeats included."""
    return let(
        word_hashes(text),
        lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n)))))
        .when(F.size(h) > 0, F.array(F.xxhash64(h)))
        .otherwise(F.array().cast("array<bigint>")),
    )


def sketch(text: Column, n: int = N, fraction: int = FRACTION) -> Column:
    top = -(1 << 63) + (1 << 64) // fraction
    low = lambda s: F.sort_array(F.array_distinct(F.filter(s, lambda x: x < F.lit(top))))
    return let(shingle_hashes(text, n), lambda s: let(low(s), lambda k: F.when((F.size(k) == 0) & (F.size(s) > 0), F.array(F.array_min(s))).otherwise(k)))


def likeness(a: Column, b: Column) -> Column:
    """The share of hashes in both among those in either."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Of the hashes of a, the share that b has too; 1 if a has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles taken together."""
    return F.sort_array(F.array_union(a, b))


def written_out(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lower(F.hex(x))), " ")


def in_ranges(docs: DataFrame) -> DataFrame:
    """The rows with ``range``: how many quantiles of doc_id lie at or below theirs, -1 for null."""
    n = docs.agg(F.count("doc_id").alias("n")).first()["n"]
    bits = min(MOST_BITS, max(0, (n // RANGE_ROWS).bit_length()))
    if not bits:
        return docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(0))
    parts = [F.lit(k / (1 << bits)) for k in range(1, 1 << bits)]
    # One row of at most 2**MOST_BITS numbers, looked up by halving.
    bounds = pointed(docs.agg(F.percentile_approx("doc_id", F.array(*parts), max(10_000, 4 << bits)).alias("bounds")))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(bits))))
    at = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get("bounds", lo + step - 1) <= F.col("doc_id"), lo + step).otherwise(lo))
    return docs.join(F.broadcast(bounds)).withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at)).drop("bounds")


def with_next(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, sketch) with ``next_text`` and ``next_sketch``. Ranges of doc_ids are sorted apart;
    each also gets the document that ends the range before it."""
    docs = in_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    ends = pointed(docs.groupBy("range").agg(F.max("doc_id").alias("end")))
    ordered, every = Window.orderBy("range"), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The first range is preceded by the last one; a row for each range, at most 2**MOST_BITS, is ordered here.
    ends = pointed(ends.select(F.col("range").alias("to"), F.coalesce(F.lag("range").over(ordered), F.last("range").over(every)).alias("from"), F.when(F.row_number().over(ordered) == 1, F.last("end").over(every)).otherwise(F.lag("end").over(ordered)).alias("end")))
    last = attached(docs, ends, (docs["doc_id"].eqNullSafe(ends["end"])) & (docs["range"] == ends["from"])).groupBy("to").agg(F.max_by(F.struct("doc_id", "text"), F.xxhash64("text")).alias("d"))
    both = docs.select("range", "doc_id", "text", F.lit(1).alias("own")).unionByName(last.select(F.col("to").alias("range"), "d.doc_id", "d.text", F.lit(0).alias("own")))
    # Sketches are made where the rows are sorted, so that they aren't sent.
    both = both.repartition("range").withColumn("sketch", sketch(F.col("text"))).withColumn("tie", F.xxhash64("text"))
    w = Window.partitionBy("range").orderBy("own", "doc_id", "tie")
    return both.withColumn("next_text", F.lag("text").over(w)).withColumn("next_sketch", F.lag("sketch").over(w)).where("own = 1").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut)))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written_out(F.col("sketch")).alias("fingerprint"), written_out(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
