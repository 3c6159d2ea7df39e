"""One-permutation MinHash fingerprints from SQL functions only.

Each shingle of five words is hashed once; the top bits of the hash name its bin and every bin keeps its
least hash. Sorting a text's hashes puts bins next to each other, least first, so the bins need no
shuffle. An empty bin takes the value of the first full bin in a probe order of its own that is the same
for all texts (optimal densification). A fingerprint holds the low BITS of each bin in hex; likeness
takes off the matches that chance alone gives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.shared import partitions

#: Bins of a fingerprint (a power of two), bits kept of each, words of a shingle, probes that are written out
#: (the others are worked out only where these find empty bins).
BINS, BITS, WORDS, PROBES = 128, 8, 5, 12
#: Bytes of text of a range of ids, and the most quantiles that cut the ids.
RANGE_BYTES, COARSE = 1 << 25, 500
SEPARATORS = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column) -> Column:
    """Sorted hashes of a text's shingles of WORDS lower-cased words; fewer words make one shingle, none make none."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, SEPARATORS), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        parts = lambda i: [F.get(h, i + j) for j in range(WORDS)]
        many = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*parts(i)))
        return F.when(n >= WORDS, many).when(n > 0, F.array(F.xxhash64(*parts(F.lit(0)), n))).otherwise(F.array().cast("array<long>"))

    return F.sort_array(_let(hashed, shingles))


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - int(math.log2(BINS))).cast("int")


def _minima(hashes: Column) -> Column:
    """The least hash of each full bin, of sorted hashes."""
    return _let(hashes, lambda a: F.filter(a, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(a, i - 1)))))


def _rule(bin_: int, salt: int) -> int:
    """A number that depends on the bin only: the same in every run and for every text."""
    x = (bin_ * 2 + salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return x >> 40


#: An empty bin looks at START, START + STEP, ... modulo BINS; steps are odd, so that it visits all bins.
START = [_rule(b, 0) % BINS for b in range(BINS)]
STEP = [_rule(b, 1) % (BINS // 2) * 2 + 1 for b in range(BINS)]


def _table(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def fingerprint(text: Column) -> Column:
    """Hex of BINS values of BITS bits; the empty string for texts without words."""
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    near = [_table([(START[b] + STEP[b] * k) % BINS for b in range(BINS)]) for k in range(PROBES)]

    def packed(minima: Column) -> Column:
        by_bin = _let(F.map_from_arrays(F.transform(minima, _bin), minima), lambda full: F.transform(bins, lambda b: F.try_element_at(full, b)))
        return _let(by_bin, lambda v: F.lower(F.array_join(F.transform(bins, lambda b: low_bits(v, b)), "")))

    def low_bits(v: Column, b: Column) -> Column:
        first = [F.get(v, F.get(t, b)) for t in near]
        far = F.transform(F.sequence(F.lit(PROBES), F.lit(BINS - 1)), lambda k: F.get(v, F.pmod(F.get(_table(START), b) + F.get(_table(STEP), b) * k, F.lit(BINS))))
        value = F.coalesce(F.get(v, b), *first, F.get(F.filter(far, lambda x: x.isNotNull()), F.lit(0)))
        return F.lpad(F.hex(value.bitwiseAND((1 << BITS) - 1)), BITS // 4, "0")

    return _let(_minima(shingle_hashes(text)), lambda m: F.when(F.size(m) > 0, packed(m)).otherwise(F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two fingerprints, 0 to 1: bins that agree, less those that agree by chance.

    Two texts without words are alike (1); such a text and any other are not (0).
    """
    width = BITS // 4
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        F.lit(0),
        lambda n, k: n + (F.substr(a, k * width + 1, F.lit(width)) == F.substr(b, k * width + 1, F.lit(width))).cast("int"),
    )
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), (same / float(BINS) - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(estimate)


def range_of(docs: DataFrame) -> Column:
    """The number of a row's range: null doc_ids first, then ranges of descending doc_ids with about RANGE_BYTES of text each.

    At most COARSE quantiles cut the ids into parts of about equal numbers of rows, and each part is cut
    evenly, so the number of ranges follows the bytes of the table and the expression stays short.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    wanted = max(partitions(docs.sparkSession), size["bytes"] // RANGE_BYTES)
    if size["lo"] is None:
        return F.lit(0).cast("long")
    coarse = min(COARSE, wanted)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / coarse for k in range(1, coarse)], 10_000).alias("cuts")).first()["cuts"] if coarse > 1 else []
    # Part k holds the ids from starts[k] to below starts[k + 1].
    starts = sorted({size["lo"], *cuts})
    inside = -(-wanted // len(starts))
    width = [max(1, -(-(b - a) // inside)) for a, b in zip(starts, [*starts[1:], size["hi"] + 1])]
    part = F.size(F.filter(_table(starts), lambda s: s <= F.col("doc_id"))) - 1
    within = F.floor((F.col("doc_id") - F.get(_table(starts), part)) / F.get(_table(width), part))
    place = (part * inside + within).cast("long")
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, n_chars) with fingerprint, next_text and next_fingerprint, by descending doc_id.

    Equal doc_ids follow by text, null doc_ids come last; the last row is followed by the first. Ids are cut
    into ranges, and a window orders each; it also gets the first row of the range that comes next, found by
    its id. Texts are shuffled once; rows that share one doc_id are ordered in one task, which spills.
    """
    spark = docs.sparkSession
    placed = docs.withColumn("range", range_of(docs))
    # One id a range: the bounds of the ranges, which the driver puts in order.
    ids = {r["range"]: r["first_id"] for r in placed.groupBy("range").agg(F.max("doc_id").alias("first_id")).collect()}
    order = sorted(ids, reverse=True)
    firsts = spark.createDataFrame([(ids[b], a) for a, b in zip(order, order[1:] + order[:1])], "first_id long, to long")
    # Two longs a range are broadcast, 50 MB for 100 TB of text.
    guests = docs.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("to").agg(F.max("text").alias("text"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("n_chars"), F.col("to").alias("range"), F.lit(True).alias("guest"))
    both = placed.withColumn("guest", F.lit(False)).unionByName(guests).withColumn("fingerprint", fingerprint(F.col("text")))
    w = Window.partitionBy("range").orderBy("guest", F.desc("doc_id"), F.desc("text"))
    own = both.withColumn("following", F.lead(F.struct("text", "fingerprint")).over(w)).where(~F.col("guest"))
    return own.select(*docs.columns, "fingerprint", F.col("following.text").alias("next_text"), F.col("following.fingerprint").alias("next_fingerprint"))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs(doc_id, text) and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 3) code points replaced by as many (or all) first ones of
    the next document, in order of descending doc_id. A null text is empty; repeated rows give repeated
    rows and follow each other; null doc_ids come last; other columns are ignored; an empty table gives no
    rows. A single row is its own next document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third)
    edited = with_next(rows).withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), third)))
    prints = edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
