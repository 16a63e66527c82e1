"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each distinct shingle is hashed once. The top bits of a hash name one of BINS bins,
whose smallest hash is kept. A bin that stays empty takes the value of a bin that is
not, found by its own sequence of hashed probes (optimal densification), so equal
sets fill it alike. The low BITS bits of every bin are stored as two hex digits.
Two random values agree in BITS bits with probability 2**-BITS; the likeness of two
fingerprints takes that out of the share of equal bins.

Shingles are runs of five words; 1 to 4 words form one. Words are runs of characters
other than 0x20 and 0x09-0x0D, A-Z lower-cased.

Defined cases: null text counts as empty; a text without words has the empty string
as its fingerprint, which is like another empty one by 1 and like any other by 0; in
a table of one row the next document is the row itself; rows with equal doc_id follow
each other by text; a null doc_id comes first; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a fingerprint (a power of two) and the bits stored of each.
BINS, BITS = 128, 8
#: Probes into other bins before all filled ones are ranked.
PROBES = 6
#: Documents in one range of doc_id, unless that made more than RANGES of them.
RANGE_ROWS, RANGES = 1500, 20_000

_SHIFT = 64 - BINS.bit_length() + 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds column out: array of BINS stored values, empty for a text without words.

    Every step is a column of its own that the next refers to more than once, so it
    is computed once a row.
    """
    df = df.withColumn("_text", F.btrim(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(" \t\n\x0b\f\r")))
    df = df.withColumn("_words", F.when(F.col("_text") == "", F.array().cast("array<string>")).otherwise(F.split("_text", "[\\x20\\x09-\\x0D]+")))
    df = df.withColumn("_hashed", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_hashed")
    at = lambda i: F.get(F.col("_hashed"), i)
    runs = F.transform(F.slice(F.col("_hashed"), F.lit(1), F.greatest(n - 4, F.lit(0))), lambda h, i: F.xxhash64(h, at(i + 1), at(i + 2), at(i + 3), at(i + 4)))
    df = df.withColumn("_sorted", F.sort_array(F.when(n == 0, F.array().cast("array<bigint>")).when(n < 5, F.array(F.xxhash64("_hashed"))).otherwise(runs)))
    df = df.withColumn("_least", F.filter("_sorted", lambda h, i: (i == 0) | (F.shiftright(h, _SHIFT) != F.shiftright(F.get(F.col("_sorted"), i - 1), _SHIFT))))
    df = df.withColumn("_bins", F.transform("_least", lambda h: (F.shiftright(h, _SHIFT) + BINS // 2).cast("int")))
    every = F.array(*[F.lit(b) for b in range(BINS)])
    place = F.transform(every, lambda b: F.get(F.col("_least"), (F.array_position(F.col("_bins"), b) - 1).cast("int")))
    df = df.withColumn("_filled", F.when(F.size("_bins") == 0, F.array().cast("array<bigint>")).otherwise(place))

    def probe(b: Column, k: int) -> Column:
        return F.get(F.col("_filled"), F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS)).cast("int"))

    def ranked(b: Column) -> Column:
        return F.array_min(F.transform("_least", lambda h: F.struct(F.xxhash64(b, F.shiftright(h, _SHIFT)).alias("r"), h.alias("h"))))["h"]

    full = F.transform("_filled", lambda h, b: F.coalesce(h, *[probe(b, k) for k in range(PROBES)], ranked(b)).bitwiseAND(2**BITS - 1).cast("int"))
    df = df.withColumn(out, F.when(F.size("_least") == 0, F.array().cast("array<int>")).otherwise(full))
    return df.drop("_text", "_words", "_hashed", "_sorted", "_least", "_bins", "_filled")


def packed(bins: str) -> Column:
    """The fingerprint as hex digits."""
    hexes = F.array(*[F.lit(f"{v:0{BITS // 4}x}") for v in range(2**BITS)])
    return F.array_join(F.transform(bins, lambda v: F.get(hexes, v)), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two columns of stored values."""
    equal = F.size(F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda z: z["x"] == z["y"]))
    chance = 2.0**-BITS
    seen = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(seen)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs(doc_id, columns...) with next_<column> of the next row by ascending doc_id, the first after the last.

    Rows are dealt to ranges of doc_id in one shuffle. The first row of each range also
    goes to the range before it, as a guest that only serves as the next row.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    count = ids.count()
    ranges = max(1, min(RANGES, -(-count // RANGE_ROWS)))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(10_000, 4 * ranges)).alias("c")).first().c if ranges > 1 else []
    cuts = sorted(set(cuts or []))
    if cuts:
        limits = F.array(*[F.lit(c).cast("long") for c in cuts])
        place = F.array_position(F.sort_array(F.concat(limits, F.array(F.coalesce("doc_id", F.lit(-(2**63))).cast("long")))), F.coalesce("doc_id", F.lit(-(2**63))).cast("long")).cast("int")
    else:
        place = F.lit(1)
    docs = docs.withColumn("_range", place)
    first = sorted(((r._range, r.least) for r in ids.withColumn("_range", place).groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least")).collect()), key=lambda r: r[0])
    before = [(first[i][1].doc_id, first[i - 1][0]) for i in range(len(first))]
    guests = spark.createDataFrame([(d, r) for d, r in before], "first_id long, _to int")
    both = docs.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("g"))
    other = F.struct(F.col("_to").alias("r"), F.lit(True).alias("g"))
    both = both.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, other))))
    both = both.select("doc_id", *columns, F.col("_at.r").alias("_range"), F.col("_at.g").alias("_guest"))
    w = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_first(), *columns)
    both = both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns} | {"_last": F.lead("doc_id").over(w)})
    return both.where("not _guest").drop("_range", "_guest", "_last")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = with_bins(df, "text", "bins")
    df = with_next(df, ["text", "bins"])
    n = F.char_length("text")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("_half", F.floor(n / 2).cast("int"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.char_length("text") - F.col("_half")), F.substring("next_text", F.lit(1), F.col("_half"))))
    df = df.withColumn("edited_sha256", F.sha2("edited", 256))
    df = with_bins(df, "edited", "edited_bins")
    return df.select(
        "doc_id", "n_chars", "edited_sha256", packed("bins").alias("fingerprint"), packed("edited_bins").alias("edited_fingerprint"),
        likeness("bins", "edited_bins").alias("near_edited"), likeness("bins", "next_bins").alias("near_next"),
    )
