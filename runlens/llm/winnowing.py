"""Document fingerprints by winnowing, in column expressions alone.

The words of a text are hashed, each run of ``GRAM`` words becomes one hash of its word hashes, computed anew for each run instead of
rolled on from the last one, and of each ``WINDOW`` neighbouring hashes the least is kept, the rightmost of equal ones. Two texts that share ``GRAM + WINDOW - 1`` words in a row share a kept hash, and
positions that follow each other are at most ``WINDOW`` apart. Hash and position share one number, hash first, so
that the least number of a window is at once the least hash and the rightmost place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.texts import text_of

GRAM, WINDOW = 3, 6
#: Bits of a position; places further on count from zero again, and a tie over that border goes left.
PLACE_BITS = 24
#: Ids that cut the table into ranges: one for so many rows, and not more than so many.
RANGE_ROWS, MOST_RANGES = 500, 16_384


def kept(text: Column) -> Column:
    """Kept hashes with their places, as numbers in order of place. A text shorter than a gram has one, a wordless one none."""
    hashes = F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    place = (1 << PLACE_BITS) - 1

    def numbers(words: Column) -> Column:
        grams = F.slice(words, F.lit(1), F.greatest(F.lit(1), F.size(words) - (GRAM - 1)))
        mixed = lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, GRAM)))
        return F.transform(grams, lambda w, i: F.shiftleft(F.shiftrightunsigned(mixed(w, i), PLACE_BITS + 1), PLACE_BITS).bitwiseOR(
            F.lit(place) - (i.cast("long").bitwiseAND(F.lit(place)))))

    def least(all_: Column) -> Column:
        windows = F.slice(all_, F.lit(1), F.greatest(F.lit(1), F.size(all_) - (WINDOW - 1)))
        return F.array_distinct(F.transform(windows, lambda v, i: F.least(v, *(F.get(all_, i + k) for k in range(1, WINDOW)))))

    # Each step is bound once as the only entry of an array, so that nothing is computed twice.
    return F.transform(F.transform(F.array(hashes), numbers), least)[0]


def hashes_of(numbers: Column) -> Column:
    """Different kept hashes."""
    return F.array_distinct(F.transform(numbers, lambda v: F.shiftright(v, PLACE_BITS)))


def places_of(numbers: Column) -> Column:
    """Places of the kept hashes, the first word of each gram counted from 0."""
    return F.transform(numbers, lambda v: F.lit((1 << PLACE_BITS) - 1) - v.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))


def likeness(one: Column, other: Column) -> Column:
    """Shared over all different hashes of two fingerprints, from 0 to 1; two empty ones are alike."""
    shared = F.size(F.array_intersect(one, other))
    every = F.size(one) + F.size(other) - shared
    return F.when(every == 0, 1.0).otherwise(shared / every)


def spelled(hashes: Column) -> Column:
    """A fingerprint as text: its hashes of 39 bits in order, ten hex digits each."""
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 10, "0")), ""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``hashes`` (array of long) and ``places`` (as many, with repeats of a hash) of each row; a null text is empty."""
    rows = docs.select("doc_id", kept(text_of()).alias("numbers"))
    return rows.select("doc_id", F.transform("numbers", lambda v: F.shiftright(v, PLACE_BITS)).alias("hashes"), places_of(F.col("numbers")).alias("places"))


def with_next(rows: DataFrame, columns: dict[str, str], prepared: dict[str, Column] | None = None) -> DataFrame:
    """Adds to each row values of the next one by descending ``doc_id``; after the last the first comes again.

    The ids are cut into ranges at quantiles, which are ids themselves. Each range is ordered on its own, and gets the first
    row of the range after it as a guest. ``columns``: new name by own name; ``prepared``: columns made between the shuffle and
    the ordering. Rows that repeat an id follow each other by their texts. Rows without an id have no next one (null values).
    """
    count, most = rows.agg(F.count("doc_id"), F.max("doc_id")).first()
    ranges = max(1, min(MOST_RANGES, count // RANGE_ROWS))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, F.lit(4 * ranges)).alias("c")).first()["c"] if shares else []
    bounds = sorted({*cuts, most} - {None})
    # A row belongs to the first bound from below that is not less than its id.
    points = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<long>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, len(bounds).bit_length())))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(points, at + step - 1) < F.col("doc_id"), at + step).otherwise(at))
    spread = -1 - F.pmod(F.xxhash64("text"), F.lit(ranges)).cast("int")
    place = lambda r, guest: F.struct(r.cast("int").alias("range"), F.lit(guest).alias("guest"))
    # The first row of a range, whose id is its bound, is also a guest of the range of larger ids; the very first of the smallest.
    own = F.col("own_range")
    after = F.when(own < max(0, len(bounds) - 1), own + 1).otherwise(0)
    places = F.when(F.col("doc_id") == F.get(points, own), F.array(place(own, False), place(after, True))).otherwise(F.array(place(own, False)))
    dealt = rows.withColumn("own_range", F.when(F.col("doc_id").isNull(), spread).otherwise(found))
    dealt = dealt.select(*rows.columns, F.inline(places)).repartition(F.col("range"))
    for name, column in (prepared or {}).items():
        dealt = dealt.withColumn(name, column)
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc(), "text")
    leads = [F.when(F.col("doc_id").isNotNull(), F.lead(old).over(order)).alias(new) for old, new in columns.items()]
    return dealt.select("*", *leads).where(~F.col("guest")).drop("range", "guest")


def digests(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text whose second half is the beginning of the next document."""
    rows = docs.select("doc_id", text_of().alias("text"))
    numbers = {"length": F.char_length("text").cast("long"), "numbers": kept(F.col("text")), "hashes": hashes_of(F.col("numbers"))}
    followed = with_next(rows, {"text": "next_text", "hashes": "next_hashes"}, numbers)
    half = F.floor(F.col("length") / 2).cast("int")
    begun = F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)
    edited = F.concat(F.substring("text", F.lit(1), F.col("length").cast("int") - half), begun)
    rows = followed.withColumn("edited", edited).withColumn("edited_numbers", kept(F.col("edited")))
    rows = rows.withColumn("edited_hashes", hashes_of(F.col("edited_numbers")))
    return rows.select(
        "doc_id", F.col("length").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spelled(F.col("hashes")).alias("fingerprint"), spelled(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.coalesce("next_hashes", F.array().cast("array<long>"))).alias("near_next"), F.size("numbers").alias("n_kept"),
    )
