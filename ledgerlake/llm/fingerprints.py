"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle is hashed once; the upper bits name a bin, and a bin keeps its least hash. An empty bin takes the value
of the first filled bin on a walk that depends on the empty bin alone (optimal densification), so that equal bins of
two documents stay comparable. Of each bin only the ``BITS`` low-order bits are stored, packed sixteen bins to a long;
likeness is the share of equal bins, corrected for bins that agree by chance.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import materialize
from ledgerlake.llm.native_words import gram_hashes, word_hashes, words

BINS, BITS, SHINGLE = 256, 4, 5
_SHIFT = 64 - 8  # the upper 8 bits of a hash are its bin
_EMPTY = (1 << _SHIFT) - 1  # low bits of a bin without a shingle
_STEPS = 8  # steps of the walk that are tried before it is continued over all filled bins at once
_SIGN = 1 << 63


def _walk(bin_: Column, step: Column) -> Column:
    """The bin at a step of an empty bin's walk."""
    return F.pmod(F.xxhash64(bin_, step), F.lit(BINS)).cast("int")


def shingle_hashes(h: Column, k: int = SHINGLE) -> Column:
    """Hashes of the k-word shingles of a column of word hashes; fewer words are one shingle, none have none."""
    n = F.size(h)
    return F.when(n >= k, gram_hashes(h, k)).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, _SHIFT).cast("int")


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the packed fingerprint (array of longs; empty for a text without words) under ``name``."""
    as_long = lambda v: v - (1 << 64) if v >= _SIGN else v
    marks = F.array(*(F.lit(as_long((b << _SHIFT) | _EMPTY)).cast("long") for b in range(BINS)))
    filled = lambda v: F.get(v, F.lit(0)).isNotNull()
    has = lambda x: x.bitwiseAND(F.lit(_EMPTY)) != F.lit(_EMPTY)
    keep = [F.col(c) for c in df.columns]
    a, b, c, d = (f"{name}__{i}" for i in range(4))
    # each step is a column of its own: what a lambda refers to as an expression is evaluated for each element
    out = df.select(*keep, word_hashes(words(text)).alias(d))
    out = out.select(*keep, shingle_hashes(F.col(d)).alias(a))
    out = out.select(*keep, F.sort_array(F.concat(F.col(a), marks)).alias(b))
    s = F.col(b)
    # signed order begins with bin 128: one value for each bin, in that order
    out = out.select(*keep, F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))).alias(c))
    m = F.col(c)
    place = lambda bin_: (bin_ + F.lit(BINS // 2)) % BINS
    out = out.select(*keep, m.alias(c), F.filter(m, has).alias(d))
    full = F.col(d)

    def dense(x: Column) -> Column:
        own = _bin(x)
        tried = F.filter(F.transform(F.sequence(F.lit(1), F.lit(_STEPS)), lambda t: F.get(m, place(_walk(own, t)))), has)
        rest = F.array_min(F.transform(full, lambda v: F.struct(F.xxhash64(own, _bin(v), F.lit(_STEPS)).alias("o"), v.alias("v"))))["v"]
        return F.when(has(x), x).when(filled(tried), F.get(tried, F.lit(0))).otherwise(rest)

    low = (1 << BITS) - 1
    per = 64 // BITS
    digits = F.transform(m, lambda x: dense(x).bitwiseAND(F.lit(low)).cast("long"))
    out = out.select(*keep, F.when(F.size(full) == 0, F.array().cast("array<bigint>")).otherwise(digits).alias(a))
    g = F.col(a)
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), lambda w: F.aggregate(F.slice(g, w * per + 1, F.lit(per)), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, BITS).bitwiseOR(x)))
    return out.select(*keep, F.when(F.size(g) == 0, g).otherwise(packed).alias(name))


def as_text(packed: Column) -> Column:
    """A packed fingerprint as hexadecimal digits, one for each bin."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1; two texts without words are alike."""

    def differ(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    apart = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    est = (1 - apart / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(est, F.lit(0.0)))


def with_next(df: DataFrame, columns: list[str], *, key: str = "k", tie: str = "text", rows_per_bucket: int = 20_000, most_buckets: int = 65_536) -> DataFrame:
    """Add next_<column> of the following row, by descending ``key`` and then by a hash of ``tie``; the last row's is the first row.

    Rows are dealt to key ranges at approximate quantiles (at most ``most_buckets``, so what passes the driver is
    bounded); each range also gets a copy of the first row of the range after it, and windows stay inside ranges. A key
    that is a quantile more than once is cut up by the hash, as often as it is one. Rows of such a key that are equal
    in all columns are next to each other, so one of them takes part and the others are each their own next.
    """
    spark = df.sparkSession
    n = df.count()
    want = max(n // rows_per_bucket, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(1, min(want, most_buckets, n // 4))
    cuts = df.select(F.percentile_approx(F.col(key), [i / buckets for i in range(1, buckets)] or [0.5], max(10_000, 4 * buckets))).first()[0] or []
    splits = [-math.inf, *sorted({float(c) for c in cuts}), math.inf]
    hot = {c: times for c, times in Counter(cuts).items() if times > 1}  # at most half as many as buckets
    named = df.columns
    repeats = None
    if hot:
        keys = F.broadcast(spark.createDataFrame([(c,) for c in hot], f"`{key}` long"))
        same = materialize(df.join(keys, key, "left_semi").groupBy(*named).agg(F.count("*").alias("__rows")), "repeated")
        df = df.join(keys, key, "left_anti").select(*named).union(same.select(*named))
        repeats = _copies(same.where("__rows > 1").withColumn("__rows", F.col("__rows") - 1)).select(*named, *(F.col(c).alias(f"next_{c}") for c in columns))
    ranged = Bucketizer(splits=splits, inputCol="__at", outputCol="__range").transform(df.withColumn("__at", F.col(key).cast("double")))
    ranged = ranged.select(*named, F.col("__range").cast("int").alias("__range"), F.xxhash64(tie).alias("__h"))
    part = F.lit(0)
    if hot:
        at: dict[int, list[tuple[int, int]]] = {}
        for c, times in hot.items():
            at.setdefault(bisect_right(splits, float(c)) - 1, []).append((c, times))
        inside = spark.createDataFrame(list(at.items()), "__range int, __hot array<struct<key: long, times: int>>")
        ranged = ranged.join(F.broadcast(inside), "__range", "left")
        above = F.aggregate(F.filter("__hot", lambda x: x["key"] > F.col(key)), F.lit(0), lambda s, x: s + x["times"] + 1)
        times = F.get(F.filter("__hot", lambda x: x["key"] == F.col(key)), F.lit(0))["times"]
        cut = F.least(F.floor((0.5 - F.col("__h") / F.lit(2.0**64)) * times), times - 1) + 1
        part = F.coalesce(above, F.lit(0)) + F.coalesce(cut, F.lit(0)).cast("int")
    ranged = ranged.select(*named, "__h", F.struct(F.col("__range").alias("range"), part.alias("part")).alias("__bucket"))
    firsts = ranged.groupBy("__bucket").agg(F.max(F.struct(F.col(key).alias("key"), F.col("__h").alias("h"))).alias("first"))
    heads = sorted(((r["first"]["key"], r["first"]["h"], tuple(r["__bucket"])) for r in firsts.collect()), reverse=True)
    sent = [(k, h, heads[i - 1][2]) for i, (k, h, _) in enumerate(heads)]  # the first range's goes to the last
    first_of = F.broadcast(spark.createDataFrame(sent, "__head long, __head_h long, __to struct<range: int, part: int>"))  # a row a range
    j = ranged.join(first_of, (F.col(key) == F.col("__head")) & (F.col("__h") == F.col("__head_h")), "left")
    places = F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("copy")), F.struct(F.col("__to").alias("b"), F.lit(True).alias("copy")))
    j = j.select(*named, "__h", F.explode(F.filter(places, lambda x: x["b"].isNotNull())).alias("__p"))
    w = Window.partitionBy("__p.b").orderBy(F.col("__p.copy"), F.col(key).desc(), F.col("__h").desc(), F.col(tie))
    j = j.select(*named, F.col("__p.copy").alias("__copy"), *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    out = j.where(~F.col("__copy")).drop("__copy")
    return out if repeats is None else out.unionByName(repeats)


def _copies(rows: DataFrame, at_once: int = 10_000) -> DataFrame:
    """Each row as many times as its ``__rows`` says, no task more than a few times ``at_once`` of one row."""
    lot = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__rows") - 1) / at_once)))
    lots = rows.withColumn("__lot", lot).repartition(F.xxhash64(*rows.columns), "__lot")
    times = F.least(F.col("__rows") - F.col("__lot") * at_once, F.lit(at_once))
    return lots.withColumn("__lot", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("__rows", "__lot")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document, by descending doc_id; after the last comes the first. Null text counts as empty and texts without words
    have the empty fingerprint, alike (1) only with another such; a null id sorts last; rows of equal id are ordered
    by a hash of their text, so equal rows are next to each other; an only document is its own next; an empty table gives no rows; other columns aren't read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    if d.select("k").isEmpty():
        return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), *(F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next"))
    d = with_next(with_fingerprint(d, F.col("text"), "packed"), ["text", "packed"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "edited", "packed", likeness(F.col("packed"), F.col("next_packed")).alias("near_next"))
    d = with_fingerprint(d, F.col("edited"), "epacked")
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("packed")).alias("fingerprint"),
        as_text(F.col("epacked")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("epacked")).alias("near_edited"),
        "near_next",
    )
