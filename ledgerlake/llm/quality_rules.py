"""Quality rules whose thresholds adapt to each language and source.

Every document gets a few whole-number statistics. Their distributions are summarised per (lang, source) by a
log-linear histogram: a quantile sketch with a relative error of at most 1/32 that is merged by adding counts, so
partial aggregation does the merging and the result doesn't depend on order or partitioning. A fence lies some spreads
from the median: below by the distance of the lowest tenth, above by that of the upper quarter or, if it is greater,
the same. A language's fences are
drawn toward those of everything and a group's toward its language's, with a weight that falls with its rows, so that
no number of rows changes the way of judging. Documents are filtered by a join with them. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import SEPARATORS, materialize
from ledgerlake.llm.native_words import gram_hashes, is_blank, word_hashes, words

SYMBOLS = "#*$%&|<>"
#: The sketched statistics, in thousandths, and the least spread that a fence is reckoned with.
METRICS = {"word_length": 150, "symbols": 20, "dup_lines": 60, "repeated": 30}
WIDTH = 6  # spreads from the median to a fence
PRIOR_ROWS = 100  # rows of its own at which a group counts for as much as its language, and a language as everything


def repeats(pairs: Column) -> Column:
    """Positions, in order, of the windows in ``pairs`` (hash, position; by hash) whose hash is there more than once.

    ``pairs`` must be a column: an expression would be evaluated again for each element.
    """
    hash_at = lambda i: F.get(pairs, i)["h"]
    again = F.transform(pairs, lambda x, i: F.when((x["h"] == hash_at(i - 1)) | (x["h"] == hash_at(i + 1)), x["i"]))
    return F.array_sort(F.filter(again, lambda x: x.isNotNull()))


def covered(at: Column, k: int) -> Column:
    """Words inside the k-word windows at these positions."""
    step = lambda a, p: F.struct((a["sum"] + F.least(F.lit(k), p - a["last"])).alias("sum"), p.alias("last"))
    return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-k).alias("last")), step, lambda a: a["sum"])


def statistics(docs: DataFrame, *, repeat_window: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of whole texts. No shuffle."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long = lambda c: c.cast("long")
    text = F.col("text")
    d = d.select(
        "doc_id",
        "lang",
        "source",
        long(F.length(F.translate(text, SEPARATORS, ""))).alias("word_chars"),
        long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: ~is_blank(x)).alias("lines"),
        word_hashes(words(text)).alias("hashes"),
    )
    d = d.withColumn("keys", gram_hashes(F.col("hashes"), repeat_window))
    keys = F.col("keys")
    some = F.size(F.array_distinct(keys)) < F.size(keys)  # most texts repeat nothing and need no sorting
    d = d.withColumn("pairs", F.when(some, F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    lines = F.col("lines")
    return d.select(
        "doc_id",
        "lang",
        "source",
        long(F.size("hashes")).alias("n_words"),
        "word_chars",
        "n_symbols",
        long(F.size(lines)).alias("n_lines"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.coalesce(covered(repeats(F.col("pairs")), repeat_window), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def thousandths() -> dict[str, Column]:
    """The sketched statistics of a document, as whole thousandths."""
    per = lambda a, b: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {"word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeated": per("n_repeat_words", "n_words")}


def bucket(v: Column) -> Column:
    """Bucket of a whole number: itself below 64, then 32 buckets for each power of two."""
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(64 + (shift - 1) * 32 + F.call_function("shiftright", v, shift) - 32).cast("long")


def bucket_start(b: Column) -> Column:
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", (b - 64) % 32 + 32, ((b - 64) / 32).cast("int") + 1)).cast("long")


def sketch(stats: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: mergeable by adding n."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(v).alias("bucket")) for m, v in thousandths().items()))).alias("x")
    return stats.select("lang", "source", each).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, and low and high of each metric, from the sketches merged over ``keys``."""
    merged = sketched.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric").orderBy("bucket")
    ranked = merged.select(*keys, "metric", "bucket", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy(*keys, "metric")).alias("total"))
    at = lambda q: bucket_start(F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))))
    found = ranked.groupBy(*keys, "metric").agg(at(10).alias("q10"), at(50).alias("q50"), at(75).alias("q75"), F.max("total").alias("total"))
    least = F.create_map(*(F.lit(x) for kv in METRICS.items() for x in kv))
    reach = lambda spread: F.greatest(spread, least[F.col("metric")]) * WIDTH
    low = F.greatest(F.col("q50") - reach(F.col("q50") - F.col("q10")), F.lit(0))
    found = found.select(*keys, "metric", "total", low.alias("low"), (F.col("q50") + reach(F.greatest(F.col("q75") - F.col("q50"), F.col("q50") - F.col("q10")))).alias("high"))
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}")
    return found.groupBy(*keys).agg(F.max("total").alias("rows"), *(pick(m, c) for m in METRICS for c in ("low", "high")))


def judge(docs: DataFrame, *, least_words: int = 20, most_repeated_percent: int = 30, **columns: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: fewer than ``least_words`` words, or more than that share of words in repeated windows. Sketches take
    every document that passes the base; kept needs the base and all statistics inside the fences. Null text counts as
    empty (base_failed); null lang or source form groups of their own; a null id stays null; repeated rows are judged
    once each; an empty table gives no rows; other columns aren't read.

    The statistics (some numbers a row) are written once to the shared folder; sketches have at most a few hundred
    rows for each group and metric, whatever the group's size.
    """
    s = statistics(docs, **columns)
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated_percent)
    s = materialize(s.withColumn("base_failed", failed), "statistics")
    sketched = sketch(s.where(~F.col("base_failed")))
    named = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    group, lang, every = (named(fences(sketched, k), p) for k, p in ((["lang", "source"], "g"), (["lang"], "l"), ([], "e")))
    j = s.join(group, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    j = j.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    j = j.join(F.broadcast(every), F.lit(True), "left")  # one row
    drawn = lambda own, rows, to: F.call_function("div", own * rows + to * PRIOR_ROWS, rows + PRIOR_ROWS)
    fence = lambda c: drawn(F.col(f"g_{c}"), F.col("g_rows"), drawn(F.col(f"l_{c}"), F.col("l_rows"), F.col(f"e_{c}")))
    inside = F.lit(True)
    for m, v in thousandths().items():
        inside = inside & v.between(fence(f"low_{m}"), fence(f"high_{m}"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - 6)) AS p, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS k FROM w WHERE len(w) >= 8),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - p, 8))) AS n FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM rep) GROUP BY rid),
s AS (SELECT w.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON cov.rid = w.rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             [n_words, word_chars] AS _x, word_chars * 1000 // greatest(n_words, 1) AS m1, n_symbols * 1000 // greatest(n_words, 1) AS m2,
             n_dup_lines * 1000 // greatest(n_lines, 1) AS m3, n_repeat_words * 1000 // greatest(n_words, 1) AS m4 FROM s),
v AS (SELECT lang, source, unnest([1, 2, 3, 4]) AS m, unnest([m1, m2, m3, m4]) AS v FROM b WHERE NOT base_failed),
k AS (SELECT lang, source, m, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 7) * 32 + 32 + (v >> (length(bin(v)) - 6)) END AS bk FROM v),
h AS (SELECT 0 AS lv, lang, source, m, bk, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 1, lang, NULL, m, bk, count(*) FROM k GROUP BY ALL
      UNION ALL SELECT 2, NULL, NULL, m, bk, count(*) FROM k GROUP BY ALL),
c AS (SELECT lv, lang, source, m, bk, sum(n) OVER (PARTITION BY lv, lang, source, m ORDER BY bk) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, m) AS total FROM h),
q AS (SELECT lv, lang, source, m, max(total) AS total, min(CASE WHEN upto * 100 >= total * 10 THEN bk END) AS b10, min(CASE WHEN upto * 100 >= total * 50 THEN bk END) AS b50, min(CASE WHEN upto * 100 >= total * 75 THEN bk END) AS b75 FROM c GROUP BY ALL),
p AS (SELECT lv, lang, source, m, total, CASE WHEN b10 < 64 THEN b10 ELSE ((b10 - 64) % 32 + 32) << ((b10 - 64) // 32 + 1) END AS q10,
             CASE WHEN b50 < 64 THEN b50 ELSE ((b50 - 64) % 32 + 32) << ((b50 - 64) // 32 + 1) END AS q50,
             CASE WHEN b75 < 64 THEN b75 ELSE ((b75 - 64) % 32 + 32) << ((b75 - 64) // 32 + 1) END AS q75 FROM q),
f AS (SELECT lv, lang, source, m, total, greatest(0, q50 - {WIDTH} * greatest(q50 - q10, r)) AS lo, q50 + {WIDTH} * greatest(q75 - q50, q50 - q10, r) AS hi
      FROM p JOIN (VALUES (1, {METRICS["word_length"]}), (2, {METRICS["symbols"]}), (3, {METRICS["dup_lines"]}), (4, {METRICS["repeated"]})) AS x(m, r) USING (m)),
l AS (SELECT f.lang, f.m, (f.lo * f.total + e.lo * {PRIOR_ROWS}) // (f.total + {PRIOR_ROWS}) AS lo, (f.hi * f.total + e.hi * {PRIOR_ROWS}) // (f.total + {PRIOR_ROWS}) AS hi
      FROM f JOIN f e ON e.lv = 2 AND e.m = f.m WHERE f.lv = 1),
g AS (SELECT f.lang, f.source, f.m, (f.lo * f.total + l.lo * {PRIOR_ROWS}) // (f.total + {PRIOR_ROWS}) AS lo, (f.hi * f.total + l.hi * {PRIOR_ROWS}) // (f.total + {PRIOR_ROWS}) AS hi
      FROM f JOIN l ON l.m = f.m AND l.lang IS NOT DISTINCT FROM f.lang WHERE f.lv = 0),
o AS (SELECT b.rid, bool_and(CASE g.m WHEN 1 THEN m1 WHEN 2 THEN m2 WHEN 3 THEN m3 ELSE m4 END BETWEEN g.lo AND g.hi) AS ok
      FROM b JOIN g ON g.lang IS NOT DISTINCT FROM b.lang AND g.source IS NOT DISTINCT FROM b.source GROUP BY b.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept FROM b LEFT JOIN o USING (rid)
"""
