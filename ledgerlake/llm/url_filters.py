"""URL filters: stated host and path rules, and association rules mined from labelled URLs.

Pages are labelled by what is on them: lines that labelled documents have too. Spark's FP-growth mines token
combinations that imply a blocked label; rules below a confidence, a lift over the share of blocked rows, or a support,
and those that a shorter rule of at least the same confidence covers, are pruned. Each rule is indexed under the one of
its tokens that fewest URLs have, so that a URL meets a rule only through that token and is then tested for the others.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import SEPARATORS, Scope, join_by_count, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label:block"  # no token has a colon after these letters: tokens begin with h: or p:
LEAST_LINE = 20  # characters of a line that can tell a page's document


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: the labels of its host and their parts, the segments of its path (numbers as one token)."""
    kept = lambda a, p: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(p), x))
    segments = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, "[0-9]+", "0"))
    return F.array_distinct(F.concat(kept(F.split(host, r"\."), "h:"), kept(F.split(host, r"[.-]"), "h:"), kept(segments, "p:")))


def label_pages(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """page id and blocked, for pages (id, html) that hold lines of labelled documents; labels are (doc_id, blocked).

    A line counts with its length if all labelled documents that have it agree; a page is blocked if most of what counts
    is of blocked documents, and has no row where nothing counts. Lines of fewer than LEAST_LINE characters don't.
    """
    told = labels.select(F.col(labels.columns[0]).cast("long").alias("doc_id"), F.col(labels.columns[1]).alias("blocked")).where("doc_id is not null and blocked is not null")
    told = told.groupBy("doc_id").agg(F.max("blocked").alias("blocked"))
    kept = lambda x: F.length(x) >= LEAST_LINE
    trimmed = lambda a: F.filter(F.transform(a, lambda x: F.trim(x, F.lit(SEPARATORS))), kept)
    hashed = lambda a: F.explode(F.array_distinct(F.transform(trimmed(a), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("size")))))
    # texts stay where they are: only the hashes of their lines go to the labels, and that at any size
    text = F.col("text").cast("string")
    lines = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_distinct(F.transform(trimmed(F.split(text, "\n")), lambda x: F.xxhash64(x))).alias("hs"))
    lines = lines.where(F.size("hs") > 0).join(told.hint("merge"), "doc_id").select("blocked", F.explode("hs").alias("h"))
    sure = lines.groupBy("h").agg(F.min("blocked").alias("blocked"), F.max("blocked").alias("most")).where(F.col("blocked") == F.col("most")).select("h", "blocked")
    runs = F.split(F.regexp_replace(pages.columns[1], "[\\s]+", " "), "<[^>]*>")
    own = materialize(pages.select(F.col(pages.columns[0]).cast("long").alias("page_id"), hashed(runs).alias("x")).select("page_id", "x.h", "x.size"), "page-lines")
    sure = own.groupBy("h").agg(F.count("*").alias("rows")).join(sure, "h")
    met = join_by_count(own, materialize(sure, "sure-lines"), ["h"])
    votes = met.groupBy("page_id").agg(F.sum(F.when(F.col("blocked"), F.col("size")).otherwise(-F.col("size"))).alias("votes"))
    return votes.select("page_id", (F.col("votes") > 0).alias("blocked"))


def mine(labelled: DataFrame, *, min_rows: int = 20, min_confidence: float = 0.5, min_lift: float = 1.5) -> DataFrame:
    """Rules (rule_id, tokens, confidence, support) that imply ``blocked``, from rows (tokens, blocked).

    A rule holds for at least ``min_rows`` rows, however many there are, and has any number of tokens; its confidence is
    at least ``min_confidence`` and ``min_lift`` times the share of blocked rows (or 1, where that is more than 1 can
    be). No rows, or none that is blocked, give no rules. A null ``blocked`` is no label.
    """
    spark = labelled.sparkSession
    schema = "rule_id long, tokens array<string>, confidence double, support double"
    rows = labelled.where(F.col("blocked").isNotNull())
    n, bad = rows.agg(F.count("*"), F.count_if("blocked")).first()
    if not bad:
        return spark.createDataFrame([], schema)
    if min_rows > n:
        return spark.createDataFrame([], schema)
    # only tokens that are frequent among blocked rows can be part of a rule: fewer, shorter baskets
    often = rows.where("blocked").select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") >= min_rows).select("t")
    numbered = rows.withColumn("r", F.monotonically_increasing_id())  # before tokens are rows of their own
    told = numbered.select("r", "blocked", F.explode("tokens").alias("t")).join(often, "t")
    baskets = told.groupBy("r").agg(F.collect_set("t").alias("t"), F.max("blocked").alias("blocked"))
    baskets = baskets.select(F.when(F.col("blocked"), F.concat("t", F.array(F.lit(LABEL)))).otherwise(F.col("t")).alias("items"))
    # rows without a frequent token count for the support too
    left = baskets.count()
    if not left:
        return spark.createDataFrame([], schema)
    min_confidence = max(min_confidence, min(1.0, min_lift * bad / n))
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, min(1.0, (min_rows - 0.5) / left)), minConfidence=min_confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(LABEL)))
    found = materialize(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * left / n).alias("support")), "url-rules")
    # a rule is covered by one with a part of its tokens and no less confidence
    parts = found.select(F.col("tokens").alias("whole"), F.col("confidence").alias("c"), F.explode("tokens").alias("first"))
    short = found.select(F.col("tokens").alias("part"), F.col("confidence").alias("pc"), F.col("tokens")[0].alias("first"))
    covered = parts.join(short, "first").where((F.size("part") < F.size("whole")) & (F.size(F.array_except("part", "whole")) == 0) & (F.col("pc") >= F.col("c"))).select(F.col("whole").alias("tokens")).distinct()
    kept = found.join(covered, "tokens", "left_anti")
    return kept.select(F.monotonically_increasing_id().alias("rule_id"), "tokens", "confidence", "support").select(*(c.split()[0] for c in schema.split(", ")))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct (host, path) that a mined rule fits: host, path, confidence (the greatest)."""
    each = urls.select("host", "path").distinct().withColumn("tokens", tokens(F.col("host"), F.col("path")))
    need = rules.select("rule_id", F.col("tokens").alias("need"), "confidence", F.explode("tokens").alias("token"))
    found = materialize(each.select("host", "path", "tokens", F.explode("tokens").alias("token")).join(need.select("token").distinct(), "token"), "url-tokens")
    df = found.groupBy("token").agg(F.count("*").alias("rows"))
    index = need.join(df, "token").groupBy("rule_id").agg(F.min_by(F.struct("token", "need", "confidence", "rows"), F.struct("rows", "token")).alias("x")).select("x.*")
    # the rules of a token are one row, so that each token's count is that of its urls
    index = materialize(index.groupBy("token").agg(F.collect_list(F.struct("need", "confidence")).alias("rules"), F.max("rows").alias("rows")), "url-index")
    met = join_by_count(found, index, ["token"]).select("host", "path", "tokens", F.explode("rules").alias("r"))
    met = met.where(F.size(F.array_except("r.need", "tokens")) == 0)
    return met.groupBy("host", "path").agg(F.max("r.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, confidence.

    ``rules`` are (verdict, host, path prefix); one fits its host and all subdomains, and the longest that fits decides;
    of fitting rules of equal length the last in the list does. They are part of the plan, so they should be few.
    Where none fits, the mined rules decide: block if one fits, else allow (confidence is null where none fits).
    ``labels`` has (id, blocked); null labels are skipped and repeated ones vote each. Null and malformed urls have empty
    host and path, no tokens, and are allowed. Null ids stay null, repeated rows are judged each, empty tables give no
    rows, other columns are not read.
    """
    url = F.col(url_col).cast("string")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    told = labels.select(F.col(labels.columns[0]).cast("long").alias("page_id"), F.col(labels.columns[1]).alias("blocked"))
    with Scope(pages.sparkSession) as scope:
        mined = materialize(mine(p.join(told, "page_id").select(tokens(F.col("host"), F.col("path")).alias("tokens"), "blocked"), **mining), "url-rules-kept")
        fitted = scope.keep(materialize(matches(p, mined), "url-matches"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, F.lit(host + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    out = p.join(fitted, ["host", "path"], "left")
    by_method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "confidence")
