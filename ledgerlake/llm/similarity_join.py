"""Exact n-gram Jaccard join by grouped prefixes, down to connected components.

A document's set is its distinct word shingles as 64-bit hashes (sets are compared by these). Documents of equal sets
form a class with one representative. If two sets are similar enough, prefixes of both in hash order (the part that
two sets must share anything in, and some more) share at least K tokens. Representatives with the same prefix and
size are one group, and groups are joined on prefix tokens:

* Tokens that few groups have are joined directly; a pair of groups goes on if it can still reach K shared tokens.
* A group most of whose prefix is made of frequent tokens could miss partners that way. Those, and groups of several
  members, are joined a second time among themselves with tokens in order of rarity, in which members of a family of
  near copies differ in the first positions, so that positions and sizes rule out most pairs. Each posting list is
  first compared with one hub; only pairs that are not yet in one component are then looked at, so that a large family
  needs about as many comparisons as it has members.

Candidates are verified on their whole sets. Nothing is capped: the threshold between the two ways only moves work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Scope, Words, documents_of, hot_parts, id_filter, join_by_count, join_wide, materialize, mix, passes, slices, with_filter_places
from ledgerlake.llm.components import components

FREQUENT = 32  # a token of more groups' prefixes is left to the second join


def _sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words are one shingle."""
    grams = w.grams(k)
    for a, b in zip(w.of[:-1].tolist(), w.of[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield mix(np.array([_fold(w.hash[a:b])], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _fold(h: np.ndarray) -> int:
    x = 0
    for v in h.tolist():
        x = (x * 0x9E3779B97F4A7C15 + v + 1) % (1 << 64)
    return x


def _least(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any partner at least."""
    return -(-percent * n // 100)


def _more(n: int, percent: int) -> int:
    """K: tokens by which a prefix is longer than needed for one shared token."""
    return min(_least(n, percent), 3 + n // 20)


def _list(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _digests(docs: DataFrame, k: int, percent: int, lower: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, h1, h2, prefix = [], [], [], []
                for s in _sets(Words(part.column("text"), lower), k):
                    n.append(len(s))
                    h1.append(mix(s).sum(dtype=np.uint64))
                    h2.append(mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64))
                    prefix.append(s[: len(s) - _least(len(s), percent) + _more(len(s), percent)])
                cols = [part.column("doc_id"), part.column("text_key"), pa.array(n, pa.int64()), *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)), _list(prefix)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n", "h1", "h2", "prefix"])

    return docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_key long, n long, h1 long, h2 long, prefix array<long>")


def _whole_sets(docs: DataFrame, needed: DataFrame, k: int, lower: bool) -> DataFrame:
    """rep and set of the documents in ``needed``: a filter of fixed size keeps most others out of the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(needed, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = passes(bits.value, batch.column("__h1").to_numpy(), batch.column("__h2").to_numpy())
            for part in slices(batch.filter(pa.array(ok)), "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _list(list(_sets(Words(part.column("text"), lower), k)))], ["doc_id", "set"])

    found = with_filter_places(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id long, set array<long>")
    return found.join(needed, "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")


def _prefixed(df: DataFrame, p: str, *but: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in but else f"{p}_{c}") for c in df.columns))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Pairs of a hub are dealt out over copies of its set."""
    x = materialize(pairs, "candidates")
    hot = {side: hot_parts(x, side) for side in ("a", "b")}  # a hub may be either end
    for side, other in (("a", "b"), ("b", "a")):
        x = join_wide(x, sets.select(F.col("rep").alias(side), F.col("set").alias(f"s{side}")), side, other, hot[side])
    both = F.size(F.array_intersect("sa", "sb"))
    return x.where(both * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent).select("a", "b")


def link(docs: DataFrame, *, shingle: int = 5, percent: int = 80, lower: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included), and
    text_key (xxhash64 of the text, which tells rows of one id apart).

    Two documents link if 100 * |intersection| >= percent * |union| of their shingle sets. With fewer words than a
    shingle the whole sequence is one; without words (or with null text) the set is empty and links with nothing. A
    null id links with nothing and has a null component. Rows that repeat an id are judged each by their own text.
    ``lower`` folds A-Z. An empty table gives no rows; other columns are not read.
    """
    d = documents_of(docs, id_col=id_col, text_col=text_col)
    with Scope(d.sparkSession) as scope:
        digest = materialize(_digests(d, shingle, percent, lower), "digests")
        linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
        some = digest.where(linkable)
        rows = F.count("*").alias("rows")
        classes = materialize(some.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
        reps = some.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "h1", "h2"]).dropDuplicates(["doc_id", "n", "h1", "h2"])
        reps = materialize(reps.select(F.col("doc_id").alias("rep"), "n", "copies", "prefix", F.xxhash64("prefix").alias("ph")), "representatives")
        groups = materialize(reps.groupBy("n", "ph").agg(F.min("rep").alias("gid"), F.count("*").alias("members"), rows), "groups")
        reps = materialize(join_by_count(reps, groups, ["n", "ph"]).drop("ph"), "grouped")
        links = _links(d, reps, shingle, percent, lower)
        found = components(links).select(F.col("node").alias("rep"), "label")
        labelled = classes.join(found, "rep", "left").select("n", "h1", "h2", F.coalesce("label", "rep").alias("component_id"), F.col("copies").alias("rows"))
        mine = join_by_count(some.select("doc_id", "text_key", "n", "h1", "h2"), materialize(labelled, "labelled"), ["n", "h1", "h2"])
        alone = digest.where(~linkable).withColumn("component_id", F.col("doc_id"))
        out = [x.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_key") for x in (mine, alone)]
        return scope.keep(materialize(out[0].unionByName(out[1]), "linked"))


def _links(docs: DataFrame, reps: DataFrame, shingle: int, percent: int, lower: bool) -> DataFrame:
    least = lambda n: F.ceil(n * percent / 100).cast("long")
    more = lambda n: F.least(least(n), 3 + F.floor(n / 20))
    close = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)

    # groups, their prefix tokens and how many groups have each
    entries = reps.where("rep = gid").select(F.explode("prefix").alias("token"), "gid", "n", "members")
    df = F.count("*")
    shared = materialize(entries.groupBy("token").agg(df.alias("df"), df.alias("rows")).where("df > 1"), "frequencies")
    live = materialize(join_by_count(entries, shared, ["token"]), "postings")
    often = live.groupBy("gid").agg(F.sum((F.col("df") > FREQUENT).cast("long")).alias("often"))
    again = reps.join(often, "gid", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    again = again.withColumn("again", (F.col("members") > 1) | (F.col("often") >= more(least(F.col("n")))))
    again = materialize(again.select("rep", "gid", "n", "copies", "often", "again"), "second")

    # first join: rare tokens
    group = again.where("rep = gid").select("gid", "often", "again")
    rare = live.where(F.col("df") <= FREQUENT).select("token", "gid", "n").join(group, "gid")
    a, b = _prefixed(rare, "a", "token"), _prefixed(rare, "b", "token")
    met = a.join(b, "token").where((F.col("a_gid") < F.col("b_gid")) & close(F.col("a_n"), F.col("b_n")) & ~(F.col("a_again") & F.col("b_again")))
    met = met.groupBy("a_gid", "b_gid", "a_n", "b_n").agg(F.count("*").alias("c"), F.first("a_often").alias("a_often"), F.first("b_often").alias("b_often"))
    met = met.where(F.col("c") + F.least("a_often", "b_often") >= F.least(more(F.col("a_n")), more(F.col("b_n"))))
    of = again.select("gid", "rep")
    pairs = met.select("a_gid", "b_gid").join(of.select(F.col("gid").alias("a_gid"), F.col("rep").alias("a")), "a_gid").join(of.select(F.col("gid").alias("b_gid"), F.col("rep").alias("b")), "b_gid")
    pairs = materialize(pairs.select("a", "b"), "pairs")

    # whole sets of the documents that are compared
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(again.where("again").select("rep")).distinct()
    needed = materialize(needed, "needed")
    sets = materialize(_whole_sets(docs, needed, shingle, lower), "sets")
    links = materialize(_verify(pairs, sets, percent), "links")

    # second join: tokens by rarity among the documents left to it
    hard = again.where("again").select("rep", "n", "copies")
    tokens = materialize(sets.join(hard, "rep"), "second-sets").select("rep", "n", "copies", F.explode("set").alias("token"))
    shared = materialize(tokens.groupBy("token").agg(df.alias("df"), df.alias("rows")).where("df > 1"), "frequencies")
    ranked = join_by_count(tokens, shared, ["token"]).groupBy("rep", "n", "copies").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    alone = F.col("n") - F.size("t")  # tokens of no other document come first
    inside = F.greatest(F.col("n") - least(F.col("n")) + 1 - alone, F.lit(0)).cast("int")
    ranked = ranked.select("rep", "n", "copies", alone.alias("alone"), F.posexplode(F.slice("t", F.lit(1), inside)).alias("i", "x"))
    # a partner's size is at most what the tokens from this position on can match
    largest = F.floor((F.col("n") - F.col("alone") - F.col("i")) * (100 + percent) / percent).cast("long") - F.col("n")
    postings = ranked.select("rep", "n", "copies", F.col("x.token").alias("token"), largest.alias("upto"))
    postings = materialize(postings.where(F.col("upto") >= least(F.col("n"))), "second-postings")
    hub = F.max(F.struct("copies", -F.col("rep"), "n")).alias("hub")
    hubs = postings.groupBy("token").agg(hub, df.alias("rows")).select("token", (-F.col("hub.col2")).alias("hub"), F.col("hub.n").alias("hub_n"), "rows")
    hubs = materialize(hubs, "hubs")
    star = join_by_count(postings, hubs, ["token"]).where((F.col("rep") != F.col("hub")) & close(F.col("n"), F.col("hub_n")))
    star = star.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    links = materialize(links.union(_verify(star, sets, percent)), "links")

    # the rest: pairs of a posting list that are not in one component yet
    label = components(links).select(F.col("node").alias("rep"), "label")
    marked = postings.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    led = hubs.select("token", F.col("hub").alias("rep"), "rows").join(label, "rep", "left").select("token", F.coalesce("label", "rep").alias("lead"), "rows")
    marked = materialize(join_by_count(marked, materialize(led, "leads"), ["token"]), "marked")
    mixed = marked.groupBy("token").agg(df.alias("rows"), F.count_if(F.col("label") != F.col("lead")).alias("odd")).where("odd > 0")
    mixed = materialize(mixed.drop("odd"), "mixed")
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.02))).cast("int")
    side = marked.select("token", "rep", "n", "upto", "label", "lead")
    one = _prefixed(side.where("label <> lead"), "a", "token").withColumn("sc", F.explode(F.sequence(size_class(least(F.col("a_n"))), size_class(F.col("a_upto")))))
    other = _prefixed(join_by_count(side, mixed, ["token"]), "b", "token").withColumn("sc", size_class(F.col("b_n")))
    fits = (F.col("a_label") != F.col("b_label")) & close(F.col("a_n"), F.col("b_n")) & (F.col("b_n") <= F.col("a_upto")) & (F.col("a_n") <= F.col("b_upto"))
    rest = one.join(other, ["token", "sc"]).where(fits).select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")).distinct()
    return materialize(links.union(_verify(rest, sets, percent)), "links")
