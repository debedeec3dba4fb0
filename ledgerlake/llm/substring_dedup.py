"""Removal of passages that occur in an earlier document too, by repeated-phrase automata.

1. Content-chosen anchors: of each window's grams of half its length the one of least hash. Windows of the same words
   have the same anchor, so only windows around anchors that several documents have can recur.
2. Those windows are hashed and counted by content; what recurs is owned by the first document that has it. Passages
   are cut from the owners' texts as pieces of bounded length, such that each window lies whole in one of them.
3. Documents are dealt out with the pieces that they have a window of. Each shard of them compiles an Aho-Corasick
   automaton (pyahocorasick) of phrases taken from its pieces, close enough that every window of a piece holds one,
   streams its documents through it, and follows each phrase found along its piece, word by word. Runs of a window's
   length or more are removed. Hashes only choose candidates; what is removed was compared as text. Documents without
   a recurring anchor hold no passage and aren't streamed.

Exact copies of an earlier document are settled by themselves, before anything else: their words have the same SHA-256
digest. Shards are keyed by document, so a passage that a third of all documents share burdens no single task; texts
are read with what was found once, at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Scope, Words, documents_of, id_filter, join_by_count, materialize, mix, passes, slices, with_filter_places

PHRASE = 10  # words of a phrase
PIECE = 128  # windows of a passage that one piece holds
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i:i+w] for each i, by doubling."""
    if len(x) < w:
        return x[:0]
    y, have = x, 1
    while have * 2 <= w:
        y, have = op(y[: len(y) - have], y[have:]), have * 2
    if have < w:
        n = len(x) - w + 1
        y = op(y[:n], y[w - have : w - have + n])
    return y


class Anchors:
    """Window starts and chosen anchors of a batch of texts."""

    def __init__(self, w: Words, window: int):
        self.k = window // 2
        n = len(w.hash)
        self.valid = np.zeros(n, bool)
        self.valid[w.gram_starts(window)] = True  # windows that start here
        self.grams = w.grams(self.k)
        reach = window - self.k + 1
        least = _slide(self.grams, reach, np.minimum)
        starts = np.flatnonzero(self.valid)
        of_window = np.zeros(len(self.grams) + reach - 1, np.uint64)  # 0: no window starts here
        of_window[reach - 1 + starts] = least[starts] if len(starts) else 0
        self.chosen = np.zeros(n, bool)
        if len(starts):
            best = _slide(of_window, reach, np.maximum)
            self.chosen[: len(self.grams)] = (best == self.grams) & (self.grams > 0)
        self.reach = reach


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _digests(texts: DataFrame, window: int) -> DataFrame:
    """The digest of each text's words and its anchors; null for texts shorter than a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                a = Anchors(w, window)
                long = np.diff(w.of) >= window
                keys = [hashlib.sha256(b" ".join(t.split())).digest() if x else None for t, x in zip(part.column("text").cast(pa.binary()).to_pylist(), long, strict=True)]
                chosen = np.flatnonzero(a.chosen)
                cols = [part.column("doc_id"), part.column("tk"), pa.array(keys, pa.binary()), _lists(a.grams[chosen].view(np.int64), np.searchsorted(chosen, w.of))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tk", "key", "anchors"])

    return texts.mapInArrow(run, "doc_id long, tk long, key binary, anchors array<long>")


def _recurring(part: pa.RecordBatch, w: Words, a: Anchors) -> np.ndarray:
    """The chosen anchors of each text that are in its list ``anchors``."""
    chosen = np.flatnonzero(a.chosen)
    told = part.column("anchors")
    keep = np.zeros(len(chosen), bool)
    for i in range(len(told)):
        lo, hi = np.searchsorted(chosen, (w.of[i], w.of[i + 1]))
        keep[lo:hi] = np.isin(a.grams[chosen[lo:hi]], np.asarray(told[i].values, np.int64).view(np.uint64))
    return chosen[keep]


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """Windows around recurring anchors: content hashes, document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                a = Anchors(w, window)
                near = np.zeros(len(w.hash) + 1, np.int32)
                at = _recurring(part, w, a)
                np.add.at(near, np.maximum(at - a.reach + 1, 0), 1)
                np.add.at(near, at + 1, -1)
                starts = np.flatnonzero((np.cumsum(near[:-1]) > 0) & a.valid)
                h = w.grams(window)[starts] if len(starts) else np.zeros(0, np.uint64)
                text = np.searchsorted(w.of, starts, side="right") - 1
                ids, tks = (part.column(c).to_numpy()[text] for c in ("doc_id", "tk"))
                other = (mix(w.hash[starts] ^ a.grams[starts]) >> np.uint64(33)).astype(np.int32) if len(starts) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(other), pa.array(ids), pa.array(tks), pa.array((starts - w.of[text]).astype(np.int32))], ["h", "h2", "doc_id", "tk", "at"])

    return texts.select("doc_id", "tk", "text", "anchors").mapInArrow(run, "h long, h2 int, doc_id long, tk long, at int")


def _pieces(owners: DataFrame, window: int) -> DataFrame:
    """The pieces of a document whose numbers are in its list ``pieces``, as words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for doc, tk, text, pieces in zip(*(part.column(c).to_pylist() for c in ("doc_id", "tk", "text", "pieces")), strict=True):
                    words = text.encode().split()
                    rows += [(doc, tk, i, b" ".join(words[i * PIECE : (i + 1) * PIECE + window - 1]).decode()) for i in pieces]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["owner", "otk", "piece", "words"])

    return owners.mapInArrow(run, "owner long, otk long, piece int, words string")


def _followed(texts: list[str], passages: list[list[str]], window: int) -> list[np.ndarray]:
    """For each text, which of its words lie in a run of at least ``window`` words that one of its passages has too."""
    ids: dict[bytes, int] = {}
    numbers = lambda words: np.array([ids.setdefault(x, len(ids)) for x in words], np.int32)
    step = window - PHRASE + 1
    own, known, phrases = [], {}, {}
    for each in passages:
        mine = set()
        for p in each:
            if p not in known:
                words = p.encode().split()
                known[p] = len(own)
                own.append(numbers(words))
                for f in range(0, len(words) - PHRASE + 1, step):
                    phrases.setdefault(b" ".join([b"", *words[f : f + PHRASE], b""]).decode(), []).append((known[p], f))
            mine.add(known[p])
    automaton = ahocorasick.Automaton()
    for phrase, places in phrases.items():
        automaton.add_word(phrase, (len(phrase), places))
    if phrases:
        automaton.make_automaton()
    out = []
    for text, each in zip(texts, passages, strict=True):
        words = text.encode().split()
        gone = np.zeros(len(words) + 1, np.int32)
        if each and len(words) >= window and phrases:
            mine = {known[p] for p in each}
            joined = b" ".join([b"", *words, b""]).decode()
            starts = np.cumsum([0, *(len(x) + 1 for x in joined[1:-1].split(" "))])  # of each word's leading space
            here = numbers(words)
            seen: dict[tuple[int, int], int] = {}  # (passage, diagonal): end of the run that was followed
            found = [(end, x) for end, x in automaton.iter(joined)]
            at = np.searchsorted(starts, [end + 1 - x[0] for end, x in found])
            for q, (_, (_, places)) in zip(at.tolist(), found, strict=True):
                for p, f in places:
                    if p not in mine or seen.get((p, q - f), -1) > q:
                        continue
                    back = min(q, f)
                    n = min(len(here) - q, len(own[p]) - f)
                    same = here[q - back : q + n] == own[p][f - back : f + n]
                    wrong = np.flatnonzero(~same)
                    i = int(np.searchsorted(wrong, back))
                    lo = int(wrong[i - 1]) + 1 if i else 0
                    hi = int(wrong[i]) if i < len(wrong) else len(same)
                    seen[p, q - f] = q - back + hi
                    if hi - lo >= window:
                        gone[q - back + lo] += 1
                        gone[q - back + hi] -= 1
        out.append(np.cumsum(gone[:-1]) > 0)
    return out


def _cut(raw: bytes, start: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans and the white space after each; ``start`` has the place of each word."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : start[a]])
        at = int(start[b]) if b < len(start) else len(raw)
    return b"".join([*kept, raw[at:]]).decode()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _found(texts: DataFrame, window: int) -> DataFrame:
    """Spans of words that texts share with the pieces in their lists ``pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                spans = []
                for gone in _followed(part.column("text").to_pylist(), part.column("pieces").to_pylist(), window):
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
                    spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tk"), pa.array(spans, _SPANS)], ["doc_id", "tk", "removed"])

    return texts.mapInArrow(run, "doc_id long, tk long, removed array<struct<start: long, end: long>>")


def _split(texts: DataFrame, ids: DataFrame, then: Step | None = None, schema: str = "") -> tuple[DataFrame, DataFrame]:
    """Rows whose doc_id may be in ``ids``, and those whose isn't, by a filter of fixed size: the latter need no shuffle.

    The latter go on through ``then``, which makes rows of ``schema``, in the worker that filters them. Two Python
    operators in one task would have two workers, and executors keep theirs, so that each would have twice as many.
    """
    bits = texts.sparkSession.sparkContext.broadcast(id_filter(ids, "doc_id"))
    names = texts.columns

    def some(wanted: bool) -> Step:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    ok = passes(bits.value, part.column("__h1").to_numpy(), part.column("__h2").to_numpy())
                    yield part.select(names).filter(pa.array(ok == wanted))

        return run

    placed, maybe, others = with_filter_places(texts, "doc_id"), some(True), some(False)
    after = placed.mapInArrow(lambda batches: then(others(batches)), schema) if then else placed.mapInArrow(others, texts.schema)
    return placed.mapInArrow(maybe, texts.schema), after


def _repeats(d: DataFrame, window: int) -> DataFrame:
    """One row per text (doc_id, tk) of which something goes: copy (all of it), removed (word spans). A written table."""
    with Scope(d.sparkSession) as scope:
        digest = materialize(_digests(d, window), "digests").where("doc_id is not null and key is not null")
        classes = materialize(digest.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1"), "classes")
        copies = materialize(join_by_count(digest.select("doc_id", "tk", "key"), classes, ["key"]).where("doc_id > rep").select("doc_id", "tk").distinct(), "copies")
        first = digest.select("doc_id", "tk", "anchors").join(copies, ["doc_id", "tk"], "left_anti")
        each = materialize(first.select("doc_id", "tk", F.explode(F.array_distinct("anchors")).alias("anchor")), "anchors")
        shared = each.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).where("lo < hi")
        shared = materialize(shared.select("anchor", "rows"), "shared")
        told = materialize(join_by_count(each, shared, ["anchor"]).groupBy("doc_id", "tk").agg(F.collect_set("anchor").alias("anchors")), "told")
        texts = _split(d.select("doc_id", "tk", "text").where("doc_id is not null"), told)[0]
        texts = materialize(texts.join(told, ["doc_id", "tk"]).dropDuplicates(["doc_id", "tk"]), "texts")

        windows = materialize(_windows(texts, window), "windows")
        owned = windows.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "tk", "at")).alias("first"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).where("first.doc_id < hi")
        piece = F.floor(F.col("first.at") / PIECE).cast("int").alias("piece")
        owned = materialize(owned.select("h", "h2", F.col("first.doc_id").alias("owner"), F.col("first.tk").alias("otk"), piece, "rows"), "owned")
        # a window has one owner, so a document meets the pieces that it has a window of, and no others
        met = join_by_count(windows.select("h", "h2", "doc_id", "tk"), owned, ["h", "h2"]).where("owner < doc_id")
        met = materialize(met.select("doc_id", "tk", "owner", "otk", "piece").distinct(), "met")
        wanted = met.groupBy("owner", "otk", "piece").agg(F.count("*").alias("rows"))
        of = wanted.groupBy(F.col("owner").alias("doc_id"), F.col("otk").alias("tk")).agg(F.collect_list("piece").alias("pieces"))
        pieces = _pieces(texts.select("doc_id", "tk", "text").join(of, ["doc_id", "tk"]), window)
        pieces = materialize(pieces.join(wanted, ["owner", "otk", "piece"]), "pieces")
        theirs = join_by_count(met, pieces, ["owner", "otk", "piece"]).groupBy("doc_id", "tk").agg(F.collect_list("words").alias("pieces"))
        found = _found(texts.select("doc_id", "tk", "text").join(theirs, ["doc_id", "tk"]), window).withColumn("copy", F.lit(False))
        return scope.keep(materialize(found.unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True), "repeats"))


def remove_repeats(docs: DataFrame, *, window: int = 50, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, text (what is kept, its white space unchanged), removed (word spans).

    Columns named in ``keep`` are carried in a struct ``kept``.

    A word goes if it is covered by ``window`` consecutive words whose sequence also starts in a document with a smaller
    doc_id; windows are judged on the input. Documents of fewer words keep all, as do null ids (which are no earlier
    document to any); rows of equal id don't remove each other and are judged each by their own text; null text counts
    as empty; an empty table gives no rows; other columns are not read. A window shorter than a phrase (PHRASE words) is
    refused.
    """
    if window < PHRASE:
        raise ValueError(f"a window has {PHRASE} words at least")
    d = documents_of(docs, F.struct(*(F.col(c) for c in keep)).alias("kept") if keep else F.lit(False).alias("kept"), id_col=id_col, text_col=text_col)
    d = d.withColumn("tk", F.xxhash64("text"))  # tells texts of one id apart
    repeats = _repeats(d.drop("kept"), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                n = np.diff(w.of)
                texts = part.column("text").to_pylist()
                spans, copies = (part.column(c).to_pylist() if c in part.schema.names else [None] * len(n) for c in ("removed", "copy"))
                for i, copied in enumerate(copies):
                    spans[i] = [{"start": 0, "end": int(n[i])}] if copied else spans[i] or []
                    if spans[i]:
                        raw, a = texts[i].encode(), w.of[i]
                        texts[i] = _cut(raw, w.start[a : w.of[i + 1]] - w.offsets[i], [(s["start"], s["end"]) for s in spans[i]])
                gone = [sum(s["end"] - s["start"] for s in x) for x in spans]
                cols = [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, _SPANS), part.column("kept")]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "text", "removed", "kept"])

    out = f"doc_id long, n_words long, n_removed long, text string, removed array<struct<start: long, end: long>>, kept {d.schema['kept'].dataType.simpleString()}"
    known = F.col("doc_id").isNotNull()  # rows without an id would all meet in one task
    maybe, others = _split(d.where(known), repeats, run, out)
    joined = maybe.join(repeats.hint("merge"), ["doc_id", "tk"], "left")  # planned alike at any size
    done = joined.select("doc_id", "text", "kept", "copy", "removed").mapInArrow(run, out).union(others).union(d.where(~known).mapInArrow(run, out))
    return done if keep else done.drop("kept")
