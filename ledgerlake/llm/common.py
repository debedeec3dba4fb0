"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master may go without, not a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^-].*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-ledgerlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)  # folders written in the innermost open scope
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back, which cuts its lineage.

    What was shuffled for it is deleted at once, since nothing will ask for it again.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/ledgerlake/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(at)  # a plan of its own, made under that setting
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if (made := _MADE.get()) is not None:
        made.append(at)
    return spark.read.schema(df.schema).parquet(at)


def delete(spark: SparkSession, folders: Iterable[str]) -> None:
    for at in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folders_of(df: DataFrame) -> set[str]:
    """Folders written by ``materialize`` that a table reads."""
    return {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/ledgerlake/" in f}


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nobody reads any more."""
    delete(df.sparkSession, folders_of(df))


class Scope:
    """Tables that are materialized inside ``with Scope(spark) as s`` are deleted at its end, but for those that
    ``s.keep`` was given, which the surrounding scope then has."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], set()

    def __enter__(self) -> Scope:
        self.outer, self.token = _MADE.get(), _MADE.set(self.made)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept |= {f.rsplit("/", 1)[1] for f in folders_of(df)}
        return df

    def __exit__(self, *_) -> None:
        _MADE.reset(self.token)
        stay = [at for at in self.made if at.rsplit("/", 1)[1] in self.kept]
        if self.outer is not None:
            self.outer += stay
        delete(self.spark, (at for at in self.made if at not in stay))


def few_parts(sample: DataFrame) -> DataFrame:
    """A bounded sample in as many partitions as there are cores, eight at most."""
    return sample.coalesce(max(1, min(8, sample.sparkSession.sparkContext.defaultParallelism)))


HOT_KEYS = 10_000


def join_by_count(rows: DataFrame, keys: DataFrame, on: list[str], count: str = "rows", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keys``, a written table of one row a key that says in ``count`` how many of ``rows`` have it.

    Keys that hold more than one in HOT_KEYS of all rows are at most so many; they are broadcast, so that their rows stay
    where they are. Rows of the others are shuffled, of which no key has more than that share. ``count`` is dropped.
    """
    total = keys.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    least = max(64, total // HOT_KEYS)
    hot, rest = keys.where(F.col(count) > least).drop(count), keys.where(F.col(count) <= least).drop(count)
    met = rows.join(F.broadcast(hot), on)
    return met.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how))


def hot_parts(rows: DataFrame, on: str) -> DataFrame:
    """Keys with more than one in HOT_KEYS of all rows (a written table), and in how many parts to deal theirs out."""
    least = max(64, rows.count() // HOT_KEYS)
    return rows.groupBy(on).agg(F.count("*").alias("n")).where(F.col("n") > least).select(on, F.ceil(F.col("n") / least).cast("int").alias("__parts"))


def join_wide(rows: DataFrame, keys: DataFrame, on: str, by: str, hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``keys``, which has one row a key, but a long one.

    Rows of keys in ``hot`` (``hot_parts``) are dealt out by the column ``by`` over copies of the key's row; there are at
    most two such copies for each HOT_KEYS-th part of the rows.
    """
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    copied = keys.join(F.broadcast(hot), on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [on, "__part"]).drop("__part")


def documents_of(docs: DataFrame, *extra: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text under fixed names (null text: empty), so that other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *extra)


# ---- word hashes over Arrow buffers -------------------------------------------------------------------

_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[[ord(c) for c in SEPARATORS]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(256, dtype=np.uint64) + np.uint64(7919))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_WORD_BASE, _GRAM_BASE = 0xD1342543DE82EF95, 0xDA942042E4DD58B5
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the next call."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        made = []
        for b in (base, _inverse(base)):
            p = np.ones(size, np.uint64)
            step, done = b, 1
            while done < size:  # doubling: p[done:2*done] = p[:done] * b**done
                p[done : 2 * done] = p[:done] * np.uint64(step)
                step, done = step * step % (1 << 64), 2 * done
            made.append(p)
        known = _POWERS[base] = (made[0], made[1])
    return known[0][:n], known[1][:n]


def _ranges(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end], from prefix sums modulo 2**64."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[end] - total[start]) * down[start]


class Words:
    """Word boundaries and 64-bit word hashes of a batch of texts; ``of[i]:of[i+1]`` are the words of text i."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        self.raw, self.offsets = raw, offsets
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = _IS_SEPARATOR[raw]
        first = ~gap[1:-1] & gap[:-2]
        last = ~gap[1:-1] & gap[2:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        first[inner] = ~gap[1:-1][inner]  # a text's first byte starts a word of its own
        last[inner - 1] = ~gap[1:-1][inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offsets)
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix(_ranges(_BYTE_VALUE[raw], _WORD_BASE, self.start, self.end) + size * _ODD) if len(raw) else np.zeros(0, np.uint64)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the k words from each word on; those within k - 1 words of a text's end run on and are the caller's to drop."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        at = np.arange(n)
        return mix(_ranges(self.hash, _GRAM_BASE, at, at + k))

    def gram_starts(self, k: int) -> np.ndarray:
        """The words from which k words of the same text follow."""
        n = len(self.hash)
        if n == 0:
            return np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))
        at = np.arange(n)
        return at[at + k <= self.of[1:][text]]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Consecutive slices of a batch whose texts have about ``most`` bytes; a longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    at = 0
    total = np.cumsum(sizes)
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


# ---- a filter of fixed size -------------------------------------------------------------------------

FILTER_WORDS = 1 << 20  # of 64 bits: 8 MB, whatever is put in


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of fixed size over the longs in a column. When it fills up it lets more through, never less."""
    at = F.explode(F.array(F.xxhash64(column, F.lit(1)), F.xxhash64(column, F.lit(2)))).alias("h")
    bits = ids.select(at).select(F.pmod("h", F.lit(FILTER_WORDS)).cast("int").alias("word"), F.shiftrightunsigned("h", 58).cast("int").alias("bit"))
    told = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()  # FILTER_WORDS rows at most
    out = np.zeros(FILTER_WORDS, np.int64)
    out[told.column("word").to_numpy()] = told.column("bits").to_numpy()
    return out


def with_filter_places(df: DataFrame, column: str) -> DataFrame:
    """Add the hashes that ``passes`` looks up."""
    return df.withColumn("__h1", F.xxhash64(column, F.lit(1))).withColumn("__h2", F.xxhash64(column, F.lit(2)))


def passes(bits: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h1), bool)
    for h in (h1, h2):
        ok &= (bits[h % FILTER_WORDS] >> (h.view(np.uint64) >> np.uint64(58)).astype(np.int64)) & 1 == 1
    return ok
