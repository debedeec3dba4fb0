"""Token counts by heap-and-linked-list byte-pair merging.

The count of a word is its number of initial symbols minus the merges that apply to it, so no identifiers are
made. Merges are found by a heap of adjacent pairs (lowest rank first, leftmost of equals) over a doubly linked
list of symbols, which takes O(n log n) for a word of n symbols however long it is.

Spark deals out the documents; a Python worker keeps the counts of words it has met, in a dictionary of bounded
size, and reads the tokenizer's file once. The file must be found at the same path on every executor.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import documents_of, slices

#: A worker forgets the counts it has kept when there are this many.
KEPT_WORDS = 1_000_000

#: The splitting pattern of a byte-level pre-tokenizer that uses its own (fixed value of the format).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    return [s for _, s in sorted([(b, chr(b)) for b in shown] + [(b, chr(256 + i)) for i, b in enumerate(rest)])]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols that are left once every pair of ``ranks`` is merged, lowest rank first."""
    n = len(symbols)
    if n < 2:
        return n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    left = n
    while heap:
        rank, i = heapq.heappop(heap)
        a = symbols[i]
        j = after[i]
        if a is None or j >= n or ranks.get((a, symbols[j])) != rank:
            continue  # one of the two symbols has been merged meanwhile
        a = symbols[i] = a + symbols[j]
        symbols[j] = None
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((a, symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], a))) is not None:
            heapq.heappush(heap, (r, h))
    return left


class Counter:
    """Counts the tokens of texts as the tokenizer in a ``tokenizers`` JSON file would emit them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain byte-pair models are counted")
        pairs = (m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.bytes = byte_symbols()
        self.lower = self.nfc = False
        steps = told.get("normalizer")
        for step in [] if steps is None else steps.get("normalizers", [steps]):
            if step["type"] == "NFC":
                self.nfc = True
            elif step["type"] == "Lowercase":
                self.lower = True
            elif step["type"] != "Replace" or step["pattern"] != {"Regex": r"\s+"} or step["content"] != " ":
                raise ValueError(f"{path}: unknown normalizer {step}")
        first = told["pre_tokenizer"].get("pretokenizers", [told["pre_tokenizer"]])
        self.apart = first[0]["type"] == "Split"  # white space is dropped: words can be counted one by one
        if self.apart:
            if first[0]["behavior"] != "Removed" or not first[0]["invert"]:
                raise ValueError(f"{path}: unknown pre-tokenizer {first[0]}")
            self.pattern = regex.compile(first[0]["pattern"]["Regex"])
        else:
            self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        special = [t["content"] for t in told.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = {s[:2] for s in special}
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def _part(self, part: str) -> int:
        n = self.parts.get(part)
        if n is None:
            table = self.bytes
            symbols = [table[b] for b in part.encode()]
            symbols[-1] += self.suffix
            if len(self.parts) >= KEPT_WORDS:
                self.parts.clear()
            n = self.parts[part] = merged_length(symbols, self.ranks)
        return n

    def _plain(self, text: str) -> int:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # one character at a time, unlike Python's rule for a final sigma
            text = text.replace("Σ", "σ").lower()
        if not self.apart or any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes these four as white space
            return sum(map(self._part, self.pattern.findall(text)))
        words, total = self.words, 0
        for w in text.split():
            n = words.get(w)
            if n is None:
                if len(words) >= KEPT_WORDS:
                    words.clear()
                n = words[w] = sum(map(self._part, self.pattern.findall(w)))
            total += n
        return total

    def __call__(self, text: str) -> int:
        if self.special is not None and any(m in text for m in self.marks):
            pieces = self.special.split(text)
            return len(pieces) - 1 + sum(map(self._plain, pieces))
        return self._plain(text)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No begin, end or other special tokens are added; special strings inside a text count as one token each, as the
    library takes them by default. Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated
    rows give repeated results; other columns, whatever their names, are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                n = [count(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.binary_length(part.column("text")).cast(pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
                )

    counted = documents_of(docs, id_col=id_col, text_col=text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
