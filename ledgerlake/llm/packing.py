"""Packing token streams into training windows: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's whole windows go out at once; its rest goes to
the open window it fills best. When none has room, the fullest open window is emitted (topped up with the head of
the incoming rest when its gap is worth a cut) and a new one is opened. What is open at a partition's end is merged
there, so that one unfilled window a partition is left; those are merged in groups of ``FAN``, tree-wise, until one
window is left over all. A task holds ``open_windows`` windows or ``FAN`` leftovers, whatever the input's size.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm.common import documents_of, materialize, slices
from ledgerlake.llm.token_counts import BYTE_LEVEL_PATTERN, byte_symbols

FAN = 256  # leftovers that one task merges
LONG_RUN = 5_000  # texts with a longer run without (or of) white space go to the slower, heap-based encoder
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, part long, complete boolean"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_TYPES = [pa.int64()] * 6 + [pa.binary(), pa.int64(), pa.bool_()]

Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start in the document, ids, tokens of the document


class Encoder:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file, by the faster encoder of ``tiktoken`` where both agree."""

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = {t["content"] for t in told["added_tokens"]}
        self.fast = None
        model, first = told["model"], told["pre_tokenizer"] or {}
        plain = told["normalizer"] is None and first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]
        if plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            back = {s: b for b, s in enumerate(byte_symbols())}
            ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
            order = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
            if None not in order and order == sorted(order):  # ids follow the order of merges
                self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.ids(text), np.uint32)

    def ids(self, text: str) -> list[int]:
        ids = None
        if self.fast is not None and not any(s in text for s in self.special) and not self._long_run(text):
            ids = self.fast.encode_ordinary(text)
        if ids is None:
            ids = self.slow.encode(text, add_special_tokens=False).ids
        return ids

    @staticmethod
    def _long_run(text: str) -> bool:
        if len(text) <= LONG_RUN:
            return False
        words = text.split()
        return max(map(len, words), default=LONG_RUN + 1) > LONG_RUN or len(text) - sum(map(len, words)) - len(words) > LONG_RUN


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class OpenWindows:
    """At most ``most`` unfilled windows; ``add`` yields the windows that are emitted."""

    def __init__(self, size: int, most: int, least_cut: int):
        self.size, self.most, self.least_cut = size, most, least_cut
        self.windows: list[tuple[int, int, list[Piece]]] = []  # (gap, order, pieces), by gap
        self.order = 0

    def _put(self, gap: int, pieces: list[Piece]) -> None:
        self.order += 1
        bisect.insort(self.windows, (gap, self.order, pieces), key=lambda w: w[:2])

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        doc, start, ids, total = piece
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            yield [(doc, start + at, ids[at : at + self.size], total)]
        start, ids = start + whole, ids[whole:]
        if not len(ids):
            return
        at = bisect.bisect_left(self.windows, (len(ids), 0), key=lambda w: w[:2])
        if at < len(self.windows):
            gap, _, pieces = self.windows.pop(at)
            pieces.append((doc, start, ids, total))
            if gap == len(ids):
                yield pieces
            else:
                self._put(gap - len(ids), pieces)
            return
        if len(self.windows) >= self.most:
            gap, _, pieces = self.windows.pop(0)
            if gap >= self.least_cut:
                pieces.append((doc, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            yield pieces
        self._put(self.size - len(ids), [(doc, start, ids, total)])

    def merge(self) -> tuple[list[list[Piece]], list[Piece]]:
        """Full windows made of what is open, the emptiest poured into the fullest, and the one that stays unfilled."""
        full, windows, self.windows = [], self.windows, []
        if not windows:
            return full, []
        (gap, _, into), rest = windows[0], windows[1:]
        rest.sort(key=lambda w: w[:2])
        while rest:
            _, _, pieces = rest.pop()
            while pieces:
                doc, start, ids, total = pieces.pop()
                into.append((doc, start, ids[:gap], total))
                if len(ids) < gap:
                    gap -= len(ids)
                    continue
                full.append(into)
                if len(ids) > gap:
                    pieces.append((doc, start + gap, ids[gap:], total))
                if pieces and rest:
                    gap, _, into = rest.pop(0)
                else:  # the poured window itself is the only one left
                    into, pieces = pieces, []
                    gap = self.size - sum(len(p[2]) for p in into)
                    if not into and rest:
                        gap, _, into = rest.pop(0)
        return full, into


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """One unfilled window as sequences whose lengths are powers of two, which need no padding."""
    left, out = sum(len(p[2]) for p in pieces), []
    todo = pieces[::-1]
    while left:
        need = 1 << (left.bit_length() - 1)
        left -= need
        window: list[Piece] = []
        while need:
            doc, start, ids, total = todo.pop()
            if len(ids) > need:
                todo.append((doc, start + need, ids[need:], total))
                ids = ids[:need]
            window.append((doc, start, ids, total))
            need -= len(ids)
        out.append(window)
    return out


class _Rows:
    """Collects pieces as Arrow rows; sequence ids are dense within (round, part)."""

    def __init__(self, level: int, part: int):
        self.base, self.part, self.n = (level << 58) | (part << 32), part, 0
        self.columns: list[list] = [[] for _ in _NAMES]
        self.bytes = 0

    def put(self, pieces: list[Piece], complete: bool = True) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            for column, value in zip(self.columns, (doc, start, len(ids), total, self.base + self.n, offset, raw, self.part, complete), strict=True):
                column.append(value)
            offset += len(ids)
            self.bytes += len(raw)
        self.n += bool(pieces)

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, _TYPES, strict=True)], _NAMES)
        self.columns, self.bytes = [[] for _ in _NAMES], 0
        return out


def _merger(level: int, size: int, last: bool):
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        """Merge the leftovers (at most FAN unfilled windows) of one group."""
        windows: dict[int, list] = {}
        for r in sorted(rows.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"])):
            windows.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
        held = OpenWindows(size, len(windows), 1)
        for pieces in windows.values():
            held._put(size - sum(len(p[2]) for p in pieces), pieces)
        full, rest = held.merge()
        out = _Rows(level, key[0].as_py())
        for pieces in full:
            out.put(pieces)
        for pieces in powers_of_two(rest) if last else []:
            out.put(pieces)
        if not last:
            out.put(rest, complete=False)
        return pa.Table.from_batches([out.take()])

    return merge


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, window: int = 2048, open_windows: int = 64, end_id: int = 1, least_cut: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack all rows into sequences of at most ``window`` tokens; one row per piece.

    A document is its ids and then ``end_id``. Columns: doc_id, start, length, doc_tokens, sequence_id, offset, ids
    (little-endian unsigned 32-bit). Each id of each row lies in exactly one piece; offsets of a sequence are gapless
    from 0. Every sequence but those with gaps under ``least_cut`` is full; the last one over all is cut at powers of
    two. Null and empty texts give one piece that holds ``end_id``; a null id stays null; repeated rows are packed once
    each; an empty table gives no rows; other columns are not read.

    The tokenized, packed table is written once to the shared folder, since leftovers are merged from it; nothing else
    than leftovers is shuffled.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        held, out = OpenWindows(window, open_windows, least_cut), _Rows(0, part)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for rows in slices(batch, "text"):
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    ids = np.concatenate([encode(text), end])
                    for pieces in held.add((doc, 0, ids, len(ids))):
                        out.put(pieces)
                    if out.bytes > 8 << 20:
                        yield out.take()
        full, rest = held.merge()
        for pieces in full:
            out.put(pieces)
        out.put(rest, complete=False)
        yield out.take()

    packed = materialize(documents_of(docs, id_col=id_col, text_col=text_col).mapInArrow(pack, PIECES), "packed")
    result, left, level = packed.where("complete"), packed.where("not complete"), 1
    parts = left.agg(F.max("part")).first()[0]
    while parts is not None:
        last = parts < FAN
        left = left.groupBy(F.expr(f"part div {FAN}").alias("grp")).applyInArrow(_merger(level, window, last), PIECES)
        result = result.unionByName(left.where("complete"))
        left = left.where("not complete")
        parts, level = (None if last else parts // FAN), level + 1
    return result.drop("part", "complete")
