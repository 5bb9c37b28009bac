"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct new pre-tokens of a stretch of a partition are laid out in one
array of symbols with links to both neighbours. An index maps each mergeable
pair to all its positions there. Ranks that occur are applied in ascending
order, each to all its positions at once; the pairs that a merge makes are
added to the lists of their ranks. Pre-tokens are then kept in a bounded table.

A vocabulary file of the tokenizers library (byte-level BPE) is read on the
driver and sent with the tasks; its size does not depend on the data.

Defined results
- null text counts as empty; an empty text has no ids and decodes to an empty text; null ids decode to null.
- strings of added tokens within a text become their ids, as the library does by default.
- a vocabulary file with options that are not handled here (a normalizer, other pre-tokenizers, dropout, flags of added tokens) raises.
- ids outside the vocabulary raise; bytes that are no UTF-8 decode to U+FFFD.
- repeated rows are encoded alike; other columns are kept, one called as a new one is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept by a Python worker, and bytes of text that are encoded together.
KEPT_PIECES, STRETCH_BYTES = 300_000, 8_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself, or the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


def _first_characters() -> re.Pattern:
    """PATTERN for texts of the first 256 characters: their classes as plain sets, which the standard library matches faster."""
    letters, digits, spaces = ("".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))


#: What a vocabulary file may say besides its tokens: part, option, values that mean what is done here.
_HANDLED = (
    ("normalizer", None, (None,)), ("pre_tokenizer", "type", ("ByteLevel",)), ("pre_tokenizer", "add_prefix_space", (False,)), ("pre_tokenizer", "use_regex", (True, None)), ("decoder", "type", ("ByteLevel",)),
    ("model", "type", ("BPE", None)), ("model", "dropout", (None, 0.0)), ("model", "continuing_subword_prefix", (None, "")), ("model", "end_of_word_suffix", (None, "")), ("model", "byte_fallback", (False, None)), ("model", "ignore_merges", (False, None)),
)


def _check(data: dict) -> None:
    for part, option, values in _HANDLED:
        held = data.get(part)
        if (held if option is None else (held or {}).get(option)) not in values:
            raise ValueError(f"{part} {option or ''} of this vocabulary is not handled: {held}")
    for t in data.get("added_tokens", []):
        if any(t.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"flags of added token {t['content']!r} are not handled")


class _Pieces(dict):
    """Pre-token -> number; unknown ones get the next number and are noted in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        self[piece] = i = len(self)
        return i


def _gather(store: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The pieces store[start : start + count], one after the other."""
    ends = np.cumsum(count)
    return store[np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        _check(data)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = np.array([vocab[s] for s in symbols], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys, self.left, self.right = keys[self.order], left, right
        first = np.full(max(vocab.values()) + 1, -1)
        first[self.made] = np.arange(len(pairs))
        later = np.arange(len(pairs))
        # A pair never ranks before the merges that make its parts; else all positions of a rank could not be merged at once.
        if len(set(self.made.tolist())) != len(pairs) or (first[left] >= later).any() or (first[right] >= later).any():
            raise ValueError("the merges are not in the order of their making")
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes | None] = [None] * size
        for token, i in vocab.items():
            if token not in self.added:
                self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.pattern, self.first_pattern = regex.compile(PATTERN), _first_characters()
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._forget()

    def _forget(self) -> None:
        self.kept = _Pieces()
        self.store, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        if not len(flat):
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        n = len(flat)
        symbol = np.append(self.byte_ids[flat], -1)  # the last one stands for "no neighbour"
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[-1] = n
        after[ends[lengths > 0] - 1] = n
        before[(ends - lengths)[lengths > 0]] = n
        alive = np.ones(n, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self._ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.append(0, cut)].tolist(), np.split(at, cut) if len(cut) else (at,), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        at = np.flatnonzero(after[:-1] != n)
        if len(at):
            add(at)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else _distinct(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (symbol[at] == a)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # in a run of equal symbols every other pair merges, from the left
                taken, last = [], -1
                for p in at.tolist():
                    if p != last:
                        taken.append(p)
                        last = after[p]
                at = np.array(taken, dtype=np.int64)
            if not len(at):
                continue
            gone = after[at]
            then = after[gone]
            alive[gone] = False
            symbol[at] = self.made[r]
            after[at] = then
            before[then] = at
            left = before[at]
            around = np.concatenate([left[left != n], at[then != n]])
            if len(around):
                add(_distinct(around))
        counts = np.zeros(len(words), dtype=np.int64)
        counts[lengths > 0] = np.add.reduceat(alive, (ends - lengths)[lengths > 0], dtype=np.int64)
        return symbol[:-1][alive].astype(np.int32), counts

    def _pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.first_pattern.findall(text)

    def _split(self, text: str) -> list[str]:
        if self.split_added is None or not any(a in text for a in self.added):
            return self._pieces(text)
        parts = self.split_added.split(text)
        return list(chain.from_iterable([p] if p in self.added else self._pieces(p) for p in parts))

    def encode_all(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the borders between texts."""
        if len(self.kept) > KEPT_PIECES:
            self._forget()
        if not self.kept:
            for token, i in self.added.items():
                self._keep([self.kept[token]], np.array([i], np.int32), np.array([1]))
            self.kept.fresh.clear()
        number = self.kept.__getitem__
        used = []
        for t in texts:
            parts = self._split(t)
            used.append(np.fromiter(map(number, parts), dtype=np.int64, count=len(parts)))
        fresh, self.kept.fresh = self.kept.fresh, []
        self._keep(fresh, *self.merge([p.encode() for p in fresh]))
        flat = np.concatenate(used) if used else np.empty(0, np.int64)
        count = self.count[flat]
        ends = np.append(0, np.cumsum(count))
        return _gather(self.store, self.start[flat], count), ends[np.append(0, np.cumsum([len(u) for u in used], dtype=np.int64))]

    def _keep(self, pieces: Sequence, ids: np.ndarray, counts: np.ndarray) -> None:
        if len(pieces):
            self.start = np.append(self.start, len(self.store) + np.cumsum(counts) - counts)
            self.count = np.append(self.count, counts)
            self.store = np.append(self.store, ids)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _distinct(at: np.ndarray) -> np.ndarray:
    at = np.sort(at)
    return at[np.append(True, at[1:] != at[:-1])]


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """One codec by worker process and vocabulary."""
    if spec not in _codecs:
        _codecs.clear()
        _codecs[spec] = Codec(spec)
    return _codecs[spec]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def stretches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.Table, list[str]]]:
    """Batches put together up to STRETCH_BYTES, with their texts."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(text).nbytes
        if size >= STRETCH_BYTES:
            t = pa.Table.from_batches(held)
            yield t, [x or "" for x in t.column(text).to_pylist()]
            held, size = [], 0
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t, [x or "" for x in t.column(text).to_pylist()]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds the ids of each text, and what they decode to if `decoded` names a column. keep: the columns to return besides, all by default."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    new = [ids, *([decoded] if decoded else [])]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    fields = [docs.schema[c] for c in kept]
    out = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    names = [*kept, *new]
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for rows, texts in stretches(batches, text):
            flat, ends = c.encode_all(texts)
            cols = [rows.column(k).combine_chunks().cast(t) for k, t in zip(kept, types, strict=True)]
            cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)))
            if decoded:
                cols.append(pa.array([c.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    used = list(dict.fromkeys([*kept, text]))
    return docs.select(*used).mapInArrow(run, out)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each list of ids."""
    from pyspark.sql import functions as F

    spec = rows.sparkSession.sparkContext.broadcast(read_spec(path))

    @F.pandas_udf("string")
    def run(lists):
        c = codec(spec.value)
        return lists.map(lambda x: None if x is None else c.decode(x))

    return rows.withColumn(out, run(ids))
