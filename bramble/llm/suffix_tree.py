"""Language-model scores from a probabilistic suffix tree over words.

Words are whitespace-separated after lower-casing A-Z; a text is a start, its words and one
end token. A state of the tree is a context: up to DEPTH symbols before a token, the start among
them. Contexts are of variable length. One is retained if its next symbols diverge enough from
those of the context one shorter: the log-likelihood that it gains over all its training
occurrences must pay PENALTY nats for each distinct next symbol. A context of k symbols must occur
k times, and twice at least. These floors do not rise with the corpus, so what is learned grows
with the training texts.

The root is the add-one unigram (one more place for all unseen words). A retained context s that
occurs n(s) times with T(s) distinct next symbols smooths its counts by the distribution q of its
longest retained suffix: P(w | s) = (n(s, w) + T(s) q(w)) / (n(s) + T(s)). Every distribution adds
up to 1. A token is scored by its longest retained context.

Counting is an exchange between blocks of whole texts and owners of ranges of 64-bit hashes.
Round by round, a block sends the distinct sequences whose counts it must know, with its own
counts, and owners answer with totals. Left out, without loss, are sequences
- whose context occurs too seldom;
- whose context without its first symbol has a single next symbol: longer contexts cannot gain
  anything over it;
- of held-out texts, if the training texts lack the sequence without its first symbol.
A sequence that several blocks have is told to one of them to be its first; so distinct next
symbols are counted by context. Contexts go to owners one round later, with the number of
distinct next symbols and the gain; these say which are retained.

Only messages are shuffled, pre-aggregated by block, so a word or a text that fills a third of
the corpus is a row of each block's message. A block's tokens and counts are files in the shared
folder, named anew by each attempt of a task; a reply names the files that belong to it.

Memory: a task holds one block (about 120 bytes a token, BLOCK_BYTES of text) or what one owner was
sent (the number of owners grows with the text, OWNER_BYTES). Nothing is broadcast.

Defined results
- null text counts as empty: it has the end token alone.
- without training documents every term is log10(1) = 0.
- rows may repeat, null ids included; words may have any length. Words are known by 64-bit hashes, sequences by hashes of SPARE_BITS more bits than the text's size has, 64 at most: one in 2**SPARE_BITS or fewer meets another one. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bramble.llm import files
from bramble.llm.common import drop_dir, fresh_dir, partitions

DEPTH = 5
#: Nats that each distinct next symbol of a retained context must gain.
PENALTY = 2.0
#: Text of a block (less where there are fewer than two blocks a partition; the last one of a partition has half as much more at most), and text for each owner.
BLOCK_BYTES, OWNER_BYTES = 14_000_000, 16_000_000
SPARE_BITS = 24
START, END = 0, 1  # symbols of a block; its words follow

_MESSAGE = "block long, files string, owner int, keys binary, n binary, contexts binary, kinds binary, gain binary"
_REPLY = "block long, files string, owner int, n binary, first binary, kinds binary, tokens long, types long"


def least_count(length: int) -> int:
    """Training occurrences that a context needs; never fewer for a longer one."""
    return max(2, length)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on as byte planes of the least width: high planes are mostly zero and compress."""
    a = np.ascontiguousarray(a).astype("<u8", copy=False)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<i8").ravel()


def _least_key(owner: int, owners: int, bits: int) -> np.uint64:
    """Owners have equal ranges of keys."""
    return np.uint64(-(-(owner << bits) // owners))


def _pack_keys(sorted_keys: np.ndarray, least: np.uint64) -> bytes:
    """Differences, the first one from the least key of the owner."""
    return _pack(np.diff(sorted_keys, prepend=least))


def _unpack_keys(raw: bytes, least: np.uint64) -> np.ndarray:
    return np.cumsum(_unpack(raw).view(np.uint64), dtype=np.uint64) + least


class _Symbols(dict):
    """Word -> number in the block, in the order of their first places."""

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self) + 2
        return i


def _save(uri: str, arrays: dict[str, np.ndarray], doc_id: pa.Array | None = None) -> None:
    columns = {k: pa.array([_pack(v)], pa.large_binary()) for k, v in arrays.items()}
    if doc_id is not None:
        columns["doc_id"] = pa.ListArray.from_arrays(pa.array([0, len(doc_id)], pa.int32()), doc_id)
    t = pa.table(columns)
    with files.open_new(uri) as out, pa.ipc.new_file(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)


def _load(uri: str) -> pa.Table:
    with files.open_old(uri) as f:
        return pa.ipc.open_file(f).read_all()


def _array(t: pa.Table, column: str) -> np.ndarray:
    return _unpack(t.column(column)[0].as_py())


class _Block:
    """The places of a block (each text's start, words and end) and what is known of them so far.

    ``n[k]`` has by place the training count of the k + 1 symbols that end there; it is exact where the place is live
    and wherever it may reach least_count. ``live[k]`` are the places whose context of length k + 1 matters: it occurs often
    enough and no shorter one there has a single next symbol. Only the last ones are held.
    """

    def __init__(self, paths: list[str], bits: int):
        head = _load(paths[0])
        self.later, self.shift = paths[1:], np.uint64(64 - bits)
        self.doc_id = head.column("doc_id")[0].values
        self.hash, self.symbol, self.size = _array(head, "hash").view(np.uint64), _array(head, "symbol").astype(np.int32), _array(head, "size")
        whole = self.size + 1
        self.starts = np.cumsum(whole) - whole
        self.place = (np.arange(len(self.symbol)) - np.repeat(self.starts, whole)).astype(np.int32)
        self.train_texts = _array(head, "train").astype(bool)
        self.train = np.repeat(self.train_texts, whole)
        self.n: list[np.ndarray | None] = []
        self.live: list[np.ndarray | None] = []

    def levels(self) -> Iterator[int]:
        """Reads what is known of sequences, length by length."""
        for path in self.later:
            n = _array(_load(path), "n")
            if self.n:
                known = self._blank()
                known[self.live[-1]] = n
                n = known
            else:
                n = n[self.symbol]
            self.known(n)
            yield len(self.n) - 1

    def _blank(self) -> np.ndarray:
        """Counts where nothing was asked: once at most, and as the context before, which has no other next symbol, where settled."""
        n = self.train.astype(np.int64)
        n[self.settled] = self.n[-1][self.settled - 1]
        return n

    def known(self, n: np.ndarray) -> None:
        """Takes the next counts and finds the places that are live for contexts one longer."""
        k = len(self.n)
        self.n.append(n)
        if not k:
            self.settled = np.empty(0, np.int32)
            at = np.flatnonzero(self.place >= 1).astype(np.int32)
        else:
            at = self.live[-1]
            done = n[at] == self.n[k - 1][at - 1]
            self.settled = np.concatenate([self.settled, at[done]])
            at = at[~done & (self.place[at] > k)]
        self.live.append(at[n[at - 1] >= least_count(k + 1)])
        if k > 2:
            self.n[k - 3] = None
        if k > 1:
            self.live[k - 2] = None

    def grams(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the symbols that end at these places."""
        h = self.hash[self.symbol[at - (length - 1)]]
        for back in range(length - 2, -1, -1):
            h = _mix(h, self.hash[self.symbol[at - back]])
        return h >> self.shift

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Live places whose sequence's count must be asked for, the distinct sequences in order, and their numbers by place."""
        k, at = len(self.n), self.live[-1]
        at = at[self.n[k - 1][at] > 0]
        return at, *np.unique(self.grams(at, k + 1), return_inverse=True)

    def learn(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes the answers; returns the counts by live place, and for each distinct sequence a place of it."""
        at, keys, number = self.asked()
        live, n = self.live[-1], self._blank()
        n[at] = total[number]
        where = np.zeros(len(keys), np.int32)
        where[number] = at
        self.known(n)
        return n[live], where

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct contexts of the live places for length k in order, and their numbers by place."""
        return np.unique(self.grams(self.live[k - 1] - 1, k), return_inverse=True)

    def weigh(self, n_all: int, where: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the last length: its distinct contexts, and what this block's training texts add to their distinct next symbols and to their gain.

        where: a place of each distinct sequence that was asked for; first: whether it counts here.
        """
        k = len(self.n) - 1
        live = self.live[k - 1]
        keys, number = self.contexts(k)
        by_place = np.zeros(len(self.symbol), np.int32)
        by_place[live] = number
        kinds = np.bincount(by_place[where[first]], minlength=len(keys))
        at = live[self.train[live]]
        longer = np.log(self.n[k][at] / self.n[k - 1][at - 1])
        shorter = np.log(self.n[k - 1][at] / (n_all if k == 1 else self.n[k - 2][at - 1]))
        return keys, kinds, np.bincount(by_place[at], longer - shorter, len(keys))

    def smoothed(self, q: np.ndarray, kinds: np.ndarray) -> None:
        """Moves probabilities by place on to the retained contexts of the last length. kinds: by distinct context, 0 if it is not retained."""
        k = len(self.n) - 1
        live = self.live[k - 1]
        if len(live):
            t = kinds[self.contexts(k)[1]]
            live, t = live[t > 0], t[t > 0]
            q[live] = (self.n[k][live] + t * q[live]) / (self.n[k - 1][live - 1] + t)


def _messages(block: int, names: str, owners: int, bits: int, keys: np.ndarray, n: np.ndarray, contexts: np.ndarray, kinds: np.ndarray, gain: np.ndarray) -> pa.Table:
    """A row for each owner that gets something, and one at least. keys and contexts are in order."""
    least = [_least_key(o, owners, bits) for o in range(owners)]
    borders = np.array(least[1:], np.uint64)
    a, b = (np.concatenate([[0], np.searchsorted(x, borders), [len(x)]]) for x in (keys, contexts))
    rows = [
        (block, names, o, _pack_keys(keys[a[o] : a[o + 1]], least[o]), _pack(n[a[o] : a[o + 1]]), _pack_keys(contexts[b[o] : b[o + 1]], least[o]), _pack(kinds[b[o] : b[o + 1]]), gain[b[o] : b[o + 1]].astype(np.float32).tobytes())
        for o in range(owners)
        if a[o + 1] > a[o] or b[o + 1] > b[o] or o == block % owners
    ]
    kinds_of = (pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * 5)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds_of, strict=True)], names=[c.split()[0] for c in _MESSAGE.split(", ")])


def _answer(rows: pa.Table, owners: int, bits: int) -> pa.Table:
    """At an owner: totals of what all blocks sent, in the order that each sent it."""
    rows = rows.sort_by("block")
    least = _least_key(rows.column("owner")[0].as_py(), owners, bits)
    column = lambda c: rows.column(c).to_pylist()

    def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])[:-1].tolist()

    keys, cuts = joined([_unpack_keys(x, least) for x in column("keys")])
    own = np.concatenate([_unpack(x) for x in column("n")])
    distinct, number = np.unique(keys, return_inverse=True)
    total = np.bincount(number, own, len(distinct)).astype(np.int64)
    lead = np.full(len(distinct), -1)
    learned = np.flatnonzero(own)[::-1]
    lead[number[learned]] = learned  # of repeated places the last one written, so the first, stays
    first = np.zeros(len(keys), bool)
    first[lead[lead >= 0]] = True

    contexts, context_cuts = joined([_unpack_keys(x, least) for x in column("contexts")])
    distinct_contexts, of = np.unique(contexts, return_inverse=True)
    kinds = np.bincount(of, np.concatenate([_unpack(x) for x in column("kinds")]), len(distinct_contexts)).astype(np.int64)
    gain = np.bincount(of, np.concatenate([np.frombuffer(x, np.float32) for x in column("gain")]), len(distinct_contexts))
    kinds[gain < PENALTY * kinds] = 0

    split = lambda a, at: np.split(a, at)
    sums = np.zeros((2, rows.num_rows), np.int64)
    sums[:, 0] = total.sum(), (total > 0).sum()
    return pa.table({
        "block": rows.column("block"), "files": rows.column("files"), "owner": rows.column("owner"),
        "n": pa.array([_pack(x) for x in split(total[number], cuts)], pa.binary()),
        "first": pa.array([np.packbits(x).tobytes() for x in split(first, cuts)], pa.binary()),
        "kinds": pa.array([_pack(x) for x in split(kinds[of], context_cuts)], pa.binary()),
        "tokens": pa.array(sums[0]), "types": pa.array(sums[1]),
    })


class _Replies:
    """What a block was told by all owners."""

    def __init__(self, rows: pa.Table, directory: str):
        rows = rows.sort_by("owner")
        self.names = rows.column("files")[0].as_py()
        self.files = [f"{directory}/{name}" for name in self.names.split(" ")]
        self.block = rows.column("block")[0].as_py()
        n = [_unpack(x) for x in rows.column("n").to_pylist()]
        self.n = np.concatenate(n)
        self.first = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(rows.column("first").to_pylist(), n, strict=True)]).astype(bool)
        self.kinds = np.concatenate([_unpack(x) for x in rows.column("kinds").to_pylist()])


_NONE = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0)


def _tokens(directory: str, owners: int, block_bytes: int):
    """Cuts a partition into blocks: writes their tokens and sends their distinct words."""

    def block(number: int, doc_id: list[pa.Array], texts: list[str], train: list[bool]) -> Iterator[pa.RecordBatch]:
        symbols, parts = _Symbols(), []
        for t in texts:
            words = words_of(t)
            parts.append(np.fromiter(map(symbols.__getitem__, words), np.int64, len(words)))
        size = np.array([len(p) + 1 for p in parts], np.int64)
        ends = np.cumsum(size + 1)
        at = np.zeros(int(ends[-1]), np.int64)
        inner = np.ones(len(at), bool)
        inner[ends - 1] = inner[ends - size - 1] = False
        at[inner], at[ends - 1] = np.concatenate(parts), END
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, (b"\n\n", b"\n", *symbols)), np.uint64, len(symbols) + 2)  # no word has a line feed
        learned = np.repeat(np.array(train, bool), size + 1)
        learned[ends - size - 1] = False  # the start is no token
        path = files.new_name(directory, number, ".tokens")
        _save(path, {"hash": hashes, "symbol": at, "size": size, "train": np.array(train, np.uint64)}, pa.concat_arrays(doc_id))
        order = np.argsort(hashes[1:]) + 1
        n = np.bincount(at[learned], minlength=len(hashes))[order]
        yield from _messages(number, path.rpartition("/")[2], owners, 64, hashes[order], n, *_NONE).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, piece = TaskContext.get().partitionId(), 0
        doc_id, texts, train, held = [], [], [], 0
        full: tuple | None = None  # waits until what follows is half a block
        for b in batches:
            if not b.num_rows:
                continue
            doc_id.append(b.column("doc_id"))
            texts += b.column("text").to_pylist()
            train += b.column("train").to_pylist()
            held += b.column("text").nbytes
            if full and held >= block_bytes // 2:
                yield from block(task << 24 | piece, *full)
                full, piece = None, piece + 1
            if held >= block_bytes:
                full, doc_id, texts, train, held = (doc_id, texts, train), [], [], [], 0
        if full or texts:
            before = full or ([], [], [])
            yield from block(task << 24 | piece, before[0] + doc_id, before[1] + texts, before[2] + train)

    return run


def _word_counts(told: _Replies, hashes: np.ndarray) -> np.ndarray:
    """By symbol; the start has as many as the end."""
    count = np.zeros(len(told.n) + 1, np.int64)
    count[np.argsort(hashes[1:]) + 1] = told.n
    count[START] = count[END]
    return count


def _step(directory: str, owners: int, bits: int, k: int, depth: int, n_all: int):
    """Takes the counts of sequences of k + 1 symbols; asks for those one longer, and sends the contexts of length k."""

    def run(rows: pa.Table) -> pa.Table:
        told = _Replies(rows, directory)
        path = files.new_name(directory, told.block, f".{k}")
        b = _Block(told.files, bits)
        for _ in b.levels():
            pass
        if k == 0:
            count, sent = _word_counts(told, b.hash), _NONE
            _save(path, {"n": count})
            b.known(count[b.symbol])
        else:
            n, where = b.learn(told.n)
            sent = b.weigh(n_all, where, told.first)
            _save(path, {"n": n} | ({"kinds": told.kinds} if k > 1 else {}))
        keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        if k < depth:
            at, keys, number = b.asked()
            n = np.bincount(number, b.train[at], len(keys)).astype(np.int64)
        return _messages(told.block, f"{told.names} {path.rpartition('/')[2]}", owners, bits, keys, n, *sent)

    return run


def _scores(directory: str, n_all: int, types: int, bits: int):
    def run(rows: pa.Table) -> pa.Table:
        told = _Replies(rows, directory)
        b = _Block(told.files, bits)
        # The file of a length has what was told of contexts one shorter; the last ones come with the replies.
        kinds = [_array(t, "kinds") for t in map(_load, b.later) if "kinds" in t.column_names] + [told.kinds]
        if not b.later:  # the tree is its root
            b.known(_word_counts(told, b.hash)[b.symbol])
            count = b.n[0]
            root = (count + 1) / (n_all + types + 1)
            q = root
        for k in b.levels():
            if not k:
                count = b.n[0]
                root = (count + 1) / (n_all + types + 1)
                q = root.copy()
            else:
                b.smoothed(q, kinds[k - 1])
        token = b.place > 0
        add_up = lambda x: np.add.reduceat(np.where(token, x, 0), b.starts)
        return pa.table({
            "doc_id": b.doc_id, "train": pa.array(b.train_texts), "n_tokens": pa.array(b.size), "n_known": pa.array(add_up((count > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(b.size), n_all, np.int64)), "base_score": pa.array(add_up(np.log10(root))), "score": pa.array(add_up(np.log10(q))),
        })

    return run


def score(docs: DataFrame, train_on: Column, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per row of docs: doc_id, train, n_tokens, n_known, train_tokens, base_score, score. train_on: which rows to learn from."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train_on, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(partitions(spark), math.ceil(size / OWNER_BYTES))
    block_bytes = min(BLOCK_BYTES, max(1_000_000, size // (2 * partitions(spark))))
    bits = min(64, int(size).bit_length() + SPARE_BITS)
    folder = fresh_dir(spark, "suffix-tree")
    old = None

    def answered(messages: DataFrame, name: str, bits: int) -> DataFrame:
        nonlocal old
        path = fresh_dir(spark, name)
        messages.groupBy("owner").applyInArrow(lambda rows: _answer(rows, owners, bits), _REPLY).write.parquet(path)
        if old:
            drop_dir(spark, old)
        old = path
        return spark.read.schema(_REPLY).parquet(path)

    def by_block(replies: DataFrame):
        # The work of a block is in its files, not in the size of its replies: small partitions are not to be merged.
        return replies.repartition(tasks, "block").groupBy("block")

    replies = answered(rows.mapInArrow(_tokens(folder, owners, block_bytes), _MESSAGE), "words", 64)
    seen = replies.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0)), F.countDistinct("block")).first()
    n_all, types, tasks = int(seen[0]), int(seen[1]), max(1, min(int(seen[2]), 4 * owners))
    if n_all and depth:
        for k in range(depth + 1):
            replies = answered(by_block(replies).applyInArrow(_step(folder, owners, bits, k, depth, n_all), _MESSAGE), f"replies-{k}", bits)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return by_block(replies).applyInArrow(_scores(folder, n_all, types, bits), f"doc_id {id_type}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
