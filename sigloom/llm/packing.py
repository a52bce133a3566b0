"""Packing of token streams into windows by Karmarkar-Karp multiway differencing.

Documents are encoded where they are read. Whole windows are cut off long documents;
what is left of each document stays in one piece and is dealt into a group of about
``GROUP`` ids by a hash. In a group, every piece starts as a partition of
the windows with one part filled; the two partitions with the largest imbalances
are merged, the fullest part of one with the emptiest of the other, until one
is left, whose parts are nearly equal. While its fullest part exceeds the
capacity, the number of windows rises and the group is dealt again, until
padding would exceed ``SLACK``; only then is what does not fit cut off, and fills the
room of other windows.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace

CAPACITY = 2048
GROUP = 1 << 19
#: The share of padding up to which the number of windows rises before a document is cut.
SLACK = 0.005
#: Words whose ids a worker keeps; the oldest half goes when it is full.
KEPT = 400_000


class Irregular(Exception):
    """White space beside a space: the text can't be cut there."""


class Encoder(dict):
    """Byte-level BPE by words: each distinct one is encoded once while it is kept.

    The tokenizer's own pattern never joins what stands before a single space with
    what follows, so a text's ids are those of its first word and of each further
    word with its space. Texts with other white space beside a space are encoded
    whole. The merges run in the faster of the installed libraries, over the
    vocabulary in the given file; ids are the same.
    """

    def __init__(self, path: str, kept: int = KEPT):
        import json

        import tiktoken

        super().__init__()
        self.kept = kept
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {t["content"]: int(t["id"]) for t in told["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.core = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Irregular
        out = np.array(self.core.encode_ordinary(" " + word), "<u4").tobytes()
        if len(word) <= 40:
            if len(self) >= self.kept:
                for w in list(self)[: self.kept // 2]:
                    del self[w]
            self[word] = out
        return out

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, as little-endian 32-bit numbers."""
        if any(s in text for s in self.special):
            return np.array(self.core.encode(text, allowed_special=self.special), "<u4")
        first, *words = text.split(" ")
        try:
            return np.frombuffer(np.array(self.core.encode_ordinary(first), "<u4").tobytes() + b"".join(map(self.__getitem__, words)), "<u4")
        except Irregular:
            return np.array(self.core.encode_ordinary(text), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it lasts over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def differencing(sizes: np.ndarray, parts: int) -> np.ndarray:
    """Multiway differencing: for each size, the part it goes to; parts get nearly equal sums."""
    n = len(sizes)
    if parts <= 1 or n == 0:
        return np.zeros(n, np.int64)
    # a partition: its parts' sums, ascending, and for each the last piece put in; pieces chain to the one before
    follows = np.full(n, -1)
    first: dict[int, int] = {}
    heap, made = [], []
    for i in np.argsort(-sizes, kind="stable").tolist():
        heap.append((-int(sizes[i]), len(made)))
        made.append((np.array([int(sizes[i])]), np.array([i])))  # only the parts in use, at the upper end
    heapq.heapify(heap)
    head = np.arange(n)  # of the chain that ends with a piece
    while len(heap) > 1:
        a, b = made[heapq.heappop(heap)[1]], made[heapq.heappop(heap)[1]]
        if len(a[0]) < len(b[0]):
            a, b = b, a
        (sa, ta), (sb, tb) = a, b
        together = len(sa) + len(sb)
        if together <= parts:  # the fullest parts of either meet empty ones
            sums, tails = np.concatenate([sa, sb]), np.concatenate([ta, tb])
        else:
            both = together - parts  # b's emptiest used parts join a's emptiest ones, the fullest with the emptiest
            sums, tails = sa.copy(), ta.copy()
            k = len(sb)
            # opposing order: a ascending against b descending, over all parts; unused parts of a come first
            free = parts - len(sa)
            sums = np.concatenate([sb[k - free :][::-1], sa]) if free else sums
            tails = np.concatenate([tb[k - free :][::-1], ta]) if free else tails
            rest_s, rest_t = sb[: k - free][::-1], tb[: k - free][::-1]
            at = np.arange(free, free + len(rest_s))
            sums[at] += rest_s
            follows[head[rest_t]] = tails[at]
            head[rest_t] = head[tails[at]]
            tails[at] = rest_t
            assert len(rest_s) == both
        order = np.argsort(sums, kind="stable")
        sums, tails = sums[order], tails[order]
        if len(sums) == parts and sums[0]:
            base = int(sums[0])
            sums = sums - base  # only differences matter from here on
        made.append((sums, tails))
        heapq.heappush(heap, (-int(sums[-1] - (sums[0] if len(sums) == parts else 0)), len(made) - 1))
    out = np.empty(n, np.int64)
    for part, tail in enumerate(made[heap[0][1]][1].tolist()):
        i = tail
        while i >= 0:
            out[i] = part
            i = int(follows[i])
    return out


def fitted(sizes: np.ndarray, capacity: int, slack: float = SLACK) -> np.ndarray:
    """(n, 4) rows (item, from, length, window) that hold every item, in windows none of which exceeds the capacity.

    Items are whole unless the windows of differencing are still too full when padding reaches ``slack``.
    """
    total = int(sizes.sum())
    parts, most = max(1, -(-total // capacity)), max(1, int(-(-total // (capacity * (1 - slack)))))
    step = 1
    while True:
        to = differencing(sizes, parts)
        load = np.bincount(to, sizes, parts).astype(np.int64)
        if parts >= most or not len(sizes) or load.max() <= capacity:
            break
        parts, step = min(most, parts + step), 2 * step
    rows = [[i, 0, int(n), int(w)] for i, (n, w) in enumerate(zip(sizes, to))]
    by: dict[int, list[list[int]]] = {}
    for r in rows:
        if load[r[3]] > capacity:
            by.setdefault(r[3], []).append(r)
    cut: list[list[int]] = []
    for w, members in by.items():
        excess = int(load[w] - capacity)
        for r in sorted(members, key=lambda r: (-r[2], r[0])):
            off = min(excess, r[2])
            if not off:
                break
            cut.append([r[0], r[1] + r[2] - off, off, -1])
            r[2] -= off
            excess -= off
    rooms = sorted((int(capacity - n), w) for w, n in enumerate(load) if n < capacity)
    for item, start, n, _ in sorted(cut, key=lambda r: (-r[2], r[0], r[1])):
        while n:
            at = min(bisect.bisect_left(rooms, (n, -1)), len(rooms) - 1)  # the least room that is enough, or else the largest
            room, w = rooms.pop(at)
            rows.append([item, start, min(n, room), w])
            if room > n:
                bisect.insort(rooms, (room - n, w))
            start, n = start + min(n, room), n - min(n, room)
    return np.array([r for r in rows if r[2]], np.int64).reshape(-1, 4)


_COLUMNS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary()}


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Encode and cut off whole windows: ``(doc_id, start, length, ids_crc32, doc_tokens, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        cols: list[list] = [[] for _ in _COLUMNS]
        held = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _COLUMNS.values())], names=list(_COLUMNS))
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.ids(text or "").tobytes() + int(end_id).to_bytes(4, "little")
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    for c, v in zip(cols, (doc, s, len(part) // 4, zlib.crc32(part), n, part)):
                        c.append(v)
                held += n
                if held > 1 << 20:
                    yield flush()
                    held = 0
        if cols[0]:
            yield flush()

    schema = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in _COLUMNS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Each piece with ``sequence_id`` and its ``offset`` there; every id is in exactly one piece.

    A null or empty text is its end id alone. Rows are packed one by one, also where
    they repeat or have no doc_id; other columns are ignored, and an empty table gives no
    rows. ``with_ids`` keeps the pieces' ids, as 32-bit little-endian numbers, which
    is what a writer of training files needs. Sequences of a group have ids next to each other;
    the numbers have gaps.
    """
    ws = Workspace(docs.sparkSession, "packing")
    made = ws.table(pieces(docs, tokenizer, end_id, capacity).withColumn("row", F.monotonically_increasing_id()))
    rest = made.where(F.col("length") < capacity)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / group))
    full = made.where(F.col("length") == capacity).withColumn("sequence_id", F.col("row") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    columns = [c for c in _COLUMNS if c != "ids" or with_ids]
    schema = ", ".join(f"{c} {t}" for c, t in made.dtypes if c in columns) + ", sequence_id long, offset long"

    def deal(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("row").to_numpy(), -table.column("length").to_numpy()))
        table = table.take(pa.array(order))
        item, begin, length, window = fitted(table.column("length").to_numpy(), capacity)[:, :].T
        seq = np.lexsort((begin, item, window))
        item, begin, length, window = (v[seq] for v in (item, begin, length, window))
        start = table.column("start").to_numpy()[item] + begin
        own = [table.column("ids")[i].as_buffer() for i in range(table.num_rows)]
        ids = [memoryview(own[i])[4 * s : 4 * (s + n)] for i, s, n in zip(item.tolist(), begin.tolist(), length.tolist())]
        first = np.r_[True, window[1:] != window[:-1]]
        offset = np.cumsum(length) - length
        offset = offset - np.maximum.accumulate(np.where(first, offset, 0))
        out = {
            "doc_id": table.column("doc_id").take(pa.array(item)),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(i) for i in ids], pa.int64()),
            "doc_tokens": table.column("doc_tokens").take(pa.array(item)),
        }
        if with_ids:
            out["ids"] = pa.array([bytes(i) for i in ids], pa.binary())
        # even; whole windows have odd numbers; a group has fewer windows than twice its ids
        return pa.table({**out, "sequence_id": pa.array(2 * (key[0].as_py() * (2 * group) + window), pa.int64()), "offset": pa.array(offset, pa.int64())})

    dealt = rest.withColumn("packed", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("packed").applyInArrow(deal, schema)
    return dealt.select(*columns, "sequence_id", "offset").unionByName(full.select(*columns, "sequence_id", "offset"))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
