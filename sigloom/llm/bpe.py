"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes of a text cuts it where the content says so,
hence copied passages are cut alike wherever they stand. A worker encodes each
chunk it has not met once and keeps the result, for all documents it reads.
A cut may split a word; such a join is repaired by encoding again the span from
the last white space before it to the first one after it, together with a word on
either side: the ids have to agree with those of the chunks there. White space ends
every token of this kind of vocabulary, so one round is enough. What is encoded is encoded by the library, by words, which are
kept in the same manner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that decide a cut, the mean chunk's bytes (a power of two), and bytes of chunks and words a worker keeps.
REACH, MEAN = 16, 512
KEPT_CHUNKS, KEPT_WORDS = 24 << 20, 300_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _table() -> np.ndarray:
    """A fixed random number for each byte value."""
    x = np.arange(1, 257, dtype=np.uint32) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


_GEAR = _table()


def cuts(data: bytes, mean: int = MEAN) -> list[int]:
    """Where chunks end: the hash of the ``REACH`` bytes before has its upper bits zero."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= REACH:
        return [len(b)]
    h = _GEAR[b]
    for k in (1, 2, 4, 8):  # sums of 2, 4, 8, 16 terms, each shifted by its distance
        h[k:] += h[:-k] << np.uint32(k)
    at = np.flatnonzero(h[REACH:] < np.uint32((1 << 32) // mean)) + REACH + 1
    return [*at.tolist(), *([] if len(at) and at[-1] == len(b) else [len(b)])]


class Coder:
    """A worker's tokenizer with what it has encoded so far."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.names = {i: t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}
        self.size = 0

    def _encoded(self, words: list[bytes]) -> tuple[bytes, bytes]:
        """Decimal ids and decoded tokens of words, either joined by spaces."""
        kept = self.words
        new = [w for w in dict.fromkeys(words) if w not in kept]
        if len(kept) + len(new) > KEPT_WORDS:
            for w in list(kept)[: len(kept) // 2]:
                del kept[w]
            new = [w for w in dict.fromkeys(words) if w not in kept]
        for i in range(0, len(new), 1024):
            some = new[i : i + 1024]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)):
                ids = e.ids
                kept[w] = (" ".join(map(str, ids)).encode(), b" ".join(map(self.names.__getitem__, ids)))
        rows = list(map(kept.__getitem__, words))
        return b" ".join([r[0] for r in rows if r[0]]), b" ".join([r[1] for r in rows if r[0]])

    def _chunk(self, chunk: bytes) -> tuple[bytes, bytes]:
        got = self.chunks.get(chunk)
        if got is None:
            got = self._encoded(chunk.split())
            self.size += 2 * len(chunk) + len(got[0]) + len(got[1])
            if self.size > KEPT_CHUNKS:
                self.chunks.clear()
                self.size = 0
            self.chunks[chunk] = got
        return got

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Decimal ids of a whole text, and the tokens they decode to, joined by spaces."""
        data = (text or "").encode("utf-8", "surrogatepass")
        out, carry, start, before = [], [], 0, b""
        for end in cuts(data):
            chunk = data[start:end]
            start = end
            if carry:  # the join before this chunk split a word: repair it up to the first white space
                head = chunk.split(None, 1)[0] if chunk and not _SPACE[chunk[0]] else b""
                if len(head) == len(chunk):
                    carry.append(chunk)
                    continue
                chunk = chunk[len(head) :]
                out.append(self._repaired(before, b"".join([*carry, head]), (chunk[:256].split(None, 1) or [b""])[0]))
                carry = []
            if chunk and end < len(data) and not _SPACE[chunk[-1]] and not _SPACE[data[end]]:
                tail = chunk.rsplit(None, 1)[-1]
                carry, chunk = [tail], chunk[: len(chunk) - len(tail)]
            out.append(self._chunk(chunk))
            before = (chunk[-256:].rsplit(None, 1) or [b""])[-1]
        if carry:
            out.append(self._encoded([b"".join(carry)]))
        return b" ".join([o[0] for o in out if o[0]]), b" ".join([o[1] for o in out if o[0]])

    def _repaired(self, left: bytes, word: bytes, right: bytes) -> tuple[bytes, bytes]:
        """A split word's ids, from encoding it anew with a word on either side.

        The span's ids have to begin and end with those of the words beside it, as their
        chunks have them, or chunks don't stand for themselves with this vocabulary.
        """
        got = self.words.get(word)
        if got is None:
            span = b" ".join([w for w in (left, word, right) if w]).decode("utf-8", "replace")
            ids = self.tokenizer.encode_batch_fast([span], add_special_tokens=False)[0].ids
            told = [str(i).encode() for i in ids]
            a, b = (self._encoded([w])[0].split() if w else [] for w in (left, right))
            if told[: len(a)] != a or told[len(told) - len(b) :] != b:
                raise ValueError("this vocabulary's tokens reach over white space")
            own = slice(len(a), len(told) - len(b))
            got = self.words[word] = (b" ".join(told[own]), b" ".join(map(self.names.__getitem__, ids[own])))
        return got


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` with ``ids array<int>`` and ``decoded string`` of each whole ``text`` added.

    A null or blank text has no ids and decodes to nothing. Repeated rows are each answered,
    columns of these names are replaced, and an empty table stays empty.
    """
    return _with(docs, tokenizer, [("ids", "array<int>", pa.list_(pa.int32()), lambda i, d: np.array(i.split(), np.int32)), ("decoded", "string", pa.string(), lambda i, d: d.decode("utf-8", "replace"))])


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``rows`` with ``decoded``: the text of ``ids``, special tokens included.

    Null or empty ids decode to nothing. Repeated rows are each answered, a column called
    decoded is replaced, and an empty table stays empty.
    """
    kept = rows.drop("decoded")
    at = kept.columns.index("ids")
    names = [*kept.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tokenizer.decode(i or [], skip_special_tokens=False) for i in b.column(at).to_pylist()], pa.string())], names=names)

    from pyspark.sql import types as T

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def _with(docs: DataFrame, tokenizer: str, made: list) -> DataFrame:
    from pyspark.sql import types as T

    kept = docs.drop(*[m[0] for m in made])
    names = [*kept.columns, *[m[0] for m in made]]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):  # bounded output whatever the batch
                b = whole.slice(i, 512)
                got = [c.encode(t) for t in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([f(*g) for g in got], kind) for _, _, kind, f in made]], names=names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(n, T._parse_datatype_string(d)) for n, d, _, _ in made]]))


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row of ``docs(doc_id, text, ...)``.

    A null or blank text has no tokens, so both digests are of the empty string.
    Repeated rows are each answered; other columns are ignored.
    """
    sha = lambda x: hashlib.sha256(x).hexdigest()
    made = [
        ("n_tokens", "bigint", pa.int64(), lambda i, d: i.count(b" ") + 1 if i else 0),
        ("ids_sha256", "string", pa.string(), lambda i, d: sha(i)),
        ("decoded_sha256", "string", pa.string(), lambda i, d: sha(d)),
    ]
    return _with(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer, made).drop("text")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
