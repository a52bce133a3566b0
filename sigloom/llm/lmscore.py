"""Language-model scoring by cross-entropy difference.

Two models of the same order, smoothing and vocabulary are counted from the corpus: the
target from the documents labelled good, the background from all documents. The
vocabulary, shared by both, is the ``VOCABULARY`` most frequent words that occur twice
or more; all others are one word. After every word of the vocabulary, the
next word's probability comes from bigrams that back off to words, after any other
from words alone. A document is scored by counts without its own, so that a text in the
target is not favoured for being there. Its losses are the mean over its words of -ln p
under either model, and its score is the difference: below zero, the document is more
like the target than the corpus is.

Only the vocabulary and the ``COMMON`` most frequent bigrams are broadcast. Bigram counts grow
with the corpus: a bigram is two numbers of words, and bigrams travel packed, those of a
block of texts and a bucket of bigrams as one row of arrays. Buckets grow in number with the
corpus. A document's losses are first computed as if none of its bigrams stood elsewhere.
What its common bigrams take off is known on the spot; the others are met
with their counts bucket by bucket. As no other bigram stands for more than about one in
``COMMON`` of all, no bucket grows hot, however often one bigram or text repeats. Of the
counts, a bucket holds an entry of a bigram for each block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace

#: Words of the vocabulary, bigrams that every task knows, added to each word's count, weight of the shorter context in occurrences.
VOCABULARY, COMMON, ADDED, BACKOFF = 1 << 18, 1 << 20, 0.5, 4.0
#: Bytes of text that a task handles at a time (or one longer text), and bytes of text for each bucket of bigrams.
HELD, BUCKET = 1 << 23, 1 << 23


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows (key, text, target) -> (keys, targets, numbers of words, each word's place among the distinct ones, these words' hashes) of some rows at a time."""
    import xxhash

    for batch in batches:
        keys, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        texts = batch.column(1).cast(pa.large_string()).fill_null("")
        block = np.cumsum(pc.binary_length(texts).to_numpy()) // HELD
        cuts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)] if len(block) else np.zeros(1, np.int64)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            words = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(i, j - i)))
            coded = words.flatten().dictionary_encode()
            code, row = coded.indices.to_numpy(), np.repeat(np.arange(j - i), words.value_lengths().to_numpy())
            distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
            there = np.array([len(w) > 0 for w in distinct], bool)[code]  # white space at the ends leaves empty words
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct)).view(np.int64)
            yield keys[i:j], marks[i:j], np.bincount(row[there], minlength=j - i), code[there], hashes


WORD, ALL = range(2)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, target) -> counts of words, and of all words and bytes."""
    for _, marks, size, code, hashes in _blocks(batches):
        row = np.repeat(np.arange(len(size)), size)
        n, t = np.bincount(code, minlength=len(hashes)), np.bincount(code, marks[row], len(hashes)).astype(np.int64)
        some = n > 0
        kind = np.r_[np.full(some.sum(), WORD, np.int32), np.int32(ALL)]
        cols = [np.r_[hashes[some], 0], np.r_[n[some], len(code)], np.r_[t[some], size[marks].sum()]]
        yield pa.RecordBatch.from_arrays([pa.array(kind), *[pa.array(c.astype(np.int64)) for c in cols]], names=["kind", "item", "n", "t"])


def _pack(x: np.ndarray, sorted_: bool = False) -> bytes:
    """Whole numbers by planes of their bytes, which compress well; ascending ones as steps."""
    x = np.diff(x, prepend=0) if sorted_ else x
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes, sorted_: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum(x) if sorted_ else x


def _bucket(pair: np.ndarray, buckets: int) -> np.ndarray:
    h = pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _parts(pair: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets with the places of their pairs, in the order these stand in."""
    at = _bucket(pair, buckets)
    order = np.argsort(at, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(at[order])) + 1, len(order)]
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if j > i:
            yield int(at[order[i]]), order[i:j]


def _summed(pair: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, with the sums of both counts."""
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    return pair[first], *((np.add.reduceat(x[order], first) if len(first) else x[:0]) for x in (n, t))


class Vocabulary:
    """Words by number, with their counts in all (n) and in target texts (t); 0 is any other word."""

    def __init__(self, words: np.ndarray, n: np.ndarray, t: np.ndarray, totals: tuple[int, int]):
        order = np.argsort(words)
        self.words = words[order]
        self.counts = [np.r_[total - c.sum(), c[order]].astype(np.int64) for c, total in zip((n, t), totals)]
        self.totals = totals

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at + 1, 0)

    def spread(self, model: int, word: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
        """BACKOFF times the probability of a word by itself, without ``own`` of its occurrences and a text of ``size`` words."""
        return BACKOFF * (self.counts[model][word] - own + ADDED) / (self.totals[model] - size + ADDED * (len(self.words) + 1))


_COUNTS = "bucket int, pair binary, n binary, t binary"


def _places(v: Vocabulary, size: np.ndarray, code: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's text and number; where words of the vocabulary's follow one; and whose pair, by the numbers of both, is of the vocabulary."""
    row, word = np.repeat(np.arange(len(size)), size), v.numbers(hashes)[code]
    at = np.flatnonzero((row[1:] == row[:-1]) & (word[:-1] > 0)) + 1 if len(row) else np.zeros(0, np.int64)
    return row, word, at, at[word[at] > 0]


def _pairs(shared, buckets: int):
    """Rows (key, text, target) -> counts of pairs, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        for _, marks, size, code, hashes in _blocks(batches):
            row, word, _, at = _places(v, size, code, hashes)
            pair, n, t = _summed(word[at - 1] * (len(v.words) + 1) + word[at], np.ones(len(at), np.int64), marks[row[at]].astype(np.int64))
            rows = [(b, _pack(pair[i], True), _pack(n[i]), _pack(t[i])) for b, i in _parts(pair, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32(), *[pa.binary()] * 3])], names=["bucket", "pair", "n", "t"])

    return run


def _united(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """A bucket's counts in one row, without the pairs that stand once: nothing is left of these without their own text."""
    cols = [[_unpack(x, c == "pair") for x in group.column(c).to_pylist()] for c in ("pair", "n", "t")]
    pair, n, t = _summed(*map(np.concatenate, cols))
    more = n > 1
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "pair": [_pack(pair[more], True)], "n": [_pack(n[more])], "t": [_pack(t[more])]})


def _grade(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(n) * 16).astype(np.int64)


def _graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(0).to_pylist():
            grade, many = np.unique(_grade(_unpack(x)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grade), pa.array(many)], names=["grade", "many"])


def _common(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs with their counts, ``most`` at most: whole grades of frequency (a 16th of a power of two), from the top."""
    grades = counted.select("n").mapInArrow(_graded, "grade long, many long").groupBy("grade").agg(F.sum("many").alias("many")).orderBy(F.desc("grade")).collect()
    have, least = 0, None
    for g in grades:
        have += g.many
        if have > most:
            break
        least = g.grade

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pair, n, t in zip(*[b.column(i).to_pylist() for i in range(3)]):
                pair, n, t = _unpack(pair, True), _unpack(n), _unpack(t)
                top = _grade(n) >= least
                yield pa.RecordBatch.from_arrays([pa.array(x[top]) for x in (pair, n, t)], names=["pair", "n", "t"])

    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counted.select("pair", "n", "t").mapInArrow(take, "pair long, n long, t long").toArrow()
    order = np.argsort(got.column("pair").to_numpy())
    return tuple(got.column(c).to_numpy()[order] for c in ("pair", "n", "t"))  # type: ignore[return-value]


def _found(pair: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs stand among ``known``, ascending, and whether they do."""
    if not len(known):
        return np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
    at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
    return at, known[at] == pair


def _less(v: Vocabulary, word: np.ndarray, c: np.ndarray, own: np.ndarray, size: np.ndarray, marked: np.ndarray, n: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    """What pairs that stand n and t times in all take off a text's two losses, where they stand c times."""
    out = []
    for model, count in ((0, n), (1, t)):
        mine = marked.astype(np.int64) if model else np.ones(len(word), np.int64)
        out.append(c * np.log1p((count - mine * c) / v.spread(model, word, mine * own, mine * size)))
    return out


_PARTS = "own_key long, bucket int, pair binary, row binary, c binary, own binary, key binary, size binary, marked binary, rows int, words int, background double, target double"
_LOSSES = "key long, rows int, words int, background double, target double"


def _apart(shared, buckets: int):
    """Rows (key, text, target) -> a row of losses for each text, less what its common pairs take off, and its other pairs packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (common, all_n, all_t) = shared.value
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 7, *[pa.int32()] * 2, *[pa.float64()] * 2]
        names = [x.split()[0] for x in _PARTS.split(", ")]
        for keys, marks, size, code, hashes in _blocks(batches):
            row, word, context, at = _places(v, size, code, hashes)
            _, place, times = np.unique(row * (len(v.words) + 1) + word, return_inverse=True, return_counts=True)
            own = times[place]  # of the word, in its text
            losses = []
            for model in (0, 1):
                mine = marks[row].astype(np.int64) if model else np.ones(len(row), np.int64)
                p = v.spread(model, word, mine * own, mine * size[row])
                one = np.ones(len(p), bool)
                one[context] = False
                p[context] /= v.counts[model][word[context - 1]] - mine[context] * own[context - 1] + BACKOFF
                p[one] /= BACKOFF
                losses.append(np.bincount(row, -np.log(p), len(keys)))
            pair, first, c = _distinct(row[at], word[at - 1] * (len(v.words) + 1) + word[at])
            at, r = at[first], row[at[first]]
            where, known = _found(pair, common)
            i = np.flatnonzero(known)
            off = _less(v, word[at[i]], c[i], own[at[i]], size[r[i]], marks[r[i]], all_n[where[i]], all_t[where[i]])
            losses = [x - np.bincount(r[i], y, len(keys)) for x, y in zip(losses, off)]
            i = np.flatnonzero(~known)
            i = i[np.argsort(pair[i], kind="stable")]
            out = [[int(k), *[None] * 8, 1, int(m), float(x), float(y)] for k, m, x, y in zip(keys, size, *losses)]
            for b, j in _parts(pair[i], buckets):
                j = i[j]
                texts, to = np.unique(r[j], return_inverse=True)
                out.append([None, b, _pack(pair[j], True), _pack(to), _pack(c[j]), _pack(own[at[j]]), _pack(keys[texts]), _pack(size[texts]), _pack(marks[texts]), None, None, None, None])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=names)

    return run


def _distinct(row: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of distinct (row, pair), where one of each stands, and how often it does."""
    order = np.lexsort((pair, row))
    r, g = row[order], pair[order]
    new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])]) if len(r) else np.zeros(0, np.int64)
    return g[new], order[new], np.diff(np.r_[new, len(r)])


def _taken_off(shared):
    """A bucket's pairs, block by block, and its counts -> what each of them takes off its text's losses, in rows that grow as the pairs do."""

    def run(asks: pa.Table, counts: pa.Table) -> pa.Table:
        v: Vocabulary = shared.value
        known, n, t = (_unpack(counts.column(c)[0].as_py(), c == "pair") if len(counts) else np.zeros(0, np.int64) for c in ("pair", "n", "t"))
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
        for part in range(len(asks)):
            got = {c: _unpack(asks.column(c)[part].as_py(), c == "pair") for c in ("pair", "row", "c", "own", "key", "size", "marked")}
            where, there = _found(got["pair"], known)
            row, where = got["row"][there], where[there]
            word = got["pair"][there] % (len(v.words) + 1)
            off = _less(v, word, got["c"][there], got["own"][there], got["size"][row], got["marked"][row], n[where], t[where])
            out[0].append(got["key"][row])
            for o, y in zip(out[1:], off):
                o.append(-y)
        key, background, target = map(np.concatenate, out)
        none = pa.array(np.zeros(len(key), np.int32))
        return pa.table({"key": key, "rows": none, "words": none, "background": background, "target": target})

    return run


def losses(ws: Workspace, marked: DataFrame, most: int = VOCABULARY, common: int = COMMON) -> DataFrame:
    """``(key, words, background, target)``: the summed losses of the text under each key of ``marked(key, text, target)``.

    Of equally frequent words at the end of the vocabulary those of smaller hashes are in it.
    """
    counts = marked.mapInArrow(_count, "kind int, item long, n long, t long").groupBy("kind", "item").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    counts = ws.table(counts.where(f"kind = {ALL} or n > 1"))
    total = counts.where(f"kind = {ALL}").first()
    top = counts.where(f"kind = {WORD}").orderBy(F.desc("n"), "item").limit(most).toArrow()
    v = Vocabulary(*[top.column(c).to_numpy() for c in ("item", "n", "t")], (total.n, total.t) if total else (0, 0))
    bytes_ = marked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + bytes_ // BUCKET
    sc = marked.sparkSession.sparkContext
    shared = sc.broadcast(v)
    counted = ws.table(marked.mapInArrow(_pairs(shared, buckets), _COUNTS).groupBy("bucket").applyInArrow(_united, _COUNTS))
    ws.sweep()
    known = sc.broadcast((v, _common(counted, common)))
    parts = ws.table(marked.mapInArrow(_apart(known, buckets), _PARTS))
    base = parts.where("bucket is null").select(F.col("own_key").alias("key"), "rows", "words", "background", "target")
    off = parts.where("bucket is not null").groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(_taken_off(shared), _LOSSES)
    each = ws.table(base.union(off).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("rows", "background", "target")], F.max("words").alias("words")))
    ws.drop(counts, counted, parts)
    # rows that repeat are summed as often as they stand
    return each.select("key", F.col("words").cast("long").alias("words"), (F.col("background") / F.col("rows")).alias("background"), (F.col("target") / F.col("rows")).alias("target"))


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """``docs`` with n_tokens, loss_target, loss_background and score added.

    target_ids(doc_id) names the target's documents; repeats and nulls in it are
    ignored. A null or blank text has no tokens and null losses and score. With no
    target documents, the target model is uniform. Repeated rows are each scored
    and counted; columns of these names are replaced. An empty table stays empty.
    """
    ws = Workspace(docs.sparkSession, "lmscore")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    # the target's ids grow with the corpus, so they are merged with the documents at every size, never broadcast
    good = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(True)).hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(good, "doc_id", "left")
    marked = ws.table(rows.select(key.alias("key"), "text", F.coalesce("target", F.lit(False)).alias("target")))
    ws.sweep()
    lost = losses(ws, marked)
    ws.drop(marked)
    got = lost.select(F.col("key").alias("_key"), F.col("words").alias("n_tokens"), *[F.when(F.col("words") > 0, F.col(c) / F.col("words")).alias(f"loss_{c}") for c in ("target", "background")])
    kept = docs.drop("n_tokens", "loss_target", "loss_background", "score")
    both = kept.withColumn("_key", key).join(got.withColumnRenamed("_key", "_of"), F.col("_key") == F.col("_of"), "left")
    return both.select(*[F.col(f"`{c}`") for c in kept.columns], "n_tokens", "loss_target", "loss_background", (F.col("loss_target") - F.col("loss_background")).alias("score"))


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return score(docs, good).drop("text")
