"""Importance resampling towards a target: documents drawn by how much their hashed n-grams resemble it.

Features are runs of consecutive words, hashed by CRC-32 into buckets. Frequent words, the head of
the vocabulary, are found by one count and broadcast with their CRC states, frequent pairs with their
buckets; a head word is one lookup and a run that starts with it goes on from its state. A feature
outside the head, the tail, takes its CRC directly. Both ways give the same bucket, so that bucket
totals are exact whatever the head holds. The draw adds Gumbel noise, made from a hash of the id, to
each document's mean gain and takes the highest, which draws without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.operators.ordered import dense_index
from tracewright.session import materialize, scratch

ORDERS = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
# Words and pairs of the head, and the bytes that one of them may have: 4 MB of words at most.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 1 << 16, 1 << 16, 64
# Entries that a task counts before it hands on the frequent half of them.
_COUNTED = 1 << 18
# Bytes of a text that are words in Python at a time.
_PIECE = 1 << 20
# Bytes that belong to words after lower-casing; every other byte separates them.
_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_TABLE = bytes(b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def word_runs(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, a bounded piece of it at a time."""
    raw = (text or "").encode().translate(_TABLE)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


@dataclass
class Head:
    """CRC states of frequent words, buckets of frequent pairs; what they lack is computed."""

    states: dict[bytes, int] = field(default_factory=dict)
    pairs: dict[tuple[bytes, bytes], int] = field(default_factory=dict)

    def buckets(self, text: str | None, orders: int, buckets: int) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every run of 1 to ``orders`` words."""
        n, out, last = 0, [], []
        states, pairs, crc = self.states, self.pairs, zlib.crc32
        for words in word_runs(text):
            if not words:
                continue
            n += len(words)
            known = list(map(states.get, words))
            single = [crc(w) if s is None else s for w, s in zip(words, known)] if None in known else known
            out.append(np.fromiter(single, np.uint32, len(words)) % np.uint32(buckets))
            if orders > 1:
                # Runs that begin in the piece before end in this one.
                longer = last + list(zip(words, single))
                out.append(np.fromiter(self._longer(longer, len(last), orders, buckets, pairs), np.uint32))
                last = longer[-(orders - 1) :]
        return n, np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)

    @staticmethod
    def _longer(run: list[tuple[bytes, int]], done: int, orders: int, buckets: int, pairs: dict) -> Iterator[int]:
        """Buckets of all runs of 2 or more words that end after the first ``done``."""
        crc = zlib.crc32
        for end in range(max(done, 1), len(run)):
            for start in range(max(end - orders + 1, 0), end):
                if end - start == 1 and (found := pairs.get((run[start][0], run[end][0]))) is not None:
                    yield found
                    continue
                state = run[start][1]
                for word, _ in run[start + 1 : end + 1]:
                    state = crc(word, crc(b" ", state))
                yield state % buckets


def head_vocabulary(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> Head:
    """The most frequent words, and pairs for ``orders`` above one, of column ``text``.

    Tasks count with bounded memory, handing on the frequent half of their entries when they have
    too many; a word that this misses is merely one of the tail.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def given(rest: bool) -> pa.RecordBatch:
            frequent = counts.most_common(_COUNTED // 2 if not rest else HEAD_WORDS + HEAD_PAIRS)
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in frequent], pa.binary()), pa.array([n for _, n in frequent], pa.int64())], ["feature", "n"]
            )

        for batch in batches:
            for text in batch.column("text"):
                for words in word_runs(text.as_py()):
                    counts.update(words)
                    if orders > 1:
                        counts.update(a + b" " + b for a, b in zip(words, words[1:]))
                    if len(counts) > _COUNTED:
                        yield given(False)
        yield given(True)

    found = texts.mapInArrow(counted, "feature binary, n bigint").filter(F.octet_length("feature") <= HEAD_BYTES)
    totals = found.groupBy("feature").agg(F.sum("n").alias("n"))
    is_pair = F.instr(F.decode("feature", "ISO-8859-1"), " ") > 0

    def most(rows: DataFrame, limit: int) -> list[bytes]:
        """At most ``limit`` features of ``HEAD_BYTES`` bytes."""
        return [bytes(r.feature) for r in rows.orderBy(F.desc("n"), "feature").limit(limit).collect()]

    with scratch():
        totals = materialize(totals.withColumn("pair", is_pair), "head")
        states = {w: zlib.crc32(w) for w in most(totals.filter("not pair"), HEAD_WORDS)}
        pairs = {}
        if orders > 1:
            for run in most(totals.filter("pair"), HEAD_PAIRS):
                a, b = run.split(b" ")
                pairs[a, b] = zlib.crc32(run) % buckets
    return Head(states, pairs)


def features(rows: DataFrame, key: str, head: Head, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``key``, ``n_words`` and ``buckets`` (one per feature) of every row's whole text."""
    shared = rows.sparkSession.sparkContext.broadcast(head)  # bounded by HEAD_WORDS, HEAD_PAIRS and HEAD_BYTES

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shared.value.buckets(t.as_py(), orders, buckets) for t in part.column("text")]
                ends = np.cumsum([0] + [len(b) for _, b in found])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([b for _, b in found])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array([n for n, _ in found], pa.int64()), lists], [key, "n_words", "buckets"]
                )

    given = rows.select(key, F.col("text").cast("string").alias("text"))
    return given.mapInArrow(hashed, f"{key} {dict(given.dtypes)[key]}, n_words bigint, buckets array<int>")


def bucket_totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: one row a task and bucket, ``buckets`` numbers to the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("buckets").flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in found.select("buckets").mapInArrow(summed, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1) (S + B)) / ((s + 1) (T + B)))) of each of B buckets."""
    big_s, big_t, b = int(source.sum()), int(target.sum()), len(source)
    return np.array(
        [math.floor(1000.0 * math.log(float(t + 1) * float(big_s + b) / (float(s + 1) * float(big_t + b))))
         for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def _weights(found: DataFrame, key: str, gain: np.ndarray) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain (0 without features)."""
    shared = found.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            sums = np.append(0, np.cumsum(shared.value[lists.flatten().to_numpy()]))
            ends = np.append(0, np.cumsum(sizes))
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("n_words"), pa.array(sizes), pa.array(weight)], [key, "n_words", "n_features", "weight"]
            )

    return found.mapInArrow(weighed, f"{key} {dict(found.dtypes)[key]}, n_words bigint, n_features bigint, weight bigint")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Noise in thousandths from the first 32 bits of a hash of the key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(
    docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS,
    min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Every row's ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (1, 2, ... of the drawn, else null).

    Drawn are the ``percent`` hundredths, rounded down, of the rows with ``min_words`` words or more
    that score highest; ties go to the smaller ``doc_id``, a null id last. A null or empty text has no
    features and weight 0. Rows repeated under one id have equal scores and take ranks one after
    another. Without a target text all gains follow from the documents alone; an empty table gives an
    empty one. Null target texts hold no features.
    """
    both = docs.select(F.col("text").cast("string").alias("text"))
    head = head_vocabulary(both, orders, buckets)
    with scratch() as kept:
        found = materialize(features(docs, "doc_id", head, orders, buckets), "features")
        aimed = target.select(F.lit(0).alias("_key"), "text")
        gain = gains(bucket_totals(found, buckets), bucket_totals(features(aimed, "_key", head, orders, buckets), buckets))
        weighed = _weights(found, "doc_id", gain)
        scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
        rows = materialize(scored, "scored")
        fit = rows.filter(F.col("n_words") >= min_words)
        drawn = fit.count() * percent // 100
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        ranked = dense_index(fit, order, "place")
        place = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
        columns = ["doc_id", "n_features", "weight", "score"]
        rest = rows.filter(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
        kept.append(materialize(ranked.select(*columns, place).unionByName(rest), "resampled"))
    return kept[0]
