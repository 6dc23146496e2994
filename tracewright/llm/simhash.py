"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a common variant at most
``radius / 2`` bits from each. Every distinct fingerprint therefore emits all
variants in that ball, variants meet in one shuffle, and colliding fingerprints
are linked. A variant's group holds as many fingerprints as a ball has points at
most, and all of them lie within ``radius`` of each other, so each is linked to
the group's smallest one only: the links reach the same components as all pairs.
Copies collapse into one fingerprint before anything is emitted.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from tracewright.llm.words import word_bytes
from tracewright.operators.components import weak_components
from tracewright.session import materialize

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint: bit b is set if it is set in over half of the shingles' XXH64.

    A text with fewer words than ``shingle`` has one shingle, its whole sequence; without words it is 0.
    """
    words = word_bytes(text)
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    size = min(shingle, len(words))
    total = len(words) - size + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, total, _BLOCK):
        begin = starts[at : min(at + _BLOCK, total)].tolist()
        end = (starts[at + size : min(at + _BLOCK, total) + size] - 1).tolist()
        pieces = [joined[b:e] for b, e in zip(begin, end)]
        digests = b"".join(map(xxhash.xxh64_digest, pieces, repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and signed 64-bit ``fingerprint`` of every row; a null text counts as one without words."""

    @F.pandas_udf(LongType())
    def hashed(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return docs.select("doc_id", hashed("text").alias("fingerprint"))


def ball(radius: int) -> list[int]:
    """Signed masks with ``radius`` bits at most."""
    masks = [sum(1 << b for b in at) for n in range(radius + 1) for at in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``radius`` bits that connect what all such pairs connect.

    ``radius`` must be even: only then is every collision a link.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be an even number of bits")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    variants = distinct.select("fingerprint", F.explode(masks).alias("mask")).select(
        "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant")
    )
    hub = F.min("fingerprint").over(Window.partitionBy("variant"))
    pairs = variants.select(F.col("fingerprint").alias("a"), hub.alias("b")).filter("a <> b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, signed ``fingerprint`` and ``component_id`` (smallest ``doc_id`` reachable) of every row.

    Repeated rows each stay in the result. Texts without words, null ones too, have
    fingerprint 0 and are linked like others. A row without ``doc_id`` takes part; its
    component is null only if nothing in it has an id. An empty table gives an empty one.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc"))
    found = materialize(links(classes.select("fingerprint"), radius), "links")
    roots = weak_components(classes.select(F.col("fingerprint").alias("node_id")), found, "a", "b")
    named = classes.join(roots.withColumnRenamed("node_id", "fingerprint"), "fingerprint")
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    members = named.join(least, "component").select("fingerprint", "component_id")
    return rows.join(members, "fingerprint").select("doc_id", "fingerprint", "component_id")


def as_hex(fingerprint) -> F.Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def kept_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the ``component_id`` that ``found`` has for it, each once.

    Rows that share a kept ``doc_id`` are one document and collapse into one row. A row
    without ``doc_id`` stays: no id names it among its group.
    """
    found = found.filter("doc_id is not null")
    per_doc = found.groupBy("doc_id").agg(
        F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("rows")
    )
    odd = materialize(per_doc.filter("not kept or rows > 1"), "dropped")
    single = docs.join(odd, "doc_id", "left_anti")
    repeated = docs.join(odd.filter("kept"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(repeated)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with the smallest ``doc_id`` of their component, each once, as ``kept_rows`` takes them."""
    return kept_rows(docs, near_duplicates(docs, shingle, radius))
