"""Lines that many documents share, found by one sorted stream over line hashes.

Every line becomes a 128-bit hash of its key with its document and position. The rows are
range-partitioned by hash, document and position, so that a line of any frequency lies in as many
partitions as it fills. Each partition is streamed once in order: first occurrences in a document
count, and once a line has enough of them all its rows go. Only the first and the last line of a
partition can go on elsewhere; they are settled by a summary of two rows a partition. What comes
back per document is a compressed bitmap of the lines that stay, and no text is moved for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracewright.operators.joins import lookup
from tracewright.operators.ordered import chunk_count
from tracewright.session import materialize, scratch

MIN_DOCS = 10
MIN_CHARS = 1
# The six characters stripped from a line.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINE, DOCUMENT = ["high", "low"], ["doc_id", "text_hash"]
ROW = [*LINE, *DOCUMENT, "position"]
# Rows of the stream: a line that goes, one that the summaries settle, and a summary.
_GOES, _OPEN, _SUMMARY = 0, 1, 2
# Documents with a bitmap that one task should hold, copies of one row for the most part.
_DOCS_PER_TASK = 200_000


def line_key(line: Column) -> Column:
    """Stripped, A-Z in lower case. ``lower`` does the same, and faster, to lines that are ASCII."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document(text: Column) -> list[Column]:
    """What names a document: its id, null too, and a hash of its text."""
    return [F.col("doc_id"), F.xxhash64(text).alias("text_hash")]


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(high, low, doc_id, text_hash, position) of each line whose key has ``min_chars`` code points or more."""
    text = F.col("text").cast("string")
    placed = docs.select(*_document(text), F.posexplode(_lines(text)).alias("position", "line"))
    keyed = placed.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("high"), F.xxhash64(F.lit(1), "key").alias("low"), "doc_id", "text_hash", "position")


def _changes(batch: pa.Table, names: list[str]) -> np.ndarray:
    """True where a row differs from the one before in any of the columns; nulls are equal."""
    out = np.ones(batch.num_rows, bool)
    if batch.num_rows > 1:
        differs = np.zeros(batch.num_rows - 1, bool)
        for name in names:
            column = batch[name].combine_chunks()
            differs |= pc.xor(column[1:].is_null(), column[:-1].is_null()).to_numpy(zero_copy_only=False)
            differs |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        out[1:] = differs
    return out


class _Run:
    """The rows of the line that the stream is in."""

    def __init__(self, opening: bool, first: pa.Table):
        self.opening, self.first, self.final = opening, first, first
        self.docs, self.held, self.given, self.last = 0, [], False, None

    def feed(self, rows: pa.Table, docs: np.ndarray, least: int) -> pa.Table | None:
        """Rows to give out: once the line has ``least`` documents, all its rows so far and from then on."""
        again = self.last is not None and self.last.equals(rows.slice(0, 1).select(DOCUMENT))
        self.docs += int(docs.sum()) - again
        self.final = rows.slice(rows.num_rows - 1)
        self.last = self.final.select(DOCUMENT)
        self.held.append(rows)
        if self.docs < least:
            return None
        out, self.held = pa.concat_tables(self.held), []
        return out


def _streamed(batches: Iterator[pa.RecordBatch], least: int, keep_first: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one sorted partition that go, those left open, and its summaries.

    Held from batch to batch are the rows of one line with fewer than ``least`` documents.
    """
    chunk = TaskContext.get().partitionId()

    def given(rows: pa.Table, kind: int, first: bool = False, docs: int = 0, began: pa.Table | None = None) -> list[pa.RecordBatch]:
        n = rows.num_rows
        flags = np.zeros(n, bool)
        flags[:1] = first
        columns = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, chunk, np.int64)), *[rows[c] for c in ROW]]
        columns += [pa.array(flags), pa.array(np.full(n, docs, np.int64)), *[(rows if began is None else began)[c] for c in DOCUMENT]]
        return pa.table(columns, schema=schema).to_batches()

    def fed(run: _Run, rows: pa.Table, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = run.feed(rows, docs, least)
        if out is None:
            return
        if keep_first and not run.given:
            if run.opening:  # an earlier partition may have the line's first occurrence
                yield from given(out.slice(0, 1), _OPEN, True)
            out = out.slice(1)
        run.given = True
        yield from given(out, _GOES)

    def closed(run: _Run) -> Iterator[pa.RecordBatch]:
        if run.held:
            yield from given(pa.concat_tables(run.held), _OPEN, not run.given)
        yield from given(run.final, _SUMMARY, docs=run.docs, began=run.first)

    run, end = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).select(ROW)
        lines = _changes(rows, LINE)
        docs = lines | _changes(rows, DOCUMENT)
        if run is None:
            run = _Run(True, rows.slice(0, 1))
        elif end.equals(rows.slice(0, 1).select(LINE)):
            lines[0] = False
        starts = np.flatnonzero(lines)
        if run.last is None:
            starts = starts[1:]
        head = int(starts[0]) if len(starts) else rows.num_rows
        if head:
            yield from fed(run, rows.slice(0, head), docs[:head])
        if len(starts):
            if run.opening:
                yield from closed(run)
            tail = int(starts[-1])
            if tail > head:
                sizes = np.diff(starts)
                goes = np.repeat(np.add.reduceat(docs[:tail].astype(np.int64), starts[:-1]) >= least, sizes)
                if keep_first:
                    goes[starts[:-1] - head] = False
                yield from given(rows.slice(head, tail - head).filter(pa.array(goes)), _GOES)
            run = _Run(False, rows.slice(tail, 1))
            yield from fed(run, rows.slice(tail), docs[tail:])
        end = run.final.select(LINE)
    if run is not None:
        yield from closed(run)


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, position) of the lines that go.

    A line goes if its key is in ``min_docs`` documents or more; with ``keep_first`` the first of all
    its occurrences, by document and position, stays.
    """
    # Written first, for a range partitioning reads its input twice.
    rows = materialize(line_hashes(docs, min_chars), "hashes")
    placed = rows.repartitionByRange(chunk_count(docs), *ROW).sortWithinPartitions(*ROW)
    id_type = dict(rows.dtypes)["doc_id"]
    schema = (
        f"kind int, chunk bigint, high bigint, low bigint, doc_id {id_type}, text_hash bigint, position int, "
        f"first boolean, docs bigint, first_doc {id_type}, first_hash bigint"
    )
    arrow = _arrow_schema(rows, schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _streamed(batches, min_docs, keep_first, arrow)

    found = materialize(placed.mapInArrow(stream, schema), "lines")
    # Two summaries a partition: a line that several partitions hold counts a document once that goes on in the next.
    w = W.partitionBy(*LINE).orderBy("chunk")
    again = F.lag("doc_id").over(w).eqNullSafe(F.col("first_doc")) & F.lag("text_hash").over(w).eqNullSafe(F.col("first_hash"))
    summaries = found.filter(F.col("kind") == _SUMMARY).withColumn("docs", F.col("docs") - again.cast("bigint"))
    edges = summaries.groupBy(*LINE).agg(F.sum("docs").alias("total"), F.min("chunk").alias("start")).filter(F.col("total") >= min_docs)
    # Two rows a partition at most.
    settled = found.filter(F.col("kind") == _OPEN).join(F.broadcast(edges), LINE)
    if keep_first:
        settled = settled.filter(~(F.col("first") & (F.col("chunk") == F.col("start"))))
    columns = [*DOCUMENT, "position"]
    return found.filter(F.col("kind") == _GOES).select(*columns).unionByName(settled.select(*columns))


def _arrow_schema(rows: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def packed(positions: np.ndarray) -> bytes:
    """Compressed bitmap: bit i (most significant first) is set if line i stays; lines beyond its end stay."""
    bits = np.ones(-(-(int(positions.max()) + 1) // 8) * 8, np.uint8)
    bits[positions] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def without(text: str | None, bitmap: bytes | None) -> str:
    """The lines of ``text`` that ``bitmap`` keeps, joined by newlines."""
    if bitmap is None:
        return text or ""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    gone = np.flatnonzero(bits == 0).tolist()
    for at in reversed(gone):
        del lines[at]
    return "\n".join(lines)


def line_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_dropped, bitmap) of every document that loses lines; the others keep all.

    ``text_hash`` is the XXH64 of the whole text, null included.
    """

    @F.pandas_udf("binary")
    def bitmap(positions: pd.Series) -> pd.Series:
        return pd.Series([packed(np.asarray(p)) for p in positions], dtype=object)

    with scratch() as kept:
        gone = dropped_lines(docs, min_docs, min_chars, keep_first)
        # One document's lines; repeated rows are one document.
        per_doc = gone.groupBy(*DOCUMENT).agg(F.collect_set("position").alias("positions"))
        out = per_doc.select("doc_id", "text_hash", F.size("positions").cast("bigint").alias("n_dropped"), bitmap("positions").alias("bitmap"))
        kept.append(materialize(out, "bitmaps"))
    return kept[0]


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """Every row's ``doc_id``, ``n_lines`` (before), ``n_dropped`` and ``kept_text``.

    A text splits at newlines; null and empty ones are one empty line, which has no key and stays.
    A document is a distinct pair of id (null too) and text: repeated rows count once towards
    ``min_docs`` and lose the same lines, equal ids with different texts count twice. A document
    that loses all its lines has an empty text. An empty table gives an empty one.
    """
    bitmaps = line_bitmaps(docs, min_docs, min_chars, keep_first)
    text = F.col("text").cast("string")
    # A struct, for a null id must find its bitmap as well. Joined by shuffle at any size: bitmaps grow with the
    # documents, and one way makes what small runs cost say what large ones do.
    given = docs.select("doc_id", text.alias("text"), F.struct(*_document(text)).alias("document"), F.size(_lines(text)).cast("bigint").alias("n_lines"))
    side = bitmaps.select(F.struct(*DOCUMENT).alias("document"), "n_dropped", "bitmap")
    joined = lookup(given, side, ["document"], ["doc_id"], "left", _DOCS_PER_TASK, force_salt=True)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([without(t, b) for t, b in zip(texts, maps)], dtype=object)

    return joined.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), cut("text", "bitmap").alias("kept_text"))


def line_digests(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``deduplicated`` with the SHA-256 of the kept text instead of the text."""
    rows = deduplicated(docs, min_docs, min_chars)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
