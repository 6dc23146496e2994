"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content. The ledger, a
Parquet table, records which rule versions have read which content and what they
found. A scan reads each unseen content once, with the rules it has not met, and
the findings go back to every path that holds the content by a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.operators.joins import lookup
from tracewright.session import materialize

_SPAN = "array<struct<start:bigint,end:bigint>>"
_BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost first, whose ``group`` has ``least`` characters or more. A changed rule needs a new version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run too short for these fails as a whole, so the least length may stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
]
RULES = BASE + MORE


def _running(steps: Column, first: Column) -> Column:
    """Starts of ``steps`` (gap before, length) from ``first`` on, as spans. For a few hundred steps."""
    state = F.struct(first.alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(s: Column, step: Column) -> Column:
        start = s["at"] + step["gap"]
        end = start + step["len"]
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))

    return F.aggregate(steps, state, add, lambda s: s["out"])


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans (code points, end exclusive) of a rule's matches, in order.

    Lengths of the matches and of the text between them add up to the places. Sums run
    in blocks, so that a text with very many matches takes no quadratic time.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.zip_with(
        F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), found,
        lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("len")),
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")), lambda i: F.slice(steps, i * _BLOCK + 1, F.lit(_BLOCK))
    )
    zero = F.lit(0).cast("long")
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda n, s: n + s["gap"] + s["len"]))
    firsts = F.aggregate(
        totals, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
        lambda s: s["out"],
    )
    spans = F.flatten(F.zip_with(blocks, firsts, _running))
    if rule.least:
        long = F.zip_with(spans, part, lambda s, p: F.when(F.length(p) >= rule.least, s))
        spans = F.filter(long, lambda s: s.isNotNull())
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(_SPAN))


def versions(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``digest`` of each row, a version of the path that the id names; null counts as empty."""
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


class Ledger:
    """The ledger in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, rules: list[Rule] = RULES):
        self.spark, self.folder, self.rules = spark, folder, rules

    def scans(self) -> DataFrame | None:
        """One row per scan of a content: ``digest``, keys of the ``rules`` that read it, ``spans`` with their rule."""
        try:
            return self.spark.read.parquet(f"{self.folder}/scans")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def scan(self, docs: DataFrame) -> None:
        """Read the contents in ``docs`` that some rule has not seen, and append what they hold."""
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
        before = self.scans()
        if before is None:
            todo = texts.withColumn("todo", keys)
        else:
            seen = before.groupBy("digest").agg(F.flatten(F.collect_set("rules")).alias("seen"))
            todo = texts.join(seen, "digest", "left").withColumn(
                "todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
            ).filter(F.size("todo") > 0)
        blobs = todo.select("digest", "text", "todo").dropDuplicates(["digest"])
        columns = {r.key: F.when(F.array_contains("todo", r.key), spans_of(F.col("text"), r)) for r in self.rules}
        held = blobs.select("digest", "todo", *[c.alias(f"{k}") for k, c in columns.items()])
        tagged = [
            F.transform(F.coalesce(F.col(f"`{r.key}`"), F.array().cast(_SPAN)), _tagger(r)) for r in self.rules
        ]
        held.select("digest", F.col("todo").alias("rules"), F.concat(*tagged).alias("spans")).write.mode("append").parquet(
            f"{self.folder}/scans"
        )

    def findings(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a ``digest``) and the ``spans`` in their content by the present rules, by start, then rule."""
        kinds = F.array(*[F.lit(r.key) for r in self.rules])
        hits = self.scans().filter(F.size("spans") > 0).select("digest", F.explode("spans").alias("s"))
        hits = hits.select("digest", "s.*").withColumn("rank", F.array_position(kinds, F.col("rule"))).filter("rank > 0")
        kind = F.substring_index("rule", "@", 1)
        # All spans of one text. Scans at one time may both have read it, and then found the same.
        spans = F.array_sort(F.collect_set(F.struct("start", "rank", "end", kind.alias("kind"))))
        return lookup(rows, hits.groupBy("digest").agg(spans.alias("spans")), ["digest"], ["doc_id"])


def _tagger(rule: Rule):
    return lambda s: F.struct(F.lit(rule.key).alias("rule"), s["start"].alias("start"), s["end"].alias("end"))


def _listed(spans: Column) -> Column:
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def found_secrets(docs: DataFrame, folder: str, rules: list[Rule] = RULES) -> DataFrame:
    """Scan what the ledger in ``folder`` lacks, then report every row of ``docs``.

    Columns: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``,
    ``digest`` and ``n_spans``. Null and empty texts hold nothing, repeated rows and copies
    get equal reports, rows without ``doc_id`` are reported too.
    """
    ledger = Ledger(docs.sparkSession, folder, rules)
    rows = materialize(versions(docs), "versions")
    ledger.scan(docs)
    none = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>")
    found = ledger.findings(rows).withColumn("spans", F.coalesce("spans", none))
    names = [r.kind for r in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    counts = [_number_of(k).alias(f"n_{k}") for k in names]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        "digest", F.size("spans").cast("long").alias("n_spans"),
    )


def _number_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
