"""Exact-size draws and splits by hash rank.

A row's rank is its place in the order of ``md5(seed | key)``. Instead of sorting,
the hash value at a wanted rank is found from a histogram of hash prefixes; the
draw itself is then a plain filter that needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from tracewright.functions.columns import hash_key

HASH = "_hash"
_STEP = 3
_EXACT_ROWS = 50_000
_MAX_STRATA = 10_000


def _locate(rows: DataFrame, prefix: str, rank: int, size: int) -> str:
    """Hash of the ``rank``-th row (1-based) among rows sharing ``prefix``."""
    while size > _EXACT_ROWS and len(prefix) < 32:
        depth = len(prefix) + _STEP
        bins = (
            rows.groupBy(F.substring(HASH, 1, depth).alias("p"))
            .agg(F.count("*").alias("n"))
            .orderBy("p")
            .collect()  # 16**_STEP rows at most
        )
        for row in bins:
            if rank <= row["n"]:
                prefix, size = row["p"], row["n"]
                break
            rank -= row["n"]
        rows = rows.filter(F.col(HASH).startswith(prefix))
    # A tie group, or no more than _EXACT_ROWS rows.
    if len(prefix) >= 32:
        return prefix
    return rows.select(HASH).orderBy(HASH).offset(rank - 1).limit(1).first()[0]


def rank_hashes(df: DataFrame, strata: list[str], cuts: Callable[[int], list[int]]) -> dict:
    """Per stratum, the hash values that close each cut: ``{values: (n, [hash or None])}``.

    ``cuts(n)`` gives ascending row counts; a cut of 0 yields None.
    """
    prefix = F.substring(HASH, 1, _STEP).alias("_p")
    hist = df.groupBy(*strata, prefix).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*strata) if strata else W.partitionBy(F.lit(1))
    # At most 16**_STEP rows per stratum reach this window.
    hist = hist.withColumn("_upto", F.sum("_n").over(w.orderBy("_p"))).withColumn(
        "_total", F.sum("_n").over(w)
    ).persist()
    sizes = hist.select(*strata, "_total").distinct().limit(_MAX_STRATA + 1).collect()
    if len(sizes) > _MAX_STRATA:
        raise ValueError(f"more than {_MAX_STRATA} strata: {strata} is not a stratum key")
    wanted, out = [], {}
    for row in sizes:
        key = tuple(row[s] for s in strata)
        marks = cuts(row["_total"])
        out[key] = (row["_total"], [None] * len(marks))
        for place, cut in enumerate(marks):
            if cut > 0:
                wanted.append((key, place, min(cut, row["_total"])))
    if not wanted:
        hist.unpersist()
        return out
    spark = df.sparkSession
    fields = [f for f in df.schema.fields if f.name in strata]
    schema = ", ".join(
        [f"`{s}` {next(f for f in fields if f.name == s).dataType.simpleString()}" for s in strata]
        + ["_place int", "_cut bigint"]
    )
    marks = spark.createDataFrame([(*k, p, c) for k, p, c in wanted], schema)
    same = [hist[s].eqNullSafe(marks[s]) for s in strata]
    inside = (F.col("_cut") <= F.col("_upto")) & (F.col("_cut") > F.col("_upto") - F.col("_n"))
    cond = inside
    for c in same:
        cond = cond & c
    # One row per cut: the histogram bin the cut falls in.
    found = hist.join(F.broadcast(marks), cond).select(
        *[marks[s] for s in strata], "_place", "_p", "_n",
        (F.col("_cut") - F.col("_upto") + F.col("_n")).alias("_rank"),
    ).persist()
    bins = found.collect()
    deep = [b for b in bins if b["_n"] > _EXACT_ROWS]
    small = found.filter(F.col("_n") <= _EXACT_ROWS)
    cond = F.substring(df[HASH], 1, _STEP) == small["_p"]
    for s in strata:
        cond = cond & df[s].eqNullSafe(small[s])
    group = W.partitionBy(*[f"_k{i}" for i in range(len(strata))], "_place").orderBy(HASH)
    near = df.select(*strata, HASH).join(F.broadcast(small), cond).select(
        *[small[s].alias(f"_k{i}") for i, s in enumerate(strata)], "_place", "_rank", df[HASH]
    )
    picks = near.withColumn("_r", F.row_number().over(group)).filter("_r = _rank").collect()
    for row in picks:
        key = tuple(row[f"_k{i}"] for i in range(len(strata)))
        out[key][1][row["_place"]] = row[HASH]
    for b in deep:
        key = tuple(b[s] for s in strata)
        rows = df.filter(F.col(HASH).startswith(b["_p"]))
        for s, value in zip(strata, key):
            rows = rows.filter(F.col(s).eqNullSafe(F.lit(value)))
        out[key][1][b["_place"]] = _locate(rows, b["_p"], b["_rank"], b["_n"])
    found.unpersist()
    hist.unpersist()
    return out


def hashed_split(
    df: DataFrame,
    key: list[str],
    strata: list[str],
    names: list[str],
    cuts: Callable[[int], list[int]],
    seed: int | str,
    column: str = "split",
) -> DataFrame:
    """Give every row one of ``names`` by hash rank inside its stratum.

    ``key`` must be unique. ``cuts(n)`` returns the cumulative row counts that end
    each name but the last, which takes the rest.
    """
    hashed = df.withColumn(HASH, hash_key(seed, *key))
    bounds = rank_hashes(hashed, strata, cuts)
    spark = df.sparkSession
    marks = len(names) - 1
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(
        [f"`_s{i}` {fields[s]}" for i, s in enumerate(strata)] + [f"_t{i} string" for i in range(marks)]
    )
    table = spark.createDataFrame(
        [(*stratum, *[h or "" for h in hashes]) for stratum, (_, hashes) in bounds.items()], schema
    )
    rule = None
    for i, name in enumerate(names[:-1]):
        test = F.col(HASH) <= F.col(f"_t{i}")
        rule = F.when(test, F.lit(name)) if rule is None else rule.when(test, F.lit(name))
    rule = rule.otherwise(F.lit(names[-1]))
    if not strata:
        _, hashes = next(iter(bounds.values()), (0, [None] * marks))
        out = hashed
        for i, h in enumerate(hashes):
            out = out.withColumn(f"_t{i}", F.lit(h or ""))
        return out.withColumn(column, rule).select(*df.columns, column)
    cond = F.lit(True)
    for i, s in enumerate(strata):
        cond = cond & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    # One row per stratum, at most _MAX_STRATA.
    return hashed.join(F.broadcast(table), cond).withColumn(column, rule).select(*df.columns, column)


def hashed_sample(df: DataFrame, n: int, key: list[str], seed: int | str) -> DataFrame:
    """Exactly ``n`` rows (all rows when there are fewer), the same ones for the same seed."""
    marked = hashed_split(df, key, [], ["in", "out"], lambda size: [min(n, size)], seed, "_draw")
    return marked.filter(F.col("_draw") == "in").drop("_draw")
