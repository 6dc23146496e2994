"""Line bitmaps, whitening and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.test_filters import odd_tables, table
from tracewright.llm import line_dedup, resampling, whitening

BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# line dedup

def plain_lines(rows, least, keep_first=False):
    """(n_lines, n_dropped, kept) of each (doc_id, text)."""
    seen = defaultdict(set)
    for i, t in rows:
        for at, line in enumerate((t or "").split("\n")):
            key = ascii_lower(line.strip(BLANKS))
            if key:
                seen[key].add((i, t))
    first = {}
    for i, t in rows:
        for at, line in enumerate((t or "").split("\n")):
            key = ascii_lower(line.strip(BLANKS))
            first[key] = min(first.get(key, (i, at)), (i, at)) if keep_first else None
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [ascii_lower(x.strip(BLANKS)) for x in lines]
        kept = [x for at, (x, k) in enumerate(zip(lines, keys)) if len(seen[k]) < least or (keep_first and first[k] == (i, at))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def found_lines(df):
    return [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()]


@pytest.fixture(params=[3, 10_000])
def batch_rows(spark, request):
    """Runs that end within a batch and runs over many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(request.param))
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_against_plain(spark, batch_rows, keep_first):
    random.seed(4)
    pool = [f"Line {k}" for k in range(12)] + ["", "  ", "\tLINE 3 \r", "Ä line", "ä line", "common"]
    texts = []
    for _ in range(90):
        lines = random.choices(pool, k=random.randrange(1, 9)) + [f"own {random.random()}"]
        if random.random() < 0.8:
            lines += ["common"] * random.randrange(1, 30)
        random.shuffle(lines)
        texts.append("\n".join(lines))
    rows = list(enumerate(texts))
    for least in (2, 10, 25, 60):
        got = found_lines(line_dedup.deduplicated(table(spark, texts), least, keep_first=keep_first))
        assert sorted(got) == sorted(plain_lines(rows, least, keep_first)), least


def test_lines_odd_tables(spark):
    odd, empty = odd_tables(spark)
    assert line_dedup.deduplicated(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = found_lines(line_dedup.deduplicated(odd, 2))
    assert sorted(got, key=str) == sorted(plain_lines(rows, 2), key=str)
    # A null id is a document's name like any other; repeated rows are one document.
    made = table(spark, ["x\na", "x\nb", "x\nb", "x\nc"], [None, None, None, 3])
    assert sorted(r[3] for r in found_lines(line_dedup.deduplicated(made, 3))) == ["a", "b", "b", "c"]
    assert all("x" in r[3] for r in found_lines(line_dedup.deduplicated(made, 4)))


def test_bitmaps_are_small_and_whole(spark):
    text = "\n".join(["same"] * 100_000 + ["own"])
    docs = table(spark, [text + str(k) for k in range(10)])
    for r in line_dedup.line_bitmaps(docs).collect():
        assert r.n_dropped == 100_000 and len(r.bitmap) < 1000
        assert line_dedup.without(text, r.bitmap) == "own"


# whitening

def vectors(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<float>")


def exact_covariance(x):
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return s, [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]


def test_whitening_against_exact_sums(spark):
    rng = np.random.default_rng(3)
    c = (rng.normal(size=(300, 8)) @ rng.normal(size=(8, 8)) + 3).astype(np.float32)
    x = [[math.floor(float(v) * 64) + 1_000_000 for v in r] for r in c]
    n, (s, cov) = len(x), exact_covariance(x)
    values, vecs = np.linalg.eigh(np.array(cov, dtype=float))
    got = defaultdict(dict)
    for r in whitening.whitened(vectors(spark, c.tolist()), 5).collect():
        assert r.n == n and r.identity_error < 1e-9
        assert r.deviation == sum((n * v - t) ** 2 for v, t in zip(x[r.vec_id], s))
        assert abs(r.explained - values[-r.component] / values.sum()) < 1e-12
        got[r.component][r.vec_id] = r.whitened
    centred = np.array([[float(Fraction(n * v - t, n)) for v, t in zip(r, s)] for r in x])
    assert sorted(got) == [1, 2, 3, 4, 5]
    for k, column in got.items():
        want = centred @ vecs[:, -k] / math.sqrt(values[-k])
        have = np.array([column[i] for i in range(n)])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-9


def test_refinement_of_clusters():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    for gap in (1e-3, 1e-7, 1e-9, 1e-11):
        values = np.array([5, 5 - gap, 5 - 2 * gap, 4, 3, 3 - gap, *np.linspace(1, 2, 18)])
        exact = [[Fraction(v) for v in row] for row in (q * values) @ q.T]
        exact = [[(exact[i][j] + exact[j][i]) / 2 for j in range(24)] for i in range(24)]
        a = np.array([[np.longdouble(float(v)) + np.longdouble(float(v - Fraction(float(v)))) for v in r] for r in exact])
        got, x = whitening.refined_eigen(exact)
        assert (np.diff(got) <= 0).all() and np.abs(x.T @ x - np.eye(24)).max() < 1e-15 * 8
        # Vectors that are right in every digit leave no more than their own rounding.
        y = x.astype(np.longdouble)
        off = y.T @ (a @ y)
        assert np.abs(off - np.diag(np.diag(off))).max() < 2e-15
        assert np.abs(np.sort(got)[::-1] - np.sort(values)[::-1]).max() < 1e-14
    float32 = np.linalg.eigh(np.array(exact, float).astype(np.float32))[1]
    assert np.abs(float32.T @ np.array(exact, float) @ float32 - np.diag(np.diag(float32.T @ np.array(exact, float) @ float32))).max() > 1e-8


def test_equal_eigenvalues_give_some_basis():
    got, x = whitening.refined_eigen([[Fraction(2 * (i == j)) for j in range(5)] for i in range(5)])
    assert (got == 2).all() and np.abs(x.T @ x - np.eye(5)).max() < 1e-15


def test_whitening_odd_tables(spark):
    rng = np.random.default_rng(1)
    good = [[float(v) for v in r] for r in rng.normal(size=(20, 3))]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0], [1.0, 2.0]]
    df = spark.createDataFrame(
        [(None if i == 3 else i, v, "c", "c") for i, v in enumerate(good + bad + good[:2])],
        "vec_id bigint, embedding array<float>, component string, n string",
    )
    rows = whitening.whitened(df).collect()
    assert len(rows) == 22 * 3 and {r.n for r in rows} == {22}
    assert len({r.whitened for r in rows if r.component == 1}) == 20 and sum(r.vec_id is None for r in rows) == 3
    flat = vectors(spark, [[1.0, float(k), 2.0] for k in range(9)])
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}
    assert whitening.whitened(vectors(spark, [[1.0, 2.0]] * 4)).count() == 0
    none = whitening.whitened(vectors(spark, []))
    assert none.count() == 0 and none.columns == rows[0].__fields__
    far = whitening.whitened(vectors(spark, [[1e12, 0.0], [-1e12, 1.0], [0.0, 2.0]])).collect()
    assert {r.vec_id for r in far if r.deviation is None} == {0, 1} and all(r.identity_error < 1e-4 for r in far)


# importance resampling

PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_draw(docs, target, orders, buckets, least, percent, seed):
    def found(text):
        words = PLAIN.findall(ascii_lower(text or ""))
        runs = [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    source = [(i, *found(t)) for i, t in docs]
    s = Counter(b for *_, bs in source for b in bs)
    t = Counter(b for text in target for b in found(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = {}
    for i, n, bs in source:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))]
    order = sorted((i for i in out if out[i][0] >= least), key=lambda i: (-out[i][3], i))
    place = {i: k + 1 for k, i in enumerate(order[: percent * len(order) // 100])}
    return {i: (*v[1:], place.get(i)) for i, v in out.items()}


@pytest.mark.parametrize("orders", [1, 2, 3])
@pytest.mark.parametrize("head", [4, 1 << 16])
def test_resampling_against_plain(spark, monkeypatch, orders, head):
    monkeypatch.setattr(resampling, "HEAD_WORDS", head)
    monkeypatch.setattr(resampling, "HEAD_PAIRS", head)
    monkeypatch.setattr(resampling, "_PIECE", 50)
    random.seed(orders)
    words = ["Alpha", "beta", "über", "日本", "x2", "7", "don't", "a-b", "\x00z", "İ"] + [f"w{k}" for k in range(60)]
    texts = [" ".join(random.choices(words, k=random.randrange(60))) for _ in range(120)] + [None, "", "..", "beta"]
    target = [" ".join(random.choices(words[:9], k=20)) for _ in range(5)] + [None]
    items = spark.createDataFrame(list(enumerate(target)), "item_id bigint, text string")
    got = resampling.resampled(table(spark, texts), items, orders, 97, 20, 30).collect()
    want = plain_draw(list(enumerate(texts)), target, orders, 97, 20, 30, 2024)
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in got} == want


def test_resampling_odd_tables(spark):
    odd, empty = odd_tables(spark)
    items = spark.createDataFrame([(1, "and the law")], "item_id bigint, text string")
    rows = resampling.resampled(odd, items, percent=100).collect()
    assert len(rows) == odd.count() and sorted(r.rank for r in rows if r.rank) == [1]
    assert all(r.weight == 0 for r in rows if not r.n_features)
    assert resampling.resampled(empty, items).count() == 0
    assert resampling.resampled(odd, items.limit(0)).count() == odd.count()
    tied = table(spark, ["word " * 30] * 6, [5, 5, 5, 5, None, None])
    ranks = [r.rank for r in resampling.resampled(tied, items, percent=50).collect()]
    assert sorted(r for r in ranks if r) == [1, 2, 3]
