"""Language identification by interpolated Kneser-Ney character models.

Spark counts character n-grams of a bounded sample of labelled documents. Each order's
n-grams of all languages stand as sorted 64-bit hashes beside their probabilities per
language. A text goes to the language with the lowest cross-entropy per character;
confidence and the limit for rejection are calibrated on sample documents left out of
the counts. Words are scored on their own, with a boundary on both sides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

ORDER = 4
# The sample: of each language the documents with the smallest hashes, up to so many rows and characters in all.
SAMPLE_ROWS = 12_000
SAMPLE_CHARS = 40_000_000
CALIBRATION = 5  # every so many documents of the sample calibrate
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TOGETHER = 50_000
_REJECTED = 0.001
_PARTS = 256


def _words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _hashes(points: np.ndarray, orders: int) -> list[np.ndarray]:
    """Hashes of the 1..orders-grams that end at each place, modulo 2**64."""
    mixed = (points.astype(np.uint64) + np.uint64(1)) * _BASE
    mixed ^= mixed >> np.uint64(29)
    out = [mixed]
    for k in range(1, orders):
        longer = out[-1].copy()
        longer[k:] = out[-1][k:] * np.uint64(31) + np.roll(mixed, k)[k:] * np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64))
        out.append(longer)
    return out


def _gram_hash(grams: list[str]) -> np.ndarray:
    """The hashes ``_hashes`` gives these n-grams of one order."""
    if not grams:
        return np.zeros(0, np.uint64)
    points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = len(grams[0])
    return _hashes(points, size)[-1][size - 1 :: size]


def gram_counts(texts: Iterator[str | None], order: int) -> Counter:
    """Counts of the n-grams that end at a letter or at the boundary behind a word; the first boundary is context only."""
    words = Counter(w for t in texts for w in _words(t))
    out: Counter = Counter()
    for word, n in words.items():
        padded = f" {word} "
        for end in range(2, len(padded) + 1):
            for size in range(1, min(order, end) + 1):
                out[padded[end - size : end]] += n
    return out


@dataclass(frozen=True)
class Model:
    """Per order sorted hashes, log10 probabilities and back-off weights (rows: n-grams, columns: languages)."""

    languages: tuple[str, ...]
    keys: tuple[np.ndarray, ...]
    logs: tuple[np.ndarray, ...]
    backoffs: tuple[np.ndarray, ...]
    floor: np.ndarray
    sharpness: float = 1.0
    limits: tuple[float, ...] = ()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Sum of log10 probabilities of each word's characters, one column a language."""
        points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) + 2 for w in words])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        depth = np.arange(len(points)) - np.repeat(starts, lengths)  # letters before this one in its word
        log = np.tile(self.floor, (len(points), 1))
        context = None
        for k, hashes in enumerate(_hashes(points, len(self.keys))):
            keys = self.keys[k]
            at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            known = (keys[at] == hashes) & (depth >= k) if len(keys) else np.zeros(len(points), bool)
            if context is not None:  # the (k-1)-gram that ended one place before
                used = np.flatnonzero(~known & (depth >= k) & np.roll(context >= 0, 1))
                log[used] += self.backoffs[k - 1][context[used - 1]]
            log[known] = self.logs[k][at[known]]
            context = np.where(known, at, -1)
        log[depth == 0] = 0.0
        return np.add.reduceat(log, starts, axis=0)


def fitted(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney for each language from its n-gram counts."""
    languages = tuple(sorted(counts))
    letters = len({g for c in counts.values() for g in c if len(g) == 1}) + 1
    grams = [sorted({g for c in counts.values() for g in c if len(g) == k} | ({" "} if k == 1 else set())) for k in range(1, order + 1)]
    logs = [np.zeros((len(g), len(languages))) for g in grams]
    backoffs = [np.zeros((len(g), len(languages))) for g in grams]
    floor = np.zeros(len(languages))  # of a character that no language has
    for column, language in enumerate(languages):
        by_order: list[Counter] = [Counter() for _ in range(order)]
        for g, n in counts[language].items():
            by_order[len(g) - 1][g] = n
        # Lower orders count the different letters in front; n-grams at a word's start have none and keep their counts.
        used = [Counter() for _ in range(order - 1)] + [by_order[-1]]
        for k in range(order - 1):
            for g in by_order[k + 1]:
                used[k][g[1:]] += 1
            for g, n in by_order[k].items():
                if g[0] == " " and len(g) > 1:
                    used[k][g] = n
        probability: dict[str, float] = {}
        for k in range(order):
            tally = Counter(used[k].values())
            discount = tally[1] / (tally[1] + 2 * tally[2]) if tally[1] and tally[2] else 0.5
            total, kinds = Counter(), Counter()
            for g, n in used[k].items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            shares = {h: discount * kinds[h] / total[h] for h in total}
            longer = {}
            for i, g in enumerate(grams[k]):
                lower = probability[g[1:]] if k else 1 / letters
                share = shares.get(g[:-1], 1.0)
                n = used[k].get(g, 0)
                longer[g] = (max(n - discount, 0) / total[g[:-1]] if n else 0.0) + share * lower
                logs[k][i, column] = np.log10(longer[g])
            if k:
                for i, h in enumerate(grams[k - 1]):
                    backoffs[k - 1][i, column] = np.log10(shares.get(h, 1.0))
            else:
                floor[column] = np.log10(shares.get("", 1.0) / letters)
            probability = longer
    ordered = []
    for k in range(order):
        hashes = _gram_hash(grams[k])
        by = np.argsort(hashes)
        ordered.append((hashes[by], logs[k][by], backoffs[k][by]))
    return Model(languages, *(tuple(x) for x in zip(*ordered)), floor)


def cross_entropies(model: Model, texts) -> np.ndarray:
    """log10 cross-entropy per character of each text, one column a language; NaN without letters."""
    place: dict[str, int] = {}
    counted = [Counter(_words(t)) for t in texts]
    for c in counted:
        for w in c:
            place.setdefault(w, len(place))
    words = list(place)
    parts = [model.word_scores(words[at : at + _TOGETHER]) for at in range(0, len(words), _TOGETHER)]
    scores = np.concatenate(parts) if parts else np.zeros((0, len(model.languages)))
    out = np.full((len(counted), len(model.languages)), np.nan)
    for i, c in enumerate(counted):
        if c:
            times = np.fromiter(c.values(), np.float64, len(c))
            letters = sum(n * (len(w) + 1) for w, n in c.items())
            out[i] = -(times @ scores[[place[w] for w in c]]) / letters
    return out


def learnable(docs: DataFrame) -> Column:
    """Documents whose labels may be learned from: not held out and labelled."""
    return ~held_out() & F.col("lang").isNotNull()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """``place``, ``text``, ``lang`` and whether it ``leads`` its language, of whole documents; both bounds are shared
    out evenly over the languages.

    A language gives its documents of the smallest hashes, at least one, whatever part of all rows it has.
    Rows alike in id, text and language count once.
    """
    place = F.xxhash64("doc_id", "text")  # rows without an id differ by their text
    given = docs.filter(learnable(docs)).select(place.alias("place"), "text", "lang")
    languages = given.agg(F.countDistinct("lang")).first()[0]
    share = lambda bound: max(bound // max(languages, 1), 1)
    sizes = given.select("lang", "place", F.coalesce(F.length("text"), F.lit(0)).alias("n")).distinct()
    # First within parts of a language, so that none of them has to be ranked as a whole.
    part = F.pmod("place", F.lit(_PARTS))
    ahead = sizes.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy("place")))
    within = Window.partitionBy("lang").orderBy("place")
    ranked = ahead.filter(F.col("rank") <= share(rows)).withColumn("rank", F.row_number().over(within))
    so_far = F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0))
    first = ranked.filter(F.col("rank") <= share(rows)).withColumn("chars", so_far)
    leads = F.col("rank") == 1
    picked = first.filter((F.col("chars") <= share(chars)) | leads).select("lang", "place", leads.alias("leads"))
    # No more than ``rows`` rows, or one a language.
    found = given.join(F.broadcast(picked), ["lang", "place"])
    alike = found.groupBy("lang", "place", "leads").agg(F.first("text").alias("text"))
    return alike.select("place", "text", "lang", "leads")


def learned(docs: DataFrame, order: int = ORDER, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """Model and calibration from the sample; None if nothing is labelled.

    The n-grams that reach the driver are no more than the sample's characters times ``order``.
    """
    picked = sample(docs, rows, chars)
    # A language's first document is always learned, so that no language is left out.
    calibrates = (F.pmod(F.shiftright("place", 7), F.lit(CALIBRATION)) == 0) & ~F.col("leads")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                c = gram_counts(texts, order)
                grams = pd.DataFrame({"gram": pd.Series(list(c), dtype=object), "n": np.fromiter(c.values(), np.int64, len(c))})
                grams.insert(0, "lang", pd.Series([lang] * len(c), dtype=object))
                yield grams

    counted = picked.filter(~calibrates).select("lang", "text").mapInPandas(count, "lang string, gram string, n bigint")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if table.empty:
        return None
    counts = {lang: dict(zip(t["gram"], t["n"].tolist())) for lang, t in table.groupby("lang")}
    model = fitted(counts, order)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = cross_entropies(model, batch["text"])
            yield pd.DataFrame({"lang": batch["lang"], "scores": list(found)})

    seen = picked.filter(calibrates & F.col("text").isNotNull()).mapInPandas(score, "lang string, scores array<double>").toPandas()
    return calibrated(model, [(a, np.array(s)) for a, s in zip(seen["lang"], seen["scores"])])


def _shares(values: np.ndarray, sharpness: float) -> np.ndarray:
    z = -(values - values.min(axis=-1, keepdims=True)) * sharpness
    e = np.exp(z)
    return e / e.sum(axis=-1, keepdims=True)


def calibrated(model: Model, seen: list[tuple[str, np.ndarray]]) -> Model:
    """Sharpness with the best likelihood, and per language the cross-entropy that all but a thousandth stay below."""
    at = {lang: i for i, lang in enumerate(model.languages)}
    pairs = [(at[lang], s) for lang, s in seen if lang in at and not np.isnan(s).any()]
    if not pairs:
        return Model(model.languages, model.keys, model.logs, model.backoffs, model.floor, 1.0, (float("inf"),) * len(at))
    truth, values = np.array([t for t, _ in pairs]), np.array([s for _, s in pairs])
    grid = [2.0**i for i in range(-2, 9)]
    likelihood = [np.log(np.maximum(_shares(values, g)[np.arange(len(truth)), truth], 1e-12)).sum() for g in grid]
    limits = tuple(
        float(np.quantile(values[truth == i, i], 1 - _REJECTED)) * 1.1 if (truth == i).any() else float("inf") for i in range(len(at))
    )
    return Model(model.languages, model.keys, model.logs, model.backoffs, model.floor, grid[int(np.argmax(likelihood))], limits)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per input row ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0, as is all without a model.
    Of equally good languages the first by name wins. ``rejected`` marks texts beyond the
    language's limit; their prediction stands.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out = batch[["doc_id", "held_out"]].copy()
            out["lang_pred"], out["score"], out["cross_entropy"], out["rejected"] = UNKNOWN, 0.0, np.nan, True
            values = cross_entropies(model, batch["text"]) if model else np.full((len(batch), 1), np.nan)
            at = np.flatnonzero(~np.isnan(values).any(axis=1))
            if len(at):
                best = values[at].argmin(axis=1)
                entropy = values[at, best]
                out.iloc[at, 2] = np.array(model.languages, object)[best]
                out.iloc[at, 3] = _shares(values[at], model.sharpness)[np.arange(len(at)), best]
                out.iloc[at, 4] = entropy
                out.iloc[at, 5] = entropy > np.array(model.limits)[best]
            yield out

    given = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = dict(given.dtypes)["doc_id"]
    return given.mapInPandas(
        predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
    )


def identified(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` and predict all of it."""
    return predicted(docs, learned(docs))
