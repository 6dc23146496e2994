"""Quality rules, near duplicates, decontamination, pseudonyms and token ids against plain Python."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash

from tracewright.llm import decontaminate, pieces, pii, quality, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame(
        [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], SCHEMA
    )


def odd_tables(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and a table without rows."""
    texts = [None, "", " \t\n", "a", "one two", "x" * 50_000, "and the of to in " * 8_000, "▁ ▁▁", "\U0001F600 ok  "]
    docs = table(spark, texts + texts[:4], [0, 1, 2, 3, None, 5, 6, 7, 8, 0, 1, 2, 3])
    clashing = ["row", "words", "hashes", "kept", "moved", "found", "fingerprint", "seed", "text_hash", "_d", "ids", "variant"]
    for name in clashing:
        docs = docs.selectExpr("*", f"'c' as {name}")
    return docs, docs.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# quality rules

def counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark, docs):
    random.seed(5)
    made = [" ".join(random.choice("abc") for _ in range(random.randrange(60))) for _ in range(60)]
    made += ["the the the the\n" * 12, "# | x\n# | x\n\ny", " ".join(map(str, range(30)))]
    both = docs.select("doc_id", "text").unionByName(table(spark, made, range(10_000, 10_000 + len(made))).select("doc_id", "text"))
    for r in quality.verdicts(both).join(both, "doc_id").collect():
        want = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_keeps_labelled(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    seen = quality.verdicts(docs).join(labels, "doc_id").filter("not base_failed")
    assert seen.filter("quality = 1 and not kept").count() == 0
    bad = seen.filter("quality = 0")
    assert bad.filter("kept").count() <= 0.2 * bad.count()


def test_quality_odd_tables(spark):
    odd, empty = odd_tables(spark)
    found = quality.verdicts(odd).collect()
    assert len(found) == odd.count() and not any(r.kept for r in found if r.n_words < 20)
    assert quality.accepted(odd).columns == odd.columns
    assert quality.verdicts(empty).count() == 0 and quality.accepted(empty).count() == 0


# near duplicates

def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Brute force over all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


def test_simhash_matches_brute_force(spark, docs):
    random.seed(7)
    words = [w for r in docs.limit(3).collect() for w in r.text.split()][:400]
    near = [" ".join(w if random.random() > 0.004 else "zz" for w in words) for _ in range(40)]
    given = docs.select("doc_id", "text").unionByName(table(spark, near, range(1000, 1040)).select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in given.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    got = simhash.near_duplicates(given).withColumn("fingerprint", simhash.as_hex("fingerprint")).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    want = components(prints)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(set(prints.values())) <= len(texts)  # some link is not an equal print
    kept = {r.doc_id for r in simhash.one_of_each(given).collect()}
    assert kept == set(want.values())


def test_links_reach_across_chains(spark):
    prints = [0, 3, 15, 1 << 63, (1 << 63) | (1 << 62) | 3, 0x0F0F0F0F]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")).collect()
    linked = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in pairs}
    assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, linked))
    assert {frozenset((0, 3)), frozenset((3, 15)), frozenset((0, 1 << 63))} <= linked
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(0,)], "fingerprint bigint"), 3)


def test_simhash_odd_tables(spark):
    odd, empty = odd_tables(spark)
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    assert all(r.component_id == 0 for r in found if r.doc_id in (0, 1, 2))  # no words: fingerprint zero
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and None in ids
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


# decontamination

def plain_tiles(item, text, least):
    free_a, free_b, out = [True] * len(item), [True] * len(text), []
    for size in range(min(len(item), len(text)), least - 1, -1):
        for i in range(len(item) - size + 1):
            for j in range(len(text) - size + 1):
                if item[i : i + size] == text[j : j + size] and all(free_a[i : i + size]) and all(free_b[j : j + size]):
                    free_a[i : i + size] = free_b[j : j + size] = [False] * size
                    out.append((i, j, size))
    return out


def test_tiles_match_brute_force():
    random.seed(1)
    for _ in range(800):
        kinds = random.choice([2, 4, 8])
        a = [random.randrange(kinds) for _ in range(random.randrange(25))]
        b = [random.randrange(kinds + 1) for _ in range(random.randrange(60))]
        if a and random.random() < 0.5:
            b[3:3] = a[len(a) // 2 :] + [9] + a[: len(a) // 2]
        least = random.choice([2, 3, 5])
        assert decontaminate.tiles(a, b, least) == plain_tiles(a, b, least)


def test_contamination_matches_brute_force(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    passages = {r.item_id: r.text.lower().split() for r in items.collect()}
    random.seed(3)
    filler = [w for r in docs.limit(2).collect() for w in r.text.split()]
    made = []
    for i, words in list(passages.items())[:12]:
        n = len(words)
        parts = [words[n // 2 :], words[: n // 2]]  # moved halves
        made.append(" ".join(filler[:30] + parts[0] + filler[30:37] + parts[1] + filler[40:60]).upper())
        made.append(" ".join(filler[:20] + words[: n // 3] + filler[20:40]))  # too little of it
    given = docs.select("doc_id", "text").unionByName(table(spark, made, range(5000, 5000 + len(made))).select("doc_id", "text"))
    want = {}
    for r in given.collect():
        words = r.text.lower().split()
        hits = {i: sum(s for *_, s in decontaminate.tiles(p, words)) / len(p) for i, p in passages.items()}
        want[r.doc_id] = sum(c >= decontaminate.COVERAGE for c in hits.values())
    got = decontaminate.contamination(given, items).collect()
    assert {r.doc_id: r.n_items for r in got} == want
    assert all(want[5000 + 2 * k] for k in range(12)) and sum(map(bool, want.values())) < len(want)
    kept = {r.doc_id for r in decontaminate.clean(given, items).collect()}
    assert kept == {i for i, n in want.items() if not n}


def test_decontamination_odd_tables(spark):
    odd, empty = odd_tables(spark)
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "and the of to in and the of to in"), (4, "again"), (None, "x")], "item_id bigint, text string")
    found = decontaminate.contamination(odd, items).collect()
    assert len(found) == odd.count() and [r.doc_id for r in found if r.contaminated] == [6]
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.clean(odd, items).count() == odd.count() - 1
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).filter("contaminated").count() == 0


# pseudonyms

def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


PERSONAL = [
    ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("card", "378282246310005"),
    ("phone", "+1 (743) 555-3824"), ("phone", "743-555-3824"), ("phone", "(743) 555-3824"), ("phone", "+442079460958"),
    ("address", "227.5.221.1"), ("social", "123-45-6789"), ("date", "2024-02-29"), ("date", "31.12.1999"), ("date", "29/02/2000"),
    ("date", "12/31/1999"), ("email", "und.34@mail7.example.com"), ("email", "A.b-9@x.org"),
]
HARMLESS = ["4111111111111112", "256.1.1.1", "000-12-3456", "2023-02-29", "1999-13-01", "1234567", "12.5", "a@b", "x@y.z1"]


def moved(spark, values, key="k"):
    out = pii.pseudonymized(table(spark, [f"see {v}, then" for v in values]), key)
    return [(r.text, r) for r in out.orderBy("doc_id").collect()]


def test_pseudonyms_keep_the_format(spark):
    for (kind, old), (text, row) in zip(PERSONAL, moved(spark, [v for _, v in PERSONAL])):
        new = text.removeprefix("see ").removesuffix(", then")
        assert new != old and row[f"n_{kind}"] == row.n_moved == 1, (old, text)
        shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
        if kind != "address":
            assert shape(new) == shape(old)
        if kind == "card":
            assert luhn(re.sub("[^0-9]", "", new)) == 0 and new[0] == old[0]
        if kind == "address":
            assert all(int(x) < 256 for x in new.split("."))
    for old, (text, row) in zip(HARMLESS, moved(spark, HARMLESS)):
        assert text == f"see {old}, then" and row.n_moved == 0


def test_pseudonyms_are_a_keyed_permutation(spark):
    values = [f"10.0.{a}.{b}" for a in range(40) for b in range(50)]
    new = [t for t, _ in moved(spark, values)]
    assert len(set(new)) == len(values)
    assert [t for t, _ in moved(spark, values[:5])] == new[:5] != [t for t, _ in moved(spark, values[:5], "other")]
    whole = spark.range(189 * 11).select(pii.permuted(pii.F.col("id"), 189, 11, "k", "t").alias("x"))
    assert sorted(r.x for r in whole.collect()) == list(range(189 * 11))


def test_pseudonyms_in_place(spark):
    text = "4111111111111111 4111111111111111\n+1 (743) 555-3824 und.34@mail7.example.com. 7536784127813050 484516811"
    new = moved(spark, [text])[0][0]
    first, second = re.findall(r"\d{16}", new)[:2]
    assert first == second != "4111111111111111" and "mail7.example.com. " in new and len(new) == len(text) + 10


def test_pseudonyms_odd_tables(spark):
    odd, empty = odd_tables(spark)
    out = pii.masked(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    assert out.select("doc_id", "text", "n_chars").exceptAll(odd.select("doc_id", "text", "n_chars")).count() == 0
    assert out.count() == odd.count()
    assert pii.masked(empty).count() == 0 and pii.pseudonymized(empty).count() == 0


# token ids

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def plain_viterbi(vocabulary, unknown, text):
    number = {p: i for i, p in enumerate(vocabulary.pieces) if i not in vocabulary.special}
    longest = max(map(len, number))
    best = [(0.0, None, None)]
    for end in range(1, len(text) + 1):
        found = None
        for start in range(max(0, end - longest), end):
            piece = number.get(text[start:end])
            if piece is None and end - start > 1:
                continue
            score = best[start][0] + (unknown if piece is None else vocabulary.scores[piece])
            if found is None or score > found[0]:
                found = (score, start, piece)
        best.append(found)
    out, end = [], len(text)
    while end:
        _, start, piece = best[end]
        out[:0] = [piece] if piece is not None else [vocabulary.byte_ids[b] for b in text[start].encode()]
        end = start
    return out


def test_viterbi_matches_brute_force_and_round_trips(vocabulary):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=pieces.MODEL)
    coder = pieces.Coder(vocabulary)
    random.seed(2)
    letters = "abcdehinorst  éèßñ\n\t.,%世\U0001F600▁   AB12"
    for _ in range(400):
        text = "".join(random.choice(letters) for _ in range(random.randrange(60)))
        ids = coder.encode(text).tolist()
        assert coder.decode(ids) == text
        if text and "▁" not in text:
            spaced = ("▁" + text).replace(" ", "▁")
            assert ids == plain_viterbi(vocabulary, coder.unknown, spaced) == list(coder.stream(spaced))
            assert model.decode(ids) == text


def test_stream_gives_ids_early_and_stays_small(vocabulary):
    coder = pieces.Coder(vocabulary)
    text = "▁" + "thing" * 40_000
    stream = coder.stream(text)
    first = [next(stream) for _ in range(3)]
    assert first == list(coder.stream(text[:200]))[:3]
    assert coder.decode(first + list(stream)) == "thing" * 40_000


def test_token_ids_on_tables(spark, docs):
    out = pieces.round_trips(docs).collect()
    assert len(out) == docs.count() and all(r.restored and r.n_ids == len(r.ids) for r in out)
    odd, empty = odd_tables(spark)
    found = pieces.round_trips(odd).collect()
    assert len(found) == odd.count()
    assert all((r.ids is None) == (r.n_ids is None) == (r.restored is None) and r.restored is not False for r in found)
    assert pieces.round_trips(empty).count() == 0
    whole = odd.filter("text is not null")
    back = pieces.decoded(pieces.encoded(whole).drop("doc_id")).select("decoded_text")
    assert back.exceptAll(whole.select("text")).count() == 0 and back.count() == whole.count()
