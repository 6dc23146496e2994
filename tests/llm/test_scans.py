"""Shards, secrets, languages and page texts against plain Python."""

import hashlib
import html
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_filters import docs, odd_tables, table  # noqa: F401
from tracewright.llm import html_text, langid, secret_scan, sharding

# shards

def check_shards(rows, texts, shards):
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, (i for i, _ in texts)))
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        assert r.next_shard in (r.shard, shards)
    for held in places.values():
        assert sorted(held) == list(range(len(held)))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    return loads


def test_shards_are_even(spark, docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = sharding.assigned(docs, 6, 512).collect()
    loads = check_shards(rows, texts, 6)
    assert max(loads.values()) <= 1.02 * sum(loads.values()) / 6
    assert len({r.virtual_slot: r.shard for r in rows}) == len({(r.virtual_slot, r.shard) for r in rows})
    grown = Counter()
    for r in rows:
        grown[r.next_shard] += r.size
    assert len(grown) == 7 and max(grown.values()) <= 1.1 * sum(grown.values()) / 7


def test_first_map_puts_the_heaviest_on_the_lightest(spark):
    random.seed(1)
    sizes = [random.randrange(1, 99) for _ in range(40)]
    given = spark.createDataFrame(list(enumerate(sizes)), "virtual_slot int, bytes long")
    got = {r.virtual_slot: r.shard for r in sharding.first_map(given, 5).collect()}
    loads, want = [0] * 5, {}
    for slot in sorted(range(40), key=lambda s: (-sizes[s], s)):
        want[slot] = loads.index(min(loads))
        loads[want[slot]] += sizes[slot]
    assert got == want


def test_one_key_may_hold_a_third(spark):
    given = table(spark, ["same text"] * 400 + [f"text {i}" for i in range(800)], [7] * 400 + list(range(800)))
    loads = check_shards(sharding.assigned(given, 4, 256).collect(), [(r.doc_id, r.text) for r in given.collect()], 4)
    assert max(loads.values()) <= 1.1 * sum(loads.values()) / 4


def test_shards_odd_tables(spark):
    odd, empty = odd_tables(spark)
    check_shards(sharding.assigned(odd, 3, 64).collect(), [(r.doc_id, r.text) for r in odd.collect()], 3)
    assert sharding.assigned(empty, 3, 64).count() == 0


# secrets

def plain_spans(text, rules=secret_scan.RULES):
    out = []
    for rank, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, m.end(), rule.kind))
    return sorted(out)


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def plain_base(text):
    """The base as it is defined, with the least lengths outside the patterns."""
    rules = [("assign", secret_scan.BASE[0].pattern, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    spans = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, group, least) in enumerate(rules) for m in re.finditer(pattern, text or "") if len(m[group]) >= least
    ]
    return sorted(spans)


def folder():
    return f"/tmp/tracewright-ledger-{uuid.uuid4().hex}"


def test_secrets_match_brute_force(spark, docs):
    random.seed(4)
    bits = ["password", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "secret", "AKIA", "Z9" * 9, "0f" * 13, "é😀", "abcdef", "ghp_" + "a1" * 20, "\n"]
    made = ["".join(random.choice(bits) for _ in range(random.randrange(30))) for _ in range(300)]
    made += ["AKIA" + "B" * 16 + " é " * 3 + "f" * 24, " ".join(["token=abcdef"] * 1500)]
    given = docs.select("doc_id", "text").unionByName(table(spark, made, range(9000, 9000 + len(made))).select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in given.collect()}
    some = 0
    for r in secret_scan.found_secrets(given, folder()).collect():
        base = plain_base(texts[r.doc_id])
        some += bool(base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in base) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert r.spans == listed(plain_spans(texts[r.doc_id]))
    assert some > 50


def test_ledger_reads_only_what_is_new(spark):
    at = folder()
    first = table(spark, ["token = abcdefgh", "nothing", "nothing"])
    secret_scan.found_secrets(first, at, secret_scan.BASE).collect()
    ledger = secret_scan.Ledger(spark, at, secret_scan.BASE)
    assert ledger.scans().count() == 2
    more = table(spark, ["token = abcdefgh", "new AKIA" + "A" * 16, "nothing"])
    got = {r.doc_id: r.spans for r in secret_scan.found_secrets(more, at, secret_scan.BASE).collect()}
    assert ledger.scans().count() == 3 and got == {0: "assign:0:16", 1: "access:4:24", 2: ""}
    changed = [secret_scan.BASE[0], secret_scan.Rule("access", "AKIA[A-Z]{4}", version=2), secret_scan.BASE[2]]
    got = {r.doc_id: r.spans for r in secret_scan.found_secrets(more, at, changed).collect()}
    fresh = [r.rules for r in ledger.scans().collect() if r.rules == ["access@2"]]
    assert len(fresh) == 3 and got[1] == "access:4:12"


def test_secrets_odd_tables(spark):
    odd, empty = odd_tables(spark)
    found = secret_scan.found_secrets(odd, folder()).collect()
    assert len(found) == odd.count() and not any(r.n_spans for r in found)
    assert secret_scan.found_secrets(empty, folder()).count() == 0


# languages

@pytest.fixture(scope="module")
def model(spark):
    return langid.learned(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_language_accuracy_on_held_out(spark, model):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predicted(given, model).join(given, "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text)) for r in rows)


def test_kneser_ney_matches_its_definition():
    texts = {"a": ["anna banana nab", "ban an"], "b": ["dodo odd good"]}
    counts = {k: langid.gram_counts(iter(v), 3) for k, v in texts.items()}
    model = langid.fitted(counts, 3)
    letters = len({g for c in counts.values() for g in c if len(g) == 1}) + 1

    def probability(lang, gram):
        c = counts[lang]
        full = len(gram) == 3

        def used(g):
            if len(g) == 3 or (g[0] == " " and len(g) > 1):
                return c.get(g, 0)
            return sum(1 for x in c if len(x) == len(g) + 1 and x[1:] == g)

        same = {g: used(g) for g in c if len(g) == len(gram)}
        tally = Counter(same.values())
        d = tally[1] / (tally[1] + 2 * tally[2]) if tally[1] and tally[2] else 0.5
        lower = probability(lang, gram[1:]) if len(gram) > 1 else 1 / letters
        peers = {g: n for g, n in same.items() if g[:-1] == gram[:-1] and n}
        if not peers:
            return lower
        total = sum(peers.values())
        return max(peers.get(gram, 0) - d, 0) / total + d * len(peers) / total * lower

    for word in ("banana", "dodo", "xan", "nzz"):
        padded = f" {word} "
        for column, lang in enumerate(model.languages):
            want = sum(np.log10(probability(lang, padded[max(0, e - 3) : e])) for e in range(2, len(padded) + 1))
            assert abs(model.word_scores([word])[0, column] - want) < 1e-9
    for context in ("an", "a", "", "od"):
        alphabet = {g for c in counts.values() for g in c if len(g) == 1} | {"?"}
        assert abs(sum(probability("a", context + x) for x in alphabet) - 1) < 1e-9


def test_language_odd_tables(spark, model):
    odd, empty = odd_tables(spark)
    found = langid.predicted(odd, model).collect()
    assert len(found) == odd.count() and {r.lang_pred for r in found if r.doc_id in (0, 1, 2, 7)} == {"und"}
    assert langid.identified(empty).count() == 0
    unlabelled = odd.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identified(unlabelled).collect()} == {"und"}
    assert langid.identified(odd).count() == odd.count()


# page texts

def test_page_texts_match_the_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extracted(pages).collect():
        article = re.search("<article>(.*)</article>", raw[r.page_id], re.S)
        pieces = re.split(r"</?(?:p|h1)>", article[1].replace("<br>", " "))
        lines = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in pieces]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


SITE = '<html><body><div>{top}</div><section><p>{text}</p><p>{more}</p></section><div>Read our terms</div></body></html>'


def test_templates_go_and_copies_stay(spark):
    rows = [(i, f"http://Site.example/{i}", SITE.format(top="Home News Shop", text=f"Story {i}", more=f"End {i % 3}")) for i in range(12)]
    rows += [(100 + i, "http://other.example/", SITE.format(top="Home News Shop", text="One story", more="copied")) for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}\nEnd {i % 3}" for i in range(12))
    assert all(got[100 + i] == "Home News Shop\nOne story\ncopied\nRead our terms" for i in range(12))


def test_templates_of_large_hosts(spark):
    # 100 pages; each of 10 unmarked notices is on 10 of them, and the same words inside the text stay.
    rows = [(i, f"http://large.example/{i}", f"<body><div>Notice {i % 10}</div><section><p>Story {i}</p></section></body>") for i in range(100)]
    rows += [(100, "http://large.example/100", "<body><section><div>Notice 1</div><p>Own</p></section></body>")]
    # Lines of marked articles recur on some pages and stay.
    rows += [(300 + i, f"http://marked.example/{i}", f"<body><div>Notice {i % 5}</div><article><h1>Title {i % 5}</h1><p>New {i}</p></article></body>") for i in range(50)]
    # A small host keeps what is on no more than half of its pages.
    rows += [(200 + i, f"http://small.example/{i}", f"<body><div>Note {i % 2}</div><p>Text {i}</p></body>") for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}" for i in range(100)) and got[100] == "Notice 1\nOwn"
    assert all(got[300 + i] == f"Title {i % 5}\nNew {i}" for i in range(50))
    assert all(got[200 + i] == f"Note {i % 2}\nText {i}" for i in range(12))


def test_parts_of_a_page():
    page = """<body class="no-sidebar"><div id=top-menu>menu</div><header>head</header><div class="content">
      <article class="post"><h1>T &amp; U &eacute;</h1><p>a<b>b</b>\n c<br>d<div class="cookie-notice">cookie</div><p>e &lt;x&gt;
      <script>var a = "</p><p>no";</script><ul><li>one<li>two</ul><form>mail</form><div hidden>no</div>
      <table><tr><td>1<td>2<tr><td>3</table><section class="comments"><article>reader</article></section></article></div><footer>f"""
    assert html_text.main_text(page) == "T & U é\nab c d\ne <x>\none\ntwo\n1 2\n3"
    assert html_text.main_text("plain &amp; text") == "plain & text"
    assert html_text.main_text('<p title="a > b">x</p><!-- y --><p>z') == "x\nz"
    assert html_text.main_text("<main><p>m</main><p>other") == "m"


def test_all_articles_of_a_page():
    page = "<article><p>first<article><p>inner</article></article><aside><article>ad</article></aside><p>between<div><article><h1>second</h1><p>x</article></div>"
    assert html_text.main_text(page) == "first\ninner\nsecond\nx"


def test_pages_odd_tables(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (None, "nowhere", ""), (2, "http://h/", "<p>" + "x " * 60_000), (2, "http://h/", "<" * 5000), (3, None, deep), (3, None, deep)]
    given = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as host", "2 as templates", "3 as n")
    got = sorted(((r.page_id, len(r.text)) for r in html_text.extracted(given).collect()), key=str)
    assert len(got) == 6 and (1, 0) in got and (None, 0) in got and (2, 119_999) in got and got.count((3, 4)) == 2
    assert html_text.extracted(given.limit(0)).count() == 0


def test_sample_holds_every_language_and_counts_copies_once(spark):
    common = [(i, f"common words number {i}", "aa") for i in range(3000)]
    ties = [(None, "the same words again", "aa")] * 500 + [(None, f"other words {i}", "aa") for i in range(100)]
    rare = [(i, "seldom heard speech", "zz") for i in range(5000, 5003)] + [(6000, None, "nn")]
    given = spark.createDataFrame(common + ties + rare, "doc_id bigint, text string, lang string")
    of = Counter(lang for i, _, lang in rare if zlib.crc32(str(i).encode()) % 3 != 1)  # not held out
    got = langid.sample(given, rows=90, chars=1_000_000).collect()
    assert of["zz"] and Counter(r.lang for r in got) == {"aa": 90 // (1 + len(of)), **of}
    assert Counter(r.text for r in got)["the same words again"] <= 1
    # Characters are bounded as well; a language's first document stays, however long.
    long = spark.createDataFrame([(i, "word " * 4000, "aa") for i in range(50)] + rare[:3], given.schema)
    held = langid.sample(long, rows=300, chars=150_000).collect()
    assert Counter(r.lang for r in held)["aa"] == 150_000 // 2 // 20_000
    assert Counter(r.lang for r in langid.sample(long, rows=300, chars=3).collect())["aa"] == 1
    assert set(langid.learned(given, rows=90).languages) >= {"aa", "zz"}


def test_one_very_long_text_is_identified(spark):
    rows = [(i, "una casa grande y bonita", "es") for i in range(40)] + [(i, "the house is large", "en") for i in range(40, 80)]
    given = spark.createDataFrame([*rows, (99, "the large house " * 200_000, None)], "doc_id bigint, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identified(given).collect()}[99] == "en"


def test_scans_at_one_time_give_each_span_once(spark):
    texts = ["password = hunter2hunter2 " + "ab12" * 8, "key AKIA" + "Z" * 16, None, ""]
    given = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id bigint, text string")
    at = folder()
    want = {r.doc_id: (r.spans, r.n_spans) for r in secret_scan.found_secrets(given, at).collect()}
    scans = secret_scan.Ledger(spark, at).scans()
    scans.write.mode("append").parquet(f"{at}/scans")  # what a second writer that began before would add
    assert secret_scan.Ledger(spark, at).scans().count() == 6
    assert {r.doc_id: (r.spans, r.n_spans) for r in secret_scan.found_secrets(given, at).collect()} == want
    assert want[0][1] >= 2 and want[0] == want[4] and want[2] == ("", 0)
