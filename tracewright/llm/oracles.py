"""SQL that says what a query returns, for the operators that SQL can express."""

from __future__ import annotations

from tracewright.llm import line_dedup, quality, resampling, secret_scan

_BLANK = r"[\x20\x09-\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]"


def _passes(rule: quality.Rule) -> str:
    tests = [f"{rule.part} >= {rule.low} * {rule.whole}"] if rule.low is not None else []
    tests += [f"{rule.part} <= {rule.high} * {rule.whole}"] if rule.high is not None else []
    return " AND ".join(tests)


def quality_sql(rules: list[quality.Rule] = quality.RULES) -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    verdict = " AND ".join(f"({_passes(r)})" for r in rules)
    n = quality.WINDOW
    return f"""
WITH given AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents),
windows AS (SELECT k, i, array_to_string(words[i:i + {n - 1}], ' ') AS w
            FROM (SELECT k, words, unnest(range(1, len(words) - {n - 2})) AS i FROM given)),
places AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, w) > 1),
covered AS (SELECT k, CAST(sum(least({n}, step)) AS BIGINT) AS n_repeat_words
            FROM (SELECT k, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i), {n}) AS step FROM places) GROUP BY k),
counted AS (
  SELECT doc_id, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
         len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^{_BLANK}*[-*•]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…){_BLANK}*$'))) AS n_ellipsis_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM given LEFT JOIN covered USING (k)),
judged AS (SELECT *, n_words < {quality.MIN_WORDS}
                     OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND {verdict} AS kept FROM judged"""


def secrets_sql(rules: list[secret_scan.Rule] = secret_scan.RULES) -> str:
    def spans(rank: int, rule: secret_scan.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
SELECT k, {rank} AS rank, '{rule.kind}' AS kind, place AS start, place + length(hits[i]) AS stop FROM (
  SELECT k, i, hits, parts, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
                            + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS place
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT k, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {rule.group}) AS parts,
           string_split_regex(text, '{pattern}') AS gaps FROM given)))
WHERE length(parts[i]) >= {rule.least}"""

    union = " UNION ALL ".join(spans(i, r) for i, r in enumerate(rules))
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    item = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)
    return f"""
WITH given AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({union}),
listed AS (
  SELECT k, {counts}, count(*) AS n_spans, string_agg({item}, ',' ORDER BY start, rank) AS spans,
         coalesce(string_agg({item}, ',' ORDER BY start, rank) FILTER (WHERE kind IN ({base})), '') AS base
  FROM found GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS digest,
       coalesce(n_spans, 0) AS n_spans
FROM given LEFT JOIN listed USING (k)"""


def lines_sql(min_docs: int = line_dedup.MIN_DOCS, min_chars: int = line_dedup.MIN_CHARS) -> str:
    blanks = " || ".join(f"chr({ord(c)})" for c in line_dedup.BLANKS)
    return f"""
WITH given AS (SELECT row_number() OVER () AS k, doc_id, md5(text) AS h, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT k, doc_id, h, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM given),
keyed AS (SELECT *, translate(trim(line, {blanks}), '{_UPPER}', '{_LOWER}') AS key FROM placed),
common AS (SELECT key FROM keyed WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT (doc_id, h)) >= {min_docs})
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON common.key = keyed.key GROUP BY k, doc_id"""


def resampling_sql() -> str:
    """For runs of one word, as the query takes them."""
    b, least, percent = resampling.BUCKETS, resampling.MIN_WORDS, resampling.PERCENT
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{word}')"
    return f"""
WITH RECURSIVE
bits(i, c, step) AS (SELECT CAST(range AS UBIGINT), CAST(range AS UBIGINT), 0 FROM range(256) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
source AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {words} AS words FROM documents),
target AS MATERIALIZED (SELECT {words} AS words FROM benchmark),
all_words AS (SELECT k, unnest(words) AS word FROM source UNION ALL SELECT NULL, unnest(words) FROM target),
vocabulary AS MATERIALIZED (SELECT word, hex(encode(word)) AS h, CAST(octet_length(encode(word)) AS INTEGER) AS n
                            FROM (SELECT DISTINCT word FROM all_words)),
steps(word, h, n, pos, c) AS (SELECT word, h, n, 0, CAST(4294967295 AS UBIGINT) FROM vocabulary UNION ALL
  SELECT word, h, n, pos + 1, xor(c >> 8, t[CAST(xor(c & 255,
    CAST('0x' || substr(h, 2 * pos + 1, 2) AS UBIGINT)) AS BIGINT) + 1])
  FROM steps, crc_table WHERE pos < n),
placed AS MATERIALIZED (SELECT word, CAST(xor(c, CAST(4294967295 AS UBIGINT)) % {b} AS BIGINT) AS bucket FROM steps WHERE pos = n),
counts AS (SELECT bucket, count(k) AS s, count(*) - count(k) AS t FROM all_words JOIN placed USING (word) GROUP BY bucket),
sizes AS (SELECT CAST(sum(s) AS DOUBLE) AS big_s, CAST(sum(t) AS DOUBLE) AS big_t FROM counts),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (big_s + {b}) / ((s + 1)::DOUBLE * (big_t + {b})))) AS BIGINT) AS gain
         FROM counts, sizes),
weighed AS (SELECT k, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
            FROM all_words JOIN placed USING (word) JOIN gain USING (bucket) WHERE k IS NOT NULL GROUP BY k),
scored AS (SELECT k, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM source LEFT JOIN weighed USING (k)),
drawn AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place,
                 count(*) OVER () * {percent} // 100 AS drawn FROM scored WHERE n_features >= {least})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN drawn USING (k)"""
