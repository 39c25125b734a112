"""DuckDB SQL for the queries that SQL can express.

The others have none: media files, zstandard, XXH64, tokenizers and the mix's hash order are
out of SQL's reach.  Tests hold those against brute force, the libraries or round trips.
"""

from __future__ import annotations

from ledgerlens.llm.line_dedup import MIN_TOKENS
from ledgerlens.llm.quality_rules import DELTA, FACTORS, MARGIN, RISK, RULES, STEPS

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: The CRC-32 of the text ``k``, bit by bit.
CRC32 = "xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295)"

RULES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
spots AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM d),
grams AS (SELECT r, p, count(*) OVER (PARTITION BY r, array_to_string(w[p:p + 7], ' ')) AS n FROM spots),
repeats AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM grams WHERE n > 1) GROUP BY r),
c AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN repeats USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT f.*, good, {CRC32.replace("k,", "CAST(doc_id AS VARCHAR),")} % 2 AS half, {", ".join(f"CASE WHEN {b} = 0 THEN 0 ELSE ({a} * 1000 + {b} - 1) // {b} END AS r_{r}" for r, (a, b) in RULES.items())} FROM f JOIN known USING (doc_id) WHERE NOT base_failed),
paths AS (SELECT lang AS of, {", ".join(f"max(r_{r}) AS m_{r}" for r in RULES)} FROM held WHERE good AND half = 0 GROUP BY lang),
tests AS (SELECT * FROM held JOIN paths ON lang IS NOT DISTINCT FROM of WHERE half = 1),
strata AS (SELECT lang, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS n_bad FROM tests GROUP BY lang HAVING count(*) FILTER (good) > 0),
steps AS (SELECT unnest(range(0, {STEPS})) AS step),
lost AS (SELECT lang, step, count(*) FILTER (good AND bad_now) AS k, count(*) FILTER (NOT good AND bad_now) AS k_bad FROM (
    SELECT lang, step, good, {" OR ".join(f"r_{r} > (m_{r} + {MARGIN}) * {list(FACTORS)}[step + 1] // 100" for r in RULES)} AS bad_now FROM tests, steps) GROUP BY ALL),
tested AS (SELECT lost.lang, step, k_bad * n - k * n_bad AS gain, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln({1 - RISK})))) AS p FROM lost JOIN strata ON lost.lang IS NOT DISTINCT FROM strata.lang),
safe AS (SELECT * FROM tested WHERE gain > 0 AND p <= {DELTA} / (SELECT count(*) FROM strata)),
best AS (SELECT lang, arg_max(step, (gain, -step)) AS step FROM safe GROUP BY lang),
cuts AS (SELECT lang, {", ".join(f"CAST((m_{r} + {MARGIN}) * {list(FACTORS)}[step + 1] // 100 AS INTEGER) AS cut_{r}" for r in RULES)} FROM best JOIN paths ON lang IS NOT DISTINCT FROM of)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"coalesce({a} * 1000 > {b} * cut_{r}, false)" for r, (a, b) in RULES.items())}) AS kept, {", ".join(f"cut_{r}" for r in RULES)}
FROM f LEFT JOIN cuts ON f.lang IS NOT DISTINCT FROM cuts.lang"""

LINES_SQL = f"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS ln FROM documents),
shown AS (SELECT doc_id, ln, line, min((doc_id, ln)) OVER (PARTITION BY line) AS first FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
uniq AS (SELECT line, first, string_split(line, ' ') AS tok FROM (SELECT DISTINCT line, first FROM shown)),
long AS (SELECT *, len(tok) AS n FROM uniq WHERE len(tok) >= {MIN_TOKENS}),
keys AS (SELECT DISTINCT line, first, tok, n, key FROM (SELECT *, unnest([
    'p' || array_to_string(tok[1:(n - 1) // 2], ' '), 'p' || array_to_string(tok[1:(n + 1) // 2], ' '),
    's' || array_to_string(tok[n - (n - 1 - (n - 1) // 2) + 1:n], ' '), 's' || array_to_string(tok[n - (n + 1 - (n + 1) // 2) + 1:n], ' ')]) AS key FROM long)),
pairs AS (SELECT DISTINCT x.line, x.tok AS a, y.tok AS b FROM keys x JOIN keys y ON x.key = y.key AND y.first < x.first AND abs(x.n - y.n) <= 1),
met AS (SELECT line, greatest(len(a), len(b)) AS most,
    coalesce(nullif(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false), 0), least(len(a), len(b)) + 1) - 1 AS head,
    coalesce(nullif(list_position(list_transform(range(0, least(len(a), len(b))), lambda i: a[len(a) - i] = b[len(b) - i]), false), 0), least(len(a), len(b)) + 1) - 1 AS tail FROM pairs),
near AS (SELECT DISTINCT line FROM met WHERE head + tail >= most - 1),
marked AS (SELECT l.doc_id, l.ln, l.line, s.line IS NOT NULL AND (l.doc_id, l.ln) <> s.first AS same, s.line IS NOT NULL AND (l.doc_id, l.ln) = s.first AND near.line IS NOT NULL AS close
  FROM l LEFT JOIN shown s ON l.doc_id = s.doc_id AND l.ln = s.ln LEFT JOIN near ON l.line = near.line),
told AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (same) AS n_equal_removed, count(*) FILTER (close) AS n_near_removed, string_agg(line, chr(10) ORDER BY ln) FILTER (NOT same AND NOT close) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_equal_removed, 0) AS n_equal_removed, coalesce(n_near_removed, 0) AS n_near_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN told USING (doc_id)"""

SUBSTRINGS_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
spots AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d),
grams AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM spots),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first FROM grams) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM hit),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT e.doc_id, count(*) FILTER (g.q IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY e.q) FILTER (g.q IS NULL) AS t FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.q = g.q GROUP BY e.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM q"""



def _repair_sql() -> str:
    """The cheapest edits by dynamic programming, row after row: b0 to b3 are the best ways to
    the pattern's states (nothing yet, after s, after u, after a), each a struct of cost, letters
    and repaired text, which compare in this order."""
    def step(way: str, cost: str, letter: str, line: str | None = None) -> str:
        text = f"{way}.t || CASE WHEN {way}.t = '' THEN '' ELSE chr(10) END || {line}" if line else f"{way}.t"
        return f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 't': {text}}}"

    def kept(way: str, initial: str) -> str:
        return step(way, f"CASE WHEN gone OR left(role, 1) <> '{initial}' THEN 1000000000 ELSE 3 * cut END", "K", "role || ':' || text")

    def given(way: str, role: str) -> str:
        return step(way, "CASE WHEN gone THEN 1000000000 ELSE 3 + 3 * cut END", "R", f"'{role}:' || text")

    def new(way: str, role: str) -> str:
        return step(way, "3", "I", f"'{role}:'")

    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    gone = [step(f"b{q}", "4", "D") for q in range(4)]
    to_user = [f for q in (0, 1, 3) for f in (kept(f"b{q}", "u"), given(f"b{q}", "user"))]
    never = "{'c': 1000000000, 'a': '', 't': ''}"
    inserted = f"""SELECT conv_id, i, n0 AS b0, n1 AS b1, m2 AS b2, {least("n3", new("m2", "assistant"))} AS b3
        FROM (SELECT *, {least("n2", new("n0", "user"), new("n1", "user"), new("n3", "user"))} AS m2 FROM"""
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, {CRC32} % 20 AS h FROM raw)),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i,
    rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS shown, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM hurt),
r AS (SELECT *, shown = '' AS blank, shown = '' OR again AS gone, CASE WHEN shown <> '' AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM told),
sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
ways AS (
  {inserted} (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS n0, {never} AS n1, {never} AS n2, {never} AS n3 FROM sums))
  UNION ALL
  {inserted} (SELECT w.conv_id, r.i, {gone[0]} AS n0, {least(gone[1], kept("b0", "s"))} AS n1, {least(gone[2], *to_user)} AS n2, {least(gone[3], kept("b2", "a"), given("b2", "assistant"))} AS n3
    FROM ways w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
best AS (SELECT s.*, {least("b0", "b3")} AS way FROM sums s JOIN ways w ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(way.c, 0) AS BIGINT) AS cost,
  coalesce(way.a, '') AS audit, sha256(coalesce(way.t, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id"""


NEGATIVES_SQL = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.uid <> b.uid),
p AS (SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS w FROM s WHERE same QUALIFY w <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, w ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor, anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score QUALIFY rank <= 5"""

ORACLES: dict[str, str] = {"op1_quality_rules": RULES_SQL, "op3_line_dedup": LINES_SQL, "op4_substring_dedup": SUBSTRINGS_SQL, "op9_warc": WARC_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op13_conversation_repair": _repair_sql()}
