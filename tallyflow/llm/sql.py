"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from .mixing import DIMENSIONS, ROUNDS, TEMPERING

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _low(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


_NUMBERED = "d AS (SELECT row_number() OVER () AS rid, * FROM documents)"

SUBSTRING = f"""WITH {_NUMBERED},
w AS (SELECT rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i : i + 34], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
dup AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT DISTINCT rid, i + o AS p FROM win JOIN dup USING (k) CROSS JOIN range(35) r(o)),
each AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each LEFT JOIN hit USING (rid, p) WHERE hit.rid IS NULL GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rid)"""

DECONTAMINATION = f"""WITH {_NUMBERED},
w AS (SELECT rid, doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_ALNUM}') AS ws FROM d),
b AS (SELECT item_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_ALNUM}') AS ws FROM benchmark),
bw AS (SELECT item_id, least(len(ws), 10) AS m, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
size AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT rid, m, i, array_to_string(ws[i : i + m - 1], ' ') AS k FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w CROSS JOIN size)),
hit AS (SELECT rid, m, i, item_id FROM dw JOIN bw USING (m, k)),
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n IS NOT NULL AS contaminated FROM w LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""

URL_FILTER = rf"""WITH rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT row_number() OVER () AS rid, page_id, coalesce({_low("regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
best AS (SELECT rid, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (rid)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, low AS component_id, doc_id = low AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)"""

LINE_DEDUP = f"""WITH {_NUMBERED},
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN lead(pos, 2) OVER o IS NOT NULL THEN array_to_string([line, lead(line) OVER o, lead(line, 2) OVER o], chr(10)) END AS run FROM l WINDOW o AS (PARTITION BY rid ORDER BY pos)),
f AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, rid, pos) > 1 AND length(line) >= 60 AS single, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, rid, pos) > 1 AS later FROM k),
gone AS (SELECT rid, pos FROM f WHERE single UNION SELECT rid, pos + o FROM f CROSS JOIN range(3) r(o) WHERE later),
m AS (SELECT l.*, gone.rid IS NOT NULL AS cut FROM l LEFT JOIN gone USING (rid, pos)),
g AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY rid ORDER BY pos), false) AS begins FROM m),
a AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE cut) AS lost, count(*) FILTER (WHERE begins) AS runs, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut) AS t FROM g GROUP BY rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN a USING (rid)"""


def _mixing() -> str:
    """The rounds of proportional fitting, one table a step."""
    cells = ", ".join(DIMENSIONS)
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, source AS source0, lang AS lang0,
      coalesce('t' || (CAST('0x' || substr(md5(lower(regexp_extract(text, '{_WORD}', 0))), 1, 4) AS BIGINT) % 8), 'unknown') AS topic, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS n_tokens FROM documents)""",
        f"m0 AS (SELECT {cells}, sum(n_tokens) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM d GROUP BY {cells})",
    ]
    for x in DIMENSIONS:
        steps.append(f"aim_{x} AS (SELECT {x}, pow(sum(tokens), {TEMPERING[x]}) / sum(pow(sum(tokens), {TEMPERING[x]})) OVER () * sum(sum(tokens)) OVER () AS aim FROM m0 GROUP BY {x})")
    for k in range(ROUNDS * len(DIMENSIONS)):
        x = DIMENSIONS[k % len(DIMENSIONS)]
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (aim, mass), CASE WHEN sum(mass) OVER (PARTITION BY {x}) > 0 THEN mass * aim / sum(mass) OVER (PARTITION BY {x}) ELSE 0 END AS mass FROM m{k} JOIN aim_{x} USING ({x}))")
    last = ROUNDS * len(DIMENSIONS)
    steps.append(f"p AS (SELECT d.*, CASE WHEN tokens > 0 THEN mass / tokens ELSE 1 END AS w FROM d JOIN m{last} USING ({cells}))")
    return f"""WITH {", ".join(steps)} SELECT doc_id, source0 AS source, lang0 AS lang, topic, n_tokens, round(w, 6) AS weight, round(least(1.0, 0.5 * w), 6) AS probability,
      CAST('0x' || substr(md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < least(1.0, 0.5 * w) AS kept FROM p"""


COLLOCATIONS = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, {_low("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS a FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w CROSS JOIN range(1, 6) r(m)) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM g WHERE m > 1),
cut AS (SELECT lang, phrase, a, k, array_to_string(ws[1 : k], ' ') AS one, array_to_string(ws[k + 1 :], ' ') AS two FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, cut.a, n, k, x.a AS l, y.a AS r, (1000 * cut.a::HUGEINT * n) // (x.a::HUGEINT * y.a) AS score FROM cut JOIN t USING (lang) JOIN g x ON x.lang = cut.lang AND x.phrase = one JOIN g y ON y.lang = cut.lang AND y.phrase = two),
low AS (SELECT lang, phrase, a, n, l, r, CAST(score AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT lang, array_to_string(ws[i : i + q - 1], ' ') AS phrase, a AS f FROM (SELECT lang, a, ws, m, q, unnest(range(1, m - q + 2)) AS i FROM c JOIN range(2, 5) z(q) ON q < m)),
kept AS (SELECT * FROM low WHERE NOT EXISTS (FROM inside WHERE inside.lang = low.lang AND inside.phrase = low.phrase AND 100 * f >= 100 * a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000"""


ORACLES = {
    "op3_substring_dedup": SUBSTRING,
    "op4_decontamination": DECONTAMINATION,
    "op5_url_filter": URL_FILTER,
    "op6_minhash_dedup": NEAR_DUPLICATES,
    "op7_mixing": _mixing(),
    "op8_line_dedup": LINE_DEDUP,
    "op12_collocations": COLLOCATIONS,
}
