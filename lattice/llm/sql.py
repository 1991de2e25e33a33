"""DuckDB SQL for the rows of those queries that SQL can express, by their plain definitions."""

from __future__ import annotations

from .license_scan import STRIDE, TEMPLATES, THRESHOLD, ceil
from .line_dedup import MIN_LINES, MIN_WORDS

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"


def _line_dedup() -> str:
    """Every smallest run down from a line, and up from one, that holds enough; those that stand earlier go."""
    near = ", ".join(f"lead(x, {j}) OVER o AS a{j}, lead(w, {j}) OVER o AS w{j}, lag(x, {j}) OVER o AS b{j}, lag(w, {j}) OVER o AS z{j}" for j in range(1, MIN_LINES))

    def size(words: str) -> str:
        totals = ["w", *[f"coalesce({words}{j}, 0)" for j in range(1, MIN_LINES - 1)]]
        return "CASE " + " ".join(f"WHEN {' + '.join(totals[:j])} >= {MIN_WORDS} THEN {j}" for j in range(1, MIN_LINES)) + f" ELSE {MIN_LINES} END"

    below = ", ".join(["x", *[f"a{j}" for j in range(1, MIN_LINES)]])
    above = ", ".join(["x", *[f"b{j}" for j in range(1, MIN_LINES)]])
    return f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM s),
t AS (SELECT doc_id, i, trim(l, ' ' || chr(9) || chr(13)) AS x FROM a),
n AS (SELECT doc_id, i, x, length(x) - length(replace(x, ' ', '')) + 1 AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM t WHERE x <> ''),
c AS (SELECT doc_id, k, n, {size("w")} AS s, {size("z")} AS u, [{below}] AS below, [{above}] AS above FROM (SELECT *, {near} FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY k))),
v AS (SELECT doc_id, k, s, array_to_string(below[1:s], chr(10)) AS h FROM c WHERE k + s <= n
  UNION SELECT doc_id, k - u + 1, u, array_to_string(list_reverse(above[1:u]), chr(10)) FROM c WHERE k - u + 1 >= 0),
f AS (SELECT h, min((doc_id, k)) AS place FROM v GROUP BY h),
m AS (SELECT doc_id, unnest(range(k, k + s)) AS k FROM v JOIN f USING (h) WHERE (doc_id, k) > place),
g AS (SELECT DISTINCT n.doc_id, n.i FROM m JOIN n ON n.doc_id = m.doc_id AND n.k = m.k),
r AS (SELECT a.doc_id, string_agg(l, chr(10) ORDER BY a.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS n_removed, count(*) AS n_all FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY a.doc_id)
SELECT d.doc_id, CASE WHEN n_removed = 0 THEN text ELSE coalesce(kept, '') END AS text, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE n_all END AS n_lines, n_removed FROM documents d JOIN r ON r.doc_id = d.doc_id"""


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _license_scans() -> str:
    rows = []
    for t in TEMPLATES:
        tokens = sorted(set(t.words()))
        need = len(tokens) if t.phrase else ceil(THRESHOLD * len(tokens))
        rows.append(f"('{t.label}', {t.base}, {t.phrase}, {_quoted(t.words())}, {_quoted(tokens)}, {need})")
    return f"""
WITH t AS (SELECT * FROM (VALUES {', '.join(rows)}) t(label, base, phrase, said, tokens, need)),
d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)),
p AS (SELECT doc_id, label, base, unnest(list_filter(range(n), lambda i: w[i + 1] = said[1] AND w[i + 1:i + len(said)] = said)) AS pos FROM d, t WHERE phrase AND list_contains(w, said[1])),
b AS (SELECT doc_id, unnest(range(0, n, {STRIDE})) AS a, w FROM d WHERE n > 0 AND len(list_intersect(w, (SELECT list_distinct(flatten(list(tokens))) FROM t WHERE NOT phrase))) >= (SELECT min(need) FROM t WHERE NOT phrase)),
q AS (SELECT doc_id, a, label, len(list_intersect(tokens, w[a + 1:a + {2 * STRIDE}])) / len(tokens)::DOUBLE AS share, len(list_intersect(tokens, w[a + 1:a + {2 * STRIDE}])) >= need AS met FROM b, t WHERE NOT phrase),
h AS (SELECT doc_id, label, base, pos, pos // {STRIDE} AS block, 1.0::DOUBLE AS share FROM p UNION ALL SELECT doc_id, label, false, NULL, a // {STRIDE}, share FROM q WHERE met)
SELECT d.doc_id, any_value(d.n) AS n_words, count(pos) FILTER (WHERE base) AS n_base, min(pos) FILTER (WHERE base) AS first_word, max(pos) FILTER (WHERE base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score, count(DISTINCT block) AS n_blocks
FROM d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY d.doc_id"""


LINE_DEDUP = _line_dedup()
LICENSE_SCANS = _license_scans()

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 5], ' ') AS x FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id),
f AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT f.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, f.id = component_id AS kept FROM f LEFT JOIN n ON n.doc_id = f.id"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
t AS (SELECT item_id, w, least(8, len(w)) AS k FROM (SELECT DISTINCT item_id, {_WORDS.format('text')} AS w FROM benchmark) WHERE len(w) > 0),
i AS (SELECT item_id, k, q, array_to_string(w[q + 1:q + k], ' ') AS x FROM (SELECT item_id, k, w, unnest(range(len(w) - k + 1)) AS q FROM t)),
x AS (SELECT doc_id, k, p, array_to_string(w[p + 1:p + k], ' ') AS x FROM (SELECT doc_id, k, w, unnest(range(greatest(0, len(w) - k + 1))) AS p FROM d, (SELECT DISTINCT k FROM t))),
m AS (SELECT DISTINCT doc_id, item_id, k, p, q FROM x JOIN i USING (k, x)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM m GROUP BY doc_id),
l AS (SELECT doc_id, max(c + k - 1) AS longest FROM (SELECT doc_id, k, count(*) AS c FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, k, p - q ORDER BY p) AS run FROM m) GROUP BY doc_id, item_id, k, p - q, run) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(longest, 0) AS longest
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)"""
