"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from .licenses import _MARK, BASE_PHRASES, TEMPLATES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, {LOWER.format(f"trim(line, {SPACES})")} AS key FROM l),
bad AS (SELECT key, max(doc_id) AS keeper FROM k WHERE len(key) >= 40 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(doc_id < keeper, false) AS gone FROM k LEFT JOIN bad USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id
"""

CONTAMINATION_SQL = f"""
WITH w AS (SELECT item_id::VARCHAR AS item, {WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
b AS (SELECT DISTINCT item, s, array_to_string(w[i:i + s - 1], ' ') AS gram FROM (SELECT item, w, least(13, len(w)) AS s, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT r, i, s, array_to_string(w[i:i + s - 1], ' ') AS gram FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM b) WHERE len(w) >= s)),
h AS (SELECT r, i, g.s, item FROM g JOIN b USING (gram, s)),
p AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + s)) AS j FROM (SELECT DISTINCT r, i, s FROM h)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN n USING (r)
"""

JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.r <> y.r GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a AS r, a AS t FROM link UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.t = link.a),
low AS (SELECT reach.r, min(doc_id) AS low FROM reach JOIN d ON d.r = reach.t GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN low USING (r)
"""


def _pattern(template: str) -> str:
    """The template as a regular expression over words with a space around each."""
    out = " "
    for kind, number, word in _MARK.findall(template):
        out += "(?:" if kind == "optional" else ")?" if kind == "end" else f"(?:[^ ]+ ){{0,{number}}}" if number else f"{word} "
    return out


def _license_sql() -> str:
    count = "len(list_filter(string_split({}, ' '), lambda x: x <> ''))"
    labels = sorted({label for label, _ in TEMPLATES} | set(BASE_PHRASES.values()))
    phrase = {p: "' " + p.replace(" ", "  ") + " '" for p in BASE_PHRASES}
    by_label = {label: [p for p, of in BASE_PHRASES.items() if of == label] for label in labels}
    matched = {label: " OR ".join(f"regexp_matches(j, '{_pattern(t)}')" for of, t in TEMPLATES if of == label) or "false" for label in labels}
    size = lambda t: sum(bool(w) for _, _, w in _MARK.findall(mandatory(t)))
    long = " OR ".join(f"regexp_matches(j, '{_pattern(t)}')" for _, t in TEMPLATES if size(t) >= 20)
    base = {label: " OR ".join(f"contains(jj, {phrase[p]})" for p in by_label[label]) or "false" for label in labels}
    listed = lambda of: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {of[x]} THEN '{x}' END" for x in labels) + "], lambda x: x IS NOT NULL)), ',')"
    either = {x: f"({base[x]} OR {matched[x]})" for x in labels}
    places = " + ".join(f"len(string_split(jj, {p})) - 1" for p in phrase.values())
    first = "least(" + ", ".join(f"CASE WHEN contains(jj, {p}) THEN {count.format(f'string_split(jj, {p})[1]')} END" for p in phrase.values()) + ")"
    last = "greatest(" + ", ".join(f"CASE WHEN contains(jj, {p}) THEN len(w) - {len(k.split())} - {count.format(f'string_split(jj, {p})[-1]')} END" for k, p in phrase.items()) + ")"
    return f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS j, ' ' || array_to_string(w, '  ') || ' ' AS jj FROM d)
SELECT doc_id, len(w) AS n_words, ({places})::BIGINT AS n_base, {first}::BIGINT AS first_word, {last}::BIGINT AS last_word,
  {listed(base)} AS base_labels, {listed(either)} AS labels,
  CASE WHEN {long} THEN 1.0::DOUBLE WHEN {" OR ".join(matched.values())} THEN 0.9 WHEN {places} > 0 THEN 0.5 ELSE 0.0 END AS score FROM t
"""


def mandatory(template: str) -> str:
    """The template without its optional regions: its mandatory words."""
    out, skip = [], 0
    for kind, number, word in _MARK.findall(template):
        skip += (kind == "optional") - (kind == "end")
        if word and not skip:
            out.append(word)
    return " ".join(out)


LICENSE_SQL = _license_sql()
