"""DuckDB SQL of the queries that SQL can express, over the raw tables."""

from trustlens.llm import license_rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bench_words(text: str) -> str:
    folded = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    return rf"list_filter(string_split_regex({folded}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


WINNOWING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_bench_words("text")} AS w FROM documents),
i AS (SELECT item_id, {_bench_words("text")} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT r, size, p, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, p, size, item_id FROM doc_windows JOIN item_windows USING (size, win)),
marked AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(p, p + size)) AS place FROM hits) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(l.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(m.n, 0) > 0 AS contaminated
FROM d LEFT JOIN marked m ON m.r = d.r LEFT JOIN listed l ON l.r = d.r
"""

_SIZE = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"

PARETO_MIX = f"""
WITH d AS (
  SELECT doc_id, source, {_SIZE} AS size, md5(coalesce(text, '')) AS h FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, count(*) FILTER (WHERE size > 0) AS n,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most FROM s),
f AS (
  SELECT *, most / weight AS fills_at,
    CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(most) OVER b, 0) AS full_words, coalesce(sum(weight) OVER b, 0) AS full_weights
  FROM w WINDOW b AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT (total - full_words) / (weights - full_weights) AS level FROM f
  WHERE fills_at >= (total - full_words) / (weights - full_weights) ORDER BY fills_at, rank LIMIT 1),
t AS (
  SELECT source, source_size, n, least(CAST(most AS DOUBLE), coalesce(level * weight, CAST(most AS DOUBLE))) AS target
  FROM f LEFT JOIN l ON true),
p AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
u AS (
  SELECT *, (CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || h), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
    / 4503599627370496.0::DOUBLE AS u FROM d),
rests AS (SELECT *, greatest(0::DOUBLE, target - whole * source_size) AS rest FROM p),
roots AS (
  SELECT source, size, count(*) AS n, CAST(floor(1024 * sqrt(size)) AS BIGINT) AS root,
    size / CAST(floor(1024 * sqrt(size)) AS BIGINT) AS certain_at FROM d WHERE size > 0 GROUP BY source, size),
factors AS (
  SELECT roots.source, certain_at, size,
    (rest - coalesce(sum(roots.n * size) OVER b, 0)) /
      (sum(roots.n * root) OVER (PARTITION BY roots.source) - coalesce(sum(roots.n * root) OVER b, 0)) AS factor
  FROM roots JOIN rests ON roots.source IS NOT DISTINCT FROM rests.source
  WINDOW b AS (PARTITION BY roots.source ORDER BY certain_at, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (
  SELECT source, coalesce(arg_min(factor, (certain_at, size)) FILTER (WHERE factor <= certain_at), max(certain_at)) AS factor
  FROM factors GROUP BY source),
o AS (
  SELECT u.*, source_size, target, whole, rest,
    CASE WHEN size > 0 THEN least(1::DOUBLE, factor * CAST(floor(1024 * sqrt(size)) AS BIGINT) / size) END AS share
  FROM u JOIN rests ON u.source IS NOT DISTINCT FROM rests.source
  LEFT JOIN shares ON u.source IS NOT DISTINCT FROM shares.source),
q AS (SELECT *, CASE WHEN share > 0 THEN u / (1 - u) * ((1 - share) / share) END AS odds FROM o),
c AS (
  SELECT *, CASE WHEN odds IS NOT NULL THEN sum(size) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id, h
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM q),
g AS (SELECT source, max(rest) - coalesce(max(upto) FILTER (WHERE upto <= rest), 0) AS gap FROM c GROUP BY source),
m AS (
  SELECT c.*, coalesce(upto <= rest, false) AS sampled,
    CASE WHEN size > 0 AND NOT coalesce(upto <= rest, false) AND abs(gap - size) < gap THEN abs(gap - size) END AS miss
  FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source),
r AS (SELECT *, rank() OVER (PARTITION BY source, miss IS NULL ORDER BY miss, odds, doc_id, h) AS place FROM m)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(CASE WHEN size > 0 THEN size * (whole + CASE WHEN sampled OR (miss IS NOT NULL AND place = 1) THEN 1 ELSE 0 END)
    ELSE 0 END AS BIGINT) AS taken
FROM r
"""


def _licenses() -> str:
    """The same sentence and rule tables, applied with joins and window functions to one row per
    sentence instead of arrays within a row."""
    sentences = ", ".join(f"({i}, '{name}', '{pattern}')" for i, (name, pattern) in enumerate(license_rules.SENTENCES))
    steps, previous = [], "seqs"
    for i, (name, ids) in enumerate(license_rules.RULES):
        pattern = ",+" + ",+".join(x.replace(".", r"\.") for x in ids) + ",+"
        steps.append(
            f"r{i} AS (SELECT r, ids, regexp_replace(rest, '{pattern}', ',,', 'g') AS rest, "
            f"CASE WHEN regexp_matches(rest, '{pattern}') THEN list_append(named, '{name}') ELSE named END AS named "
            f"FROM {previous})"
        )
        previous = f"r{i}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM d WHERE regexp_matches(text, '{license_rules.TRIGGER}')),
parts AS (
  SELECT r, line_no, unnest(string_split_regex(line, '{license_rules.SENTENCE_END}')) AS part,
    generate_subscripts(string_split_regex(line, '{license_rules.SENTENCE_END}'), 1) AS part_no
  FROM lines WHERE regexp_matches(line, '{license_rules.TRIGGER}')),
clean AS (
  SELECT r, line_no, part_no, trim(regexp_replace(
    replace(regexp_replace(regexp_replace(regexp_replace(lower(part), '([0-9])\.([0-9])', '\1~\2', 'g'),
      '([0-9])\.([0-9])', '\1~\2', 'g'), '[^\p{{L}}\p{{N}}~/]', ' ', 'g'), '~', '.'), '\s+', ' ', 'g')) AS s FROM parts),
known(rank, name, pattern) AS (VALUES {sentences}),
hits AS (
  SELECT r, line_no, part_no, arg_min(name, rank) AS name
  FROM clean JOIN known ON regexp_full_match(s, ' ?(?:' || pattern || ')') WHERE s <> '' GROUP BY ALL),
seqs AS (
  SELECT r, string_agg(name, ',' ORDER BY line_no, part_no) AS ids,
    string_agg(',' || name || ',', '' ORDER BY line_no, part_no) AS rest, CAST([] AS VARCHAR[]) AS named
  FROM hits GROUP BY r),
{", ".join(steps)}
SELECT doc_id, CAST(coalesce(len(string_split(ids, ',')), 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(named)), ','), '') AS licenses,
  coalesce(trim(regexp_replace(rest, ',+', ',', 'g'), ','), '') AS unmatched
FROM d LEFT JOIN {previous} USING (r)
"""


LICENSES = _licenses()

_ESCAPED = r"regexp_replace(regexp_replace({0}, '<(\\*)(/?)s>', '<\\\1\2s>', 'g'), '\[(\\*)(/?)INST\]', '[\\\1\2INST]', 'g')"

CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(20 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""

_FOLDED_WORDS = (
    f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
    r"'[\x20\x09-\x0D]+'), lambda x: x <> '')"
)

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_FOLDED_WORDS} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(3, len(w)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared s JOIN sizes i ON i.doc_id = x JOIN sizes j ON j.doc_id = y
  WHERE 100 * s.n >= 85 * (i.n + j.n - s.n)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id,
  least(d.doc_id, coalesce(y, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_id ON least_id.x = d.doc_id
"""

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n,
    unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
w AS (SELECT *, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM l),
first AS (SELECT words, min((doc_id, n)) AS place FROM w WHERE len(words) > 0 GROUP BY words),
long AS (SELECT * FROM first WHERE len(words) >= 8),
cut AS (
  SELECT place, i, list_concat(words[1:i - 1], words[i + 1:]) AS rest
  FROM (SELECT place, words, unnest(range(1, len(words) + 1)) AS i FROM long)),
near AS (
  SELECT DISTINCT place FROM (
    SELECT a.place FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND b.place < a.place
    UNION ALL SELECT a.place FROM cut a JOIN long b ON a.rest = b.words AND b.place < a.place
    UNION ALL SELECT a.place FROM long a JOIN cut b ON b.rest = a.words AND b.place < a.place)),
judged AS (
  SELECT w.doc_id, w.n, line, len(w.words) > 0 AS worded, near.place IS NOT NULL AS is_near,
    near.place IS NULL AND first.place < (w.doc_id, w.n) AS is_repeat
  FROM w LEFT JOIN first ON first.words = w.words LEFT JOIN near ON near.place = first.place)
SELECT doc_id, CAST(count(*) FILTER (WHERE worded) AS BIGINT) AS n_lines,
  CAST(count(*) FILTER (WHERE worded AND is_repeat) AS BIGINT) AS n_exact,
  CAST(count(*) FILTER (WHERE worded AND is_near) AS BIGINT) AS n_near,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT (worded AND (is_near OR is_repeat))), '')) AS BIGINT)
    AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT (worded AND (is_near OR is_repeat))), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
