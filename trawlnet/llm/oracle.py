"""DuckDB SQL of the queries that SQL can express, by brute force over the same tables.

None is given for op3 (tag rules and a tree fitted in Python), op6 (the plan depends on the order in which stocks run out; its round trip and
totals are tested), op8 (its held-out part and sums of logarithms aren't the same to the last bit in another engine), op10 (boosted trees) and the pipeline, which
contains op6 and op10. tests/llm holds those against brute-force versions.
"""

from __future__ import annotations

from .decontaminate import NEAR_PHRASE, PHRASE, SLOP
from .jaccard_join import NGRAM, THRESHOLD
from .licenses import CONTAINMENT, SHINGLE, TEMPLATES
from .passages import MIN_WORDS
from .repetition import MAX_COVERED, MAX_LINES, MAX_REPEAT, SHORT
from .repetition import MIN_WORDS as REPEATED_WORDS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str) -> str:
    """Words of a text: what white space of ASCII leaves."""
    return rf"list_filter(string_split_regex(coalesce({text}, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '')"


def _folded(text: str) -> str:
    """Words in lower case, split at any ASCII character that isn't a letter or digit."""
    return rf"list_filter(string_split(regexp_replace(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _windows(words: str, length: str) -> str:
    """Places (from 1) of all windows of so many words."""
    return f"unnest(range(1, len({words}) - {length} + 2))"


def _covered(name: str, least: int) -> str:
    """Per text the words in windows of `least` words that it has twice."""
    return f"""
{name}_at AS (SELECT r, i, array_to_string(ws[i : i + {least - 1}], ' ') AS g FROM (SELECT r, ws, {_windows("ws", str(least))} AS i FROM w)),
{name}_again AS (SELECT r, i FROM {name}_at QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
{name} AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + {least})) AS place FROM {name}_again) GROUP BY r),"""


def _quality() -> str:
    (long_short, long_limit), (short, short_limit) = SHORT
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS ws, text FROM documents),{_covered("c", REPEATED_WORDS)}{_covered("s", long_short)}{_covered("t", short)}
one AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
diagonal AS (SELECT a.r, b.i - a.i AS d, a.i - row_number() OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS island FROM one a JOIN one b ON a.r = b.r AND a.word = b.word AND a.i < b.i),
longest AS (SELECT r, max(n) AS n FROM (SELECT r, count(*) AS n FROM diagonal GROUP BY r, d, island) GROUP BY r),
line AS (SELECT r, {_words("line")} AS ws FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM w)),
lines AS (SELECT r, sum(n) AS n FROM (SELECT r, len(ws) * count(*) AS n FROM line WHERE len(ws) > 0 GROUP BY r, ws HAVING count(*) > 1) GROUP BY r),
m AS (SELECT w.doc_id, len(ws) AS n, greatest(len(ws), 1) AS d, coalesce(c.n, 0) AS c, coalesce(s.n, 0) AS s, coalesce(t.n, 0) AS t, coalesce(longest.n, 0) AS l, coalesce(lines.n, 0) AS li
  FROM w LEFT JOIN c USING (r) LEFT JOIN s USING (r) LEFT JOIN t USING (r) LEFT JOIN longest USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n::INT AS n_words, c::INT AS covered_words, c / d AS covered_fraction, (CASE WHEN l >= {REPEATED_WORDS} THEN l ELSE 0 END)::INT AS longest_repeat, l::INT AS longest_any,
  s / d AS fraction_{long_short}, t / d AS fraction_{short}, (li / d)::DOUBLE AS line_fraction,
  c / d <= {MAX_COVERED} AND l <= {MAX_REPEAT} AND li / d <= {MAX_LINES} AND s / d <= {long_limit} AND t / d <= {short_limit} AS keep
FROM m"""


def _links() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, {_words("text")} AS ws FROM documents WHERE doc_id IS NOT NULL),
long AS (SELECT doc_id, ws, {_windows("ws", str(NGRAM))} AS i FROM w),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + {NGRAM - 1}], ' ') AS gram FROM long UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {NGRAM - 1}),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b, o = x.n AND o = y.n AS same FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE o / (x.n + y.n - o) >= {THRESHOLD} - 1e-9),
reach(a, b) AS (SELECT DISTINCT a, a FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a)
SELECT a AS doc_id, any_value(class_id) AS class_id, least(a, min(CASE WHEN same THEN b END)) AS copy_of, count(*) AS n_links FROM link JOIN class USING (a) GROUP BY a"""


def _licenses() -> str:
    import re

    templates, shingles = [], []
    for k, (name, text) in enumerate(TEMPLATES):
        ws = [x for x in re.split(r"[^a-z0-9]+", text.lower()) if x]
        own = {" ".join(ws[i : i + SHINGLE]) for i in range(len(ws) - SHINGLE + 1)}
        templates.append(f"({k}, '{name}', {max(4, 1 << (len(ws) - 1).bit_length())}, {len(own)})")
        shingles += [f"({k}, '{x}')" for x in sorted(own)]
    return f"""
WITH t(k, license, width, n) AS (VALUES {", ".join(templates)}),
s(k, shingle) AS (VALUES {", ".join(shingles)}),
f AS (SELECT row_number() OVER () AS r, doc_id, {_folded("text")} AS ws FROM documents),
p AS (SELECT r, doc_id, i - 1 AS p, array_to_string(ws[i : i + {SHINGLE - 1}], ' ') AS shingle FROM (SELECT r, doc_id, ws, {_windows("ws", str(SHINGLE))} AS i FROM f)),
m AS (SELECT r, doc_id, k, license, n, p, shingle, unnest(range((greatest(0, p + {SHINGLE} - 2 * width) + width - 1) // width, p // width + 1)) AS j FROM p JOIN s USING (shingle) JOIN t USING (k)),
found AS (SELECT r, doc_id, k, license, j, count(DISTINCT shingle) / any_value(n) AS containment, min(p) AS first_word, max(p) + {SHINGLE - 1} AS last_word FROM m GROUP BY r, doc_id, k, license, j HAVING count(DISTINCT shingle) / any_value(n) >= {CONTAINMENT})
SELECT doc_id, license, containment, first_word::INT AS first_word, last_word::INT AS last_word, (count(*) OVER (PARTITION BY r, license))::INT AS windows FROM found
QUALIFY row_number() OVER (PARTITION BY r, license ORDER BY containment DESC, first_word, k) = 1"""


def _passages() -> str:
    return f"""
WITH w AS (SELECT DISTINCT row_number() OVER () AS r, doc_id, {_words("text")} AS ws FROM documents WHERE doc_id IS NOT NULL),
here AS (SELECT r, doc_id, i, array_to_string(ws[i + 1 : i + {MIN_WORDS}], ' ') AS g FROM (SELECT r, doc_id, ws, {_windows("ws", str(MIN_WORDS))} - 1 AS i FROM w)),
again AS (SELECT r, doc_id, i FROM here QUALIFY count(*) OVER (PARTITION BY g) > 1),
cut AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS part FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {MIN_WORDS} THEN 0 ELSE 1 END AS new FROM again))
SELECT DISTINCT doc_id, min(i)::INT AS start_word, (max(i) + {MIN_WORDS})::INT AS end_word FROM cut GROUP BY r, doc_id, part"""


def _matches() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_folded("text")} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {_folded("text")} AS ws FROM benchmark),
phrase AS (SELECT q, item_id, i, least(len(ws), {PHRASE}) AS n, array_to_string(ws[i : i + {PHRASE - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - {PHRASE} + 1, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM phrase),
here AS (SELECT r, doc_id, i - 1 AS p, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT r, doc_id, ws, n, {_windows("ws", "n")} AS i FROM d, sizes)),
exact AS (SELECT r, doc_id, q, item_id, 'exact' AS kind, count(DISTINCT phrase.i) AS windows, min(p) AS first_word, max(p + n - 1) AS last_word FROM phrase JOIN here USING (g, n) GROUP BY r, doc_id, q, item_id),
near AS (SELECT q, item_id, i, least(len(ws), {NEAR_PHRASE}) AS n, ws[i : i + {NEAR_PHRASE - 1}] AS ws FROM (SELECT *, unnest(range(1, greatest(len(ws) - {NEAR_PHRASE} + 1, 1) + 1)) AS i FROM b WHERE len(ws) >= {PHRASE})),
term AS (SELECT q, item_id, i, n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS j FROM near),
one AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS x FROM d),
maybe AS (SELECT r, q, i FROM one JOIN term USING (word) GROUP BY r, q, i HAVING count(DISTINCT j) = any_value(n)),
placed AS (SELECT r, doc_id, q, item_id, i, n, p FROM (SELECT r, doc_id, q, item_id, i, n, j, unnest(range(x - j - {SLOP}, x - j + {SLOP + 1})) AS p FROM one JOIN term USING (word) JOIN maybe USING (r, q, i)) GROUP BY r, doc_id, q, item_id, i, n, p HAVING count(DISTINCT j) = n),
proximity AS (SELECT r, doc_id, q, item_id, 'proximity' AS kind, count(DISTINCT i) AS windows, min(greatest(p, 0)) AS first_word, max(greatest(p, 0) + n - 1) AS last_word FROM placed GROUP BY r, doc_id, q, item_id)
SELECT doc_id, item_id, kind, windows, first_word, last_word FROM (FROM exact UNION ALL FROM proximity)"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _quality(),
    "op2_ngram_jaccard": _links(),
    "op4_license_scan": _licenses(),
    "op5_suffix_array": _passages(),
    "op7_decontamination": _matches(),
    "op9_recompression": _passages(),
}
