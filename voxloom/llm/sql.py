"""SQL for DuckDB with the results of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

import unicodedata

from .lookalike import LOOKALIKES

_LATEST = """
WITH latest AS (
  SELECT sample_index, similarity, lower(trim(model)) AS model, lower(trim(voice)) AS voice
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_index ORDER BY scored_at DESC) AS rn FROM scores)
  WHERE rn = 1
), goal AS (
  SELECT lower(trim(model)) AS model, lower(trim(voice)) AS voice, max(keep_fraction) AS keep_fraction
  FROM cutoff_targets GROUP BY 1, 2
), ok AS (
  SELECT l.*, g.keep_fraction,
         count(*) OVER (PARTITION BY l.model, l.voice) AS valid,
         row_number() OVER (PARTITION BY l.model, l.voice ORDER BY similarity DESC, sample_index) AS pos
  FROM latest l JOIN goal g USING (model, voice)
  WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND similarity BETWEEN 0 AND 1
), cut AS (
  SELECT model, voice, any_value(valid) AS valid,
         max(CASE WHEN pos = ceil(CAST(keep_fraction AS DECIMAL(19,9)) * valid) THEN similarity END) AS cutoff
  FROM ok GROUP BY model, voice
)
"""

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

_SAME = "lower(upper(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')))"
_COPIES = f"""
WITH u AS (SELECT 'unified' AS t, sample_index AS id, {_SAME.format('text')} AS f FROM unified WHERE text IS NOT NULL),
j AS (SELECT record_id, key AS k, CASE WHEN value IS NULL THEN '' ELSE json_extract_string(value, '$') END AS v
      FROM (SELECT * FROM raw_records WHERE json_valid(text)), json_each(text)),
l AS (SELECT record_id, split_part(line, ':', 1) AS k, CASE WHEN contains(line, ':') THEN substr(line, strpos(line, ':') + 1) ELSE '' END AS v
      FROM (SELECT record_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM raw_records WHERE NOT json_valid(text)) WHERE trim(line) <> ''),
r AS (SELECT 'raw_records' AS t, record_id AS id, string_agg(lower(trim(k)) || '=' || coalesce({_SAME.format('v')}, ''), '|' ORDER BY lower(trim(k)), v) AS f
      FROM (SELECT * FROM j UNION ALL SELECT * FROM l) GROUP BY record_id),
g AS (SELECT t, id, min(id) OVER (PARTITION BY t, f) AS k FROM (SELECT * FROM u WHERE f <> '' UNION ALL SELECT * FROM r))
"""

_SPLITS = """
WITH RECURSIVE u AS (SELECT sample_index, nullif(lower(trim(client_id)), '') AS c, nullif(nullif(lower(trim(voice)), ''), 'common_voice') AS v FROM unified),
e AS (SELECT DISTINCT c, v FROM u WHERE c IS NOT NULL AND v IS NOT NULL),
near AS (SELECT DISTINCT a.c AS x, b.c AS y FROM e a JOIN e b USING (v)),
reach AS (SELECT x, y FROM near UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x),
cc AS (SELECT x AS c, min(y) AS m FROM reach GROUP BY x), vv AS (SELECT v, min(m) AS vm FROM e JOIN cc USING (c) GROUP BY v),
k AS (SELECT sample_index, CASE WHEN u.c IS NOT NULL THEN 'a:' || coalesce(cc.m, u.c) WHEN u.v IS NOT NULL THEN coalesce('a:' || vv.vm, 'b:' || u.v) ELSE '~:' || sample_index END AS component
  FROM u LEFT JOIN cc ON cc.c = u.c LEFT JOIN vv ON vv.v = u.v),
p AS (SELECT *, CAST(concat('0x', substr(md5('42#' || component), 1, 8)) AS BIGINT) / 4294967296.0 AS point FROM k),
t AS (SELECT split, sum(share) AS share FROM split_targets WHERE share > 0 GROUP BY 1),
r AS (SELECT split, sum(share) OVER (ORDER BY split) / (SELECT sum(share) FROM t) AS upto, row_number() OVER (ORDER BY split DESC) = 1 AS last FROM t),
g AS (SELECT split, coalesce(lag(upto) OVER (ORDER BY split), 0) AS lo, CASE WHEN last THEN 2 ELSE upto END AS upto FROM r),
assigned AS (SELECT p.sample_index, p.component, g.split FROM p JOIN g ON p.point >= g.lo AND p.point < g.upto)
"""

_LEAKS = r"""
WITH item AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
ip AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 7), ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM item WHERE len(w) >= 8)),
part AS (SELECT doc_id, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS x FROM documents WHERE text <> '')),
placed AS (SELECT doc_id, x, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM part),
word AS (SELECT doc_id, lower(x) AS x, upto - length(x) AS s, upto AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM placed WHERE regexp_matches(x, '^[\p{L}\p{N}]')),
doc AS (SELECT doc_id, list(x ORDER BY k) AS w, list(s ORDER BY k) AS s, list(e ORDER BY k) AS e FROM word GROUP BY 1 HAVING count(*) >= 8),
dp AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM doc)),
hit AS (SELECT item_id, doc_id, i FROM ip JOIN dp USING (p)),
isle AS (SELECT *, sum(o) OVER (PARTITION BY item_id, doc_id ORDER BY i) AS isle FROM (
  SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY item_id, doc_id ORDER BY i) + 8 THEN 1 ELSE 0 END AS o FROM hit)),
span AS (SELECT item_id, doc_id, min(i) AS a, max(i) + 7 AS b FROM isle GROUP BY item_id, doc_id, isle),
spans AS (SELECT item_id, doc_id, CAST(s[a] AS INTEGER) AS start, CAST(e[b] AS INTEGER) AS "end", CAST(b - a + 1 AS INTEGER) AS words FROM span JOIN doc USING (doc_id))
"""

_OVERLAPS = r"""
WITH u AS (SELECT sample_index, split, lower(trim(coalesce(dataset_source, ''))) AS source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM unified WHERE split IN ('train', 'validation', 'test')),
m AS (SELECT sample_index, split, source, w, min(sample_index) OVER (PARTITION BY w) AS cid FROM u WHERE len(w) > 0),
c AS (SELECT cid, any_value(list_transform(w, lambda x: CAST(hash(x) % 4611686018427387904 AS BIGINT))) AS w, any_value(len(w)) AS n, bool_or(split = 'train') AS t, bool_or(split <> 'train') AS e FROM m GROUP BY 1),
b AS (SELECT cid, n, t, e, x, count(*) AS k FROM (SELECT cid, n, t, e, unnest(w) AS x FROM c) GROUP BY ALL),
near AS (SELECT l.cid AS l, r.cid AS r FROM b l JOIN b r ON l.x = r.x AND l.e AND r.t AND l.cid <> r.cid AND abs(l.n - r.n) * 5 <= greatest(l.n, r.n)
  GROUP BY ALL HAVING (greatest(any_value(l.n), any_value(r.n)) - sum(least(l.k, r.k))) * 5 <= greatest(any_value(l.n), any_value(r.n))),
d AS (SELECT near.l, near.r, greatest(a.n, z.n) AS most, list_reduce(list_transform(a.w, lambda x: [x]), lambda row, x: list_reduce(list_transform(range(1, z.n + 1), lambda j: [j]),
  lambda acc, j: list_append(acc, least(acc[-1] + 1, row[j[1] + 1] + 1, row[j[1]] + CASE WHEN z.w[j[1]] = x[1] THEN 0 ELSE 1 END)), [row[1] + 1]), range(0, z.n + 1))[-1] AS edits
  FROM near JOIN c a ON a.cid = near.l JOIN c z ON z.cid = near.r),
link AS (SELECT l, r, CAST(edits AS INTEGER) AS edits FROM d WHERE edits * 5 <= most UNION ALL SELECT cid, cid, 0 FROM c WHERE e AND t)
"""



def _looks() -> str:
    """Forms by plain replacement of characters: letters by a table, widths by their distance, then composed marks and single spaces."""
    given = LOOKALIKES.split()
    swaps = dict(zip(given[::2], given[1::2], strict=True)) | {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | {"　": " ", " ": " ", " ": " "}
    for char in map(chr, (*range(0x370, 0x530), *range(0x1F00, 0x2000))):  # accented letters of other scripts
        base, *marks = unicodedata.normalize("NFD", char)
        if marks and base in swaps:
            swaps[char] = unicodedata.normalize("NFC", swaps[base] + "".join(marks))
    one = {a: b for a, b in swaps.items() if len(b) == 1}
    text = r"regexp_replace(text, '[\x{ad}\x{34f}\x{61c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202c}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{feff}\x{fe00}-\x{fe0f}]', '', 'g')"
    text = f"translate({text}, '{''.join(one).replace(chr(39), chr(39) * 2)}', '{''.join(one.values()).replace(chr(39), chr(39) * 2)}')"
    for joined, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("Ĳ", "IJ"), ("ĳ", "ij"), ("Ǆ", "DŽ"), ("ǆ", "dž"), ("Ǉ", "LJ"), ("ǉ", "lj"), ("Ǌ", "NJ"), ("ǌ", "nj"), ("ŉ", "ʼn")):
        text = f"replace({text}, '{joined}', '{plain}')"
    return rf"trim(regexp_replace(nfc_normalize({text}), '[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


_LOOKS = f"""
WITH f AS (SELECT audio_id, text, {_looks()} AS form FROM synthetic_audio WHERE text IS NOT NULL),
s AS (SELECT form, text, count(*) AS n, min(audio_id) AS least FROM f WHERE form <> '' GROUP BY ALL),
c AS (SELECT form, min(least) AS class_id, sum(n) AS everything FROM s GROUP BY 1 HAVING count(*) > 1)
"""

ORACLES: dict[str, str] = {
    "p1_found": _LATEST + "SELECT o.sample_index FROM ok o JOIN cut c USING (model, voice) WHERE o.similarity >= c.cutoff",
    "p1_cutoffs": _LATEST
    + """SELECT g.model, g.voice, g.keep_fraction, CAST(coalesce(c.valid, 0) AS BIGINT) AS valid, c.cutoff,
       CAST(count(o.sample_index) AS BIGINT) AS kept
FROM goal g LEFT JOIN cut c USING (model, voice)
LEFT JOIN ok o ON o.model = g.model AND o.voice = g.voice AND o.similarity >= c.cutoff
GROUP BY g.model, g.voice, g.keep_fraction, c.valid, c.cutoff""",
    "p3_found": """
WITH base AS (
  SELECT sample_index, lower(trim(client_id)) AS who,
         greatest(coalesce(up_votes, 0), 0) - greatest(coalesce(down_votes, 0), 0) AS q
  FROM unified WHERE trim(client_id) <> ''
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY who ORDER BY q DESC, sample_index) AS rn FROM base
)
SELECT sample_index FROM ranked WHERE rn > greatest(1, (SELECT count(*) FROM base) // 100)""",
    "p3_dropped": """
WITH base AS (
  SELECT sample_index, lower(trim(client_id)) AS client_id FROM unified WHERE trim(client_id) <> ''
), cap AS (SELECT greatest(1, count(*) // 100) AS cap FROM base)
SELECT client_id, CAST(cap AS BIGINT) AS cap, CAST(count(*) - cap AS BIGINT) AS dropped
FROM base, cap GROUP BY client_id, cap HAVING count(*) > cap""",
    "p7_found": f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM eval_items), doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ip AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 7), ' ') AS p
       FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM item WHERE len(w) >= 8)),
dp AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 7), ' ') AS p
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM doc WHERE len(w) >= 8))
SELECT DISTINCT item_id, doc_id FROM ip JOIN dp USING (p)""",
    "p7_spans": f'{_LEAKS} SELECT item_id, doc_id, start, "end", words FROM spans',
    "p7_removals": f"""{_LEAKS}, o AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS no FROM o)
SELECT doc_id, min(start) AS start, max("end") AS "end", count(DISTINCT item_id) AS items FROM n GROUP BY doc_id, no""",
    "p6_found": f"""{_OVERLAPS} SELECT DISTINCT least(a.sample_index, z.sample_index) AS id_a, greatest(a.sample_index, z.sample_index) AS id_b
FROM link JOIN m a ON a.cid = link.l AND a.split <> 'train' JOIN m z ON z.cid = link.r AND z.split = 'train'""",
    "p6_links": f"{_OVERLAPS} SELECT l AS class_held_out, r AS class_train, edits FROM link",
    "p6_members": f"""{_OVERLAPS}, k AS (SELECT l AS cid, count(*) AS n FROM link GROUP BY 1)
SELECT m.sample_index, m.cid AS class_id, m.split, CAST(CASE WHEN m.split <> 'train' THEN coalesce(k.n, 0) ELSE 0 END AS BIGINT) AS links FROM m LEFT JOIN k USING (cid)""",
    "p6_report": f"""{_OVERLAPS}, k AS (SELECT l AS cid, bool_or(edits = 0) AS exact, bool_or(edits > 0) AS near FROM link GROUP BY 1)
SELECT split, source AS dataset_source, count(*) FILTER (exact) AS exact_rows, count(*) FILTER (near) AS near_rows, count(*) AS overlapping_rows FROM m JOIN k USING (cid) WHERE split <> 'train' GROUP BY 1, 2""",
    "p4_assigned": f"{_SPLITS} SELECT sample_index, component, split FROM assigned",
    "p4_shares": f"""{_SPLITS} SELECT a.split, any_value(s.share) AS target_share, count(*) AS rows, count(DISTINCT a.component) AS components, count(*) / sum(count(*)) OVER () AS actual_share
FROM assigned a LEFT JOIN split_targets s USING (split) GROUP BY a.split""",
    "p5_forms": f"SELECT audio_id, text, {_looks()} AS form FROM synthetic_audio",
    "p5_found": f"{_LOOKS} SELECT DISTINCT least(a.audio_id, b.audio_id) AS id_a, greatest(a.audio_id, b.audio_id) AS id_b FROM f a JOIN f b ON a.form = b.form AND a.text < b.text WHERE a.form <> ''",
    "p5_classes": f"{_LOOKS} SELECT f.audio_id, c.class_id, CAST(c.everything - s.n AS BIGINT) AS links FROM f JOIN c USING (form) JOIN s ON s.form = f.form AND s.text = f.text",
    "p2_found": f"{_COPIES} SELECT t AS table_name, k AS keep_id, id AS copy_id FROM g WHERE id <> k",
    "p2_counts": f"{_COPIES} SELECT t AS table_name, k AS keep_id, count(*) AS copies FROM g GROUP BY t, k HAVING count(*) > 1",
    "p2_collapsed": f"""{_COPIES},
c AS (SELECT t, k, count(*) AS copies FROM g GROUP BY t, k)
SELECT a.t AS table_name, a.id AS keep_id, coalesce(c.copies, 1) AS copies
FROM (SELECT 'unified' AS t, sample_index AS id FROM unified UNION ALL SELECT 'raw_records', record_id FROM raw_records) a
LEFT JOIN g ON g.t = a.t AND g.id = a.id LEFT JOIN c ON c.t = a.t AND c.k = a.id WHERE coalesce(g.k, a.id) = a.id""",
    "p4_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT lower(trim(client_id)) AS c, lower(trim(voice)) AS v FROM unified
  WHERE trim(client_id) <> '' AND trim(voice) <> '' AND lower(trim(voice)) <> 'common_voice'
), near AS (SELECT DISTINCT a.c AS x, b.c AS y FROM e a JOIN e b USING (v)),
reach AS (SELECT x, y FROM near UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x)
SELECT min(y) AS client_a, x AS client_b FROM reach GROUP BY x HAVING min(y) <> x""",
}
