"""The registered queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

_KEY = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"
_IDS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

#: Lineitem rows as ordered files, and their attributes as findings.
_LINES = f"""
l AS (SELECT {_KEY} AS file, CASE WHEN l_orderkey % 10 = 0 AND l_linenumber % 2 = 1 THEN 'shared' ELSE o_custkey::VARCHAR END AS study, l_orderkey::VARCHAR AS series, l_quantity AS distance, l_returnflag AS modality, l_linestatus AS description,
             round(l_discount * 100)::INT AS discount, round(l_tax * 100)::INT AS tax, l_linenumber, l_quantity,
             min(l_linestatus) OVER (PARTITION BY l_orderkey) = max(l_linestatus) OVER (PARTITION BY l_orderkey) AS agree
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT *, row_number() OVER (PARTITION BY study, series ORDER BY distance, file) - 1 AS ordinal, count(*) OVER (PARTITION BY study, series) AS n_files FROM l),
a AS (SELECT * FROM (
        SELECT file, '00081030' AS path, modality AS value, 'annex-e' AS kind, 'X' AS action FROM l
        UNION ALL SELECT file, '00100010', description, 'annex-e', 'Z' FROM l
        UNION ALL SELECT file, '00291010', CASE WHEN discount >= 5 THEN discount::VARCHAR END, 'private', NULL FROM l
        UNION ALL SELECT file, '00081050', CASE WHEN tax > 0 THEN tax::VARCHAR END, 'annex-e', 'X' FROM l
        UNION ALL SELECT file, '00280301', CASE WHEN l_quantity > 40 THEN 'NO' WHEN l_quantity > 25 THEN 'YES' END, 'burned-in', NULL FROM l
        UNION ALL SELECT file, '00080018', file, 'annex-e', 'U' FROM l) WHERE value IS NOT NULL),
j AS (SELECT a.*, o.study, o.series, o.ordinal, o.n_files FROM a JOIN o USING (file))"""


def _rows(check_no: int, kind: str, source: str, scope: str = "series", **columns: str) -> str:
    names = ("study", "series", "path", "item", "file", "ordinal", "value", "expected_value", "expected", "actual")
    kinds = {"ordinal": "BIGINT", "expected": "DOUBLE", "actual": "DOUBLE"}
    shown = ", ".join(f"{columns.get(n, 'NULL')}::{kinds.get(n, 'VARCHAR')} AS {n}" for n in names)
    return f"SELECT {check_no} AS check_no, '{kind}' AS kind, '{scope}' AS scope, {shown} FROM {source}"


_OF = {c: c for c in ("study", "series", "file", "ordinal")}
_CHECKS = {
    "position_gap": (
        """
p1 AS (SELECT *, lag(distance) OVER w AS before, lag(file) OVER w AS previous FROM o WINDOW w AS (PARTITION BY study, series ORDER BY ordinal)),
p2 AS (SELECT *, distance - before AS actual FROM p1 WHERE before IS NOT NULL),
p3 AS (SELECT study, series, floor(actual / 0.01::DOUBLE + 0.5) AS bucket, count(*) AS n, arg_min(actual, ordinal) AS first FROM p2 GROUP BY ALL),
p4 AS (SELECT study, series, first AS expected, sum(n) OVER (PARTITION BY study, series) AS steps, row_number() OVER (PARTITION BY study, series ORDER BY n DESC, first) AS r FROM p3),
p5 AS (SELECT p2.*, expected FROM p2 JOIN p4 USING (study, series) WHERE r = 1 AND steps >= 2 AND abs(actual - expected) > 0.01::DOUBLE),
p6 AS (SELECT study, series, ordinal AS item, previous AS file, ordinal - 1 AS ordinal, expected, actual FROM p5 UNION ALL SELECT study, series, ordinal, file, ordinal, expected, actual FROM p5)""",
        _rows(1, "position-gap", "p6", **_OF, item="item", expected="round(expected, 6)", actual="round(actual, 6)"),
    ),
    "duplicate_position": (
        """
d1 AS (SELECT *, CASE WHEN distance - lag(distance) OVER w <= 0.01::DOUBLE THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY study, series ORDER BY ordinal)),
d2 AS (SELECT *, sum(fresh) OVER (PARTITION BY study, series ORDER BY ordinal)::BIGINT AS island FROM d1),
d3 AS (SELECT *, count(*) OVER (PARTITION BY study, series, island) AS size FROM d2)""",
        _rows(2, "duplicate-position", "d3 WHERE size > 1", **_OF, item="island"),
    ),
    "spacing_outliers": (
        """
s1 AS (SELECT study, series, discount, tax, count(*) AS n, min(ordinal) AS first FROM o GROUP BY ALL),
s2 AS (SELECT *, row_number() OVER (PARTITION BY study, series ORDER BY n DESC, discount, tax, first) AS r FROM s1),
s3 AS (SELECT o.*, x.first, b.discount AS bd, b.tax AS bt FROM o JOIN s2 x USING (study, series, discount, tax) JOIN s2 b USING (study, series) WHERE b.r = 1 AND x.r > 1)""",
        _rows(3, "inconsistent-pixel-spacing", "s3", **_OF, item="first", value="concat(discount, '.0\\', tax, '.0')", expected_value="concat(bd, '.0\\', bt, '.0')"),
    ),
    "orientation_mix": ("", _rows(4, "inconsistent-orientation", "o WHERE NOT agree", **_OF)),
    "mixed_modality_series": (
        "m1 AS (SELECT *, min(modality) OVER (PARTITION BY study, series) AS lo, max(modality) OVER (PARTITION BY study, series) AS hi FROM o)",
        _rows(5, "mixed-modality", "m1 WHERE lo <> hi", **_OF, value="modality"),
    ),
    "varying_value": (
        """
v1 AS (SELECT *, coalesce(value, '') AS v FROM j WHERE n_files >= 2 AND kind = 'annex-e' AND path <> '00080018'),
v2 AS (SELECT study, series, path, v, count(*) AS n, any_value(n_files) AS n_files FROM v1 GROUP BY ALL),
v3 AS (SELECT *, sum(n) OVER p AS every, count(*) OVER p AS k, row_number() OVER (PARTITION BY study, series, path ORDER BY n DESC, v) AS r FROM v2 WINDOW p AS (PARTITION BY study, series, path)),
v4 AS (SELECT v1.*, v3.v AS most FROM v1 JOIN v3 USING (study, series, path) WHERE r = 1 AND every = v3.n_files AND k > 1 AND v1.v <> v3.v)""",
        _rows(6, "varying-value", "v4", **_OF, path="path", item="path", value="v", expected_value="most"),
    ),
    "extra_field": (
        "x1 AS (SELECT *, count(*) OVER (PARTITION BY study, series, path) AS n FROM j WHERE n_files >= 2)",
        _rows(7, "extra-field", "x1 WHERE n < n_files", **_OF, path="path", item="path"),
    ),
    "_shared_series": (
        "h1 AS (SELECT series AS several FROM o GROUP BY series HAVING min(study) <> max(study))",
        _rows(8, "inconsistent-identifier", "o JOIN h1 ON series = several", series="series", file="file", ordinal="ordinal", value="study"),
    ),
    "mixed_modality_folder": (
        "f1 AS (SELECT * FROM l WHERE (SELECT min(modality) <> max(modality) FROM l))",
        _rows(9, "mixed-modality", "f1", "folder", file="file", value="modality"),
    ),
}


def _checked(*names: str) -> str:
    steps = ", ".join(_CHECKS[n][0] for n in names if _CHECKS[n][0])
    return f"WITH {_LINES}{', ' if steps else ' '}{steps} " + " UNION ALL ".join(f"SELECT * FROM ({_CHECKS[n][1]})" for n in names)


_ALL = _checked(*_CHECKS)
_TAG = """CASE l_linenumber % 4 WHEN 0 THEN '50' || printf('%02x', l_partkey % 256) || '00' || printf('%02x', l_suppkey % 256) WHEN 1 THEN '60' || printf('%02x', l_partkey % 256) || '3000'
 WHEN 2 THEN '60' || printf('%02x', l_suppkey % 256) || '4000' ELSE '00' || printf('%02x', l_partkey % 256) || '0000' END"""
_MASKS = "(VALUES (0, '50xxxxxx', 'X'), (1, '60xx3000', 'X'), (2, '60xx4000', 'X')) AS p(ordinal, mask, action)"
_SYNTAXES = "['1.2.840.10008.1.2', '1.2.840.10008.1.2.1', '1.2.840.10008.1.2.5', '1.2.840.10008.1.2.4.50', '1.2.840.10008.1.2.2']"

ORACLES = {
    **{n: _checked(n) for n in _CHECKS if n[0] != "_"},
    "check_series": _ALL,
    "shared_series": f"""
WITH r AS (SELECT {_KEY} AS file, l_suppkey::VARCHAR AS study, l_partkey::VARCHAR AS series FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY study, series ORDER BY file) - 1 AS ordinal FROM r),
s AS (SELECT series FROM r GROUP BY series HAVING count(DISTINCT study) > 1)
{_rows(8, "inconsistent-identifier", "o WHERE series IN (SELECT series FROM s)", series="series", file="file", ordinal="ordinal", value="study")}""",
    "tag_normalise": f"""
WITH s AS (SELECT {_IDS}, printf('%08x', l_partkey) AS h, (l_linenumber + l_partkey) % 6 AS k FROM lineitem)
SELECT {_IDS}, CASE k WHEN 0 THEN '(' || h[1:4] || ',' || h[5:8] || ')' WHEN 1 THEN h[1:4] || ',' || upper(h[5:8]) WHEN 2 THEN '0x' || h WHEN 3 THEN 'x' || upper(h) WHEN 4 THEN '  ' || h || ' ' ELSE '(' || h || ')' END AS spelling,
       CASE WHEN k < 5 THEN h END AS tag FROM s""",
    "tag_parts": f"""
WITH s AS (SELECT {_IDS}, {_TAG} AS tag FROM lineitem)
SELECT {_IDS}, '(' || upper(tag[1:4]) || ',' || upper(tag[5:8]) || ')' AS display, ('0x' || tag[1:4])::INT AS tag_group, ('0x' || tag[5:8])::INT AS tag_element, ('0x' || tag[1:4])::INT % 2 = 1 AS private,
       ('0x' || tag[1:4])::INT % 2 = 1 AND ('0x' || tag[5:8])::INT BETWEEN 16 AND 255 AS creator, regexp_full_match(tag, '[0-9a-f]{{8}}') AS normal FROM s""",
    "classify_fields": """
WITH f AS (SELECT c_custkey::VARCHAR AS file, * FROM customer)
SELECT file, '00100010' AS path, 'annex-e' AS kind, 'Z' AS action, c_name AS value FROM f WHERE c_name IS NOT NULL
UNION ALL SELECT file, '00100020', 'annex-e', 'Z/D', c_custkey::VARCHAR FROM f
UNION ALL SELECT file, '60003000', 'annex-e', NULL, c_nationkey::VARCHAR FROM f WHERE c_nationkey IS NOT NULL
UNION ALL SELECT file, '60013000', 'private', NULL, trunc(c_acctbal)::INT::VARCHAR FROM f WHERE c_acctbal IS NOT NULL
UNION ALL SELECT file, '601e3000', 'annex-e', 'X', (c_nationkey % 5)::VARCHAR FROM f WHERE c_nationkey IS NOT NULL
UNION ALL SELECT file, '00280301', 'burned-in', NULL, c_mktsegment FROM f WHERE c_mktsegment IS NOT NULL""",
    "mask_lookup": f"""
WITH t AS (SELECT DISTINCT {_TAG} AS tag FROM lineitem)
SELECT tag, min(ordinal) AS ordinal, arg_min(action, ordinal) AS action FROM t JOIN {_MASKS} ON regexp_full_match(tag, replace(mask, 'x', '[0-9a-f]')) GROUP BY tag""",
    "name_fields": f"""
WITH t AS (SELECT {_IDS}, {_TAG} AS tag FROM lineitem),
d AS (SELECT '60' || printf('%02x', p_partkey % 256) || '3000' AS tag, arg_min(p_name, p_partkey) AS name, arg_min(p_size, p_partkey) % 2 = 0 AS even FROM part GROUP BY 1),
e AS (SELECT {_IDS}, t.tag, CASE WHEN t.tag[4] IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN NULL WHEN d.tag IS NOT NULL THEN 'exact' WHEN regexp_full_match(t.tag, '50..00..') THEN 'Curve Data' WHEN regexp_full_match(t.tag, '60..4000') THEN 'Overlay Comments'
             WHEN t.tag LIKE '%0000' THEN 'Group Length' END AS found, name, even FROM t LEFT JOIN d ON t.tag = d.tag)
SELECT {_IDS}, tag, CASE found WHEN 'exact' THEN name ELSE found END AS name, CASE found WHEN 'exact' THEN CASE WHEN even THEN 'US or SS' END WHEN 'Curve Data' THEN 'OW' WHEN 'Overlay Comments' THEN 'LT' WHEN 'Group Length' THEN 'UL' END AS listed_vr FROM e""",
    "mask_values": """
WITH r AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'OB' WHEN 1 THEN 'SQ' ELSE 'LO' END AS vr, CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name END AS value, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS length FROM customer),
p AS (SELECT *, CASE WHEN vr = 'OB' AND length IS NULL THEN '<binary, length not stated>' WHEN vr = 'OB' THEN '<binary, ' || format('{:,}', length) || CASE WHEN length = 1 THEN ' byte>' ELSE ' bytes>' END
      WHEN value = '' THEN '(empty)' WHEN value IS NULL AND vr = 'SQ' THEN '(sequence)' WHEN value IS NULL THEN '(not shown)' ELSE value END AS plain, vr <> 'OB' AND value IS NOT NULL AND value <> '' AS maskable FROM r)
SELECT c_custkey, plain, CASE WHEN maskable THEN '●●●●●●●●' ELSE plain END AS masked, maskable FROM p""",
    "instance_view": f"""
WITH {_LINES} SELECT file, study, series, file AS sop, l_quantity AS instance_number, modality, concat(discount, '\\', tax) AS spacing, CASE WHEN discount % 3 > 0 THEN 6 END::INT AS cosines,
       CASE WHEN tax > 0 THEN discount::DOUBLE END AS position_x, CASE WHEN tax > 0 THEN tax::DOUBLE END AS position_y, CASE WHEN tax > 0 THEN l_quantity END AS position_z, discount % 3 = 0 AND discount > 0 AS malformed_geometry FROM l""",
    "masked_view": """
WITH r AS (SELECT c_custkey, c_nationkey % 2 = 0 AS known, CASE c_nationkey % 4 WHEN 0 THEN 'OB' WHEN 1 THEN 'SQ' ELSE 'LO' END AS vr, CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name END AS value FROM customer)
SELECT c_custkey, CASE WHEN vr = 'OB' THEN '<binary, ' || format('{:,}', c_custkey) || CASE WHEN c_custkey = 1 THEN ' byte>' ELSE ' bytes>' END WHEN value = '' THEN '(empty)' WHEN value IS NULL AND vr = 'SQ' THEN '(sequence)' WHEN value IS NULL THEN '(not shown)'
       WHEN known THEN '●●●●●●●●' ELSE value END AS shown FROM r""",
    "nested_flatten": """
WITH l AS (SELECT o_orderkey::VARCHAR AS file, o_custkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT file, '00100020' AS path, '00100020' AS tag, 'LO' AS vr, o_custkey::VARCHAR AS value, NULL::INT AS item_count, 0 AS depth, 0 AS pos FROM l WHERE k = 0
UNION ALL SELECT file, '00081140', '00081140', 'SQ', NULL, n::INT, 0, 1 FROM l WHERE k = 0
UNION ALL SELECT file, concat('00081140/', k, '/00081150'), '00081150', 'UI', l_partkey::VARCHAR, NULL, 1, (2 + 2 * k)::INT FROM l
UNION ALL SELECT file, concat('00081140/', k, '/00081155'), '00081155', 'UI', l_suppkey::VARCHAR, NULL, 1, (3 + 2 * k)::INT FROM l""",
    "file_list": """
WITH f AS (SELECT l_orderkey, list(concat('line-', l_linenumber, '-', l_partkey) ORDER BY concat('line-', l_linenumber, '-', l_partkey)) AS f FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(f[1:5], ', ') || CASE WHEN len(f) > 5 THEN concat(', and ', len(f) - 5, ' more') ELSE '' END AS listed FROM f""",
    "report_names": """
WITH f AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN ' -- ' ELSE concat(' ', o_orderpriority, ' / ', CASE WHEN o_orderstatus = 'O' THEN 'ÖÄ' ELSE o_orderstatus END) END AS folder FROM orders),
s AS (SELECT *, regexp_replace(regexp_replace(lower(folder), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS made FROM f)
SELECT o_orderkey, CASE WHEN made = '' THEN 'files' ELSE made END AS slug, concat('metaudit-', CASE WHEN made = '' THEN 'files' ELSE made END, '-', strftime(o_orderdate, '%Y-%m-%d'), '.json') AS name FROM s""",
    "series_labels": """
WITH r AS (SELECT o_custkey::VARCHAR AS study, o_orderkey::VARCHAR AS series, CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey % 50)::VARCHAR END AS number FROM orders), p AS (SELECT *, row_number() OVER (ORDER BY study, series) AS position FROM r)
SELECT study, series, position, coalesce(number, position::VARCHAR) AS label FROM p""",
    "series_order": """
WITH r AS (SELECT user_id::VARCHAR AS study, concat(user_id, '-', event_type) AS series, user_id % 7 = 0 OR event_id % 11 <> 0 AS numbered, user_id % 3 = 0 OR event_id % 2 = 0 AS placed, user_id % 5 = 0 AND event_id % 2 = 1 AS tilted FROM events)
SELECT study, series, count(*) AS n_files, CASE WHEN min(tilted) = max(tilted) AND bool_and(placed) THEN 'Ordered by position' WHEN bool_and(numbered) THEN 'Ordered by instance number, as not every file has a usable position'
       ELSE 'Ordered by file name, as neither positions nor instance numbers serve' END AS words FROM r GROUP BY study, series""",
    "spacing_tolerance": f"""
WITH {_LINES}, w AS (SELECT *, discount + 1 + l_linenumber % 3 * 0.00004::DOUBLE AS x FROM o),
s1 AS (SELECT study, series, discount, tax, count(*) AS n, min(ordinal) AS first, arg_min(x, ordinal) AS lead FROM w GROUP BY ALL),
s2 AS (SELECT *, row_number() OVER (PARTITION BY study, series ORDER BY n DESC, lead, tax, first) AS r FROM s1),
s3 AS (SELECT w.*, a.first, a.lead, b.lead AS best, b.tax AS bt FROM w JOIN s2 a USING (study, series, discount, tax) JOIN s2 b USING (study, series) WHERE b.r = 1 AND a.r > 1)
{_rows(3, "inconsistent-pixel-spacing", "s3", study="study", series="series", file="file", ordinal="ordinal", item="first", value="concat(lead, chr(92), tax, '.0')", expected_value="concat(best, chr(92), bt, '.0')")}""",
    "file_findings": f"WITH {_LINES} SELECT file, path, kind, action, row_number() OVER (PARTITION BY file ORDER BY path)::INT AS place FROM a",
    "report_findings": f"""
WITH c AS ({_ALL}), {_LINES}, d AS (SELECT DISTINCT check_no, kind, scope, study, series, path, item FROM c),
s AS (SELECT study, series, arg_min(l_linenumber::VARCHAR, ordinal) AS label FROM o GROUP BY ALL), p AS (SELECT *, row_number() OVER (ORDER BY study, series) AS position FROM s),
q AS (SELECT series, min(position) AS position, arg_min(label, position) AS label FROM p GROUP BY series),
g AS (SELECT d.*, coalesce(p.position, q.position) AS position, coalesce(p.label, q.label) AS label FROM d LEFT JOIN p ON d.study = p.study AND d.series = p.series LEFT JOIN q ON d.study IS NULL AND d.series = q.series)
SELECT check_no, study, series, path, item, CASE WHEN scope = 'folder' THEN 'Whole folder' ELSE 'Series ' || label END AS "group", position,
       row_number() OVER (PARTITION BY scope = 'folder', position, kind IN ('varying-value', 'extra-field') ORDER BY check_no, length(item) NULLS FIRST, item NULLS FIRST)::INT AS heads FROM g""",
    "profile_quality": r"""
WITH p AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN '(' || printf('%04x', p_partkey) || ')' ELSE printf('%08x', floor(p_partkey / 2 * CASE WHEN p_partkey % 4 < 2 THEN 1 ELSE 2 END)::BIGINT) END AS tag, p_size % 10 > 0 AS has_name, p_partkey % 7 = 0 AS odd, p_partkey % 11 = 0 AS short FROM part)
SELECT tag AS subject, 'tag is not normalised' AS violation FROM p WHERE NOT regexp_full_match(tag, '[0-9a-f]{8}')
UNION ALL SELECT tag, 'has an empty name' FROM p WHERE NOT has_name UNION ALL SELECT tag, 'has an unknown action' FROM p WHERE odd UNION ALL SELECT tag, 'has not all action columns' FROM p WHERE short
UNION ALL SELECT tag, 'occurs more than once' FROM p GROUP BY tag HAVING count(*) > 1
UNION ALL SELECT r_name, v FROM (SELECT r_name, unnest(CASE r_regionkey WHEN 2 THEN ['invalid mask'] WHEN 3 THEN ['unknown match'] WHEN 4 THEN ['invalid mask', 'has an unknown action'] ELSE [] END) AS v FROM region)
UNION ALL SELECT * FROM (VALUES ('60xx4000', 'pattern row is missing'), ('oddGroup', 'pattern row is missing'))""",
    "dictionary_quality": r"""
WITH d AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN upper(printf('%07x', s_suppkey) || 'g') ELSE printf('%08x', s_suppkey // 3) END AS tag, (s_nationkey % 3)::VARCHAR AS edition FROM supplier)
SELECT tag AS subject, 'tag is not normalised' AS violation FROM d WHERE NOT regexp_full_match(tag, '[0-9a-f]{8}')
UNION ALL SELECT mask, 'invalid mask' FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN '60xx' || lpad(n_nationkey::VARCHAR, 4, '0') ELSE n_name END AS mask FROM nation) WHERE NOT regexp_full_match(mask, '[0-9a-fx]{8}')
UNION ALL SELECT tag, 'occurs more than once' FROM d GROUP BY tag HAVING count(*) > 1
UNION ALL SELECT DISTINCT edition, 'edition differs from the profile''s' FROM d WHERE edition NOT IN (SELECT (p_size % 2)::VARCHAR FROM part)""",
    "frame_samples": """
SELECT p_partkey::VARCHAR AS file, CASE WHEN p_partkey % 3 <> 1 THEN array_to_string(list_transform(string_split(p_name, ''), lambda c: ord(c)), ',') END AS words,
       CASE WHEN p_partkey % 3 = 1 THEN 'a frame has fewer bytes than pixels' END AS error FROM part""",
    "slice_distance": f"""
WITH r AS (SELECT {_IDS}, l_discount * l_tax AS x, -l_tax AS y, 1.0::DOUBLE AS z, l_discount AS px, l_tax AS py, l_quantity AS pz, l_discount AS d, l_tax AS t FROM lineitem)
SELECT {_IDS}, round((px * x + py * y + pz * z) / sqrt(x * x + y * y + z * z), 6) AS distance, abs(d) <= 0.0001::DOUBLE AND abs(t) <= 0.0001::DOUBLE AS agrees FROM r""",
    "order_series": """
WITH r AS (SELECT event_id, event_id::VARCHAR AS file, user_id::VARCHAR AS study, concat(user_id, '-', event_type) AS series, CASE WHEN user_id % 7 = 0 OR event_id % 11 <> 0 THEN event_id::DOUBLE END AS number,
                  CASE WHEN user_id % 3 = 0 THEN 3 WHEN event_id % 2 = 0 THEN 2 END AS axis, value, user_id % 5 = 0 AND event_id % 2 = 1 AS tilted FROM events),
g AS (SELECT *, min(tilted) OVER s = max(tilted) OVER s AS agree, bool_and(axis IS NOT NULL) OVER s AS placed, bool_and(number IS NOT NULL) OVER s AS numbered FROM r WINDOW s AS (PARTITION BY study, series)),
d AS (SELECT *, CASE WHEN agree AND placed THEN 'position' WHEN numbered THEN 'instance-number' ELSE 'filename' END AS ordered_by,
             CASE WHEN agree AND placed THEN CASE WHEN tilted THEN CASE WHEN axis = 2 THEN -value ELSE 0 END WHEN axis = 3 THEN value ELSE 0 END END AS distance FROM g)
SELECT file, study, series, ordered_by, agree AS orientation_consistent, round(distance, 6) AS distance,
       row_number() OVER (PARTITION BY study, series ORDER BY CASE ordered_by WHEN 'position' THEN distance WHEN 'instance-number' THEN number END, file) - 1 AS ordinal FROM d""",
    "series_meta": f"""
WITH {_LINES}, m AS (SELECT study, series, modality, row_number() OVER (PARTITION BY study, series ORDER BY count(*) DESC, modality) AS r FROM o GROUP BY study, series, modality),
s AS (SELECT study, series, description, row_number() OVER (PARTITION BY study, series ORDER BY count(*) DESC, description) AS r FROM o GROUP BY study, series, description)
SELECT study, series, count(*) AS n_files, 'position' AS ordered_by, any_value(m.modality) AS modality, any_value(s.description) AS description, arg_min(l_linenumber::VARCHAR, ordinal) AS series_number
FROM o JOIN m USING (study, series) JOIN s USING (study, series) WHERE m.r = 1 AND s.r = 1 GROUP BY study, series""",
    "ungrouped_files": """
WITH r AS (SELECT event_id::VARCHAR AS file, event_id % 4 = 0 AS no_study, event_id % 6 = 0 AS no_series FROM events)
SELECT file, CASE WHEN no_study AND no_series THEN 'missing-both' WHEN no_study THEN 'missing-study' ELSE 'missing-series' END AS reason,
       CASE WHEN no_study AND no_series THEN 'neither identifier' WHEN no_study THEN 'no study identifier' ELSE 'no series identifier' END AS words FROM r WHERE no_study OR no_series""",
    "finding_text": f"""
WITH c AS ({_ALL}), {_LINES}, sizes AS (SELECT study, series, count(*) AS n FROM l GROUP BY ALL),
v AS (SELECT check_no, kind, scope, study, series, path, item, CASE WHEN kind = 'mixed-modality' THEN value END AS modality, count(*) AS n, any_value(expected) AS expected, any_value(actual) AS actual FROM c GROUP BY ALL),
f AS (SELECT check_no, kind, scope, study, series, path, item, sum(n)::BIGINT AS n_files, any_value(expected) AS expected, any_value(actual) AS actual, list(modality ORDER BY n DESC, modality) AS m, list(n ORDER BY n DESC, modality) AS k FROM v GROUP BY ALL),
t AS (SELECT f.*, sizes.n AS size, CASE path WHEN '00081030' THEN 'Study Description' WHEN '00100010' THEN 'Patient''s Name' ELSE '(' || upper(path[1:4]) || ',' || upper(path[5:8]) || ')' END AS name FROM f LEFT JOIN sizes USING (study, series))
SELECT check_no, study, series, path, item, n_files, CASE kind
  WHEN 'varying-value' THEN name || ' is not the same on every file'
  WHEN 'extra-field' THEN name || ' appears on ' || n_files || ' of ' || size || ' files only'
  WHEN 'position-gap' THEN 'A slice may be missing — ' || round(actual)::INT || ' mm between two slices where ' || round(expected)::INT || ' mm is expected'
  WHEN 'duplicate-position' THEN 'Two slices occupy the same position'
  WHEN 'inconsistent-pixel-spacing' THEN n_files || CASE WHEN n_files = 1 THEN ' file has' ELSE ' files have' END || ' different pixel dimensions from the rest'
  WHEN 'inconsistent-identifier' THEN 'Slices in this series belong to different studies'
  WHEN 'inconsistent-orientation' THEN 'Slices in this series are not all in the same plane'
  ELSE CASE WHEN scope = 'folder' THEN 'This folder holds more than one kind of scan — ' || array_to_string([m[i] || ' (' || k[i] || CASE WHEN k[i] = 1 THEN ' file)' ELSE ' files)' END for i in range(1, len(m) + 1)], ', ')
       ELSE 'This series contains ' || (n_files - k[1]) || CASE WHEN n_files - k[1] = 1 THEN ' file' ELSE ' files' END || ' from a different kind of scan — ' || array_to_string(m[2:], ' and ') || ' among ' || m[1] END END AS text FROM t""",
    "field_summary": f"""
WITH {_LINES}, t AS (SELECT count(*) AS total FROM lineitem), s AS (SELECT path, kind, action, count(*) AS present_in, count(DISTINCT value) AS n_values FROM a WHERE kind <> 'burned-in' GROUP BY ALL)
SELECT s.*, total, CASE WHEN present_in = total THEN 'in all ' || total || ' files' ELSE 'in ' || present_in || ' of ' || total || ' files' END AS presence,
       CASE action WHEN 'X' THEN 'remove' WHEN 'Z' THEN 'blank, or replace with a dummy' WHEN 'U' THEN 'replace with a new UID' END AS gloss FROM s, t""",
    "field_values": f"WITH {_LINES} SELECT path, value, 'LO' AS vr, count(*) AS n_files FROM a WHERE kind <> 'burned-in' GROUP BY path, value",
    "burned_in": f"""
WITH {_LINES}, v AS (SELECT value, count(*) AS n FROM a WHERE kind = 'burned-in' GROUP BY value), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM v)
SELECT 'Burned-in annotation: ' || string_agg(n || CASE WHEN k = 1 THEN ' file' || CASE WHEN n = 1 THEN '' ELSE 's' END ELSE '' END || CASE WHEN n = 1 THEN ' declares ' ELSE ' declare ' END || value, ', ' ORDER BY k)
       || '; ' || ((SELECT count(*) FROM l) - sum(n))::BIGINT || ' do not carry the field' AS text FROM r""",
    "outcome_totals": """
WITH r AS (SELECT CASE WHEN event_id % 10 < 7 THEN 'read' WHEN event_id % 10 < 9 THEN 'skipped' ELSE 'failed' END AS outcome, event_type < 'm' AS early FROM events)
SELECT count(*) AS selected, count(*) FILTER (outcome = 'read') AS read, count(*) FILTER (outcome = 'skipped' AND early) AS not_dicom, count(*) FILTER (outcome = 'skipped' AND NOT early) AS dicomdir, count(*) FILTER (outcome = 'failed') AS failed FROM r""",
    "file_summary": f"""
WITH {_LINES} SELECT file, count(*) + 1 AS fields, count(*) FILTER (kind = 'annex-e') AS annex_e, count(*) FILTER (kind = 'private') AS private, count(*) FILTER (kind = 'burned-in') AS burned_in, count(*) FILTER (kind <> 'burned-in') AS identifying FROM a GROUP BY file""",
    "headline": f"""
WITH c AS ({_ALL}), {_LINES}, d AS (SELECT DISTINCT check_no, kind, scope, study, series, path, item FROM c),
n AS (SELECT (SELECT count(*) FROM l) AS files, (SELECT count(DISTINCT (study, series)) FROM l) AS series, (SELECT count(DISTINCT path) FROM a WHERE kind <> 'burned-in') AS fields,
             (SELECT count(*) FROM d WHERE kind IN ('varying-value', 'extra-field')) AS nc, (SELECT count(*) FROM d WHERE kind NOT IN ('varying-value', 'extra-field')) AS st)
SELECT 1 AS line_no, files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END || ' read across ' || series || ' series' AS text FROM n
UNION ALL SELECT 2, fields || CASE WHEN fields = 1 THEN ' field' ELSE ' fields' END || ' could identify a patient' FROM n
UNION ALL SELECT 3, nc || ' identifying field' || CASE WHEN nc = 1 THEN ' is' ELSE 's are' END || ' not the same on every file' FROM n WHERE nc > 0
UNION ALL SELECT 4, st || ' structural inconsistenc' || CASE WHEN st = 1 THEN 'y' ELSE 'ies' END || ' between files' FROM n WHERE st > 0""",
    "folder_name": """
WITH r AS (SELECT o_orderpriority < '3' AS low, CASE WHEN o_orderpriority < '3' THEN 'study' ELSE o_orderstatus END AS root FROM orders)
SELECT CASE WHEN low THEN 'low' ELSE 'high' END AS part, CASE WHEN count(DISTINCT root) = 1 AND count(root) = count(*) THEN min(root) END AS folder FROM r GROUP BY low""",
    "diff_findings": """
WITH e AS (SELECT l_orderkey, l_returnflag AS kind FROM lineitem WHERE l_quantity > 10), g AS (SELECT l_orderkey, l_returnflag AS kind FROM lineitem WHERE l_quantity < 40)
SELECT *, 'missing' AS side FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM g) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM e)""",
    "voi_window": f"""
WITH r AS (SELECT {_IDS}, l_returnflag, CASE WHEN l_extendedprice <= 29999.5::DOUBLE - 39999 / 2.0::DOUBLE THEN 0 WHEN l_extendedprice > 29999.5::DOUBLE + 39999 / 2.0::DOUBLE THEN 255
           ELSE floor(((l_extendedprice - 29999.5::DOUBLE) / 39999.0::DOUBLE + 0.5::DOUBLE) * 255 + 0.5::DOUBLE) END::INT AS y FROM lineitem)
SELECT {_IDS}, CASE WHEN l_returnflag = 'A' THEN 255 - y ELSE y END AS grey FROM r""",
    "stored_value": f"""
WITH r AS (SELECT {_IDS}, l_returnflag, (l_partkey >> 2) & 255 AS raw FROM lineitem) SELECT {_IDS}, CASE WHEN l_returnflag = 'A' AND raw >= 128 THEN raw - 256 ELSE raw END AS stored FROM r""",
    "frame_range": """
WITH r AS (SELECT l_orderkey, l_partkey % 4096 AS w FROM lineitem), x AS (SELECT l_orderkey, w, (CASE WHEN w >= 2048 THEN w - 4096 ELSE w END) * 2.0::DOUBLE - 1024.0::DOUBLE AS v FROM r),
m AS (SELECT *, min(v) OVER (PARTITION BY l_orderkey) AS lo, max(v) OVER (PARTITION BY l_orderkey) AS hi FROM x),
u AS (SELECT *, (lo + hi) / 2 AS c, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE hi - lo END AS wd FROM m),
g AS (SELECT *, CASE WHEN v <= c - 0.5::DOUBLE - (wd - 1) / 2 THEN 0 WHEN v > c - 0.5::DOUBLE + (wd - 1) / 2 THEN 255 ELSE floor(((v - (c - 0.5::DOUBLE)) / (wd - 1) + 0.5::DOUBLE) * 255 + 0.5::DOUBLE)::INT END AS y FROM u)
SELECT l_orderkey, any_value(c) AS used_center, any_value(wd) AS used_width, string_agg(y::VARCHAR, ',' ORDER BY w) AS grey FROM g GROUP BY l_orderkey""",
    "decodability": f"""
WITH r AS (SELECT o_orderkey, o_orderkey AS k, o_custkey AS q, ({_SYNTAXES})[o_orderkey % 5 + 1] AS syntax, ([NULL, 1, 3])[o_custkey % 3 + 1] AS samples, (['MONOCHROME1', 'RGB', 'YBR_FULL', 'PALETTE COLOR', 'MONOCHROME2', NULL])[(o_orderkey + o_custkey) % 6 + 1] AS form,
                  ([NULL, 0, 1, 0])[o_custkey % 4 + 1] AS planar, ([NULL, 1, 4])[o_orderkey % 3 + 1] AS frames FROM orders),
s AS (SELECT o_orderkey, CASE k % 5 WHEN 0 THEN 'native' WHEN 1 THEN 'native' WHEN 2 THEN 'rle' WHEN 3 THEN 'jpeg' END AS kind, CASE k % 5 WHEN 0 THEN 'Implicit VR Little Endian' WHEN 1 THEN 'Explicit VR Little Endian' WHEN 2 THEN 'RLE Lossless' ELSE 'an unrecognised transfer syntax' END AS syntax_name,
             coalesce(samples, 1) AS samples, coalesce(form, '') AS form, coalesce(planar, 0) AS planar, coalesce(frames, 1) AS frames, q % 17 > 0 AS has_rows, q % 19 > 0 AS has_bits, k % 13 > 0 AS sixteen, k % 7 > 0 AS has_pixels,
             (k % 5 >= 2) <> (q % 11 = 0) AS enc, q % 5 AS fragments, q % 2 * 4 AS offsets FROM r),
t AS (SELECT *, enc AND frames > 1 AND NOT CASE WHEN offsets > 0 THEN TRUE ELSE fragments = frames END AS open, (samples = 1 AND form IN ('MONOCHROME1', 'MONOCHROME2')) OR (samples = 3 AND form = 'RGB') AS good FROM s),
v AS (SELECT o_orderkey, syntax_name, CASE WHEN kind IS NULL THEN 'unsupported-syntax|the transfer syntax is not supported' WHEN NOT has_pixels THEN 'no-pixel-data|there is no pixel data' WHEN (kind <> 'native') <> enc THEN 'defect|transfer syntax and element encoding disagree'
       WHEN form = 'PALETTE COLOR' THEN 'unsupported-format|palette colour' WHEN kind <> 'jpeg' AND form LIKE 'YBR%' THEN 'unsupported-format|YBR samples' WHEN kind <> 'jpeg' AND samples = 3 AND form = 'RGB' AND planar <> 0 THEN 'unsupported-format|colour planes'
       WHEN kind = 'jpeg' AND open THEN 'unsupported-format|frame boundaries cannot be resolved' WHEN kind = 'jpeg' AND form = '' THEN 'defect|samples and photometric form do not go together' WHEN kind = 'jpeg' AND NOT has_rows THEN 'defect|missing attributes'
       WHEN kind <> 'jpeg' AND NOT (has_rows AND has_bits) THEN 'defect|missing attributes' WHEN kind <> 'jpeg' AND NOT sixteen THEN 'defect|bits allocated are neither 8 nor 16' WHEN kind <> 'jpeg' AND NOT good THEN 'defect|samples and photometric form do not go together'
       WHEN kind <> 'jpeg' AND open THEN 'unsupported-format|frame boundaries cannot be resolved' ELSE 'ok|' END AS x FROM t)
SELECT o_orderkey, syntax_name, split_part(x, '|', 1) AS decodability, nullif(split_part(x, '|', 2), '') AS problem FROM v""",
    "fragments_to_frames": """
WITH f AS (SELECT l_orderkey AS k, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT k::VARCHAR AS file, idx, CASE WHEN CASE k % 3 WHEN 0 THEN (n + 1) // 2 WHEN 1 THEN n ELSE n - 1 END <= 1 THEN 0 WHEN k % 3 = 0 THEN idx // 2 ELSE idx END AS frame FROM f
WHERE k % 3 < 2 OR n <= 2""",
    "offset_tables": """
WITH f AS (SELECT l_orderkey AS k, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY l_orderkey) AS n, coalesce(sum(l_partkey + 8) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
           FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
t AS (SELECT *, start + CASE WHEN k % 5 = 0 AND idx = k % 3 THEN 1 ELSE 0 END AS entry FROM f WHERE k % 2 = 0),
s AS (SELECT f.k, min(f.idx) AS first FROM f JOIN t ON t.k = f.k AND t.idx = 0 AND t.entry = f.start GROUP BY f.k),
e AS (SELECT f.k, max(f.idx) AS next FROM f JOIN t ON t.k = f.k AND t.idx = 1 AND t.entry = f.start GROUP BY f.k),
g AS (SELECT k, any_value(n) AS n FROM f GROUP BY k)
SELECT k::VARCHAR AS file, n AS fragments, CASE WHEN k % 2 = 0 THEN n ELSE 0 END AS offsets, CASE WHEN k % 2 = 0 THEN first IS NOT NULL AND (n = 1 OR coalesce(next > first, FALSE)) END AS offsets_match FROM g LEFT JOIN s USING (k) LEFT JOIN e USING (k)""",
}
