"""URL filters: host and path rules, and a path-template tree for urls that no rule fits (native).

Urls are grouped by host and path template. Digits and hexadecimal ids in a segment become placeholders;
where a level of a host's tree has many children, those whose share of labelled bad urls does not differ
significantly from that of all of them become a wildcard; then, from the deepest level up, branches whose
share does not differ from that of all their siblings are merged into a wildcard. A template whose smoothed
share of bad urls reaches the threshold is rejected. Labels come from the rules' own verdicts, or from a
table of labelled pages.

Rows are aggregated to (host, shape) first, so a host with a third of all urls is as many rows as it has
shapes. The tree has as many levels as the deepest path, ``max_levels`` at most; what lies deeper is one last
segment.

Defined results: a null url or one without '://' has an empty host and path, fits no rule and is judged
by the template of that empty host; rows that repeat are rows of their own; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Scheme, host and path; the host ends at the first of / ? # and the path at the first of ? #.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, PARTS, 1)), F.regexp_extract(url, PARTS, 2)


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. The rules are literals of the plan: a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def template(path: Column, max_levels: int) -> Column:
    """Segments of a path with placeholders; what lies deeper than ``max_levels`` is one last segment."""
    shaped = F.regexp_replace(F.regexp_replace(path, r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "{h}"), r"[0-9]+", "{n}")
    return F.split(F.regexp_replace(shaped, "^/", ""), "/", max_levels)


def _with_level(segments: Column, level: int, value: Column) -> Column:
    return F.transform(segments, lambda x, i: F.when(i == level, value).otherwise(x))


def _similar(bn: Column, bb: Column, fn: Column, fb: Column, z: float) -> Column:
    """Whether a branch's share of bad urls does not differ significantly from its family's."""
    share = (fb + 1) / (fn + 2)
    return F.abs((bb + share) / (bn + 1) - share) <= z * F.sqrt(share * (1 - share) / (bn + 1))


def template_tree(urls: DataFrame, max_children: int = 16, z: float = 1.96, strength: float = 4.0) -> DataFrame:
    """(host, shape, template, labelled, bad, purity) from (host, shape, is_bad): ``purity`` is the smoothed share of bad urls of a template."""
    tree = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("is_bad").alias("labelled"), F.sum(F.coalesce(F.col("is_bad").cast("int"), F.lit(0))).alias("bad"))
    tree = materialise(tree.withColumn("template", F.col("shape")), "templates")
    levels = tree.agg(F.max(F.size("shape"))).first()[0] or 0
    for level in range(levels):  # wildcards for the similar ones of many children
        deep = tree.filter(F.size("template") > level).select("host", F.slice("template", 1, level).alias("parent"), F.get("template", F.lit(level)).alias("child"), "labelled", "bad")
        kids = deep.groupBy("host", "parent", "child").agg(F.sum("labelled").alias("bn"), F.sum("bad").alias("bb"))
        wide = kids.groupBy("host", "parent").agg(F.count("*").alias("kids"), F.sum("bn").alias("fn"), F.sum("bb").alias("fb")).filter(F.col("kids") > max_children)
        starred = kids.join(wide, ["host", "parent"]).filter(_similar(F.col("bn"), F.col("bb"), F.col("fn"), F.col("fb"), z)).select("host", "parent", "child", F.lit(True).alias("starred"))
        placed = tree.withColumns({"parent": F.slice("template", 1, level), "child": F.get("template", F.lit(level))}).join(starred, ["host", "parent", "child"], "left")
        tree = placed.withColumn("template", F.when(F.col("starred"), _with_level(F.col("template"), level, F.lit("*"))).otherwise(F.col("template"))).drop("parent", "child", "starred")
        tree = materialise(tree, "templates")  # each level reads the table of the last one, not its whole plan
    for level in reversed(range(levels)):  # merge similar branches, deepest first
        family = _with_level(F.col("template"), level, F.lit("*"))
        branch = tree.filter(F.size("template") > level).groupBy("host", "template").agg(F.sum("labelled").alias("bn"), F.sum("bad").alias("bb")).withColumn("family", family)
        pooled = branch.groupBy("host", "family").agg(F.sum("bn").alias("fn"), F.sum("bb").alias("fb"))
        merged = branch.join(pooled, ["host", "family"]).filter(_similar(F.col("bn"), F.col("bb"), F.col("fn"), F.col("fb"), z)).select("host", "template", "family")
        tree = tree.join(merged, ["host", "template"], "left").withColumn("template", F.coalesce("family", "template")).drop("family")
        tree = materialise(tree, "templates")
    overall = tree.agg(((F.sum("bad") + 1) / (F.sum("labelled") + 2)).alias("overall"))
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("hn"), F.sum("bad").alias("hb")).crossJoin(overall)  # with one row
    prior = (F.col("hb") + strength * F.col("overall")) / (F.col("hn") + strength)
    templates = tree.groupBy("host", "template").agg(F.sum("labelled").alias("tn"), F.sum("bad").alias("tb")).join(hosts.select("host", prior.alias("prior")), "host")
    templates = templates.select("host", "template", "tn", "tb", ((F.col("tb") + strength * F.col("prior")) / (F.col("tn") + strength)).alias("purity"))
    return tree.select("host", "shape", "template").join(templates, ["host", "template"]).select("host", "shape", "template", F.col("tn").alias("labelled"), F.col("tb").alias("bad"), "purity")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None, threshold: float = 0.5, max_levels: int = 32, **tree_options) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), one row a page. ``labels``: optional (page_id, bad), one row a page at most."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "ruled": verdict, "shape": template(F.col("path"), max_levels)})
    if labels is None:
        labelled = parsed.withColumn("is_bad", F.col("ruled") == "block")
    else:
        labelled = parsed.join(labels.select(F.col("page_id").alias("labelled_id"), F.col("bad").cast("boolean").alias("is_bad")), F.col("page_id") == F.col("labelled_id"), "left").drop("labelled_id")
    tree = template_tree(labelled.select("host", "shape", "is_bad"), **tree_options)
    judged = parsed.join(tree, ["host", "shape"], "left")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.array_join("template", "/").alias("template"), F.round("purity", 9).alias("purity"),
    )


def query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql(levels: int = 12) -> str:
    """The query in SQL, for paths of so many levels at most."""
    rule, verdict = "NULL", "NULL"
    for action, text in sorted(RULES, key=lambda r: len(r[1])):
        name, slash, start = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{action}' ELSE {verdict} END"
    share = "((fb + 1) / (fn + 2)::DOUBLE)"
    similar = f"abs((bb + {share}) / (bn + 1) - {share}) <= 1.96::DOUBLE * sqrt({share} * (1 - {share}) / (bn + 1))"
    star = lambda k: f"list_concat(template[1:{k}], ['*'], template[{k + 2}:])"
    steps, last = [], "t"
    for k in range(levels):
        steps.append(f"""
k{k} AS (SELECT host, template[1:{k}] AS parent, template[{k + 1}] AS child, sum(labelled) AS bn, sum(bad) AS bb FROM {last} WHERE len(template) > {k} GROUP BY ALL),
f{k} AS (SELECT host, parent, count(*) AS kids, sum(bn) AS fn, sum(bb) AS fb FROM k{k} GROUP BY ALL),
s{k} AS (SELECT host, parent, child FROM k{k} JOIN f{k} USING (host, parent) WHERE kids > 16 AND {similar}),
t{k} AS MATERIALIZED (SELECT t.host, shape, labelled, bad, CASE WHEN s{k}.child IS NOT NULL THEN {star(k)} ELSE template END AS template
        FROM {last} t LEFT JOIN s{k} ON t.host = s{k}.host AND len(template) > {k} AND template[1:{k}] = s{k}.parent AND template[{k + 1}] = s{k}.child)""")
        last = f"t{k}"
    for k in reversed(range(levels)):
        steps.append(f"""
b{k} AS (SELECT host, template, {star(k)} AS family, sum(labelled) AS bn, sum(bad) AS bb FROM {last} WHERE len(template) > {k} GROUP BY ALL),
p{k} AS (SELECT host, family, sum(bn) AS fn, sum(bb) AS fb FROM b{k} GROUP BY ALL),
m{k} AS (SELECT host, template, family FROM b{k} JOIN p{k} USING (host, family) WHERE {similar}),
u{k} AS MATERIALIZED (SELECT t.host, shape, labelled, bad, coalesce(family, t.template) AS template FROM {last} t LEFT JOIN m{k} m ON t.host = m.host AND t.template = m.template)""")
        last = f"u{k}"
    return rf"""
WITH a AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS ruled,
             string_split(regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all(path, '[0-9A-Za-z]+|[^0-9A-Za-z]+'),
               lambda x: CASE WHEN regexp_full_match(x, '[0-9a-fA-F]{{8,}}') AND regexp_matches(x, '[0-9]') THEN '{{h}}' ELSE x END), ''), '[0-9]+', '{{n}}', 'g'), '^/', ''), '/') AS shape FROM a),
t AS (SELECT host, shape, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS bad, shape AS template FROM r GROUP BY host, shape),{",".join(steps)},
o AS (SELECT (sum(bad) + 1) / (sum(labelled) + 2)::DOUBLE AS overall FROM {last}),
h AS (SELECT host, (sum(bad) + 4.0::DOUBLE * any_value(overall)) / (sum(labelled) + 4.0::DOUBLE) AS prior FROM {last}, o GROUP BY host),
g AS (SELECT host, template, (sum(bad) + 4.0::DOUBLE * any_value(prior)) / (sum(labelled) + 4.0::DOUBLE) AS purity FROM {last} JOIN h USING (host) GROUP BY host, template)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, array_to_string(template, '/') AS template, round(purity, 9) AS purity
FROM r JOIN {last} USING (host, shape) JOIN g USING (host, template)"""


ORACLE = _sql()
