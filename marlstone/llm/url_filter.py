"""URL filters: host and path rules, and a tree of path templates (DataFrame operations only).

A path is shaped: long hexadecimal runs become {h} and numbers {n}. Urls are counted by
host and shape, with those that a rule decides as labels; the tree is grown on these counts,
a level for each segment, from the host down. At a node,
  a place that holds more than MAX_BRANCHES different segments is variable: segments with
  less than MIN_SHARE of its urls form one group, {*};
  other segments form groups of like shape: the kind of the segment (number, hexadecimal,
  word, empty) and the commonest sequence of kinds below it.
In each group statistically similar siblings merge. Those with MIN_LABELLED labels or more
are put in BINS by their share of blocked urls, and neighbouring bins stay together unless
their shares differ by more than GAP and Z standard errors. Siblings with fewer labels, or
none, join them where all labelled ones of the group are alike and at least MIN_SIBLINGS
of them have labels: then the shape decides and not the name. Else those without labels
are a branch of their own, and the rest stand by themselves. A template is a path through
merged branches; it is rejected if its smoothed share of blocked urls reaches PURITY and it
has MIN_LABELLED labels. Urls of other templates pass.

The tree has LEVELS levels; what a path has beyond them is one last segment. Null urls, and
urls without ://, have an empty host and path; rows are judged one by one, repeated ones alike.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

#: Rules (fixed values): verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_BRANCHES, MIN_SHARE, MIN_LABELLED, MIN_SIBLINGS, Z, GAP, PURITY, PRIOR_WEIGHT = 32, 0.05, 3, 3, 2.0, 0.1, 0.8, 2.0
BINS, LEVELS = 64, 8


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def decided(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), h + p, v) for v, h, p in order]
    none = F.lit(None).cast("string")
    return F.coalesce(*[F.when(f, name) for f, name, _ in fits], none), F.coalesce(*[F.when(f, v) for f, _, v in fits], none)


def shaped(part: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(part, r"[0-9a-f]{12,}", "{h}"), r"[0-9]+", "{n}")


def segments(shape: Column) -> Column:
    """The segments of a shaped path; the LEVELS-th holds all that follow."""
    parts = F.split(shape, "/", LEVELS + 1)
    return F.slice(parts, 2, F.size(parts))


def kinds(segs: Column) -> Column:
    """A letter for each segment: e empty, n number, h hexadecimal, w any other."""
    return F.array_join(F.transform(segs, lambda s: F.when(s == "", "e").when(s == "{n}", "n").when(s.contains("{h}"), "h").otherwise("w")), "")


def _siblings(live: DataFrame, d: int) -> DataFrame:
    """node, seg, l, b, grp: the branches of level d, each with its group."""
    cells = live.select("node", F.col("segs")[d].alias("seg"), F.substring("kinds", d + 1, 1).alias("own"), F.substring("kinds", d + 2, LEVELS).alias("tail"), "n", "b", "l")
    cells = cells.groupBy("node", "seg", "own", "tail").agg(*[F.sum(c).alias(c) for c in "nbl"])
    one = cells.groupBy("node", "seg", "own").agg(*[F.sum(c).alias(c) for c in "nbl"], F.max(F.struct("n", "tail"))["tail"].alias("mode"))
    places = one.groupBy("node").agg(F.count(F.lit(1)).alias("branches"), F.sum("n").alias("urls"))
    rare = (F.col("branches") > MAX_BRANCHES) & (F.col("n") < MIN_SHARE * F.col("urls"))
    return one.join(places, "node").select("node", "seg", "b", "l", F.when(rare, "{*}").otherwise(F.concat("own", F.lit(":"), "mode")).alias("grp"))


def _branches(siblings: DataFrame) -> DataFrame:
    """node, seg, to: the merged branch of each segment. Bins keep the ordered part at BINS + 1 rows a group."""
    key = ["node", "grp"]
    bin_ = F.expr(f"(b * {BINS}) div l")
    rows = siblings.withColumn("bin", F.when(F.col("l") >= MIN_LABELLED, bin_))
    bins = rows.where("bin is not null").groupBy(*key, "bin").agg(F.sum("b").alias("b"), F.sum("l").alias("l"))
    order = Window.partitionBy(*key).orderBy("bin")
    bins = bins.withColumn("b0", F.lag("b").over(order)).withColumn("l0", F.lag("l").over(order))
    pooled = (F.col("b") + F.col("b0")) / (F.col("l") + F.col("l0"))
    error = F.sqrt(F.greatest(pooled * (1 - pooled) * (1 / F.col("l") + 1 / F.col("l0")), F.lit(0.0)))
    apart = F.when(F.col("b0").isNull(), 0).when(F.col("b") / F.col("l") - F.col("b0") / F.col("l0") > F.greatest(F.lit(GAP), Z * error), 1).otherwise(0)
    bins = bins.select(*key, "bin", F.sum(apart).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    alike = rows.groupBy(*key).agg(F.count(F.when(F.col("l") > 0, 1)).alias("some")).join(bins.groupBy(*key).agg(F.max("c").alias("last")), key, "left")
    alike = alike.select(*key, ((F.col("some") >= MIN_SIBLINGS) & (F.coalesce("last", F.lit(0)) == 0)).alias("alike"))
    rows = rows.join(alike, key).join(bins, [*key, "bin"], "left")
    cluster = F.coalesce("c", F.when(F.col("alike"), 0).when(F.col("l") == 0, -1))
    return rows.select("node", "seg", F.coalesce(F.concat("node", F.lit("/"), "grp", F.lit("#"), cluster.cast("string")), F.concat("node", F.lit("/="), "seg")).alias("to"))


def templates(pages: DataFrame) -> DataFrame:
    """host, shape, node, b, l: the template of each shape, and its shape's labels. pages: host, shape, verdict (null: not labelled)."""
    counts = pages.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b"), F.count("verdict").alias("l"))
    counts = counts.withColumn("node", F.col("host")).withColumn("segs", segments(F.col("shape"))).withColumn("kinds", kinds(F.col("segs")))
    counts = stage(counts, "url-counts")
    deepest = counts.agg(F.max(F.size("segs"))).collect()[0][0] or 0  # one number, LEVELS at most
    for d in range(deepest):
        longer = F.size("segs") > d
        branch = _branches(stage(_siblings(counts.where(longer), d), "url-siblings"))
        # An ended path has a null segment and so keeps its node.
        moved = counts.withColumn("seg", F.get("segs", F.lit(d))).join(branch, ["node", "seg"], "left")
        counts = stage(moved.select("host", "shape", F.coalesce("to", "node").alias("node"), "n", "b", "l", "segs", "kinds"), "url-level")
    return counts.select("host", "shape", "node", "b", "l")


def rejected_shapes(pages: DataFrame) -> DataFrame:
    """host, shape of the shapes whose template is rejected. pages as for templates()."""
    held = templates(pages)
    prior = held.agg(((F.coalesce(F.sum("b"), F.lit(0)) + 1) / (F.coalesce(F.sum("l"), F.lit(0)) + 2)).alias("prior")).collect()[0]["prior"]  # one number
    whole = held.groupBy("node").agg(F.sum("b").alias("b"), F.sum("l").alias("l"))
    bad = whole.where((F.col("l") >= MIN_LABELLED) & ((F.col("b") + PRIOR_WEIGHT * prior) / (F.col("l") + PRIOR_WEIGHT) >= PURITY))
    return held.join(bad.select("node"), "node", "left_semi").select("host", "shape")


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row: id, host, path, rule, verdict."""
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), shaped(F.col("path")).alias("shape"))
    bad = rejected_shapes(rows.select("host", "shape", "verdict")).withColumn("bad", F.lit("block"))
    out = rows.join(bad, ["host", "shape"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "bad", F.lit("allow")).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))


def _sql() -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fit = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{pick(v, h, p)}'" for v, h, p in order) + " END"
    shape = "regexp_replace(regexp_replace(path, '[0-9a-f]{12,}', '{h}', 'g'), '[0-9]+', '{n}', 'g')"

    def level(d: int) -> str:
        own, last = f"segs[{d}]", f"k{d - 1}"
        return f"""
c{d} AS (SELECT node, {own} AS seg, kinds[{d}] AS own, kinds[{d + 1}:] AS tail, sum(n) AS n, sum(b) AS b, sum(l) AS l FROM {last} WHERE len(segs) >= {d} GROUP BY ALL),
o{d} AS (SELECT node, seg, own, sum(n) AS n, sum(b) AS b, sum(l) AS l, max({{'n': n, 't': tail}}).t AS mode FROM c{d} GROUP BY ALL),
p{d} AS (SELECT node, count(*) AS branches, sum(n) AS urls FROM o{d} GROUP BY ALL),
s{d} AS MATERIALIZED (SELECT node, seg, b, l, CASE WHEN branches > {MAX_BRANCHES} AND n < {MIN_SHARE} * urls THEN '{{*}}' ELSE own || ':' || mode END AS grp, CASE WHEN l >= {MIN_LABELLED} THEN b * {BINS} // l END AS bin FROM o{d} JOIN p{d} USING (node)),
a{d} AS (SELECT node, grp, bin, sum(b) AS b, sum(l) AS l FROM s{d} WHERE bin IS NOT NULL GROUP BY ALL),
g{d} AS (SELECT *, lag(b) OVER w AS b0, lag(l) OVER w AS l0 FROM a{d} WINDOW w AS (PARTITION BY node, grp ORDER BY bin)),
q{d} AS (SELECT node, grp, bin, sum(CASE WHEN b0 IS NOT NULL AND b / l - b0 / l0 > greatest({GAP}, {Z} * sqrt(greatest((b + b0) / (l + l0) * (1 - (b + b0) / (l + l0)) * (1 / l + 1 / l0), 0))) THEN 1 ELSE 0 END) OVER (PARTITION BY node, grp ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c FROM g{d}),
m{d} AS (SELECT node, grp, count(*) FILTER (l > 0) >= {MIN_SIBLINGS} AS enough FROM s{d} GROUP BY ALL),
n{d} AS (SELECT m{d}.node, m{d}.grp, enough AND coalesce(top, 0) = 0 AS alike FROM m{d} LEFT JOIN (SELECT node, grp, max(c) AS top FROM q{d} GROUP BY ALL) t ON t.node = m{d}.node AND t.grp = m{d}.grp),
b{d} AS (SELECT s.node, s.seg, coalesce(s.node || '/' || s.grp || '#' || CAST(coalesce(c, CASE WHEN alike THEN 0 WHEN l = 0 THEN -1 END) AS VARCHAR), s.node || '/=' || s.seg) AS dest FROM s{d} s JOIN n{d} n ON n.node = s.node AND n.grp = s.grp LEFT JOIN q{d} q ON q.node = s.node AND q.grp = s.grp AND q.bin = s.bin),
k{d} AS MATERIALIZED (SELECT x.* REPLACE (coalesce(dest, x.node) AS node) FROM {last} x LEFT JOIN b{d} ON b{d}.node = x.node AND b{d}.seg = x.{own})"""

    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS MATERIALIZED (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS said, {shape} AS shape FROM u),
k AS (SELECT host, shape, count(*) AS n, count(*) FILTER (said = 'block') AS b, count(said) AS l FROM r GROUP BY ALL),
parts AS (SELECT *, string_split(shape, '/')[2:] AS p FROM k),
cut AS (SELECT *, CASE WHEN len(p) > {LEVELS} THEN list_append(p[1:{LEVELS - 1}], array_to_string(p[{LEVELS}:], '/')) ELSE p END AS segs FROM parts),
k0 AS MATERIALIZED (SELECT host, shape, n, b, l, host AS node, segs, array_to_string([CASE WHEN s = '' THEN 'e' WHEN s = '{{n}}' THEN 'n' WHEN contains(s, '{{h}}') THEN 'h' ELSE 'w' END FOR s IN segs], '') AS kinds FROM cut),
{",".join(level(d) for d in range(1, LEVELS + 1))},
t AS (SELECT node, sum(b) AS b, sum(l) AS l FROM k{LEVELS} GROUP BY ALL),
bad AS (SELECT node FROM t WHERE l >= {MIN_LABELLED} AND (b + {PRIOR_WEIGHT} * (SELECT (sum(b) + 1) / (sum(l) + 2) FROM k0)) / (l + {PRIOR_WEIGHT}) >= {PURITY}),
x AS (SELECT host, shape, 1 AS hit FROM k{LEVELS} SEMI JOIN bad USING (node))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN hit = 1 THEN 'block' END, 'allow') AS verdict FROM r LEFT JOIN x USING (host, shape)
"""


SQL = _sql()
