"""URL filter: fixed host rules first, then a tree of path templates learnt from labelled pages.

The tree is built level by level. At every level, below (host, template so far):

* variable segments become wildcards: digit runs are `{n}` and long hexadecimal runs `{x}`; of the
  other segments, those seen in less than one of RARE of the parent's pages become `*` where the
  parent has more than WIDE different ones, unless the share of bad pages differs from that of the
  rest of these by more than chance;
* branches that are statistically alike merge into `~`: a branch keeps its name only where the share
  of bad pages below it differs from that of its siblings by more than chance (two-proportion test);
* levels go on until paths end or no place is left with good and bad labelled pages below it, where
  nothing could keep its name: what follows is `~` at every level.

A page is blocked where the smoothed purity of its template, (good + GOOD_PRIOR) / (labelled +
GOOD_PRIOR + BAD_PRIOR), is below MIN_PURITY. A template without labels is allowed.

Only DataFrame functions run. Pages are first summed to distinct shapes (host and generalised
segments), so a host with a third of all pages costs map-side sums; the tree works on shapes alone.

A null URL, or one without `://`, has an empty host and path and is judged like any other shape.
Repeated rows and null ids are judged row by row. Labels are (key, bad) rows; a null key labels nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.shared import LOWER, UPPER, settled

# Fixed rules: (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LEVELS = 4  # of the SQL counterpart, which ends there
WIDE, RARE = 20, 50
ALIKE = 3.84
GOOD_PRIOR, BAD_PRIOR = 4, 1
MIN_PURITY = 0.6

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def located(pages: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, host, path) of every page."""
    url = F.coalesce(F.col(url_column), F.lit(""))
    return pages.select(
        F.col(id_column).alias("id"),
        F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, _PARTS, 2).alias("path"),
    )


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action; both null where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, site, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(site + start)).otherwise(rule)
        action = F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def shapes(places: DataFrame) -> DataFrame:
    """The column segments: those of the path, with digit and hexadecimal runs generalised."""
    part = lambda x: F.regexp_replace(F.regexp_replace(x, "[0-9a-fA-F]{16,}", "{x}"), "[0-9]+", "{n}")
    return places.withColumn("segments", F.transform(F.array_remove(F.split("path", "/"), ""), part))


def templates(counted: DataFrame) -> DataFrame:
    """Shapes (host, segments, n, labelled, bad) with the template of each, from the root down."""
    above, own = ["host", "template"], ["host", "segments", "n", "labelled", "bad", "template"]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    tree, level, ended = counted.withColumn("template", F.lit("")), 0, []
    while True:
        parents = tree.groupBy(*above).agg(F.sum("n").alias("whole"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        # every level is read several times, so it is written down: the plan would grow with each level
        tree = settled(tree.join(parents, above))
        both = (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_labelled"))
        rest = F.repeat(F.lit("/~"), F.size("segments") - level)
        ended.append(tree.filter(~both).withColumn("template", F.concat("template", rest)).select(*own))
        tree = tree.filter(both).withColumn("name", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
        if tree.isEmpty():
            return reduce(DataFrame.union, ended)
        branches = settled(tree.groupBy(*above, "name", "whole", "all_labelled", "all_bad").agg(*sums))
        kinds = branches.groupBy(*above).agg(F.count("*").alias("kinds"))
        rare = (F.col("kinds") > WIDE) & (F.col("n") * RARE < F.col("whole")) & ~F.col("name").contains("{") & (F.col("name") != "")
        branches = branches.join(kinds, above).withColumn("rare", rare)
        folded = branches.filter("rare").groupBy(*above).agg(F.sum("labelled").alias("rare_labelled"), F.sum("bad").alias("rare_bad"))
        folds = F.col("rare") & ~F.coalesce(_differs("rare_labelled", "rare_bad"), F.lit(False))
        branches = settled(branches.join(folded, above, "left").withColumn("t", F.when(folds, F.lit("*")).otherwise(F.col("name"))))
        grown = branches.groupBy(*above, "t", "all_labelled", "all_bad").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        named = grown.withColumn("own", _differs("all_labelled", "all_bad")).select(*above, "t", "own")
        place = branches.select(*above, "name", "t").join(named, [*above, "t"])
        place = place.select(*above, "name", F.when(F.col("own") | (F.col("t") == ""), F.col("t")).otherwise(F.lit("~")).alias("t"))
        tree = tree.join(place, [*above, "name"])
        ended.append(tree.filter("name = ''").select(*own))
        tree = tree.filter("name <> ''").withColumn("template", F.concat("template", F.lit("/"), "t")).select(*own)
        level += 1


def _differs(labelled: str, bad: str) -> Column:
    """Whether a branch's share of bad pages differs from its siblings', given the sums of all of them.

    With b of n bad here, c of m bad in the siblings, N = n + m and B = b + c:
    (b*m - c*n)^2 * N > ALIKE * n*m * B*(N-B), the two-proportion test without its divisions.
    """
    n, b, whole, worse = (F.col(c).cast("double") for c in ("labelled", "bad", labelled, bad))
    m, c = whole - n, worse - b
    gap = b * m - c * n
    return gap * gap * whole > F.lit(ALIKE).cast("double") * n * m * worse * (whole - worse)


def judged(
    pages: DataFrame, labels: DataFrame, key: Column, id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """(id, host, path, rule, template, purity, verdict) of every page.

    `labels` has (key, bad) with bad 0 or 1; `key` is computed from a page's `path` and finds its label.
    """
    places = located(pages, id_column, url_column)
    known = labels.select("key", "bad").filter("key IS NOT NULL").groupBy("key").agg(F.max("bad").cast("bigint").alias("bad"))
    shaped = shapes(places)
    marked = shaped.withColumn("key", key).join(known, "key", "left")
    counted = marked.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    tree = settled(templates(counted))
    pure = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    purity = (F.col("labelled") - F.col("bad") + GOOD_PRIOR) / (F.col("labelled") + GOOD_PRIOR + BAD_PRIOR)
    pure = pure.withColumn("purity", purity.cast("double"))
    found = tree.select("host", "segments", "template").join(pure.select("host", "template", "purity"), ["host", "template"])
    rule, action = fixed_rule(F.col("host"), F.col("path"))
    own = F.when(F.col("purity") < MIN_PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return shaped.join(found, ["host", "segments"]).select(
        "id", "host", "path", rule.alias("rule"), "template", "purity", F.coalesce(action, own).alias("verdict")
    )
