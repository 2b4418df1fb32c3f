"""URL filters: host and path rules, and a path-template tree per host.

Only DataFrame functions are used. URLs are first reduced to (host, shape),
where a shape is the path with every run of digits as ``#``, and counted; the
tree is grown over that table, level by level: a segment stays literal only if
it has enough pages and its labelled purity differs from that of its siblings
by a two-proportion z-test; all other segments, variable or statistically
alike, merge into one wildcard branch. It grows until no path has a segment
left; a branch whose pages cannot differ any more gets the rest of its
wildcards at once. The templates at the leaves are judged
by their purity, smoothed towards their host's, which is smoothed towards that
of all pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, null_safe_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: then up to ``?``, ``#`` or the end. No ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules: [(length, rule, path, action)]) of the rules whose host is
    the host or a domain above it. ``rules``: rule like ``example.net/en/``
    (host, then path from the first slash), action."""
    named = rules.where(F.col("rule").isNotNull()).select(
        "rule", "action", F.regexp_extract("rule", r"^[^/]*", 0).alias("rule_host"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = hosts.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host"))
    return spread.join(named, "rule_host").groupBy("host").agg(
        F.collect_set(F.struct(F.length("rule").alias("length"), "rule", "path", "action")).alias("rules"))


def template_tree(shapes: DataFrame, *, min_pages: int = 8, min_labelled: int = 8, z: float = 2.576) -> DataFrame:
    """(host, shape, template) from (host, shape, pages, labelled, good)."""
    parts = F.filter(F.split("shape", "/", -1), lambda s: s != "")
    level = shapes.select("host", "shape", "pages", "labelled", "good", F.lit("").alias("template"), parts.alias("parts"))
    level = cut_lineage(level.withColumn("ended", F.size("parts") == 0), "url_tree")
    done, depth = [level.where("ended")], 0
    while not (level := level.where(~F.col("ended"))).isEmpty():
        depth += 1
        here = level.withColumn("segment", F.get("parts", F.lit(depth - 1)))
        branches = here.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "good")])
        branches = cut_lineage(branches, "url_branches")
        above = branches.groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"))
        both = branches.where((F.col("pages") >= min_pages) & (F.col("labelled") >= min_labelled) & (F.col("segment") != "#"))
        both = null_safe_join(both, above, ["host", "template"], "inner")
        others = F.col("all_labelled") - F.col("labelled")
        pooled = F.col("all_good") / F.col("all_labelled")
        spread = pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / others)
        apart = F.abs(F.col("good") / F.col("labelled") - (F.col("all_good") - F.col("good")) / others)
        # squares on both sides: no root, so SQL engines agree
        kept = both.where((others > 0) & (apart * apart > z * z * spread)).select("host", "template", "segment", F.lit(True).alias("literal"))
        here = null_safe_join(here, kept, ["host", "template", "segment"], "left")
        # too few labels, or all alike: neither this level nor a deeper one has a literal segment
        alike = (F.col("all_labelled") <= min_labelled) | (F.col("all_good") == 0) | (F.col("all_good") == F.col("all_labelled"))
        here = null_safe_join(here, above.select("host", "template", alike.alias("alike")), ["host", "template"], "inner")
        name = F.concat(F.lit("/"), F.when(F.col("literal"), F.col("segment")).otherwise(F.lit("*")))
        left = F.size("parts") - depth
        here = here.withColumn("template", F.concat("template", name, F.when(F.col("alike"), F.repeat(F.lit("/*"), left)).otherwise(F.lit(""))))
        level = cut_lineage(here.withColumn("ended", F.col("alike") | (left == 0)).drop("segment", "literal", "alike"), "url_tree")
        done.append(level.where("ended"))
    return reduce(DataFrame.unionByName, done).select("host", "shape", "template", "pages", "labelled", "good")


def template_verdicts(shapes: DataFrame, *, smoothing: float = 10.0, min_purity: float = 0.5, **tree) -> DataFrame:
    """(host, shape, template, purity, template_verdict): block if the share of
    good pages among a template's labelled ones, smoothed by ``smoothing``
    pages of its host's share, is below ``min_purity``. No label at all: 0.5
    everywhere."""
    leaves = cut_lineage(template_tree(shapes, **tree), "url_leaves")
    labelled, good = leaves.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    overall = good / labelled if labelled else 0.5
    templates = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    hosts = templates.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("good").alias("host_good"))
    base = (F.col("host_good") + F.lit(smoothing) * F.lit(overall)) / (F.col("host_labelled") + F.lit(smoothing))
    purity = (F.col("good") + F.lit(smoothing) * base) / (F.col("labelled") + F.lit(smoothing))
    judged = null_safe_join(templates, hosts, ["host"], "inner").select("host", "template", purity.alias("purity"))
    judged = judged.withColumn("template_verdict", F.when(F.col("purity") < min_purity, "block").otherwise("allow"))
    return null_safe_join(leaves.select("host", "shape", "template"), judged, ["host", "template"], "inner")


def judge_urls(df: DataFrame, id_col: str, url_col: str, rules: DataFrame, good: Column, **options) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) for every row.

    ``rules`` (rule, action) decide where one fits: its host or a subdomain,
    and the path starts with its path; the longest wins. Elsewhere the
    template's verdict holds. ``good`` is a label from ``df``'s columns: true,
    false, or null for pages without one. Null urls and those without ``://``
    have an empty host and path, form a template of their own and fit no rule.
    Repeated rows come out as often. Other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    pages = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), good.cast("boolean").alias("good"))
    pages = cut_lineage(pages.withColumn("shape", F.regexp_replace("path", "[0-9]+", "#")), "url_pages")
    shapes = pages.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.count("good").alias("labelled"),
                                                F.count_if("good").alias("good"))
    verdicts = null_safe_join(template_verdicts(shapes, **options), matching_rules(shapes, rules), ["host"], "left")
    both = null_safe_join(pages, verdicts, ["host", "shape"], "inner")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]) & (r["path"] != ""))
    best = F.array_max(fits)
    return both.withColumn("best", best).select(
        "id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.col("template_verdict")).alias("verdict"),
        "template", "purity")
