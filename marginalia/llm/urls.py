"""URL filters: explicit rules first, then a tree of path templates per host.

A rule (host/path) fits its host and all subdomains if the path of the url starts with the
rule's path; the longest fitting rule decides. Other urls get the verdict of their template.

Templates: digits in a segment become ``{n}``. Then, level by level from the host down and as deep as MIN_URLS urls share a
node, the children of a node that hold fewer than MIN_URLS urls become the wildcard ``*``; all others stay literal. Branches
of one node whose labelled purity doesn't differ by a two-proportion z-test are merged, and their subtrees with them: in order of
purity, by bins of 1 / BINS, a bin joins the group before it unless it differs from the group's pooled counts by Z or more. A merged
branch has the name of its first member. Nodes with fewer urls end in ``**``. A template's purity is smoothed
towards its host's, and a host's towards that of all urls; a template below MIN_PURITY is blocked.

All steps are DataFrame aggregations over (host, node, segment) of distinct paths, so a hot host is combined
before it is shuffled, and what is gathered by node has BINS + 1 entries at most.

Nulls and ties: a null url, or one without ``://``, has an empty host and path and belongs to the
template of these. A null label is no label; repeated rows count as often as they stand there. Very long urls are taken
whole. Columns that aren't kept may have any names; kept ones must not have those of the result. With no labels at all every
purity is 1 and every url without a rule is allowed. Empty tables give empty results.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_table, written

MIN_URLS, BINS, Z, WEIGHT, MIN_PURITY = 20, 64, 1.96, 4.0, 0.7
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: str) -> Column:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), PARTS, 2)


def rule_of(rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. rules: (verdict, host/path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):  # longer ones stand outside
        at, _, rest = rule.partition("/")
        fits = ((F.col(host) == at) | F.endswith(F.col(host), F.lit("." + at))) & F.startswith(F.col(path), F.lit("/" + rest))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def masked(path: str = "path") -> Column:
    return F.regexp_replace(F.substring(F.col(path), 2, 1 << 30), r"[0-9]+", "{n}")


def host_priors(paths: DataFrame) -> DataFrame:
    """host, prior: a host's share of good labels, smoothed towards that of all."""
    total = paths.agg(F.sum("n_labelled").alias("n"), F.sum("n_good").alias("g")).first()
    overall = float(total["g"] / total["n"]) if total["n"] else 1.0
    hosts = paths.groupBy("host").agg(F.sum("n_labelled").alias("n"), F.sum("n_good").alias("g"))
    return hosts.select("host", ((F.col("g") + F.lit(WEIGHT * overall)) / (F.col("n") + F.lit(WEIGHT))).alias("prior"))


def purity(good: Column, labelled: Column, prior: Column) -> Column:
    return (good + prior * WEIGHT) / (labelled + F.lit(WEIGHT))


def merged(branches: DataFrame) -> DataFrame:
    """host, node, bin, group: bins of purity of a node's branches (host, node, prior, n_labelled, n_good, bin), those that don't differ in one group."""
    bins = branches.groupBy("host", "node", "bin").agg(F.max("prior").alias("prior"), F.sum("n_labelled").alias("n"), F.sum("n_good").alias("g"))
    lists = bins.groupBy("host", "node").agg(F.max("prior").alias("prior"), F.sort_array(F.collect_list(F.struct("bin", "n", "g"))).alias("bins"))
    prior, weight = F.col("prior"), F.lit(WEIGHT)

    def add(group: Column, x: Column) -> Column:
        seen, own = group["n"] + weight, x["n"] + weight
        p, q = purity(group["g"], group["n"], prior), purity(x["g"], x["n"], prior)
        mean = (p * seen + q * own) / (seen + own)
        spread = F.sqrt(F.greatest(mean * (1 - mean), F.lit(1e-9)) * (1 / seen + 1 / own))
        new = (F.size(group["bins"]) > 0) & ((q - p) / spread >= Z)
        number = group["number"] + new.cast("int")
        listed = F.concat(group["bins"], F.array(F.struct(x["bin"].alias("bin"), number.alias("group"))))
        return F.struct(F.when(new, x["n"]).otherwise(group["n"] + x["n"]).alias("n"), F.when(new, x["g"]).otherwise(group["g"] + x["g"]).alias("g"), number.alias("number"), listed.alias("bins"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("g"), F.lit(0).alias("number"), F.array().cast("array<struct<bin:int,group:int>>").alias("bins"))
    found = lists.select("host", "node", F.explode(F.aggregate("bins", none, add)["bins"]).alias("b"))
    return found.select("host", "node", "b.bin", "b.group")


def children(open_paths: DataFrame, priors: DataFrame) -> DataFrame:
    """host, node, segment, name: what each next segment of nodes with MIN_URLS urls or more is called in a template."""
    key = ["host", "node"]
    kids = open_paths.groupBy(*key, "segment").agg(*[F.sum(c).alias(c) for c in ("n_urls", "n_labelled", "n_good")])
    kids = written(kids, "url-kids")
    nodes = kids.groupBy(*key).agg(F.sum("n_urls").alias("all")).where(F.col("all") >= MIN_URLS)
    nodes = written(nodes.join(priors, "host").select(*key, "prior"), "url-nodes")
    kids = join_table(kids, nodes, key, "inner").withColumn("branch", F.when(F.col("n_urls") >= MIN_URLS, F.col("segment")).otherwise("*"))
    branches = kids.groupBy(*key, "branch").agg(F.max("prior").alias("prior"), *[F.sum(c).alias(c) for c in ("n_labelled", "n_good")])
    share = purity(F.col("n_good"), F.col("n_labelled"), F.col("prior"))
    branches = written(branches.withColumn("bin", F.floor(share * BINS).cast("int")), "url-branches")
    branches = join_table(branches, written(merged(branches), "url-groups"), [*key, "bin"], "inner")
    names = written(branches.groupBy(*key, "group").agg(F.min("branch").alias("name")), "url-names")
    named = written(join_table(branches, names, [*key, "group"], "inner").select(*key, "branch", "name"), "url-named")
    return written(join_table(kids, named, [*key, "branch"], "inner").select(*key, "segment", "name"), "url-children")


def with_templates(paths: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds template to distinct paths (host, masked, n_urls, n_labelled, n_good)."""
    state = paths.withColumns({"parts": F.split("masked", "/"), "node": F.lit(""), "template": F.lit(None).cast("string")})
    level = 0
    while True:
        own = state.withColumn("segment", F.when(F.col("template").isNull(), F.get("parts", F.lit(level))))
        open_paths = own.where("segment is not null")
        names = children(open_paths.drop("parts", "template"), priors)
        joined = join_table(own, names, ["host", "node", "segment"])
        node = F.when(F.col("name").isNotNull(), F.concat("node", F.lit("/"), "name")).otherwise(F.col("node"))
        ended = F.col("name").isNotNull() & (F.size("parts") == level + 1)
        template = F.when(F.col("template").isNotNull(), F.col("template")).when(ended, node).when(F.col("name").isNull(), F.concat("node", F.lit("/**")))
        after = written(joined.withColumn("template", template).withColumn("node", node).drop("segment", "name"), "url-tree")
        if level:
            discard(state)
        state, level = after, level + 1
        if not state.where("template is null").limit(1).count():
            return state.drop("parts", "node")


def judged(paths: DataFrame, priors: DataFrame) -> DataFrame:
    """host, masked, template, purity, template_verdict of distinct paths with a template."""
    found = paths.groupBy("host", "template").agg(F.sum("n_labelled").alias("n"), F.sum("n_good").alias("g")).join(priors, "host")
    found = found.select("host", "template", purity(F.col("g"), F.col("n"), F.col("prior")).alias("purity"))
    verdict = F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow").alias("template_verdict")
    found = written(found.select("*", verdict), "url-verdicts")
    return join_table(paths, found, ["host", "template"], "inner").select("host", "masked", "template", "purity", "template_verdict")


def filter_urls(urls: DataFrame, rules: Sequence[tuple[str, str]], keep: Sequence[str], url: str = "url", good: str | None = None) -> DataFrame:
    """keep, host, path, template, purity, rule, verdict of every row. good: column with 1, 0 or null."""
    label = F.col(good).cast("int") if good else F.lit(None).cast("int")
    rows = urls.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"), label.alias("__good"))
    rows = rows.withColumn("masked", masked())
    paths = rows.groupBy("host", "masked").agg(F.count(F.lit(1)).alias("n_urls"), F.count("__good").alias("n_labelled"), F.coalesce(F.sum("__good"), F.lit(0)).alias("n_good"))
    paths = written(paths, "url-paths")
    priors = written(host_priors(paths), "url-hosts")
    verdicts = written(judged(with_templates(paths, priors), priors), "url-judged")
    rule, says = rule_of(rules)
    out = join_table(rows, verdicts, ["host", "masked"])
    return out.select(*keep, "host", "path", "template", "purity", rule.alias("rule"), F.coalesce(says, "template_verdict").alias("verdict"))
