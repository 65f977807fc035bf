"""URL filter: per-host tree of path templates, and host/path rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.sources.tables import materialise

WILDCARD = "*"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are (host, path, verdict) and few."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def segment_shapes(path: Column, deepest: int = 8) -> Column:
    """Segments of a path with what always varies generalised: runs of digits to ``0``, long hexadecimal to ``f``.

    What lies deeper than ``deepest`` segments is one last segment.
    """
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    shapes = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), r"[0-9a-f]{8,}", "f"), r"[0-9]+", "0"))
    tail = F.array_join(F.slice(shapes, deepest, F.greatest(F.size(shapes), F.lit(1))), "/")
    return F.when(F.size(shapes) <= deepest, shapes).otherwise(F.concat(F.slice(shapes, 1, deepest - 1), F.array(tail)))


def alike_siblings(children: DataFrame, node: list[str], alike: float, z: float = 1.96) -> DataFrame:
    """(node, child, branch): siblings that neither look nor are labelled differently share a branch.

    ``children`` has few rows a node: child, purity, and of its pages the number n, the bad, the good, those that end there, and
    those that go on with a number. In order of purity a child joins the branch before it while, for each of these four shares of
    n, the Wilson intervals (``z`` deviations) of all members have a point in common, and purities differ by ``alike`` at most. So
    a branch without labels joins a labelled one that looks like it only where it is small enough to have none by chance. A
    branch of several is named by them, as in ``?(de|fr)``; no segment has a ``?``.
    """
    counts = [F.col(c).cast("double") for c in ("bad", "good", "ends", "numbers")]
    n = F.col("n").cast("double")
    centres = [(x + z * z / 2) / (n + z * z) for x in counts]
    reaches = [F.sqrt(x * (n - x) / n + z * z / 4) * z / (n + z * z) for x in counts]
    lows, highs = (F.array(*(c + sign * r for c, r in zip(centres, reaches, strict=True))) for sign in (-1, 1))
    row = F.struct("purity", "child", lows.alias("lows"), highs.alias("highs"))
    told, widest = "array<struct<child:string,step:int>>", [F.array(*[F.lit(v)] * len(counts)) for v in (0.0, 1.0)]
    start = F.struct(F.lit(0).alias("step"), F.lit(0.0).alias("first"), widest[0].alias("lows"), widest[1].alias("highs"), F.array().cast(told).alias("told"))

    def join(so_far: Column, c: Column) -> Column:
        lows, highs = F.zip_with(so_far["lows"], c["lows"], lambda a, b: F.greatest(a, b)), F.zip_with(so_far["highs"], c["highs"], lambda a, b: F.least(a, b))
        stays = (so_far["step"] > 0) & (c["purity"] - so_far["first"] <= alike) & F.forall(F.zip_with(lows, highs, lambda a, b: a <= b), lambda x: x)
        step = F.when(stays, so_far["step"]).otherwise(so_far["step"] + 1)
        first, lows, highs = (F.when(stays, same).otherwise(c[new]) for same, new in ((so_far["first"], "purity"), (lows, "lows"), (highs, "highs")))
        now = F.array(F.struct(c["child"].alias("child"), step.alias("step"))).cast(told)
        return F.struct(step.alias("step"), first.alias("first"), lows.alias("lows"), highs.alias("highs"), F.concat(so_far["told"], now).alias("told"))

    steps = children.groupBy(*node).agg(F.aggregate(F.array_sort(F.collect_list(row)), start, join)["told"].alias("told"))
    members = F.array_sort(F.transform(F.filter("told", lambda t: t["step"] == F.col("c.step")), lambda t: t["child"]))
    several = F.concat(F.lit("?("), F.array_join("members", "|"), F.lit(")"))
    named = steps.select(*node, "told", F.explode("told").alias("c")).select(*node, "c.child", members.alias("members"))
    return named.select(*node, "child", F.when(F.size("members") == 1, F.col("child")).otherwise(several).alias("branch"))


def template_verdicts(paths: DataFrame, *, max_children: int = 24, alike: float = 0.15, prior: float = 4.0, silent: float = 0.25, reject_at: float = 0.5, min_bad: int = 2) -> DataFrame:
    """The tree over (host, shape, n, bad, good): (host, shape, template, purity, labels, rejected).

    ``shape`` is an array of segments; ``n`` counts pages, ``bad`` and ``good`` those labelled
    so. Level by level, a node's children become one wildcard if they are more than
    ``max_children``; else those merge into one branch that look alike and are labelled alike (see
    :func:`alike_siblings`). A template's purity is its share of bad labels, which holds for all its pages, labelled or not. A page without
    a label counts as ``silent`` good ones, since what nobody marked is mostly fine, and ``prior`` labels of its parent's purity
    smooth it, and so up to the host, whose own parent is the share over all hosts; the paths that end at a node others go on from are a
    template beside theirs. A template is rejected from purity ``reject_at`` on if it has ``min_bad`` bad labels.
    Counts are summed per node before any join, and only nodes with few
    children join by child, so a host or node with most shapes is split like any skewed join.
    """

    def share(bad: Column, good: Column, n: Column, parent: Column) -> Column:
        return (bad + prior * parent) / (bad + good + silent * (n - bad - good) + prior)

    depth, bad, good, pages = paths.agg(F.max(F.size("shape")), F.sum("bad"), F.sum("good"), F.sum("n")).first()
    everywhere = ((bad or 0) + 1) / ((bad or 0) + (good or 0) + silent * ((pages or 0) - (bad or 0) - (good or 0)) + 2)

    def pooled(rows: DataFrame, keys: list[str], parent: Column, *others: Column) -> DataFrame:
        purity = share(F.sum("bad"), F.sum("good"), F.sum("n"), parent).alias("purity")
        return rows.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum("n").alias("n"), purity, *others)

    hosts = pooled(paths, ["host"], F.lit(everywhere)).select("host", "purity", F.col("bad").alias("own"), (F.col("bad") + F.col("good")).alias("labels"))
    known = paths.join(hosts, "host").withColumn("template", F.lit(""))
    node = ["host", "template"]
    for level in range(1, (depth or 0) + 1):
        known = known.withColumn("child", F.coalesce(F.get("shape", F.lit(level - 1)), F.lit("")))
        ends = F.sum(F.when(F.size("shape") == level, F.col("n")).otherwise(0)).alias("ends")
        numbers = F.sum(F.when(F.coalesce(F.get("shape", F.lit(level)).startswith("0"), F.lit(False)), F.col("n")).otherwise(0)).alias("numbers")
        children = pooled(known, [*node, "child"], F.first("purity"), ends, numbers)
        width = children.groupBy(*node).agg((F.count(F.when(F.col("child") != "", 1)) > max_children).alias("wide"), (F.count(F.when(F.col("child") != "", 1)) > 0).alias("deeper"))
        narrow = children.join(width.where("not wide").select(*node), node).where("child <> ''")
        named = alike_siblings(narrow, node, alike)
        known = known.join(width, node).join(named, [*node, "child"], "left")
        branch = F.when(F.col("child") == "", F.lit("")).when(F.col("wide"), F.lit(WILDCARD)).otherwise(F.col("branch"))
        known = known.withColumn("branch", branch)
        own = pooled(known, [*node, "branch"], F.first("purity")).select(*node, "branch", F.col("purity").alias("next"), F.col("bad").alias("next_own"), (F.col("bad") + F.col("good")).alias("next_labels"))
        known = known.join(own, [*node, "branch"])
        moved = F.when(F.col("branch") == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), "branch"))
        # Where all paths end the node is its own template, and its labels count once.
        told = (F.when(F.col("deeper"), F.col(new)).otherwise(F.col(old)).alias(old) for new, old in (("next", "purity"), ("next_own", "own"), ("next_labels", "labels")))
        known = materialise(known.select("host", "shape", "n", "bad", "good", *told, moved.alias("template")))
    return known.select("host", "shape", "template", "purity", "labels", ((F.col("purity") >= reject_at) & (F.col("own") >= min_bad)).alias("rejected"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", label: Column | None = None, **tree) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict, template, purity, labels.

    A rule that fits decides (see :func:`matched_rule`); elsewhere the template tree does, block
    where a template is rejected; ``labels`` counts the template's. ``label`` (1 bad, 0 good, null none) teaches the tree; by
    default pages that a rule fits are the labelled ones. Pages are counted by host and shape
    first, and the verdicts joined back by those, so a host with most pages is split like any
    skewed join. A null url or one without ``://`` has empty host and path; null and repeated
    ids stay row by row; other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), (F.lit(None) if label is None else label).cast("int").alias("_label"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = rows.select("page_id", "_label", host.alias("host"), path.alias("path"))
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"), segment_shapes(F.col("path")).alias("shape"))
    label = F.coalesce(F.col("_label"), F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    counted = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(label == 1, 1)).alias("bad"), F.count(F.when(label == 0, 1)).alias("good"))
    judged = template_verdicts(materialise(counted), **tree)
    judged = judged.select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), "template", "purity", "labels", "rejected")
    joined = rows.join(judged, (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape")), "left")
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity", "labels")
