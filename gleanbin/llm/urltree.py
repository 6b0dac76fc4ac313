"""URL filters by a path-template tree.

Each host has a tree of its paths' segments, walked level by level. At a node,

* variable segments become the wildcard *: those with a digit, and all but the told-apart ones of a node at which most
  pages have a segment of their own (CROWD children or more, more than half as many as pages);
* of the other segments, those with labelled pages are held against each other: one whose bad share lies within NEAR
  standard errors of that of its labelled siblings together is merged with the like of it into +, any other stays apart;
* a segment without a labelled page has no evidence of its own: it is written * too, but its pages are judged by the
  smoothed prior, not by the pages that share the wildcard.

A node whose pages are all labelled bad, or none bad, or that has a single path, is not walked further, as nothing below
can be told apart; what is left of its paths is * for each segment. So there are as many rounds as the deepest point at
which a host's bad and other paths share a node, whatever the paths' length; no cap on depth or branches.

A template's purity is the bad share of its labelled pages, smoothed towards the share of all (PRIOR pages of it), and it
is rejected from LEAST on. Rules come first: the longest that fits. Where no labels are given, pages under rules are the
labelled ones (bad: blocked), and templates judge the pages that no rule fits.

The work is on distinct (host, path) with counts, summed before any shuffle; a host that holds most rows is a key with
counts only. Each level is written, and paths that are done leave the tree.

Defined cases: null urls and those without :// have empty host and path, and so one template; labels of pages that
aren't there do nothing; null page_id is judged but never labelled; a page with several labels is bad if one says so;
repeated rows count each; very long urls are read whole; segments * and + are written \\* and \\+ where they stay apart; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanbin.llm.common import Scratch, written

#: Rules as (host, path, blocks).
RULES = [("com", "/", False), ("example.com", "/en/", True), ("www.example.com", "/en/", False), ("net", "/es/", True), ("net", "/fr/", True)]
CROWD, NEAR, PRIOR, LEAST = 20, 2.0, 10.0, 0.5
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every row."""
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, URL, 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.select("page_id", host.alias("host"), F.regexp_extract(url, URL, 2).alias("path"))


def fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (the longest that fits) and blocks (its verdict, else null)."""
    name, blocks = F, F
    for host, path, bad in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        name, blocks = name.when(fits(host, path), host + path), blocks.when(fits(host, path), bad)
    return rows.withColumns({"rule": name.otherwise(None) if rules else F.lit(None).cast("string"), "blocks": blocks.otherwise(None) if rules else F.lit(None).cast("boolean")})


def _steps(tree: DataFrame, own: Scratch) -> DataFrame:
    """host, template, _at (a segment), _step (what becomes of it) and _blind (no evidence of its own)."""
    sums = [F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b")]
    branch = own.written(tree.where("_at is not null").groupBy("host", "template", "_at").agg(*sums), "branch")
    own_b, own_l = F.when(F.col("_at") != "*", F.col("b")), F.when(F.col("_at") != "*", F.col("l"))
    words = F.count_if(F.col("_at") != "*")
    node = branch.groupBy("host", "template").agg(words.alias("_k"), F.sum(F.when(F.col("_at") != "*", F.col("n"))).alias("_n"), F.sum(own_l).alias("_l"), F.sum(own_b).alias("_b"))
    share = (F.col("_b") + 0.5) / (F.col("_l") + 1)
    apart = (F.col("l") > 0) & (F.abs(F.col("b") - F.col("l") * share) > NEAR * F.sqrt(F.col("l") * share * (1 - share)))
    variable = (F.col("_at") == "*") | ((F.col("_k") >= CROWD) & (2 * F.col("_k") > F.col("_n")))
    literal = F.when(F.col("_at").isin("*", "+"), F.concat(F.lit("\\"), F.col("_at"))).otherwise(F.col("_at"))
    step = F.when((F.col("_at") != "*") & apart, literal).when(variable, "*").when(F.col("l") > 0, "+").otherwise("*")
    blind = ~variable & (F.col("l") == 0)
    return own.written(branch.join(node, ["host", "template"]).select("host", "template", "_at", step.alias("_step"), blind.alias("_blind")), "steps")


def templates(paths: DataFrame, own: Scratch) -> DataFrame:
    """host, path, template and blind (judged by the prior alone) of distinct paths with n, labelled, bad."""
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    tree = own.written(paths.withColumns({"_s": segments, "template": F.lit(""), "_d": F.lit(0)}), "tree")
    counts, out, depth = ["n", "labelled", "bad"], None, 0
    done = lambda rows, blind, rest: rows.select("host", "path", rest.alias("template"), blind.alias("blind"), *counts)
    while True:
        node = tree.groupBy("host", "template").agg(F.sum("n").alias("_n"), F.sum("bad").alias("_b"), F.count("*").alias("_paths"))
        open_ = node.select("host", "template", ((F.col("_b") > 0) & (F.col("_b") < F.col("_n")) & (F.col("_paths") > 1)).alias("_open"))
        at = F.get("_s", F.lit(depth))
        # a segment with a digit is variable whatever its siblings are
        here = F.when(at.rlike("[0-9]"), "*").when(at == "*", "\\*").otherwise(at)
        tree = own.written(tree.join(open_, ["host", "template"]).withColumn("_at", here), "level")
        rest = F.concat("template", F.repeat(F.lit("/*"), F.greatest(F.size("_s") - depth, F.lit(0))))
        closed = done(tree.where(~F.col("_open") | F.col("_at").isNull()), F.lit(False), F.when(F.col("_open"), F.col("template")).otherwise(rest))
        out = closed if out is None else out.unionByName(closed)
        walked = tree.where("_open and _at is not null")
        steps = _steps(walked, own)
        tree = own.written(walked.join(steps, ["host", "template", "_at"]).withColumn("template", F.concat("template", F.lit("/"), "_step")).drop("_at", "_open", "_step"), "stepped")
        depth += 1
        blind = done(tree.where("_blind"), F.lit(True), F.concat("template", F.repeat(F.lit("/*"), F.size("_s") - depth)))
        out = out.unionByName(blind)
        tree = tree.where("not _blind").drop("_blind")
        if not tree.limit(1).count():
            return out


def judged(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row. labels: page_id, bad (boolean)."""
    own = Scratch(pages.sparkSession)
    rows = ruled(parsed(pages), rules)
    if labels is None:
        rows = rows.withColumn("_bad", F.col("blocks"))
    else:
        one, _ = written(labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("_bad")), "labels")
        rows = rows.join(one, "page_id", "left")
    paths = own.written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("_bad").alias("labelled"), F.count_if("_bad").alias("bad")), "paths")
    total = paths.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("l")).first()
    prior = total["b"] / total["l"] if total["l"] else 0.0
    shaped = own.written(templates(paths, own), "templates")
    sums = shaped.where("not blind").groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l"))
    pure = own.written(sums.select("host", "template", ((F.col("b") + PRIOR * prior) / (F.col("l") + PRIOR)).alias("purity"), (F.col("l") > 0).alias("_seen")), "purity")
    held = shaped.where("not blind").join(pure, ["host", "template"]).select("host", "path", "template", "purity", ((F.col("purity") >= LEAST) & F.col("_seen")).alias("_rejected"))
    blind = shaped.where("blind").select("host", "path", "template", F.lit(prior).alias("purity"), F.lit(False).alias("_rejected"))
    verdicts, _ = written(held.unionByName(blind), "verdicts")
    own.clear()
    blocked = F.coalesce(F.col("blocks"), F.col("_rejected"))
    return rows.join(verdicts, ["host", "path"]).select("page_id", "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"), "template", "purity")


def op10(pages: DataFrame) -> DataFrame:
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
