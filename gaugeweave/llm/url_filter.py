"""URL filters: rules of hosts and paths, and link-graph propagation for what no rule covers.

Hosts most of whose ruled pages are allowed are trusted seeds, those most of whose ruled pages are blocked are blocked
seeds.  Trust follows links between hosts (personalised PageRank); distrust follows them backwards, from a blocked host
to those that link to it.  A page without a rule is blocked where distrust is at least ``threshold`` of its host's trust
and distrust together, else allowed.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and is allowed (no host can
distrust it); null html has no links; links of a host to itself don't count; hosts reached by neither are allowed, as are
those farther from every seed than ``rounds`` links; no graph raises, however deep or dense; further columns, whatever
their names, are not looked at; repeated rows are judged alike and their links count once; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, forget

#: Absolute and protocol-relative link targets.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s<>]+)"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Add ``rule`` and ``action`` of the longest rule that fits ``host`` and ``path``; rules are (action, "host/path")."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(action)
    return pages.withColumns({"rule": rule, "action": action})


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (src, dst) of links between different hosts."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(LINK), 1)).alias("to"))
    links = links.select("src", F.translate(F.regexp_extract("to", r"//([^/?#]*)", 1), UPPER, LOWER).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").distinct()


COLUMNS = "host string, trust double, distrust double"


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 10_000, tolerance: float = 1e-4, most: int = 1_000_000) -> DataFrame:
    """(host, trust, distrust) from ``links`` (src, dst) and ``seeds`` (host, good, bad: seed weights).

    The scores are natural logarithms, null for hosts that no trust or distrust reaches, so that they never get too small
    for a float.  Both are divided by their sum at the end, so that they compare.  That is the personalised PageRank in which
    what a host without links holds goes back to the seeds: going back only scales all scores alike.

    Ends when a round changes no host's trust or distrust by more than ``tolerance`` of that value (at least by more
    than rounding does), or after ``rounds`` rounds: then scores are left as they are, and a host more than ``rounds`` links
    away from every seed is reached by none.  A host that is reached for the first time changes by its whole value; and
    since scores flow in fixed shares, after a round without a larger change none follows.

    A graph of up to ``most`` links (counted) is walked in one task, where rounds cost little; a larger one takes a Spark
    job a round, of which one number reaches the driver.  Both ways give the same scores.
    """
    links = links.join(links.groupBy("src").agg(F.count("*").alias("n_out")), "src").join(links.groupBy("dst").agg(F.count("*").alias("n_in")), "dst")
    links = cut(links, "host-links")
    ends = links.select(F.col("src").alias("host")).unionByName(links.select(F.col("dst").alias("host")))
    zero = F.lit(0.0)
    base = seeds.select("host", "good", "bad").unionByName(ends.distinct().select("host", zero.alias("good"), zero.alias("bad")))
    base = base.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # Hosts without links keep their seeds' share.
    start = lambda c: F.when(F.col(c) > 0, F.log((1 - damping) * F.col(c)))
    base = cut(base.select("host", start("good").alias("good"), start("bad").alias("bad")), "host-seeds")
    linked = ends.distinct()
    if links.limit(most + 1).count() <= most:
        near = base.join(linked, "host", "left_semi")
        walked = links.withColumn("_g", F.lit(0)).groupBy("_g").cogroup(near.withColumn("_g", F.lit(0)).groupBy("_g")).applyInPandas(_walker(damping, rounds, tolerance), COLUMNS)
        alone = base.join(linked, "host", "left_anti").select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
        scores = cut(walked.unionByName(alone), "host-scores")
    else:
        scores = _by_rounds(links, base, damping, rounds, tolerance)
    whole = scores.agg(*[F.log(F.sum(F.exp(c))).alias(f"_{c}") for c in ("trust", "distrust")])
    return scores.crossJoin(F.broadcast(whole)).select("host", (F.col("trust") - F.col("_trust")).alias("trust"), (F.col("distrust") - F.col("_distrust")).alias("distrust"))  # one row


def _walker(damping: float, rounds: int, tolerance: float):
    """All rounds over the links of one task."""

    def walk(links: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        place = pd.Series(np.arange(len(base)), index=base["host"])
        scores = []
        for seed, source, target, shares in (("good", "src", "dst", "n_out"), ("bad", "dst", "src", "n_in")):
            own = base[seed].fillna(-np.inf).to_numpy(float)
            if not len(links):
                scores.append(own)
                continue
            at, to, keep = place[links[source]].to_numpy(), place[links[target]].to_numpy(), np.log(damping / links[shares].to_numpy(float))
            order = np.argsort(to, kind="stable")
            at, to, keep = at[order], to[order], keep[order]
            first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            size, there = np.diff(np.append(first, len(to))), to[first]
            now = own.copy()
            with np.errstate(invalid="ignore", divide="ignore"):
                for _ in range(rounds):
                    part = now[at] + keep
                    top = np.maximum.reduceat(part, first)
                    low = np.where(np.isfinite(top), top, 0.0)
                    new = own.copy()
                    new[there] = np.logaddexp(own[there], low + np.log(np.add.reduceat(np.exp(part - np.repeat(low, size)), first)))
                    moved = np.where(new == now, 0.0, np.abs(new - now))
                    now = new
                    if not (moved > max(tolerance, 1e-12)).any():
                        break
            scores.append(now)
        trust, distrust = (pd.Series(s).where(np.isfinite(s), None).astype(object) for s in scores)
        return pd.DataFrame({"host": base["host"], "trust": trust, "distrust": distrust})

    return walk


def _by_rounds(links: DataFrame, base: DataFrame, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """A job a round; sums of logarithms are taken around the largest one of a host."""
    scores, before = base.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")), None
    for _ in range(rounds):
        flows = []
        for c, source, target, shares in (("trust", "src", "dst", "n_out"), ("distrust", "dst", "src", "n_in")):
            part = links.join(scores.where(F.col(c).isNotNull()).select(F.col("host").alias(source), F.col(c).alias("_v")), source)
            part = part.select(F.col(target).alias("host"), (F.col("_v") + F.log(damping / F.col(shares))).alias("_v"))
            top = part.groupBy("host").agg(F.max("_v").alias("_top"))
            flows.append(part.join(top, "host").groupBy("host", "_top").agg(F.sum(F.exp(F.col("_v") - F.col("_top"))).alias("_s")).select("host", (F.col("_top") + F.log("_s")).alias(f"_{c}")))
        plus = lambda a, b: F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))
        new = base.join(flows[0], "host", "left").join(flows[1], "host", "left").select("host", plus(F.col("good"), F.col("_trust")).alias("trust"), plus(F.col("bad"), F.col("_distrust")).alias("distrust"))
        new = cut(new.join(scores.select("host", F.col("trust").alias("_t"), F.col("distrust").alias("_d")), "host"), "host-scores")
        moved = lambda v, was: F.col(v).isNotNull() & (F.col(was).isNull() | (F.abs(F.col(v) - F.col(was)) > max(tolerance, 1e-12)))
        left = not new.where(moved("trust", "_t") | moved("distrust", "_d")).isEmpty()
        if before is not None:
            forget(before)
        before, scores = new, new.select("host", "trust", "distrust")
        if not left:
            break
    return scores


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5, **walk) -> DataFrame:
    """One row per page: its id, host, path, rule, verdict, and its host's trust and distrust."""
    rows = ruled(pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")), rules)
    count = rows.where("host <> ''").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("a"), F.count_if(F.col("action") == "block").alias("b"))
    seeds = count.select("host", (F.col("a") > F.col("b")).cast("double").alias("good"), (F.col("b") > F.col("a")).cast("double").alias("bad"))
    scores = propagate(host_links(pages, url_col, html_col), seeds, **walk)
    share = F.when(F.col("trust").isNull(), 1.0).otherwise(1 / (1 + F.exp(F.col("trust") - F.col("distrust"))))
    spread = F.when(F.col("distrust").isNotNull() & (share >= threshold), "block").otherwise("allow")
    value = lambda c: F.coalesce(F.exp(c), F.lit(0.0)).alias(c)
    return rows.join(scores, "host", "left").select(id_col, "host", "path", "rule", F.coalesce("action", spread).alias("verdict"), value("trust"), value("distrust"))
