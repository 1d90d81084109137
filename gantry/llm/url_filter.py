"""URL filter: explicit rules first, then trust and distrust spread over the link graph of hosts.

Only DataFrame functions are used. Links between hosts are summed to weighted edges: absolute links and those that
name a host without a scheme (`//host/`); all other links of a page stay on its own host and make no edge. Trust is a
personalised PageRank along the links from hosts that the rules allow; distrust is one against the links from hosts
that the rules block. The rank of hosts without links goes back to the seeds, so both sum to 1 and can be compared;
rounds go on until no host's rank changes by more than `tolerance` of what one seed starts with, however many there
are; a damping below 1 makes sure of that.
A host whose distrust reaches `threshold` of both together, and a floor as a share of what one seed starts with, is
blocked; other hosts are allowed.

Cases: a null url or one without `://` has an empty host and path, fits no rule and is allowed; null or empty html has
no links; repeated rows each get a row; without links the seeds' own scores decide; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import materialise, packed, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the query's rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From after the first `://` up to `/`, `?` or `#`, A-Z in lower case; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null. `rules` is a short list; it becomes part of the plan."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Weighted links between different hosts: src, dst, weight."""
    links = F.when(F.col(html).contains("//"), F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1)))
    whole = lambda link: F.when(link.startswith("//"), F.concat(F.lit("x:"), link)).otherwise(link)
    rows = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.transform(links, lambda x: host_of(whole(x)))).alias("dst"))
    rows = rows.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return rows.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """Personalised PageRank: `seeds` has host and seed (equal mass, not yet normalised); returns host and score, which sum to 1.

    Rank that stands on hosts without links goes back to the seeds: that only scales the solution without it, so it is
    left out of the rounds and made up for at the end.
    """
    total = seeds.agg(F.sum("seed").alias("s"), F.max("seed").alias("one")).first()
    if not total["s"]:
        return seeds.select("host", F.lit(0.0).alias("score"))
    least = tolerance * (1 - damping) * total["one"] / total["s"]
    seeds = materialise(seeds.select("host", (F.lit(1 - damping) * F.col("seed") / F.lit(float(total["s"]))).alias("seed")), "seeds")
    out_weight = edges.groupBy("src").agg(F.sum("weight").alias("of"))
    share = materialise(edges.join(out_weight, "src").select("src", "dst", (F.lit(damping) * F.col("weight") / F.col("of")).alias("share")), "shares")
    score = seeds.select("host", F.col("seed").alias("score"), F.lit(0.0).alias("old"))
    while True:
        old = score.select(F.col("host").alias("src"), "score")
        moved = share.join(old, "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        new = moved.join(seeds, "host", "full_outer").join(score.select("host", F.col("score").alias("old")), "host", "full_outer")
        score = materialise(new.select("host", (F.coalesce("seed", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("score"), F.coalesce("old", F.lit(0.0)).alias("old")), "ranks")
        now = score.agg(F.max(F.abs(F.col("score") - F.col("old"))).alias("most"), F.sum("score").alias("s")).first()
        if now["most"] <= least:
            return score.select("host", (F.col("score") / F.lit(float(now["s"]))).alias("score"))


def judge(pages: DataFrame, *, url: str = "url", html: str = "html", rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, floor: float = 1e-6, tolerance: float = 1e-3) -> DataFrame:
    """`pages` without the html, with host, path, rule and verdict."""
    columns = [c for c in pages.columns if c not in (html, "host", "path", "rule", "verdict")]
    named = packed(pages.select(*(F.col(f"`{c}`") for c in columns)), host=host_of(F.col(url)), path=path_of(F.col(url)))
    ruled = named.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    per_host = materialise(
        ruled.where(F.col("host") != "").groupBy("host").agg(
            F.count("*").alias("n"),
            F.sum(F.when(F.col("fit.verdict") == "allow", 1).otherwise(0)).alias("allowed"),
            F.sum(F.when(F.col("fit.verdict") == "block", 1).otherwise(0)).alias("blocked"),
        ),
        "host-rules",
    )
    trusted = per_host.where((F.col("allowed") * 2 >= F.col("n")) & (F.col("allowed") > 0)).select("host", F.lit(1.0).alias("seed"))
    blocked = per_host.where((F.col("blocked") * 2 > F.col("n"))).select("host", F.lit(1.0).alias("seed"))
    edges = materialise(host_edges(pages, url, html), "edges")
    if edges.isEmpty():
        trust, distrust = (x.select("host", F.col("seed").alias("score")) for x in (trusted, blocked))
        least = floor
    else:
        least = floor / max(blocked.count(), 1)  # scores sum to 1 over all seeds
        trust = propagate(edges, trusted, tolerance=tolerance)
        distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), blocked, tolerance=tolerance)
    scores = trust.select("host", F.col("score").alias("trust")).join(distrust.select("host", F.col("score").alias("distrust")), "host", "full_outer")
    good, bad = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    # only what the method blocks is joined back; both sides are tables, so that a hot host's join can be split
    bad_hosts = materialise(scores.where((bad > least) & (bad >= F.lit(threshold) * (good + bad))).select(F.col("host").alias("bad")), "bad-hosts")
    joined = ruled.join(bad_hosts, F.col("host") == F.col("bad"), "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return unpacked(joined, columns, host=F.col("host"), path=F.col("path"), rule=F.col("fit.rule"), verdict=verdict)


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
