"""Which urls may be read: rules by host and path, and trust and distrust that links carry on.

Hosts with allowed pages are trusted seeds, hosts with blocked pages distrusted ones. Trust flows
along links as a personalised PageRank, distrust against them: who links to blocked hosts is
distrusted too. A page that no rule fits is judged by its host's balance of both.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.session import checkpointed

#: (verdict, host, path) as the registered query takes them.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MAX_RULES = 100  # that many become part of the plan; more, or a table of rules, are joined
DAMPING, ENOUGH = 0.85, 1e-6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A tag that never ends is searched up to the next one only.
_LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct of rule and verdict, or null; of equally long ones the first by text."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """(verdict, host, path) of all rules; of those that are equal but for the verdict, the first by text."""
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")
    return table.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))


def ruled_by_join(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``r``, as of ``rule_for``, to (host, path, ...) by joins with any number of rules of ``rule_table``.

    Distinct (host, path) are looked up: first the ends of the host among the hosts with rules, then, for the
    lengths of path that these rules have, the beginning of the path. Both are equi-joins with one row
    per key on the side of the rules.
    """
    told = rules.select(F.col("host").alias("end"), F.col("path").alias("start"), "verdict")
    lengths = told.groupBy("end").agg(F.collect_set(F.char_length("start")).alias("lengths"))
    labels = F.split("host", "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.select("host", "path").distinct()
    held = asked.withColumn("end", F.explode(ends)).join(lengths, "end")
    fits = held.withColumn("n", F.explode("lengths")).where(F.char_length("path") >= F.col("n"))
    fits = fits.withColumn("start", F.substr("path", F.lit(1), F.col("n"))).join(told, ["end", "start"])
    rule = F.concat("end", "start")
    best = F.min(F.struct((-F.char_length(rule)).alias("less"), rule.alias("rule"), "verdict")).alias("best")
    found = fits.groupBy("host", "path").agg(best).select("host", "path", F.struct("best.rule", "best.verdict").alias("r"))
    return rows.join(found, ["host", "path"], "left").select(*rows.columns, "r")


def edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links between different hosts: ``src, dst, n`` (pages of src with a link to dst).

    Links without a host stay on their page's host and carry nothing. A page counts once for a host,
    before anything is shuffled.
    """
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    address = F.regexp_replace(body, "&amp;", "&")
    groups = [F.regexp_extract_all(address, F.lit(_LINK), F.lit(i)) for i in (1, 2, 3)]
    links = F.filter(F.concat(*groups), lambda x: x.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"))
    # What precedes the two slashes does not matter for the host.
    hosts = F.transform(links, lambda x: host_of(F.concat(F.lit("x://"), F.regexp_replace(x, "^[^/]*//", ""))))
    rows = pages.select(host_of(F.col(f"`{url}`").cast("string")).alias("src"), hosts.alias("hosts"))
    out = rows.select("src", F.explode(F.array_distinct("hosts")).alias("dst"))
    return out.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def rounds_for(damping: float, enough: float) -> int:
    """Rounds after which the ranks move by less than ``enough``, on any links.

    Trust and distrust move by at most 2 in all in the first round each, and by a share of ``damping`` of it in each further one.
    """
    return max(1, math.ceil(math.log(enough / 4) / math.log(damping)) + 2)


ROUNDS = rounds_for(DAMPING, ENOUGH)

def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, enough: float = ENOUGH) -> DataFrame:
    """``host, trust, distrust`` from ``seeds`` (host, trusted, blocked: weights of 0 or more) and ``edges``.

    Trust follows the links, distrust goes against them; both begin with, and return to, their seeds,
    and each sums to 1 if there is a seed. What reaches a host without a way on returns to the seeds.
    Every round joins by host and sums before it shuffles; it is written to the shared folder, so a
    lost executor costs one round. It ends once the ranks move by less than ``enough`` in all, and
    raises if they still move by more after ``rounds_for`` rounds.
    """
    hosts = seeds.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    sums = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    share = lambda c, total: F.coalesce(F.col(c), F.lit(0.0)) / F.lit(total or 1.0)
    base = checkpointed(hosts.join(seeds, "host", "left").select("host", share("trusted", sums.t).alias("s"), share("blocked", sums.b).alias("d")))
    # Shares of what a host hands on, along and against its links.
    there = links.join(links.groupBy("src").agg(F.sum("n").alias("all")), "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("along"), F.lit(0.0).alias("against"))
    back = links.join(links.groupBy("dst").agg(F.sum("n").alias("all")), "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("along"), (F.col("n") / F.col("all")).alias("against"))
    ways = checkpointed(there.unionByName(back))
    ranks = base.select("host", F.col("s").alias("trust"), F.col("d").alias("distrust"))
    for _ in range(rounds_for(damping, enough)):
        sent = ranks.join(ways, "host").groupBy(F.col("to").alias("host")).agg(F.sum(F.col("trust") * F.col("along")).alias("t"), F.sum(F.col("distrust") * F.col("against")).alias("b"))
        got = base.join(sent, "host", "left").na.fill(0.0, ["t", "b"])
        lost = got.agg((F.lit(1.0) - F.sum("t")).alias("t"), (F.lit(1.0) - F.sum("b")).alias("b")).first()
        if lost.t is None:
            break
        step = got.select(
            "host",
            (damping * (F.col("t") + F.lit(lost.t) * F.col("s")) + (1 - damping) * F.col("s")).alias("trust"),
            (damping * (F.col("b") + F.lit(lost.b) * F.col("d")) + (1 - damping) * F.col("d")).alias("distrust"),
        )
        new = checkpointed(step)
        moved = new.join(ranks.withColumnsRenamed({"trust": "t0", "distrust": "d0"}), "host").agg(F.sum(F.abs(F.col("trust") - F.col("t0")) + F.abs(F.col("distrust") - F.col("d0"))).alias("m")).first().m
        ranks = new
        if (moved or 0.0) < enough:
            break
    else:
        raise RuntimeError("trust and distrust did not converge")
    return ranks


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules: Sequence[tuple[str, str, str]] | DataFrame = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page.

    ``rules`` are (verdict, host, path), as a list or as a table of any size. The longest fitting rule decides. Without one, a page is blocked if its host's distrust is larger
    than its trust, else allowed; a host that neither reaches is allowed, as are pages without a host
    (null, empty or odd urls). Repeated rows are judged alike; a null html has no links.
    """
    host, path = host_of(F.col(f"`{url}`").cast("string")), path_of(F.col(f"`{url}`").cast("string"))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    if isinstance(rules, DataFrame) or len(rules) > MAX_RULES:
        named = ruled_by_join(rows, rule_table(pages.sparkSession, rules))
    else:
        named = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    ruled = named.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("by_rule"))
    seeds = (
        ruled.where("by_rule is not null and host <> ''")
        .groupBy("host")
        .agg(F.count(F.when(F.col("by_rule") == "allow", 1)).cast("double").alias("trusted"), F.count(F.when(F.col("by_rule") == "block", 1)).cast("double").alias("blocked"))
    )
    ranks = propagate(checkpointed(seeds), checkpointed(edges(pages, url, html)))
    told = ruled.join(ranks, "host", "left").na.fill(0.0, ["trust", "distrust"])
    verdict = F.coalesce("by_rule", F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow"))
    return told.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
