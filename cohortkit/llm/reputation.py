"""Host reputation by empirical Bayes, in DataFrame functions only.

Pages with a known outcome (bad or not) are counted by host.  Suffixes, registered domains
and hosts form three levels; the bad share of a group is drawn from a beta distribution
around the share of the group above it.  How tightly, one concentration for each level, is
estimated from the data by moments: of groups of n outcomes, k of them bad, under a share m
with v = m (1 - m), the sum of n (k/n - m)^2 is expected to be the sum of v (1 + (n - 1) r),
where r = 1 / (1 + concentration).  So a host with many outcomes stands for itself, one with
few leans on its registered domain, that on its suffix, and that on the share of all pages.

The posterior of a host's bad share is a beta distribution; the logit of such a variable has
mean digamma(a) - digamma(b) and variance trigamma(a) + trigamma(b), from which comes the
lower bound that the share exceeds with probability CERTAIN.  Hosts whose bound reaches
BAD are blocked.  Rules for hosts and paths go first.

Without any outcome no host is blocked.  A url that is null or has no ``://`` has an empty
host and path, which no rule fits and which count as a host of their own.  Several outcomes
of a page count as bad if any is; repeated pages each count.  Empty tables give empty
tables; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import staged

#: A host is blocked if its bad share reaches BAD with probability CERTAIN.
BAD = 0.5
CERTAIN = 0.95
#: Bounds of a level's concentration.
LOOSE, TIGHT = 0.5, 1e6
#: Keys with at least one in HOT rows are dealt over SALTS tasks; there are at most HOT.
HOT, SALTS = 200, 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting of ``rules`` (pattern, verdict), as a struct or null.

    The pattern ``example.net/en/`` fits the host and its subdomains if the path begins with
    ``/en/``.  Of equally long ones the first listed wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for pattern, verdict in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, _, start = pattern.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(pattern).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _name(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_extract(host, r"[^@]*$", 0), r":[0-9]*$", "")


def suffix_of(host: Column, suffixes: Sequence[str]) -> Column:
    """The longest of ``suffixes`` a host ends in, else its last label; empty for addresses."""
    name = _name(host)
    out = F.when(name.rlike(r"^[0-9.]*$") | name.startswith("["), "").otherwise(F.substring_index(name, ".", -1))
    for s in sorted(suffixes, key=len):
        out = F.when((name == s) | name.endswith(f".{s}"), s).otherwise(out)
    return out


def registered_of(host: Column, suffixes: Sequence[str]) -> Column:
    """The suffix and the label before it; a host that has none is its own."""
    name, suffix = _name(host), suffix_of(host, suffixes)
    before = F.substring(name, F.lit(1), F.length(name) - F.length(suffix) - 1)
    own = F.concat(F.substring_index(before, ".", -1), F.lit("."), suffix)
    return F.when((suffix == "") | (suffix == name), name).otherwise(own)


def _digamma(x: Column) -> Column:
    y = x + 6
    tail = 1 / (12 * y**2) - 1 / (120 * y**4) + 1 / (252 * y**6)
    return F.log(y) - 1 / (2 * y) - tail - sum(1 / (x + j) for j in range(6))


def _trigamma(x: Column) -> Column:
    y = x + 6
    return 1 / y + 1 / (2 * y**2) + 1 / (6 * y**3) - 1 / (30 * y**5) + 1 / (42 * y**7) + sum(1 / (x + j) ** 2 for j in range(6))


def least_share(bad: Column, good: Column, certain: float = CERTAIN) -> Column:
    """What a share of posterior Beta(bad, good) exceeds with probability ``certain``."""
    z = NormalDist().inv_cdf(certain)
    logit = _digamma(bad) - _digamma(good) - z * F.sqrt(_trigamma(bad) + _trigamma(good))
    return 1 / (1 + F.exp(-logit))


def _concentration(groups: DataFrame, share: str) -> Column:
    """The concentration of groups (n, k) around ``share``, a scalar."""
    n, k, m = F.col("n"), F.col("k"), F.col(share)
    v = m * (1 - m)
    apart = F.try_divide((k - n * m) ** 2, n)
    spread = F.try_divide(F.sum(apart) - F.sum(F.when(n > 0, v)), F.sum(F.when(n > 0, v * (n - 1))))
    r = F.greatest(F.least(spread, F.lit(1 / (1 + LOOSE))), F.lit(1 / (1 + TIGHT)))
    return groups.agg(F.coalesce(1 / r - 1, F.lit(TIGHT))).scalar()


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, deal: Column) -> DataFrame:
    """``left`` inner joined with ``right`` (one row per ``key``, ``rows`` of ``left`` each).

    Keys with over one in HOT of all rows are dealt over SALTS tasks by ``deal``; their list,
    at most HOT keys long, is broadcast.
    """
    total = right.agg(F.sum(rows)).scalar()
    is_hot = F.col(rows) * HOT > total
    hot = right.where(is_hot).select(key, F.lit(True).alias("hot:"))
    salted = right.withColumn("salt:", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    salt = F.when(F.col("hot:"), F.pmod(deal, F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("salt:", salt)
    return dealt.join(salted.drop(rows), [key, "salt:"]).drop("hot:", "salt:")


def reputations(counts: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """host, n, k, rows, bad, good: the posterior Beta(bad, good) of each host's bad share.

    ``counts`` has a row per host: ``rows`` pages, ``n`` of them with an outcome, ``k`` bad.
    """
    hosts = staged(counts.withColumns({
        "suffix": suffix_of(F.col("host"), suffixes), "registered": registered_of(F.col("host"), suffixes),
    }))
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = staged(hosts.groupBy("registered", "suffix").agg(*sums, F.count(F.lit(1)).alias("hosts")))
    tops = domains.groupBy("suffix").agg(*sums, F.count(F.lit(1)).alias("domains"))

    def shrunk(groups: DataFrame, above: str, into: str) -> DataFrame:
        s = _concentration(groups, above)
        return groups.withColumn(into, (F.col("k") + s * F.col(above)) / (F.col("n") + s))

    everything = domains.agg((F.sum("k") + 0.5) / (F.sum("n") + 1)).scalar()
    tops = staged(shrunk(tops.withColumn("all:", everything), "all:", "top:"))
    deal = F.xxhash64("registered")
    domains = spread_join(domains, tops.select("suffix", "domains", "top:"), "suffix", "domains", deal)
    domains = staged(shrunk(domains, "top:", "domain:"))
    deal = F.xxhash64("host")
    hosts = spread_join(hosts.drop("suffix"), domains.select("registered", "hosts", "domain:"), "registered", "hosts", deal)
    hosts = staged(hosts)
    s = _concentration(hosts, "domain:")
    return staged(hosts.select(
        "host", "rows", "n", "k", (F.col("k") + s * F.col("domain:")).alias("bad"),
        (F.col("n") - F.col("k") + s * (1 - F.col("domain:"))).alias("good"),
    ))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], suffixes: Sequence[str] = ()
) -> DataFrame:
    """page_id, host, path, rule, verdict, and what the method knows of the host: labelled
    pages, bad ones, and the lower bound of its bad share.

    ``outcomes`` has page_id and bad (boolean); a null of either says nothing.
    """
    url = F.col("url").cast("string")
    placed = pages.select("page_id", host_of(F.coalesce(url, F.lit(""))).alias("host"), path_of(F.coalesce(url, F.lit(""))).alias("path"))
    marks = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counts = placed.select("page_id", "host").join(marks, "page_id", "left").groupBy("host").agg(
        F.count(F.lit(1)).alias("rows"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")
    )
    known = reputations(counts, suffixes).select(
        "host", "rows", F.col("n").alias("labelled"), F.col("k").alias("bad"), least_share(F.col("bad"), F.col("good")).alias("bound")
    )
    joined = spread_join(placed, known, "host", "rows", F.xxhash64("page_id", "path"))
    fitting = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") >= BAD, "block").otherwise("allow")
    return joined.withColumn("fitting", fitting).select(
        "page_id", "host", "path", F.col("fitting.rule").alias("rule"),
        F.coalesce("fitting.verdict", own).alias("verdict"), "labelled", "bad", F.round("bound", 6).alias("bound"),
    )
