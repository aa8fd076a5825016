"""URL filter: fixed rules, then an empirical-Bayes reputation of the host.

Outcomes (good or not) of labelled pages are counted by host. At each level, host under registered domain
under suffix, a beta-binomial prior is fitted to the spread of the rates below each parent (pooled method of moments),
so that a host with few labels takes most of its rate from its domain and suffix. A page is allowed if the lower
posterior bound of its host's rate (the ``TAIL`` quantile of the beta posterior) reaches ``LEAST``. The registered domain is the
label before the suffix and the suffix; suffixes have one label, or the two of ``DOUBLE_SUFFIXES``.

The main path has DataFrame expressions only. Counts are aggregated before they are shuffled. The page table
meets hosts once, by a join that Spark broadcasts if the stored host table is small and otherwise sorts,
splitting hosts with many pages.

Null urls and urls without ``://`` have an empty host and path, whose reputation rests on all labels. Null ids
have no label. Several labels of an id count as several outcomes; repeated pages stay. Labels with a null outcome
don't count. Without labels every rate is a half. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.llm.workspace import stored

#: Tail of the one-sided bound; the least rate; the spread assumed where the labels can't tell it.
TAIL, LEAST, SPREAD = 0.05, 0.5, 0.1
#: The quantile's grid: so many cells over so many deviations of the log odds on either side of the mode.
CELLS, REACH = 384, 12
#: Common public suffixes of two labels.
DOUBLE_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.cn", "com.hk", "com.tw", "com.sg",
    "co.in", "co.il", "co.za", "com.tr", "com.br", "com.ar", "com.mx", "github.io", "gitlab.io", "blogspot.com",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def site(host: Column, double_suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Registered domain and suffix: the last two labels and the last, or one more for a listed two-label suffix."""
    bare = F.regexp_replace(host, r"\A.*@|:[0-9]*\z", "")
    labels = F.split(bare, r"\.")
    last = lambda k: F.array_join(F.slice(labels, -F.least(F.lit(k), F.size(labels)), k), ".")
    number = bare.rlike(r"\A[0-9.]+\z|\A\[")
    double = last(2).isin(*double_suffixes) if double_suffixes else F.lit(False)
    domain = F.when(number, bare).when(double, last(3)).otherwise(last(2))
    suffix = F.when(number, "").when(double, last(2)).otherwise(last(1))
    return domain, suffix


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as its text and its verdict; nulls if none does. ``rules``: (verdict, text)."""
    text = verdict = F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, start = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + start)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def _strength(counts: DataFrame, parent: list[str]) -> float:
    """Prior strength of the children of each parent: 1 / spread - 1, the spread pooled over parents."""
    groups = counts.where("n > 0").groupBy(*parent) if parent else counts.where("n > 0").groupBy()
    of = groups.agg(
        F.count(F.lit(1)).cast("double").alias("g"), F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("kk"),
    )
    mean = F.col("k") / F.col("n")
    noise = mean * (1 - mean)
    row = of.agg(
        F.sum(F.col("kk") - F.col("k") * mean).alias("seen"),
        F.sum(noise * (F.col("g") - 1)).alias("chance"),
        F.sum(noise * (F.col("n") - F.col("nn") / F.col("n") - (F.col("g") - 1))).alias("room"),
    ).first()  # one row of three sums
    spread = (row["seen"] - row["chance"]) / row["room"] if row and row["room"] and row["room"] > 1e-9 else SPREAD
    return 1 / min(max(spread, 0.001), 0.999) - 1


def beta_quantile(rows: DataFrame, a: Column, b: Column, tail: float, name: str) -> DataFrame:
    """``rows`` and the quantile of Beta(a, b): the posterior of the log odds, summed over cells around its mode.

    Its log density is ``a t - (a + b) log(1 + e^t)``, with exponential tails, so equal cells hold all but a millionth of it.
    """
    soft = lambda t: F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))
    wide = F.sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b))  # at least the deviation
    rows = rows.withColumns({"_mode": F.log(a / b), "_h": wide * (2 * REACH / CELLS)})
    at = lambda i: F.col("_mode") + (i - CELLS // 2) * F.col("_h")
    density = lambda i: F.exp(a * (at(i) - F.col("_mode")) - (a + b) * (soft(at(i)) - soft(F.col("_mode"))))
    rows = rows.withColumn("_cells", F.transform(F.sequence(F.lit(0), F.lit(CELLS)), lambda i: F.struct(at(i).alias("t"), density(i).alias("w"))))
    rows = rows.withColumn("_below", F.aggregate("_cells", F.lit(0.0), lambda s, c: s + c["w"]) * tail)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("t"))
    inside = lambda s, c: c["t"] - F.col("_h") / 2 + F.col("_h") * (F.col("_below") - s["sum"]) / c["w"]
    step = lambda s, c: F.struct(
        (s["sum"] + c["w"]).alias("sum"), F.when(s["t"].isNull() & (s["sum"] + c["w"] >= F.col("_below")), inside(s, c)).otherwise(s["t"]).alias("t")
    )
    odds = F.aggregate("_cells", start, step, lambda s: s["t"])
    return rows.withColumn(name, 1 / (1 + F.exp(-odds))).drop("_mode", "_h", "_cells", "_below")


def reputation(pages: DataFrame, outcomes: DataFrame, double_suffixes: tuple[str, ...] = DOUBLE_SUFFIXES) -> DataFrame:
    """``host, n, k, rate, bound`` of every host of ``pages`` (``page_id, host``); ``outcomes``: ``page_id, good`` (0, 1)."""
    labelled = pages.join(outcomes.where("good IS NOT NULL"), "page_id", "left")
    counts = labelled.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k"))
    domain, suffix = site(F.col("host"), double_suffixes)
    hosts = stored(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "host-outcomes")
    rollup = lambda rows, keys: rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = rollup(hosts, ["suffix", "domain"])
    suffixes = stored(rollup(domains, ["suffix"]), "suffix-outcomes")
    domains = stored(domains, "domain-outcomes")
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    whole = (total[1] + 1) / (total[0] + 2)
    by_suffix, by_domain, by_host = _strength(suffixes, []), _strength(domains, ["suffix"]), _strength(hosts, ["suffix", "domain"])
    shrunk = lambda prior, strength: (F.col("k") + strength * prior) / (F.col("n") + strength)
    suffixes = suffixes.select("suffix", shrunk(F.lit(whole), by_suffix).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", shrunk(F.col("suffix_rate"), by_domain).alias("domain_rate"))
    rated = hosts.join(domains, ["domain", "suffix"]).withColumn("rate", shrunk(F.col("domain_rate"), by_host))
    weight = F.col("n") + by_host
    bounded = beta_quantile(rated, F.col("rate") * weight, (1 - F.col("rate")) * weight, TAIL, "bound")
    return bounded.select("host", "n", "k", "rate", "bound")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], least: float = LEAST, double_suffixes: tuple[str, ...] = DOUBLE_SUFFIXES) -> DataFrame:
    """Every page's ``host, path, rule, verdict`` and its host's ``rate`` and ``bound``."""
    host, path = host_and_path(F.col("url"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = stored(reputation(keyed.select("page_id", "host"), outcomes, double_suffixes), "host-reputation")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") >= least, "allow").otherwise("block")
    return keyed.join(known.select("host", "rate", "bound"), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.round("rate", 6).alias("rate"), F.round("bound", 6).alias("bound"),
    )
