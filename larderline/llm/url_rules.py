"""URL filters: a sort-merge range join of reversed-host keys with nested rules.

A host is turned round (``www.example.com`` -> ``com.example.www.``), so that a rule for a
host covers one interval of the sorted keys: the host and all its subdomains. Intervals are
nested or apart. A sweep over keys and rules in one sorted order keeps a stack with one slot
for each nesting level; a rule enters its slot where its interval starts and leaves it at the
first key behind the end. Path prefixes are intervals too and are swept in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larderline.session import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between ``://`` and the next of ``/ ? #``, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 2)


def host_key(host: Column) -> Column:
    """Labels from last to first, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def domain(key: Column) -> Column:
    """The first two labels of a host key, by which hosts are grouped."""
    return F.substring_index(key, ".", 2)


def sweep(probes: DataFrame, rules: DataFrame, groups: list[str], levels: list[int]) -> DataFrame:
    """Adds ``stack``: the rules whose prefix opens the probe's ``key``, by level.

    ``probes`` has ``key``, ``rules`` has ``key`` and ``level``; both have the group columns,
    and rules of one level in one group are never prefixes of each other. Sorted in one order
    with a rule before the keys it opens, the last rule seen at a level is the only one
    that can still be open there: it is, if the key starts with it, else it has been left.
    """
    columns = [c for c in probes.columns if c not in ("key", *groups)]
    events = probes.select(
        *groups, "key", F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_level"),
        F.struct(*columns).alias("_probe"),
    ).unionByName(
        rules.select(
            *groups, "key", F.lit(0).alias("_kind"), F.col("level").cast("int").alias("_level")
        ),
        allowMissingColumns=True,
    )
    order = Window.partitionBy(*groups).orderBy("key", "_kind")
    order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = {
        f"_slot{n}": F.last(F.when(F.col("_level") == n, F.col("key")), ignorenulls=True)
        .over(order)
        for n in levels
    }
    swept = events.withColumns(slots).where("_kind = 1")
    stack = F.filter(
        F.array(*[F.col(s) for s in slots]) if slots else F.array().cast("array<string>"),
        lambda rule: rule.isNotNull() & F.startswith(F.col("key"), rule),
    )
    return swept.select(*groups, "key", "_probe.*", stack.alias("stack"))


def nesting(rules: DataFrame) -> DataFrame:
    """Adds ``level`` to rules of ``node`` and ``key``: how many others of the node open the key.

    Each rule is looked up under its own beginnings, of the lengths that rules of its node have.
    """
    lengths = rules.groupBy("node").agg(F.collect_set(F.length("key")).alias("_lengths"))
    shorter = F.filter("_lengths", lambda n: n < F.length("key"))
    heads = (
        rules.join(lengths, "node")
        .select("node", "key", F.explode(shorter).alias("_n"))
        .select("node", "key", F.expr("left(key, _n)").alias("_head"))
    )
    opening = rules.select("node", F.col("key").alias("_head"))
    depth = (
        heads.join(opening, ["node", "_head"], "left_semi")
        .groupBy("node", "key")
        .agg(F.count(F.lit(1)).cast("int").alias("level"))
    )
    return rules.join(depth, ["node", "key"], "left").fillna(0, ["level"])


def levels_of(rules: DataFrame) -> list[int]:
    """Nesting levels that occur: labels of a host, or how deep path rules lie in each other."""
    return [r[0] for r in rules.select("level").distinct().orderBy("level").collect()]


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every page.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains
    if the page's path starts with the rule's. The longest fitting rule wins (host and path
    together; of equal length, the longer host; of one rule with several verdicts, the first
    in text order). Pages that no rule fits get no rule and the default verdict.

    Missing urls and urls without ``://`` have an empty host and path and fit no rule. Rules
    with a missing host, path or verdict are ignored. Repeated pages are kept. Columns of
    ``pages`` that have one of the added names are replaced.

    Both sweeps group by a prefix of the key and a hash of the path that is as wide as the
    session's shuffle, so one host or rule with a third of the pages is dealt over all tasks;
    rules are sent only to the groups that exist. Each distinct address is swept once.
    """
    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("path"), F.lit(spread)).cast("int")
    rules = rules.select("host", "path", "verdict").dropna()
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rules = staged(
        rules.withColumn("host", F.translate("host", UPPER, LOWER))
        .withColumn("node", host_key(F.col("host")))
        .withColumn("level", F.size(F.split("host", r"\."))),
        "url-rules",
    )
    added = ["host", "path", "rule", "verdict"]
    pages = pages.drop("rule", "verdict").withColumns(
        {"host": host_of(F.col(url)), "path": path_of(F.col(url))}
    )
    addresses = pages.select("host", "path").distinct().select(
        "host", "path", host_key(F.col("host")).alias("key"), salt.alias("salt")
    ).withColumn("domain", domain(F.col("key")))

    # First sweep: which rule hosts stand above an address.
    nodes = rules.select(F.col("node").alias("key"), "level").distinct()
    groups = addresses.select("domain", "salt").distinct()
    top = nodes.where("level = 1").withColumn("_top", F.substring_index("key", ".", 1))
    deep = nodes.where("level > 1").withColumn("domain", domain(F.col("key")))
    sent = deep.join(groups, "domain").select("domain", "salt", "key", "level").unionByName(
        groups.join(top, F.substring_index("domain", ".", 1) == F.col("_top")).select(
            "domain", "salt", "key", "level"
        )
    )
    on_hosts = sweep(addresses, sent, ["domain", "salt"], levels_of(nodes))

    # Second sweep: which path rules of these hosts the path starts with.
    probes = staged(
        on_hosts.select(
            "host", F.explode("stack").alias("node"), "salt", F.col("path").alias("key")
        ),
        "url-probes",
    )
    paths = staged(nesting(rules.select("node", F.col("path").alias("key"))), "url-paths")
    levels = levels_of(paths)
    sent = paths.join(probes.select("node", "salt").distinct(), "node")
    fitting = sweep(probes, sent, ["node", "salt"], levels).select(
        "host", F.col("key").alias("path"), "node", F.try_element_at("stack", F.lit(-1)).alias("_prefix")
    ) if levels else probes.select(
        "host", F.col("key").alias("path"), "node", F.lit(None).cast("string").alias("_prefix")
    )
    fitting = fitting.where(F.col("_prefix").isNotNull())
    named = rules.select(
        "node",
        F.col("path").alias("_prefix"),
        "verdict",
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("_host"),
        F.length(F.concat("host", "path")).alias("_length"),
    )
    best = (
        fitting.join(named, ["node", "_prefix"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct("_length", "_host")).alias("_best"))
    )
    judged = pages.join(best, ["host", "path"], "left")
    columns = [c for c in pages.columns if c not in added]
    return judged.select(
        *columns,
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
