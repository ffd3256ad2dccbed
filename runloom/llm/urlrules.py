"""URL filters as a sort-merge range join, in column functions alone.

A host's labels are written backwards, each with a dot behind it, so a host and all its subdomains are one interval of
keys: those that begin with the host's key. Path prefixes are intervals likewise. Points (urls) and intervals (rules) are
sorted together; intervals of this kind nest or are apart, so a sweep needs a stack of the rules that are open. After a
rule's start the stack holds the rule and the earlier rules that enclose it. A point takes the stack of the last start
before it and pops what has ended, which are the rules that its key does not begin with.

Two sweeps find a url's rules: one over host keys, giving the stack of nested hosts that have rules, and one over paths
below each of these hosts, giving the longest path. Of all rules that fit, the longest (host and path together, then host)
wins; urls that no rule fits get ``DEFAULT``.

The order is cut into ranges of about equal size, ties split by a random number, so neither a hot host nor a repeated url
gathers in one task; a range begins with the stack that the ranges before it leave. Rules are folded into stacks in blocks
of about ``RULES`` in the same way. NULL urls and urls without ``://`` have an empty host and path. Repeated rows give a row
each. Rules with a NULL host or action are none, a NULL path is empty; of equal rules ``block`` wins. Empty tables give no
rows, an empty rule set the default for all. Other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.text import written

ALLOW, BLOCK = "allow", "block"
#: Verdict where no rule fits.
DEFAULT = ALLOW
#: Rules that one fold takes, about.
RULES = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STACK = "array<struct<key:string,action:string>>"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels backwards, a dot behind each."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def still_open(stack: Column, group: Column, key: Column, of: Column) -> Column:
    """The stack without the rules of another group and those whose interval ends before the key."""
    return F.filter(stack, lambda x: (of == group) & key.startswith(x["key"]))


def stacked(rules: DataFrame) -> DataFrame:
    """(group, key, stack) of rules (group, key, action): the rule and those that enclose it, outermost first."""
    spark = rules.sparkSession
    blocks = max(1, -(-rules.count() // RULES))
    own = written(rules.repartitionByRange(blocks, "group", "key").withColumn("block", F.spark_partition_id()), "url-rules", spark)
    runs = own.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("group", "key", "action"))).alias("run"))
    # What is open where a block begins: rules of earlier blocks that are prefixes of its first key.
    first = runs.select("block", F.col("run")[0]["group"].alias("group"), F.col("run")[0]["key"].alias("first"))
    prefixes = first.select("block", "group", F.explode(F.sequence(F.lit(0), F.length("first"))).alias("n"), "first").filter(
        F.col("n") < F.length("first")).select("block", "group", F.col("first").substr(F.lit(1), F.col("n")).alias("key"))
    open_before = prefixes.join(own.drop("block"), ["group", "key"]).groupBy("block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.length("key"), "key", "action"))), lambda x: F.struct(x["key"], x["action"])).alias("before"))
    ready = runs.join(open_before, "block", "left").select("run", F.coalesce("before", F.array()).cast(STACK).alias("before"))

    def push(state: Column, rule: Column) -> Column:
        stack = F.concat(still_open(state["stack"], state["group"], rule["key"], rule["group"]), F.array(F.struct(rule["key"], rule["action"])))
        entry = F.struct(rule["group"].alias("group"), rule["key"].alias("key"), stack.alias("stack"))
        return F.struct(rule["group"].alias("group"), stack.alias("stack"), F.concat(state["out"], F.array(entry)).alias("out"))

    start = F.struct(F.col("run")[0]["group"].alias("group"), F.col("before").alias("stack"),
                     F.array().cast(f"array<struct<group:string,key:string,stack:{STACK}>>").alias("out"))
    return ready.select(F.inline(F.aggregate("run", start, push, lambda state: state["out"])))


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """Points (group, key, …) with ``stack``: the rules (group, key, action) of their group that their key begins with, shortest first."""
    spark = points.sparkSession
    starts = stacked(rules).withColumn("kind", F.lit(0))
    events = points.withColumn("kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    ranged = written(events.repartitionByRange("group", "key", "kind", F.rand(7)).withColumn("range", F.spark_partition_id()), "url-ranges", spark)
    # A row for each range: the last start in it, and from these the last one before it.
    ends = ranged.groupBy("range").agg(F.max(F.when(F.col("kind") == 0, F.struct("group", "key", "stack"))).alias("end"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("range", F.last("end", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("range").orderBy("group", "key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.last(F.when(F.col("kind") == 0, F.struct("group", "key", "stack")), ignorenulls=True).over(within)
    seen = ranged.withColumn("own", own).filter("kind = 1").join(F.broadcast(carried), "range").withColumn(
        "last", F.coalesce("own", "carried"))
    stack = still_open(F.coalesce("last.stack", F.array().cast(STACK)), F.col("last.group"), F.col("key"), F.col("group"))
    return seen.select(*points.columns, stack.alias("stack"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page (page_id, url) by the rules (host, path, action)."""
    spark = pages.sparkSession
    own = rules.filter(F.col("host").isNotNull() & F.col("action").isNotNull()).groupBy(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("action").alias("action"))
    own = written(own.select(host_key(F.col("host")).alias("host_key"), "path", "action"), "url-rule-set", spark)
    hosts = own.select(F.lit("").alias("group"), F.col("host_key").alias("key"), F.lit("").alias("action")).distinct()
    paths = own.select(F.col("host_key").alias("group"), F.col("path").alias("key"), "action")

    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    points = urls.select(F.lit("").alias("group"), host_key(F.col("host")).alias("key"), "page_id", "host", "path")
    nested = written(sweep(points, hosts).select("page_id", "host", "path", F.transform("stack", lambda x: x["key"]).alias("hosts"),
                                                 F.monotonically_increasing_id().alias("row")), "url-hosts", spark)
    none = nested.filter(F.size("hosts") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT).alias("verdict"))
    below = nested.filter(F.size("hosts") > 0).select(
        F.explode("hosts").alias("group"), F.col("path").alias("key"), "page_id", "host", "path", "row")
    longest = F.get("stack", F.size("stack") - 1)
    fits = sweep(below, paths).withColumn("top", longest).select("page_id", "host", "path", "row", F.when(
        F.col("top").isNotNull(), F.struct((F.length("group") + F.length("top.key")).alias("n"), F.length("group").alias("n_host"),
                                           "group", F.col("top.key").alias("key"), F.col("top.action").alias("action"))).alias("fit"))
    best = fits.groupBy("row", "page_id", "host", "path").agg(F.max("fit").alias("fit"))
    name = F.array_join(F.reverse(F.slice(F.split("fit.group", r"\."), 1, F.size(F.split("fit.group", r"\.")) - 1)), ".")
    judged = best.select("page_id", "host", "path", F.concat(name, F.col("fit.key")).alias("rule"),
                         F.coalesce("fit.action", F.lit(DEFAULT)).alias("verdict"))
    return judged.unionByName(none)
