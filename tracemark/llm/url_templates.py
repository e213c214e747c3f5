"""URL filter: explicit rules first, then a tree of path templates per host.

The tree grows level by level, all hosts at once. At each node a child segment with at least `LITERAL_PAGES` pages stays literal if it holds `SUPPORT` pages or
`LITERAL_SHARE` of the node's, or if the node's segments have `LITERAL_PAGES` pages on average (then they are sections, not identifiers), or if its share of good
labels differs significantly from that of the other segments that would be lumped with it. A node may have any number of literal children; all other segments
become `*`. Literal siblings that hold `LITERAL_SHARE` of the node's pages each are merged into one branch if their shares of good labels don't differ significantly;
a smaller section keeps a branch and a name of its own. The tree grows for as long as a node has `LITERAL_PAGES` pages that go deeper. Below, no segment can be literal: up to `TAIL` segments
become `*` each, more become `**`. Like branches of a node, whatever their size and number, are judged as one: templates that differ only in such branches, and whose own shares don't
differ significantly, have one purity. They are rejected if the share of good labels among their labelled pages, smoothed towards that of their host and of all pages, is below `PURITY`.

Edge cases: a null url, or one without `://`, has an empty host and path and is judged like any other host. Null labels don't count; with none at all
every template is allowed. Repeated rows count each. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.session import bounded_broadcast, by_key, materialise, new_folder

LITERAL_SHARE, LITERAL_PAGES, SUPPORT = 0.05, 5, 20
#: A segment is unlike the others from this z value of the difference of their shares on.
UNLIKE_Z = 2.58
TAIL = 8
#: Siblings merge while the z value of the difference of their shares stays below.
MERGE_Z = 1.64
SMOOTHING = 5.0
PURITY = 0.5
ALLOW, BLOCK = "allow", "block"

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    """A rule is a host and a path; it fits the host and its subdomains where the path starts with the rule's."""
    domain, slash, rest = rule.partition("/")
    return ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)


def longest_rule(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The longest of a short list of rules that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        found = F.when(rule_fits(rule, host, path), F.lit(rule)).otherwise(found)
    return found


def _differs(n_a: Column, good_a: Column, n_b: Column, good_b: Column, z: float) -> Column:
    """Whether two shares of good labels differ significantly."""
    n_a, n_b, good_a, good_b = n_a + 2, n_b + 2, good_a + 1, good_b + 1
    p = (good_a + good_b) / (n_a + n_b)
    return F.abs(good_a / n_a - good_b / n_b) >= z * F.sqrt(p * (1 - p) * (1 / n_a + 1 / n_b))


def _merged(children: Column) -> Column:
    """Fold children (seg, n, good; sorted by the share of good) into groups of neighbours whose shares don't differ significantly."""
    group = lambda segs, n, good: F.struct(segs.alias("segs"), n.alias("n"), good.alias("good"))

    def add(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        own = F.array(group(F.array(c["seg"]), c["n"], c["good"]))
        joined = F.array(group(F.concat(last["segs"], F.array(c["seg"])), last["n"] + c["n"], last["good"] + c["good"]))
        unlike = _differs(last["n"], last["good"], c["n"], c["good"], MERGE_Z)
        return F.when(F.size(done) == 0, own).when(unlike, F.concat(done, own)).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), joined))

    empty = F.expr("cast(array() as array<struct<segs: array<string>, n: bigint, good: bigint>>)")
    return F.aggregate(children, empty, add)


def _like(units: DataFrame) -> DataFrame:
    """`pool` of each unit (`host`, `node`, `token`, `n`, `good`): the least token of the units of its node, neighbours by share of good labels, that don't differ significantly.

    Units of equal counts never part, so the fold takes them at once: of a node with a million pages it sees ten thousand rows at most. It holds one group.
    """
    units = materialise(units.select("host", "node", "token", F.col("n").cast("long").alias("n"), F.col("good").cast("long").alias("good")), "url-units")
    key = ["host", "node", "n", "good"]
    classes = units.groupBy(*key).agg(F.count("*").alias("units"), F.min("token").alias("token")).withColumn("share", (F.col("good") + 1) / (F.col("n") + 2))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, all_n, all_good = None, 0, 0, 0
        for batch in batches:
            groups = []
            for host, node, n, good, units in zip(*(batch.column(c).to_pylist() for c in (*key, "units"))):
                n_a, good_a, n_b, good_b = all_n + 2, all_good + 1, n + 2, good + 1
                p = (good_a + good_b) / (n_a + n_b)
                if at != (host, node):
                    at, group, all_n, all_good = (host, node), 0, 0, 0
                elif abs(good_a / n_a - good_b / n_b) >= MERGE_Z * sqrt(p * (1 - p) * (1 / n_a + 1 / n_b)):
                    group, all_n, all_good = group + 1, 0, 0
                all_n, all_good = all_n + units * n, all_good + units * good
                groups.append(group)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*key, "token")), pa.array(groups, pa.int64())], [*key, "token", "group"])

    ordered = by_key(classes, "host", "node").sortWithinPartitions("host", "node", "share", "token", "n")
    folded = materialise(ordered.mapInArrow(fold, "host string, node string, n long, good long, token string, group long"), "url-folded")
    pools = materialise(folded.groupBy("host", "node", "group").agg(F.min("token").alias("pool")), "url-pools")
    named = materialise(folded.join(pools, ["host", "node", "group"]).select(*key, "pool"), "url-pooled")
    return units.join(named, key).select("host", "node", "token", "pool")


def _literals(children: DataFrame) -> DataFrame:
    """The children (`host`, `node`, `seg`, `pages`, `n`, `good`) that stay literal, and whether each is `large` in its node."""
    totals = children.groupBy("host", "node").agg(F.sum("pages").alias("all_pages"), F.count("*").alias("all_segs"))
    sections = F.col("all_pages") >= LITERAL_PAGES * F.col("all_segs")
    large = F.col("pages") >= LITERAL_SHARE * F.col("all_pages")
    judged = children.join(materialise(totals, "url-totals"), ["host", "node"]).withColumn("large", large)
    judged = judged.withColumn("literal", (F.col("pages") >= LITERAL_PAGES) & ((F.col("pages") >= SUPPORT) | F.col("large") | sections))
    judged = materialise(judged.drop("all_pages", "all_segs"), "url-judged")
    rest = judged.where("not literal").groupBy("host", "node").agg(F.sum("n").alias("rest_n"), F.sum("good").alias("rest_good"))
    doubtful = judged.where(~F.col("literal") & (F.col("pages") >= LITERAL_PAGES)).join(materialise(rest, "url-rest"), ["host", "node"])
    unlike = doubtful.where(_differs(F.col("n"), F.col("good"), F.col("rest_n") - F.col("n"), F.col("rest_good") - F.col("good"), UNLIKE_Z))
    columns = [*children.columns, "large"]
    return judged.where("literal").select(columns).unionByName(unlike.select(columns))


def _branches(literal: DataFrame) -> DataFrame:
    """`token` of the branch of each literal child (`host`, `node`, `seg`), and `pool`, the branches of the node that are like it."""
    literal = materialise(literal, "url-literals")
    child = F.struct(((F.col("good") + 1) / (F.col("n") + 2)).alias("share"), "seg", "n", "good")
    grouped = literal.where("large").groupBy("host", "node").agg(F.sort_array(F.collect_list(child)).alias("children"))  # 1 / LITERAL_SHARE of them fit a node
    grouped = grouped.select("host", "node", F.explode(_merged(F.col("children"))).alias("g"))
    merged = grouped.select("host", "node", F.array_join(F.array_sort("g.segs"), "|").alias("token"), F.explode("g.segs").alias("seg"))
    named = materialise(literal.where("not large").select("host", "node", F.col("seg").alias("token"), "seg").unionByName(merged), "url-tokens")
    units = literal.join(named, ["host", "node", "seg"]).groupBy("host", "node", "token").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    return named.join(_like(units), ["host", "node", "token"])


def templates(pages: DataFrame) -> DataFrame:
    """Add `template` and `pool`, the template of its like branches, to pages (`page_id`, `host`, `path`, `good`: 1, 0 or null)."""
    spark = pages.sparkSession
    base = new_folder(spark, "url-nodes")
    rows = pages.select("page_id", "host", "path", "good", F.filter(F.split("path", "/"), lambda s: s != "").alias("segs"), F.lit("").alias("node"), F.lit("").alias("pool"))
    rows = rows.withColumn("done", F.size("segs") == 0)
    schema, depth = rows.schema, 0
    rows.write.parquet(f"{base}/level=0")
    while True:
        here = spark.read.schema(schema).parquet(f"{base}/level={depth}").where("not done").withColumn("seg", F.get("segs", F.lit(depth)))
        if here.isEmpty():
            break
        deeper = F.count_if(F.size("segs") > depth + 1)
        children = here.groupBy("host", "node", "seg").agg(F.count("*").alias("pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"), deeper.alias("deeper"))
        children = materialise(children, "url-children")
        named = materialise(_branches(_literals(children.drop("deeper"))), "url-branches")
        # of each branch, the pages that go deeper
        told = children.join(bounded_broadcast(named, 100_000), ["host", "node", "seg"], "left").withColumn("token", F.coalesce("token", F.lit("*")))
        grown = told.groupBy("host", "node", "token").agg((F.sum("deeper") >= LITERAL_PAGES).alias("grows"), F.coalesce(F.min("pool"), "token").alias("like"))
        grown = materialise(grown, "url-grown")
        joined = here.join(bounded_broadcast(named.drop("pool"), 100_000), ["host", "node", "seg"], "left").withColumn("token", F.coalesce("token", F.lit("*")))
        joined = joined.join(bounded_broadcast(grown, 100_000), ["host", "node", "token"])
        node, pool, left = F.concat("node", F.lit("/"), "token"), F.concat("pool", F.lit("/"), "like"), F.size("segs") - (depth + 1)
        tail = F.when(left > TAIL, "/**").otherwise(F.repeat(F.lit("/*"), left))
        ended = lambda path: F.when(F.col("grows"), path).otherwise(F.concat(path, tail))
        step = joined.select("page_id", "host", "path", "good", "segs", ended(node).alias("node"), ended(pool).alias("pool"), (~F.col("grows") | (left == 0)).alias("done"))
        depth += 1
        step.write.parquet(f"{base}/level={depth}")
    leaves = spark.read.schema(schema).parquet(*[f"{base}/level={d}" for d in range(depth + 1)]).where("done")
    end = F.when(F.col("path").endswith("/") & ~F.col("node").endswith("/**"), "/").otherwise("")
    return leaves.select("page_id", "host", "path", "good", F.concat("node", end).alias("template"), F.concat("pool", end).alias("pool"))


def judge(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict`, `template` and its `purity` for pages (`page_id`, `url`, `good`)."""
    url = F.col("url")
    cut = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "good")
    rows = materialise(templates(cut), "url-templates")
    share = lambda n, good, prior: (good + SMOOTHING * prior) / (n + SMOOTHING)
    counted = rows.groupBy("host", "template").agg(F.min("pool").alias("node"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    counted = materialise(counted, "url-counts")
    overall = counted.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = overall["good"] / overall["n"] if overall["n"] else 1.0
    hosts = counted.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    host_share = share(F.col("host_n"), F.col("host_good"), F.lit(prior))
    likened = _like(counted.withColumnRenamed("template", "token")).withColumnRenamed("token", "template")
    likened = materialise(counted.join(likened, ["host", "node", "template"]), "url-likened")
    pooled = materialise(likened.groupBy("host", "node", "pool").agg(F.sum("n").alias("pool_n"), F.sum("good").alias("pool_good")), "url-pool-counts")
    pure = likened.join(pooled, ["host", "node", "pool"]).join(hosts, "host").select("host", "template", share(F.col("pool_n"), F.col("pool_good"), host_share).alias("purity"))
    rule = longest_rule(rules, F.col("host"), F.col("path"))
    by_rule = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items())) if rules else F.lit(None).cast("string")
    out = rows.join(bounded_broadcast(materialise(pure, "url-purity"), 100_000), ["host", "template"]).withColumn("rule", rule)
    verdict = F.coalesce(by_rule, F.when(F.col("purity") < PURITY, BLOCK).otherwise(ALLOW))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def looks_good(html: Column) -> Column:
    """Label of a page by its visible text: 1, or 0 if symbols or capitals abound; null with fewer than 20 letters."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&[a-z]+;", " ")
    length = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    letters = length(r"\P{L}+")
    bad = (length(r"[^#*$%&|<>!]+") > 0.04 * letters) | (length(r"\P{Lu}+") > 0.4 * letters)
    return F.when(letters >= 20, F.when(bad, 0).otherwise(1))
