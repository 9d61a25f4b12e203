"""URL filters: given host and path rules first, then association rules mined by FP-growth from labelled URLs.

Given rules match through an index: a URL's host suffixes look up the rules of that host, and the longest rule whose path begins the URL's
path wins. Mined rules are token combinations that mean `block` with enough support, and with more confidence than the share of blocked URLs explains; each is indexed under
its rarest item, so a URL meets only rules that share that with it, and then its other items are compared.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Given rules: verdict, rule (host, then path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIN_SUPPORT = 0.002
#: Of the URLs that a rule fits at least half are blocked; and so many more than of all are that chance would give as many hits only so often.
MIN_CONFIDENCE = 0.5
CHANCE = 1e-5
#: Labelled URLs that must bear a rule out, however few there are.
MIN_COUNT = 10
#: Rules up to which an index is broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 100_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as a-z) and path; both empty for a null or an address without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, and words of path and query, each marked with where it stands.

    Digits count as 0 and runs of them as one, so that numbers don't make every address a word of its own.
    """
    host, path = parts(url)
    masked = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    scheme = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"(?s)^([^:/?#]*)://", 1)
    marked = F.concat(
        F.array(F.concat(F.lit("s:"), scheme)),
        F.transform(F.split(masked(host), r"\."), lambda t: F.concat(F.lit("h:"), t)),
        F.transform(F.split(masked(path), r"[^\p{L}\p{N}]+"), lambda t: F.concat(F.lit("p:"), t)),
        F.transform(F.split(masked(query), r"[^\p{L}\p{N}]+"), lambda t: F.concat(F.lit("q:"), t)),
    )
    return F.array_distinct(F.filter(marked, lambda t: (F.length(t) > 2) & ~t.rlike(r"\s")))


def weighed(hits: Column, n: Column, base: float, min_confidence: float, chance: float) -> Column:
    """Does a set of tokens that n labelled URLs hold, of which `hits` are blocked, say more than the share `base` of all that are blocked?

    Its confidence must reach min_confidence and the base, and so many hits must have a chance of at most `chance` among URLs of which the base's share is blocked (by Chernoff's bound on the binomial tail).
    """
    share = hits / n
    if not 0 < base < 1:
        return F.lit(False)  # all or none are blocked: nothing to tell apart
    away = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return (share >= max(min_confidence, base)) & (n * away >= -math.log(chance))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, chance: float = CHANCE, min_count: int = MIN_COUNT) -> DataFrame:
    """Rules from rows (url, blocked boolean): antecedent (array of items, each an array of tokens that stand for one another), confidence, support, n (URLs that hold it).

    Every set of tokens that enough blocked URLs hold (min_count and the share min_support of all, whichever is more) and that is weighed() as evidence is a rule, or a rule of fewer
    tokens covers all URLs that it covers:

    - tokens that occur in just the same labelled URLs are one item, and a URL with any of them has it;
    - items that all labelled URLs have are left out, as they change no count; items that are rules alone stand in no longer rule;
    - a rule goes if one of fewer items, all of them its own, has at least its confidence.

    FP-growth runs on the blocked URLs alone, as no set has more hits than a part of it; the sets it finds are then counted in all labelled URLs by an inverted index. Null urls and labels are left out.
    """
    rows = labelled.where("url is not null and blocked is not null").select("blocked", tokens(F.col("url")).alias("items"))
    baskets = common.stored(rows.withColumn("basket", F.monotonically_increasing_id()), "baskets")
    sums = baskets.agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked")).first()
    n, base = sums["n"], (sums["blocked"] or 0) / max(1, sums["n"])
    least = max(min_count, math.ceil(min_support * n), 1)
    good = lambda hits, size: weighed(F.col(hits), F.col(size), base, min_confidence, chance)
    found = baskets.select("basket", "blocked", F.explode("items").alias("token"))
    counts = found.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("hits"), F.bit_xor(F.xxhash64("basket")).alias("a"), F.bit_xor(F.xxhash64("basket", F.lit(1))).alias("b"))
    same = counts.where((F.col("hits") >= least) & ((F.col("n") < n) | good("hits", "n"))).groupBy("n", "hits", "a", "b").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("tokens"))
    items = common.stored(same.select("item", "tokens", "n", "hits", good("hits", "n").alias("alone")), "items")
    # One basket for each blocked URL's item that is a rule alone, and one for all of its other items: so FP-growth makes rules of one item and of more in one run.
    kept = found.where("blocked").join(common.small(items.select(F.col("item").alias("token"), "alone"), BROADCAST_RULES), "token")
    single = kept.where("alone").select(F.array("token").alias("items"))
    several = common.stored(single.unionByName(kept.where("not alone").groupBy("basket").agg(F.collect_list("token").alias("items")).select("items")), "several")
    size = several.count()
    if not size:
        return common.stored(items.select(F.array("tokens").alias("antecedent"), (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / F.lit(n)).alias("support"), "n").where("false"), "rules")
    # Half a basket less, so that rounding in the library can't ask for one more.
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / size)).fit(several).freqItemsets
    sets = common.stored(sets.select(F.sort_array("items").alias("items"), F.col("freq").alias("hits")).withColumn("id", F.monotonically_increasing_id()), "item_sets")
    # In how many labelled URLs do they stand? Each set under its rarest item.
    apart = sets.select("id", F.size("items").alias("size"), F.explode("items").alias("item")).join(items.select("item", "n"), "item")
    rarest = apart.groupBy("id").agg(F.min_by("item", F.struct("n", "item")).alias("token"), F.min("n").alias("n"), F.first("size").alias("size"))
    wider = sets.join(rarest.where("size > 1"), "id").select("id", "token", "items")
    holders = baskets.select("basket", F.col("items").alias("held"), F.explode("items").alias("token"))
    totals = holders.join(wider, "token").where(F.size(F.array_except("items", "held")) == 0).groupBy("id").agg(F.count("*").alias("n"))
    totals = totals.unionByName(rarest.where("size = 1").select("id", "n"))
    made = sets.join(totals, "id").where(good("hits", "n")).select("id", "items", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / F.lit(n)).alias("support"), "n")
    made = common.stored(made, "rules")
    # A simpler rule shares its first item with the rule it prunes, so rules meet by item, not pair by pair.
    simple = made.select(F.col("items").alias("a"), F.col("confidence").alias("c"), F.element_at("items", 1).alias("item"))
    pruned = made.select("id", "items", "confidence", F.explode("items").alias("item")).join(simple, "item")
    pruned = pruned.where((F.size("a") < F.size("items")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("a", "items")) == 0))
    rules = made.join(pruned.select("id").distinct(), "id", "left_anti")
    spelled = rules.select("id", F.posexplode("items").alias("place", "item")).join(items.select("item", "tokens"), "item").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "tokens"))).alias("all"))
    return common.stored(rules.join(spelled, "id").select(F.col("all.tokens").alias("antecedent"), "confidence", "support", "n"), "mined")


def judge(pages: DataFrame, mined: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, n_mined (mined rules that fit) of every row.

    The longest fitting given rule decides (of equal ones the first in code-point order); else a URL is blocked if a mined rule fits, and otherwise
    allowed. Null, empty and odd addresses have an empty host and path, no rule, and are allowed. Equal rows and ids stay rows of their own;
    an empty table gives none; other columns aren't read.
    """
    spark = pages.sparkSession
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(tokens(F.col(url_col)), F.array().cast("array<string>")).alias("tokens"))
    rows = common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
    given = spark.createDataFrame([(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules], "given string, rule string, rule_host string, rule_path string")
    # Suffixes of the host that are the host or follow a dot.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = rows.where("host <> ''").select("row", "path", F.explode(suffixes).alias("rule_host")).join(common.small(given, BROADCAST_RULES), "rule_host")
    fits = fits.where(F.startswith("path", "rule_path")).groupBy("row").agg(F.max_by(F.struct("rule", "given"), F.struct(F.length("rule"), F.col("rule"))).alias("best"))
    # Each mined rule under the tokens of its rarest item.
    seen = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rules = common.stored(mined.select("antecedent").withColumn("rule_id", F.monotonically_increasing_id()), "mined_rules")
    indexed = rules.select("rule_id", F.posexplode("antecedent").alias("place", "alike")).select("rule_id", "place", F.explode("alike").alias("token")).join(seen, "token", "left")
    indexed = indexed.groupBy("rule_id", "place").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")).groupBy("rule_id").agg(F.min_by("place", F.struct("n", "place")).alias("place"))
    indexed = rules.join(indexed, "rule_id").select("rule_id", "antecedent", F.explode(F.get("antecedent", F.col("place"))).alias("token"))
    hits = rows.select("row", "tokens", F.explode("tokens").alias("token")).join(common.small(common.stored(indexed, "index"), BROADCAST_RULES), "token")
    hits = hits.where(F.forall("antecedent", lambda alike: F.arrays_overlap(alike, "tokens"))).select("row", "rule_id").distinct().groupBy("row").agg(F.count("*").alias("n_mined"))
    out = rows.join(fits, "row", "left").join(hits, "row", "left")
    verdict = F.coalesce(F.col("best.given"), F.when(F.coalesce("n_mined", F.lit(0)) > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("n_mined", F.lit(0)).alias("n_mined"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; rules are mined from the pages whose documents have a quality label (0: block)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("blocked"))
    return judge(pages, mine(pages.select("page_id", "url").join(labels, "page_id").select("url", "blocked")))
