"""URL filter by association rules that FP-growth mines from labelled URLs.

A URL's tokens: its host and all the host's parent domains, its first label, path segments, the first directory, query
keys and key=value pairs, the fragment and the file extension. Tokens that stand in exactly the same labelled URLs are mined as
one and told apart again in the rules, so a long URL's tokens do not make subsets of each other. Tokens of one class only make a
rule each, which longer ones never beat. Labelled URLs' other tokens, with their class as one more, are mined by Spark's
FP-growth, which has no bound on the length of its sets: a token that is beyond the MOST_ITEMS most frequent of some URL is
crowded, and sets with crowded tokens are counted size by size, so every set of up to LONGEST tokens has its exact counts.
Rules of at most LONGEST tokens that end in a class are kept from `min_support` (LEAST URLs at least) and
`min_confidence` on, unless leaving out one token gives a rule as sure. Rules match through an inverted index: a rule is listed under its rarest token,
meets the URLs that have it, and fires when all its tokens are there. Of the rules that fire the surest counts, then the best supported, then
the smallest id; where none fires, the class that most labels have.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_id, stash, table

#: Rules given by hand: (host, path prefix, verdict).
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCK, ALLOW = "class=block", "class=allow"
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: The fewest labelled URLs of a rule, the most groups of tokens of one URL that FP-growth gets, and the most tokens of a rule.
LEAST, MOST_ITEMS, LONGEST = 3, 12, 4
#: Rules that are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 200_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies after the first :// up to / ? # or the end, and then up to ? # or the end. Both empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def listed_rule(host: Column, path: Column) -> Column:
    """The longest listed rule that fits, as host and path in one string; else null."""
    found = F.lit(None).cast("string")
    for own, prefix, _ in sorted(LISTED, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        found = F.when(fits, F.lit(own + prefix)).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """array<string>, distinct, never null. Of the host: itself and its parents, its first label of over two."""
    nothing = F.array().cast("array<string>")
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".")))
    first = F.when(F.size(labels) > 2, F.array(F.concat(F.lit("sub="), F.element_at(labels, 1)))).otherwise(nothing)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x: F.concat(F.lit("path="), x))
    directory = F.when(F.size(parts) > 0, F.array(F.concat(F.lit("dir=/"), F.element_at(parts, 1), F.lit("/")))).otherwise(nothing)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    keys = F.transform(pairs, lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    values = F.transform(pairs, lambda x: F.concat(F.lit("pair="), x))
    fragment = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)#(.*)$", 1)
    mark = F.when(fragment != "", F.array(F.concat(F.lit("frag="), fragment))).otherwise(nothing)
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    kind = F.when(extension != "", F.array(F.concat(F.lit("ext="), ascii_lower(extension)))).otherwise(nothing)
    return F.when(host == "", nothing).otherwise(F.array_distinct(F.concat(hosts, first, segments, directory, keys, values, mark, kind)))


def tokenised(pages: DataFrame) -> DataFrame:
    """page_id, url -> page_id, host, path, tokens."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    return parts.select("page_id", "host", "path", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))


def crowded_sets(ones: DataFrame, singles: DataFrame, least: int) -> list[DataFrame]:
    """[(nos, times, bad)] for 2 to LONGEST tokens: how many labelled URLs hold all tokens of a set with a crowded one, and how many of these are blocked.

    ones (uid, blocked, no) and singles (no, times) have tokens by number, below 0 where they are crowded; nos are in order. A set grows by
    one token as long as it has both classes, stands in fewer URLs than without any of its tokens, and one class has `least` of its
    URLs: of any other set, no set that has more tokens makes a rule that stays.
    """
    out = []
    held = ones.join(ones.where("no < 0").select("uid").distinct(), "uid", "left_semi").select("uid", "blocked", F.array().cast("array<long>").alias("head"), F.col("no").alias("last"))
    growing = singles.select(F.array("no").alias("nos"), "times")
    for size in range(2, LONGEST + 1):
        left, right = held.where("last < 0") if size == 2 else held, held.select("uid", "head", F.col("last").alias("next"))
        met = left.join(right, ["uid", "head"]).where("last < next").select("uid", "blocked", F.array_append("head", F.col("last")).alias("head"), F.col("next").alias("last"))
        sets = met.groupBy("head", "last").agg(F.count("*").alias("times"), F.sum("blocked").alias("bad")).where(f"greatest(bad, times - bad) >= {least}")
        sets = stash(sets.withColumn("nos", F.array_append("head", F.col("last"))), "url-sets")
        less = sets.select("nos", "times", F.explode("nos").alias("out")).select("nos", "times", F.array_remove("nos", F.col("out")).alias("less"))
        less = less if size == 2 else less.where(F.element_at("less", 1) < 0)  # sets without a crowded token are FP-growth's
        less = less.join(growing.select(F.col("nos").alias("less"), F.col("times").alias("without")), "less", "left")
        less = less.groupBy("nos").agg(F.min(F.coalesce("without", F.lit(0))).alias("without"))
        sets = stash(sets.join(less, "nos").where("without > 0"), "url-sets-counted")
        out.append(sets.select("nos", "times", "bad"))
        alive = sets.where("without > times and bad > 0 and bad < times")
        if size == LONGEST or alive.isEmpty():
            break
        growing = alive.select("nos", "times")
        held = stash(met.join(alive.select("head", "last"), ["head", "last"], "left_semi").select("uid", "blocked", "head", "last"), "url-sets-held")
    return out


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, rarest, verdict, confidence, support) from (tokens, blocked boolean). No rows where there are no labels."""
    base = stash(labelled.where("blocked is not null").select(row_id().alias("uid"), F.array_distinct("tokens").alias("tokens"), F.col("blocked").cast("int").alias("blocked")), "url-labelled")
    total = base.count()
    least = max(LEAST, math.ceil(min_support * total - 1e-9))
    met = base.select("uid", "blocked", F.explode("tokens").alias("token"))
    # Tokens with one set of URLs: the digests of their URLs add up to the same.
    single = met.groupBy("token").agg(F.count("*").alias("times"), F.sum("blocked").alias("bad"), F.bit_xor(F.xxhash64("uid")).alias("a"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("b")).where(F.col("times") >= least)
    groups = single.groupBy("times", "bad", "a", "b").agg(F.min("token").alias("item"), F.array_sort(F.collect_set("token")).alias("alike"))
    groups = stash(groups.select("item", "alike", "times", "bad"), "url-tokens-alike")
    # One token of a group stands for all of them. A rule of one class's token is as sure as any that has more tokens.
    mixed = groups.where(f"bad > 0 and bad < times and greatest(bad, times - bad) >= {least}").select("item", "times", "bad")
    placed = met.join(mixed.select(F.col("item").alias("token"), (-F.col("times")).alias("rare")), "token")
    placed = stash(placed.withColumn("place", F.row_number().over(Window.partitionBy("uid").orderBy("rare", "token"))).select("uid", "blocked", "token", "place"), "url-items")
    crowded = placed.where(F.col("place") > MOST_ITEMS).select(F.col("token").alias("item")).distinct().withColumn("crowded", F.lit(True))
    numbered = mixed.join(crowded, "item", "left").select("item", "times", "bad", F.when(F.col("crowded"), -1 - row_id()).otherwise(row_id()).alias("no"))
    numbered = stash(numbered, "url-numbered")  # below 0: crowded
    items = placed.join(numbered.where("no >= 0").select(F.col("item").alias("token")), "token").groupBy("uid").agg(F.collect_list("token").alias("tokens"))
    own_class = F.array(F.when(F.col("blocked") == 1, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    baskets = base.select("uid", "blocked").join(items, "uid", "left").select(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), own_class).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (least - 0.5) / max(1, total))), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & F.element_at("consequent", 1).isin(BLOCK, ALLOW) & (F.size("antecedent") <= LONGEST))
    rules = rules.where(~F.array_contains("antecedent", BLOCK) & ~F.array_contains("antecedent", ALLOW))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.when(F.element_at("consequent", 1) == BLOCK, "block").otherwise("allow").alias("verdict"), "confidence", "support")
    counted = groups.where("bad = 0 or bad = times").select(F.array("item").alias("tokens"), "times", "bad")
    if not numbered.where("no < 0").isEmpty():
        counted = counted.unionByName(numbered.where("no < 0").select(F.array("item").alias("tokens"), "times", "bad"))
        ones = placed.join(numbered.select(F.col("item").alias("token"), "no"), "token").select("uid", "blocked", "no")
        for sets in crowded_sets(ones, numbered.select("no", "times"), least):
            named = sets.select("nos", "times", "bad", F.explode("nos").alias("no")).join(numbered.select("no", "item"), "no")
            counted = counted.unionByName(named.groupBy("nos", "times", "bad").agg(F.array_sort(F.collect_list("item")).alias("tokens")).drop("nos"))
    for verdict, hits in (("block", F.col("bad")), ("allow", F.col("times") - F.col("bad"))):
        sure = counted.where((hits >= least) & (hits / F.col("times") >= min_confidence))
        rules = rules.unionByName(sure.select("tokens", F.lit(verdict).alias("verdict"), (hits / F.col("times")).alias("confidence"), (hits / F.lit(max(1, total))).alias("support")))
    rules = stash(rules.withColumn("rule_id", F.sha2(F.concat_ws("\x01", "verdict", "tokens"), 256)), "url-rules")
    # A rule goes if leaving out one of its tokens gives a rule as sure.
    shorter = rules.where(F.size("tokens") > 1).select("rule_id", "verdict", "confidence", F.explode("tokens").alias("out"), "tokens")
    shorter = shorter.select("rule_id", "confidence", F.sha2(F.concat_ws("\x01", "verdict", F.array_remove(F.col("tokens"), F.col("out"))), 256).alias("less"))
    beaten = shorter.join(rules.select(F.col("rule_id").alias("less"), F.col("confidence").alias("sure")), "less").where("sure >= confidence").select("rule_id").distinct()
    kept = rules.join(beaten, "rule_id", "left_anti").select("tokens", "verdict", "confidence", "support", F.array().cast("array<string>").alias("all"))
    for place in range(1, LONGEST + 1):  # each token by all that stand where it does
        here = F.get("tokens", F.lit(place - 1))
        own = groups.select(F.col("item").alias("here"), "alike")
        kept = kept.withColumn("here", here).join(own, "here", "left").select("tokens", "verdict", "confidence", "support", "all", F.explode_outer("alike").alias("one"))
        kept = kept.select("tokens", "verdict", "confidence", "support", F.when(F.col("one").isNull(), F.col("all")).otherwise(F.array_append("all", F.col("one"))).alias("all"))
    kept = kept.select(F.array_sort("all").alias("tokens"), "verdict", "confidence", "support")
    kept = stash(kept.withColumn("rule_id", F.sha2(F.concat_ws("\x01", "verdict", "tokens"), 256)), "url-rules-kept")
    times = groups.select(F.explode("alike").alias("token"), "times")
    rarest = kept.select("rule_id", F.explode("tokens").alias("token")).join(times, "token").groupBy("rule_id").agg(F.min(F.struct("times", "token"))["token"].alias("rarest"))
    return kept.join(rarest, "rule_id")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(uid, verdict, confidence): the rule that counts for each row of urls (uid, tokens) for which one fires."""
    index = stash(rules.select(F.col("rarest").alias("token"), F.col("tokens").alias("all"), F.struct((-F.col("confidence")).alias("unsure"), (-F.col("support")).alias("rare"), "rule_id", "verdict").alias("rule")), "url-index")
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    met = urls.select("uid", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    fired = met.where(F.size(F.array_except("all", "tokens")) == 0)
    return fired.groupBy("uid").agg(F.min("rule").alias("best")).select("uid", F.col("best.verdict").alias("verdict"), (-F.col("best.unsure")).alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence for each row of pages (page_id, url).

    labels (doc_id, quality, toxic) are of pages by id: a page of low quality or toxic is one to block. Null labels
    count for nothing; of several labels of a page one that blocks wins. URLs that are null, empty or without :// have no
    tokens and get the class that most labels have, allow if there are none. Repeated pages are judged alike. The listed
    rules go before the mined ones; confidence is null for them.
    """
    uid = row_id().alias("uid")
    parts = stash(tokenised(pages.select("page_id", "url")).select(uid, "*"), "url-tokens")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.where("doc_id is not null").select(F.col("doc_id").alias("page_id"), F.coalesce(bad, F.lit(False)).alias("bad"), F.coalesce(F.col("quality"), F.col("toxic")).alias("any")).where("any is not null")
    known = known.groupBy("page_id").agg(F.max("bad").alias("blocked"))
    labelled = parts.join(known, "page_id").select("tokens", "blocked")
    share = labelled.agg(F.avg(F.col("blocked").cast("int"))).first()[0]
    default = "block" if (share or 0) > 0.5 else "allow"
    rules = mine(labelled, min_support, min_confidence) if share is not None else None
    judged = parts
    if rules is not None:
        judged = parts.join(match(parts, rules), "uid", "left")
    else:
        judged = parts.withColumn("verdict", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    rule = listed_rule(F.col("host"), F.col("path"))
    by_hand = F.coalesce(*[F.when(rule == own + prefix, F.lit(verdict)) for own, prefix, verdict in LISTED])
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_hand, "verdict", F.lit(default)).alias("verdict"), F.when(rule.isNull(), F.col("confidence")).alias("confidence"))


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    """What `judge` says of every page. Null, empty and very long urls are judged, repeated pages alike; without labels all that no listed rule blocks is allowed."""
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
