"""URL filters (operator 10): listed domain rules, then association rules mined from labelled pages.

FP-growth finds token combinations of labelled urls that go with a bad label. Rules under the limits of support or
confidence go, and so does a rule that adds tokens to another without more confidence. The rest are matched by an
inverted index: a rule lies under its rarest token and is compared in full with the urls that hold that token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, split_join

#: (verdict, host, path prefix); the longest that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT = 0.001
#: Labelled urls that a rule must cover at least, whatever their number.
MIN_PAGES = 5
MIN_CONFIDENCE = 0.5
_BAD = "label:bad"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one; a rule fits its host and all subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule, verdict = F.when(fits, domain + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, segments of the path and keys of the query; numbers are one token."""
    after = lambda p: F.coalesce(F.regexp_extract(url, p, 1), F.lit(""))
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))
    keys = F.transform(F.split(after(r"(?s)\?([^#]*)"), "&"), lambda x: F.substring_index(x, "=", 1))
    segments = F.split(F.regexp_replace(F.lower(path_of(url)), "[0-9]+", "0"), "[/.]")
    return F.array_distinct(F.concat(named("scheme", F.array(F.lower(after(r"(?s)^(.*?)://")))), named("host", F.split(host_of(url), "[.-]")), named("path", segments), named("query", keys)))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """`rule` (sorted tokens), `confidence`, from `tokens` and boolean `bad`."""
    baskets = labelled.select(F.when(F.col("bad"), F.array_union("tokens", F.array(F.lit(_BAD)))).otherwise(F.col("tokens")).alias("items")).where(F.size("items") > 0)
    n = baskets.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "rule array<string>, confidence double")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_pages / n)), minConfidence=min_confidence).fit(baskets)
    found = durable(model.associationRules.where(F.col("consequent") == F.array(F.lit(_BAD))).select(F.array_sort("antecedent").alias("rule"), "confidence"))
    parts = found.select("rule", "confidence", F.explode(F.transform("rule", lambda t: F.array_remove("rule", t))).alias("part"))
    wider = found.select(F.col("rule").alias("part"), F.col("confidence").alias("known"))
    needless = parts.join(wider, "part").where("known >= confidence").select("rule").distinct()
    return found.join(needless, "rule", "left_anti")


def rule_hits(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """`key` of the pages (`key`, `tokens`) that hold every token of a rule."""
    frequency = pages.select(F.explode("tokens").alias("token")).groupBy("token").count()
    each = rules.select("rule", F.explode("rule").alias("token")).join(frequency, "token")
    rarest = Window.partitionBy("rule").orderBy("count", "token")
    index = each.withColumn("r", F.row_number().over(rarest)).where("r = 1").select("token", "rule")
    postings = pages.select("key", "tokens", F.explode("tokens").alias("token"))
    return postings.join(index, "token").where(F.size(F.array_except("rule", "tokens")) == 0).select("key").distinct()


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", quality: str = "quality", **limits) -> DataFrame:
    """`<id>`, `host`, `path`, `rule`, `verdict`, `mined` (a mined rule fits) for every row.

    A listed rule decides; else a mined rule blocks; else the url is allowed. Null and malformed urls have no tokens, so
    they are allowed. Labels of low quality are bad; null labels and labels without a page teach nothing. Repeated rows
    and null ids are judged like others: mined hits meet by url, not by id.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"))
    marked = labels.where(F.col(quality).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.max((F.col(quality) == 0)).alias("bad"))
    rules = mine_rules(rows.join(marked, "id").select(tokens_of(F.col("url")).alias("tokens"), "bad"), **limits)
    distinct = rows.where("url IS NOT NULL").select(F.col("url").alias("key")).distinct().select("key", tokens_of(F.col("key")).alias("tokens"))
    hits = rule_hits(distinct, rules).select(F.col("key").alias("url"), F.lit(True).alias("mined"))
    joined = split_join(rows, hits, ["url"], "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = joined.select("id", host.alias("host"), path.alias("path"), F.coalesce("mined", F.lit(False)).alias("mined"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    return split.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")
