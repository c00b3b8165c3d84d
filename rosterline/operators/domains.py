"""Registered domains by a table of suffix rules, with wildcards and exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.functions.urls import url_host


def with_registered_domain(urls: DataFrame, rules: DataFrame, url: str = "url", rule: str = "rule", name: str = "domain") -> DataFrame:
    """Add ``name``: the label before the public suffix and the suffix, as written in the URL's host.

    ``rules`` holds one suffix a row: ``co.uk`` covers itself, ``*.ck`` any one label before ``ck``, ``!www.ck`` is no suffix
    though a wildcard covers it. Of the rules that a host ends with, an exception wins, else the one of most labels; so
    any number of rules is an equi join of the distinct hosts' tails. A host that is a suffix itself gives ``.suffix``; one that
    no rule covers, and an IPv4 address, ``host.``; null stays null. Case of the rules and blanks around them don't matter.
    """
    known = rules.select(F.lower(F.trim(rule)).alias("_rule")).where("_rule <> ''")
    known = known.select(
        F.regexp_replace("_rule", "^!", "").alias("_key"), F.col("_rule").startswith("!").alias("_except")).distinct()
    hosts = urls.select(url_host(url).alias("_host")).where("_host is not null").distinct()
    labels = F.split("_host", r"\.")
    tails = hosts.withColumn("_labels", labels).withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("_labels"))))
    tail = F.array_join(F.slice(F.col("_labels"), F.col("_at"), F.size("_labels")), ".")
    tails = tails.select("_host", "_labels", (F.size("_labels") - F.col("_at") + 1).alias("_n"), F.lower(tail).alias("_tail"))
    # A tail meets its own rule, and the wildcard that stands for its first label.
    wild = F.concat(F.lit("*"), F.regexp_extract("_tail", r"^[^.]*(\..*)$", 1))
    keys = tails.withColumn("_key", F.explode(F.when(F.col("_n") > 1, F.array("_tail", wild)).otherwise(F.array("_tail"))))
    # An exception's suffix is one label shorter than its rule.
    size = F.col("_n") - F.col("_except").cast("int")
    best = keys.join(known, "_key").groupBy("_host").agg(F.max(F.struct("_except", size.alias("size"))).alias("_best"))
    suffix = F.array_join(F.slice(labels, F.size(labels) - F.col("_best.size") + 1, F.col("_best.size")), ".")
    before = F.coalesce(F.get(labels, F.size(labels) - F.col("_best.size") - 1), F.lit(""))
    is_ip = F.col("_host").rlike(r"^\d+\.\d+\.\d+\.\d+$")
    found = hosts.join(best, "_host", "left").select(
        "_host", F.when(is_ip, F.concat("_host", F.lit("."))).when(F.col("_best").isNotNull(), F.concat(before, F.lit("."), suffix))
        .otherwise(F.concat(F.get(labels, F.size(labels) - 1), F.lit("."))).alias(name))
    return urls.withColumn("_host", url_host(url)).join(found, "_host", "left").drop("_host")
