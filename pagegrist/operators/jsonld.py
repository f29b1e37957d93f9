"""Article bodies in JSON-LD of pages, as VARIANT values taken apart level by level."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import shared_dir

#: Characters of a script beyond which it isn't read.
MAX_JSON_CHARS = 1_000_000
_SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script\s*>"


def scripts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, json: the JSON-LD scripts of pages, of bounded length."""
    whole = F.transform(F.regexp_extract_all(F.col(html), F.lit(_SCRIPT), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, _SCRIPT, 1).alias("head"), F.regexp_extract(x, _SCRIPT, 2).alias("json")))
    found = pages.where(F.contains(F.lower(html), F.lit("ld+json"))).select(key, F.explode(whole).alias("s")).select(key, "s.*")
    typed = F.contains(F.lower(F.regexp_extract("head", r"(?i)\btype\s*=\s*[\"']?([^\"'\s>]*)", 1)), F.lit("ld+json"))
    return found.where(typed & (F.length("json") <= MAX_JSON_CHARS)).select(key, "json")


def strings_of(spark: SparkSession, documents: DataFrame, key: str, json: str, field: str) -> DataFrame:
    """key, value: the strings that stand under a field of any case, at any depth; texts that aren't JSON have none.

    Each level of nesting is one lateral variant_explode of the containers that the level before left over, written to the shared
    folder; it ends when there are none, so a deep document costs levels for itself alone, and no depth is a bound.
    """
    root = f"{shared_dir(spark)}/variant-{uuid.uuid4().hex}"
    opened, out, level = documents.select(key, F.try_parse_json(json).alias("v")).where("v is not null"), None, 0
    while True:
        each = opened.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("_name"), F.col("value").alias("_value")))
        text = F.to_json("_value")
        wanted = F.coalesce(F.lower("_name") == field.lower(), F.lit(False)) & F.startswith(text, F.lit('"'))
        kind = F.when(wanted, "found").when(text.rlike(r"^[{\[]."), "open")
        made = each.select(key, kind.alias("kind"), F.when(wanted, F.variant_get("_value", "$", "string")).alias("value"), F.when(kind == "open", F.col("_value")).alias("v")).where("kind is not null")
        made.write.parquet(f"{root}/{level}")
        made = spark.read.schema(made.schema).parquet(f"{root}/{level}")
        found = made.where("kind = 'found'").select(key, "value")
        out, opened, level = found if out is None else out.unionByName(found), made.where("kind = 'open'").select(key, "v"), level + 1
        if opened.isEmpty():
            return out


def article_body_chars(spark: SparkSession, pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, chars: the meaningful length of the longest article body in each page's JSON-LD; of pages that have one."""
    bodies = strings_of(spark, scripts(pages, key, html), key, "json", "articleBody")
    return bodies.groupBy(key).agg(F.max(T.meaningful_length(F.col("value"))).alias("chars"))
