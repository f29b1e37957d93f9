"""Source and policy registries, URL lists, archives and evaluation sets as DataFrames."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import urls as U
from ..functions.text import blank, fold
from ..session import ship

SOURCES = "sources array<struct<domain:string,name:string,focus:array<string>,feeds:array<struct<url:string,scope:string,status:string>>>>"
DISCOVERY = "policies array<struct<domain:string,discovery_mode:string,feed_urls:array<string>,focus_feed_urls:array<string>,fallbacks:array<string>,date_quality:string,coverage:string,reason:string>>"
RETRIEVAL = "policies array<struct<domain:string,browser_mode:string,credential_mode:string,firecrawl_mode:string,firecrawl_failure_codes:array<string>,representation_mode:string,failure_mode:string>>"


def read_registry(spark: SparkSession, path: str, schema: str, items: str) -> DataFrame:
    """seq and the fields of each item of a JSON registry; unreadable input gives no row."""
    return from_text(spark.read.text(path, wholetext=True), "value", schema, items)


def from_text(df: DataFrame, column: str, schema: str, items: str) -> DataFrame:
    """As read_registry, from registries that landed as text rows; corrupt text gives no row."""
    return df.select(F.posexplode(F.from_json(column, schema)[items]).alias("seq", "x")).select("seq", "x.*")


def feeds(sources: DataFrame, status: str | None = "verified") -> DataFrame:
    """domain, seq, url, scope, status of each feed, of one status."""
    each = sources.select("domain", F.posexplode("feeds").alias("seq", "f")).select("domain", "seq", "f.url", F.coalesce("f.scope", F.lit("general")).alias("scope"), "f.status")
    return each.where(F.col("status") == status) if status else each


def scope_matches(scope: Column, wanted: Column) -> Column:
    """A topic feed only where its scope and the query name each other; general ones not; all without a query."""
    q, s = F.replace(fold(wanted), F.lit("-"), F.lit(" ")), F.replace(fold(scope), F.lit("-"), F.lit(" "))
    ai = F.contains(q, F.lit("ai")) | F.contains(q, F.lit("artificial intelligence")) | F.contains(q, F.lit("machine learning"))
    return F.when(F.coalesce(wanted, F.lit("")) == "", True).when(s == "general", False).when(s == "artificial intelligence", ai).otherwise(F.contains(q, s) | F.contains(s, q))


def with_policy(df: DataFrame, domain: str, policies: DataFrame, *columns: str, order: str = "seq") -> DataFrame:
    """Left join with the first policy of a domain, in the registry's order."""
    first = policies.groupBy(F.col("domain").alias("_d")).agg(F.min_by(F.struct(*columns), order).alias("_p"))
    return df.join(first, df[domain] == F.col("_d"), "left").select("*", *[F.col(f"_p.{c}").alias(c) for c in columns]).drop("_d", "_p")


def may_use(mode: Column, codes: Column, code: Column) -> Column:
    """Whether a policy allows its hosted service after this failure."""
    return (mode == "on_failure") & F.coalesce(F.array_contains(codes, code), F.lit(False))


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """URLs of a text list, without blank lines and comments."""
    x = F.trim(column)
    return lines.select(x.alias("url")).where((x != "") & ~F.startswith(x, F.lit("#")))


def eval_items(items: DataFrame) -> DataFrame:
    """An evaluation set; an absent domain is the URL's host, an absent canary flag false."""
    return items.withColumns({"domain": F.when(F.coalesce("domain", F.lit("")) == "", U.host(F.col("url"))).otherwise(F.col("domain")), "canary": F.coalesce("canary", F.lit(False))})


# Bounds of archives.
MAX_MEMBERS, MAX_BYTES, MAX_RATIO = 1000, 5_000_000, 200


def zip_member(data: bytes, name: str) -> str | None:
    """The text of the one member of this name, in whatever folder; null of an archive that is unsafe, broken or has none or several."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            found = [i for i in infos if i.filename.rpartition("/")[2] == name]
            safe = len(infos) <= MAX_MEMBERS and len(found) == 1 and not found[0].flag_bits & 1 and found[0].file_size <= MAX_BYTES and found[0].file_size <= MAX_RATIO * found[0].compress_size
            if not safe:
                return None
            with z.open(found[0]) as member:  # what an archive declares needn't be so: never more than the bound is unpacked
                text = member.read(MAX_BYTES + 1)
            return text.decode("utf-8") if len(text) == found[0].file_size else None
    except (zipfile.BadZipFile, ValueError, RuntimeError, OSError, zlib.error, EOFError):  # a damaged archive fails in many ways
        return None


def zip_texts(spark: SparkSession, archives: DataFrame, name: str) -> DataFrame:
    """path, text of the wanted member of archives read with the binaryFile source; in Arrow batches bounded by bytes."""
    ship(spark)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [zip_member(x.as_buffer().to_pybytes(), name) if x.is_valid else None for x in b.column("content")]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, pa.string())], names=["path", "text"])

    return archives.select("path", "content").mapInArrow(read, "path string, text string")


def unbundled(spark: SparkSession, bundles: DataFrame) -> DataFrame:
    """path, content of the files within tar files read with the binaryFile source; a path goes on with the name within."""
    ship(spark)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, bundle in zip(b.column("path").to_pylist(), b.column("content")):
                with tarfile.open(fileobj=io.BytesIO(bundle.as_buffer())) as t:
                    found = [(f"{path}/{m.name}", t.extractfile(m).read()) for m in t if m.isfile()]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], names=["path", "content"])

    return bundles.select("path", "content").mapInArrow(read, "path string, content binary")


#: Sites of a registry that is to be imported.
SITES = "domain string, name string, rss_urls array<string>, rss_url string"


def imported(sites: DataFrame, health: DataFrame) -> DataFrame:
    """domain, name, place, url, scope, status of each distinct feed of the sites, in order.

    The scope is told from the address; the status from a health report (feed_url, valid), which decides before
    the feeds that count as verified.
    """
    domain = F.lower(F.trim(blank(F.col("domain"))))
    extra = F.array().cast("array<string>")
    for d, url in fixed.SUPPLEMENTAL_FEEDS:
        extra = F.when(domain == d, F.array(F.lit(url))).otherwise(extra)
    given = F.concat(F.coalesce("rss_urls", F.array().cast("array<string>")), F.array("rss_url"))
    urls = F.array_distinct(F.concat(F.filter(F.transform(given, lambda x: F.trim(blank(x))), lambda x: x != ""), extra))
    each = sites.select(domain.alias("domain"), F.coalesce(F.nullif(F.col("name"), F.lit("")), domain).alias("name"), F.posexplode(urls).alias("place", "url")).where("domain <> ''")
    low = F.lower("url")
    scope = F.lit("general")
    for name, parts in reversed(fixed.FEED_SCOPES):
        scope = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts]), name).otherwise(scope)
    said = health.groupBy(F.col("feed_url").alias("_f")).agg(F.max("valid").alias("_ok"))
    known = reduce(lambda a, b: a | b, [(F.col("domain") == d) & (F.col("url") == u) for d, u in fixed.SUPPLEMENTAL_FEEDS])
    status = F.when(F.col("_ok"), "verified").when(~F.col("_ok"), "disabled").when(known, "verified").otherwise("candidate")
    return each.join(said, each["url"] == F.col("_f"), "left").select("domain", "name", "place", "url", scope.alias("scope"), status.alias("status"))


def derived_policies(sources: DataFrame) -> DataFrame:
    """Adds the retrieval policy of each source's domain: six columns that follow from the sets it is in."""
    d = F.col("domain")
    return sources.withColumns({
        "browser_mode": F.lit("render_only"),
        "credential_mode": F.when(d == "theinformation.com", "vault_required_for_fulltext").otherwise("vault_optional"),
        "service_mode": F.when(d.isin(*fixed.SERVICE_NEVER), "never").otherwise("on_bot_or_http_block"),
        "service_failure_codes": F.array(F.lit("BOT_CHALLENGE"), F.lit("HTTP_BLOCKED")),
        "representation_mode": F.when(d == "bloomberg.com", "syndicated_candidate").otherwise("publisher_page"),
        "failure_mode": F.when(d.isin(*fixed.PAYWALL_EXPECTED), "paywall_remaining").otherwise("honest_failure"),
    })


def may_syndicate(domain: Column, code: Column, representation: Column) -> Column:
    """Whether a failed request may be answered by a syndicated article: an outlet that has one, a failure that calls for it, a policy that allows it."""
    return F.coalesce((domain == "bloomberg.com") & code.isin(*fixed.SYNDICATED_FAILURES) & (representation == "syndicated_candidate"), F.lit(False))


def snapshot_url(answer: Column) -> Column:
    """The address of an available snapshot in an archive's JSON answer; empty where there is none."""
    at = lambda k: F.get_json_object(answer, f"$.archived_snapshots.closest.{k}")
    good = (F.coalesce(at("available"), F.lit("")) != "false") & (at("status") == "200")
    return F.coalesce(F.when(good, F.trim(at("url"))), F.lit(""))


def changed(existing: DataFrame, candidate: DataFrame) -> DataFrame:
    """Paths whose content differs or is new: what an idempotent mirror has to write. Both: path, hash."""
    return candidate.join(existing, ["path", "hash"], "left_anti")


def write_changed(existing: DataFrame, candidate: DataFrame, path: str) -> int:
    """Append what changed to a mirror; nothing is written where nothing changed."""
    new = changed(existing, candidate).cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n
