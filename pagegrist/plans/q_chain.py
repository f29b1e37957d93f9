"""The chain of candidates over landed pages: each request tries its own page, then others of its host, until one passes the gate."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import access, chain, gate, html
from . import duck as D
from .q_attempts import _CLASS, _KNOWN, _PRIORITY
from .q_url import _PARTS, _STATUS, _status, access_sql, pages
from .registry import query

#: Every tenth request asks for an address that must not be followed.
_ADDRESS = "CASE WHEN page_id % 10 = 9 THEN 'http://[fe80::' || page_id || '%25eth0]/' ELSE url END"


def _requests(spark, sf):
    bad = F.concat(F.lit("http://[fe80::"), F.col("page_id").cast("string"), F.lit("%25eth0]/"))
    return pages(spark, sf).select("page_id", F.when(F.col("page_id") % 10 == 9, bad).otherwise(F.col("url")).alias("address"), U.host(F.col("url")).alias("host"))


def _judged(spark, landed, *keep):
    """page_id and the gate's error_code of landed pages."""
    g = gate.quality_gate(html.page_records(spark, landed, "page_id", keep=["html", *keep]), "article_text", "raw_title", "html")
    return g.select("page_id", *keep, F.col("error_code").alias("verdict"))


def _stages(spark, sf):
    """guard: addresses alone; direct: the page's own response; newest and first: the host's last and first landed page."""
    landed = pages(spark, sf)
    hosts = landed.groupBy(U.host(F.col("url")).alias("_h")).agg(F.max("page_id").alias("newest"), F.min("page_id").alias("first"))

    def attempts(df, engine, status, code):
        return df.select("page_id", F.lit(0).alias("place"), F.lit(engine).alias("engine"), status.alias("status"), (F.col("page_id") % 50).alias("elapsed_ms"), code.alias("error_code"))

    def guard(opened):
        return attempts(opened.where(U.safety(F.col("address")) != ""), "validation", F.lit(0), F.lit("SSRF_BLOCKED"))

    def direct(opened):
        """Two responses: the first judged by its status, and by the gate where that is good; a crawler's, which every third request gets."""
        own = landed.join(opened.select("page_id"), "page_id", "left_semi").withColumn("status", _status())
        answered = access.access_columns(own.where("status <> 200").withColumn("title", F.lit("")), "html", "title", "status")
        code, _ = access.response_failure(F.col("status"), F.col("html"), F.col("access_detected"), F.col("access_challenge"))
        good = _judged(spark, own.where("status = 200 or page_id % 3 = 0"), "status")
        crawler = good.where("page_id % 3 = 0").select("page_id", F.lit(1).alias("place"), F.lit("crawler").alias("engine"), F.lit(200).alias("status"), F.lit(7).alias("elapsed_ms"), F.col("verdict").alias("error_code"))
        plain = attempts(answered, "http", F.col("status"), code).unionByName(attempts(good.where("status = 200"), "http", F.col("status"), F.col("verdict")))
        return plain.unionByName(crawler)

    def of_host(which, engine):
        def stage(opened):
            """The host's page is judged once, for however many requests."""
            asked = opened.select("page_id", "host").join(hosts.select(F.col("_h").alias("host"), F.col(which).alias("_c")), "host").where("_c <> page_id")
            landed_here = landed.join(asked.select(F.col("_c").alias("page_id")).distinct(), "page_id", "left_semi")
            seen = _judged(spark, landed_here).select(F.col("page_id").alias("_c"), "verdict")
            return attempts(asked.join(seen, "_c"), engine, F.lit(200), F.col("verdict"))

        return stage

    return [("guard", guard), ("direct", direct), ("newest", of_host("newest", "archive")), ("first", of_host("first", "reader"))]


@cache
def _chained() -> str:
    """CTEs ending in a (all attempts that are made) and n (requests in order of stages)."""
    rank = _PRIORITY.replace("CASE code", "CASE error_code")
    verdict = "CASE WHEN detected AND challenge THEN 'BOT_CHALLENGE' WHEN detected OR status IN (401, 403, 407, 429, 451) THEN 'HTTP_BLOCKED' WHEN status = 0 OR status >= 500 THEN 'NETWORK' WHEN status BETWEEN 200 AND 299 THEN 'EXTRACT_FAILED' ELSE 'HTTP_BLOCKED' END"
    answered = access_sql(_STATUS)
    return f"""r AS MATERIALIZED (WITH {answered} SELECT page_id, {verdict} AS failed FROM x), v AS MATERIALIZED (WITH {D.tree()}, {access_sql("0")}, {D.page_gate("tr", "x")} SELECT page_id, error_code AS verdict FROM g),
h AS MATERIALIZED (WITH {_PARTS} SELECT page_id, {_STATUS} AS status, max(page_id) OVER (PARTITION BY host) AS newest, min(page_id) OVER (PARTITION BY host) AS first FROM u),
k AS MATERIALIZED (SELECT page_id, 0 AS stage_seq, 0 AS place, 'guard' AS stage, 'validation' AS engine, 0 AS status, page_id % 50 AS elapsed_ms, 'SSRF_BLOCKED' AS error_code FROM h WHERE page_id % 10 = 9
  UNION ALL SELECT page_id, 1, 0, 'direct', 'http', status, page_id % 50, CASE WHEN status = 200 THEN verdict ELSE failed END FROM h JOIN r USING (page_id) JOIN v USING (page_id)
  UNION ALL SELECT page_id, 1, 1, 'direct', 'crawler', 200, 7, verdict FROM h JOIN v USING (page_id) WHERE page_id % 3 = 0
  UNION ALL SELECT h.page_id, 2, 0, 'newest', 'archive', 200, h.page_id % 50, verdict FROM h JOIN v ON v.page_id = newest WHERE newest <> h.page_id
  UNION ALL SELECT h.page_id, 3, 0, 'first', 'reader', 200, h.page_id % 50, verdict FROM h JOIN v ON v.page_id = first WHERE first <> h.page_id),
e0 AS (SELECT page_id, min(10 * stage_seq + place) AS stop FROM k WHERE error_code IN ('', 'SSRF_BLOCKED') GROUP BY page_id),
a AS MATERIALIZED (SELECT k.*, {rank} AS p FROM k LEFT JOIN e0 USING (page_id) WHERE stop IS NULL OR 10 * stage_seq + place <= stop)"""


@query("candidate_chain", f"WITH {_chained()}, b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY (error_code = '') DESC, p DESC, stage_seq DESC, place DESC) AS n, count(*) OVER w AS n_attempts, max(stage_seq) OVER w + 1 AS n_stages, sum(elapsed_ms) OVER w AS elapsed FROM a WINDOW w AS (PARTITION BY page_id)), c AS (SELECT *, {_KNOWN.replace('ELSE', 'WHEN error_code = ' + chr(39) * 2 + ' THEN ' + chr(39) * 2 + ' ELSE')} AS code FROM b WHERE n = 1) SELECT page_id, code = '' AS ok, CASE WHEN code = '' THEN stage ELSE '' END AS stage, engine, status, code AS error_code, CASE WHEN code = '' THEN '' ELSE {_CLASS} END AS failure_class, n_attempts::BIGINT AS n_attempts, n_stages::INT AS n_stages, elapsed::BIGINT AS elapsed_ms FROM c")
def candidate_chain(spark, sf):
    """What becomes of each request."""
    return chain.resolve(spark, _requests(spark, sf), "page_id", _stages(spark, sf)).outcomes


@query("candidate_chain_stages", f"WITH {_chained()}, s(stage_seq, stage) AS (VALUES (0, 'guard'), (1, 'direct'), (2, 'newest'), (3, 'first')), e AS (SELECT page_id, min(stage_seq) AS ended FROM a WHERE error_code IN ('', 'SSRF_BLOCKED') GROUP BY page_id) SELECT stage, (SELECT count(*) FROM pages LEFT JOIN e USING (page_id) WHERE ended IS NULL OR ended >= s.stage_seq)::BIGINT AS n_in, (SELECT count(*) FROM a WHERE a.stage_seq = s.stage_seq)::BIGINT AS n_attempts, (SELECT count(*) FROM e WHERE ended = s.stage_seq)::BIGINT AS n_ended FROM s")
def candidate_chain_stages(spark, sf):
    """How many requests come into each stage and end there, and the attempts that are made."""
    made = chain.resolve(spark, _requests(spark, sf), "page_id", _stages(spark, sf)).stages
    return spark.createDataFrame(made, "stage string, n_in long, n_attempts long, n_ended long")
