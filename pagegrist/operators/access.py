"""Classification of challenge, denial and default pages, as column expressions."""

from __future__ import annotations

from re import _parser as re_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T

_END = r"(?:[^\p{L}\p{N}_]|\z)"


def required(pattern: str) -> frozenset[str]:
    """Strings in lower case of which any match of the pattern holds at least one; empty where none can be told.

    Of a sequence that is the literal run whose shortest string is longest (a mark counts for three letters, as it is rare in
    prose), of alternatives the union of theirs.
    """
    worth = lambda found: min((len(x) + 2 * sum(not c.isalnum() and c != " " for c in x) for x in found), default=0)

    def of(items) -> frozenset[str]:
        best, run = frozenset(), ""
        options: list[frozenset[str]] = []
        for op, arg in [*items, (None, None)]:
            if op is re_parser.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            options += [frozenset((run,))] if run else []
            run = ""
            if op is re_parser.SUBPATTERN:
                options.append(of(arg[3]))
            elif op is re_parser.BRANCH:
                each = [of(x) for x in arg[1]]
                options.append(frozenset().union(*each) if all(each) else frozenset())
        for found in options:
            if worth(found) > worth(best):
                best = found
        return best

    return of(re_parser.parse(pattern))


def access_columns(df: DataFrame, html: str, title: str, status: str | None = None) -> DataFrame:
    """Adds access_detected, access_challenge, access_provider, access_reason, access_score."""
    raw = F.left(T.blank(F.col(html)), F.lit(fixed.MAX_ACCESS_CHARS))
    df = df.withColumn("_raw", raw).withColumn("_low", F.lower("_raw")).withColumn("_status", F.coalesce(F.col(status), F.lit(0)) if status else F.lit(0))
    inner = T.normalize_space(F.regexp_replace(F.regexp_extract("_raw", r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", " "))
    own = T.fold(T.normalize_space(F.col(title)))
    df = df.withColumn("_title", F.when(own == "", T.fold(inner)).otherwise(own))
    r = F.col("_raw")
    # most texts hold none of the strings that the patterns need: one cheap search for these spares the patterns
    every = (*(p for _, ps in fixed.PROVIDERS for p in ps), fixed.CAPTCHA, fixed.PLAIN_CAPTCHA, fixed.CHALLENGE_SCRIPT, fixed.DENIED_TEXT, fixed.DEFAULT_PAGES, fixed.CHALLENGE_BODY)
    needed = frozenset().union(*map(required, every)) if all(map(required, every)) else frozenset()
    short = sorted(x for x in needed if not any(y != x and y in x for y in needed))
    maybe = F.lit(not short)
    for x in short:
        maybe = maybe | F.contains("_low", F.lit(x))
    df = df.withColumn("_maybe", maybe).withColumn("_tags", F.contains("_raw", F.lit("<")))

    def _found(x: Column, pattern: str) -> Column:
        if pattern.startswith("<"):
            return F.col("_tags") & x.rlike(f"(?is){pattern}")
        return (F.col("_maybe") & x.rlike(f"(?is){pattern}")) if pattern in every else x.rlike(f"(?is){pattern}")

    hits = {name: sum((_found(r, p).cast("int") for p in patterns), F.lit(0)) for name, patterns in fixed.PROVIDERS}
    df = df.withColumns({f"_hit_{i}": h for i, h in enumerate(hits.values())})
    most = F.greatest(*[F.col(f"_hit_{i}") for i in range(len(hits))])
    df = df.withColumn("_hits", most)
    provider = F.lit("")
    for i, name in reversed(list(enumerate(hits))):
        provider = F.when((F.col(f"_hit_{i}") == F.col("_hits")) & (F.col("_hits") > 0), F.lit(name)).otherwise(provider)
    df = df.withColumn("_visible", T.meaningful_length(F.regexp_replace("_raw", "<[^>]+>", "")))
    visible = F.col("_visible")
    df = df.withColumns({
        "_provider": provider, "_markup": _found(r, fixed.MARKUP),
        "_t_challenge": F.col("_title").rlike(f"(?i){fixed.CHALLENGE_TITLES}{_END}"), "_t_denied": F.col("_title").rlike(f"(?i){fixed.DENIED_TITLES}{_END}"),
        "_form": _found(r, fixed.CHALLENGE_FORM), "_script": _found(r, fixed.CHALLENGE_SCRIPT), "_denied": _found(r, fixed.DENIED_TEXT), "_default": _found(r, fixed.DEFAULT_PAGES),
        "_thin": F.col("_tags") & (F.regexp_count("_raw", F.lit(r"(?i)<script\b")) >= 2) & (F.regexp_count("_raw", F.lit(r"(?i)<p\b")) <= 2) & (visible < 900),
        "_refresh": _found(r, fixed.META_REFRESH), "_body": _found(r, fixed.CHALLENGE_BODY),
    })
    plain = (T.meaningful_length(r) < 1800) & _found(r, fixed.PLAIN_CAPTCHA)
    df = df.withColumn("_captcha", F.when(~F.col("_markup") & ~F.col("_t_challenge"), plain).otherwise(_found(r, fixed.CAPTCHA)))
    blocked_status = F.col("_status").isin(*fixed.BLOCK_STATUSES)
    points = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    score = points(blocked_status | (F.col("_status") == 503), 1.2) + points(F.col("_t_challenge"), 3.0) + points(F.col("_t_denied"), 1.8)
    score = score + F.when(F.col("_hits") > 0, F.lit(1.2) + F.least("_hits", F.lit(2)) * F.lit(0.6)).otherwise(F.lit(0.0))
    for c, v in (("_captcha", 2.5), ("_form", 2.0), ("_script", 1.8), ("_denied", 1.4), ("_thin", 0.7), ("_refresh", 0.5)):
        score = score + points(F.col(c), v)
    df = df.withColumn("access_score", score)
    c, s = F.col, F.col("access_score")
    challenge = (
        (c("_t_challenge") & (c("_markup") | blocked_status | (c("_status") == 503) | c("_body"))) | c("_captcha") | c("_form") | c("_script")
        | (c("_markup") & c("_provider").isin("cloudflare", "datadome", "perimeterx", "imperva", "aws-waf") & (s >= 3.2))
        | (c("_markup") & (c("_provider") == "akamai") & (c("_hits") >= 2) & (s >= 3.6))
    )
    evidence = (c("_t_denied") | c("_default")) & (c("_visible") < 5000) & (c("_markup") | blocked_status | c("_denied") | c("_default"))
    blocked = challenge | evidence | (c("_denied") & (c("_markup") | (c("_visible") < 1800))) | (blocked_status & (c("_visible") < 5000)) | (c("_markup") & (s >= 4.0))
    df = df.withColumn("access_challenge", challenge).withColumn("access_detected", blocked)
    named = F.when(c("_provider") == "", F.lit("generic")).otherwise(c("_provider"))
    df = df.withColumns({
        "access_provider": F.when(c("access_detected"), c("_provider")).otherwise(""),
        "access_reason": F.when(~c("access_detected"), "").when(c("access_challenge"), F.concat(named, F.lit("_challenge"))).otherwise(F.concat(named, F.lit("_http_block"))),
    })
    return df.drop(*[x for x in df.columns if x.startswith("_") and (x[1:] in _OWN or x.startswith("_hit"))])


_OWN = {"raw", "low", "maybe", "tags", "status", "title", "provider", "markup", "visible", "t_challenge", "t_denied", "form", "script", "denied", "default", "thin", "refresh", "body", "captcha"}


def challenge_shell(title: Column, text: Column, detected: Column) -> Column:
    """Two titles that have rules of their own; otherwise what the classifier says."""
    name, seen = T.fold(T.normalize_space(title)), T.window(title, text)
    has = lambda m: F.contains(seen, F.lit(m))
    return F.when(name == "security verification", has("challenge") & (has("status code") | has("waiting for"))).when(name == "access denied", has("permission to access") | has("errors.edgesuite.net")).otherwise(detected)


def http_failure(status: Column, body: Column) -> tuple[Column, Column]:
    """(error_code, failure_class) of a failed response."""
    low = F.lower(F.left(T.blank(body), F.lit(2000)))
    bot = F.lit(False)
    for m in ("captcha", "cf-browser", "challenge", "turnstile", "cloudflare"):
        bot = bot | F.contains(low, F.lit(m))
    code = F.when(status.isin(401, 403), F.when(bot, "BOT_CHALLENGE").otherwise("HTTP_BLOCKED")).when(status == 429, "HTTP_BLOCKED").when((status >= 500) | (status == 0), "NETWORK").when(status == 200, "EXTRACT_FAILED").otherwise("HTTP_BLOCKED")
    kind = F.when(status.isin(401, 403, 429), "bot").when((status >= 500) | (status == 0), "network").when(status == 200, "extract").otherwise("strategy")
    return code, kind


def response_failure(status: Column, body: Column, detected: Column, challenge: Column) -> tuple[Column, Column]:
    """(error_code, failure_class) of a response whose body is classified."""
    code, kind = http_failure(status, body)
    ok = (status >= 200) & (status < 300)
    first = lambda a, b, c, d, rest: F.when(detected & challenge, a).when(detected | status.isin(*fixed.BLOCK_STATUSES), b).when((status == 0) | (status >= 500), c).when(ok, d).otherwise(rest)
    return first("BOT_CHALLENGE", "HTTP_BLOCKED", "NETWORK", "EXTRACT_FAILED", code), first("bot", "bot", "network", "extract", kind)
