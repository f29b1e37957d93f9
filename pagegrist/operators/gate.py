"""The ordered quality gate: text metrics, score, teaser, navigation and newsflash rules, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .access import access_columns

#: Structure metrics that the rules read; absent ones count as 0 or false.
STRUCTURE = {
    "link_density": "double", "link_count": "long", "paragraph_count_dom": "long", "list_item_count": "long", "navigation_text_ratio": "double", "article_text_ratio": "double",
    "interactive_density": "double", "form_count": "long", "password_input_count": "long", "modal_count": "long", "paywall_attribute_count": "long", "hidden_prose_count": "long",
    "jsonld_article_body_chars": "long", "cta_count": "long", "text_to_html_ratio": "double", "dom_depth": "long", "article_container_present": "boolean",
}


def text_metrics(df: DataFrame, text: str) -> DataFrame:
    """Adds the paragraph and character metrics of a text column."""
    t = F.col(text)
    df = df.withColumns({
        "content_chars": T.meaningful_length(t), "letter_number_ratio": T.letter_number_ratio(t), "terminal_count": T.terminal_count(t), "terminal_ending": T.has_terminal_ending(t),
        "repeated_line_ratio": T.repeated_line_ratio(t), "paragraph_lengths": T.paragraph_lengths(t),
    })
    n = F.col("paragraph_lengths")
    df = df.withColumns({"paragraph_count": F.size(n), "paragraph_mean": T.mean(n), "long_paragraph_count": T.count_if(n, lambda x: x >= 80)})
    df = df.withColumns({
        "paragraph_variance": T.variance(n, F.col("paragraph_mean")),
        "short_paragraph_ratio": F.when(F.size(n) == 0, F.lit(0.0)).otherwise(T.count_if(n, lambda x: x <= 40) / F.size(n)),
        "shorter_paragraph_ratio": T.count_if(n, lambda x: x <= 35) / F.greatest(F.size(n), F.lit(1)),
    })
    return df.withColumn("paragraph_cv", F.when(F.col("paragraph_mean") > 0, F.sqrt("paragraph_variance") / F.col("paragraph_mean")).otherwise(F.lit(0.0)))


def with_structure(df: DataFrame) -> DataFrame:
    """Absent structure metrics as zeros."""
    zero = {"double": F.lit(0.0), "long": F.lit(0).cast("long"), "boolean": F.lit(False)}
    return df.withColumns({k: F.coalesce(F.col(k).cast(t), zero[t]) if k in df.columns else zero[t] for k, t in STRUCTURE.items()})


def _steps(*cases: tuple[Column, float]) -> Column:
    out = None
    for test, points in cases:
        out = F.when(test, F.lit(points)) if out is None else out.when(test, F.lit(points))
    return out.otherwise(F.lit(0.0))


def quality_score(title: Column) -> Column:
    """Points for length, paragraphs, endings, letters and structure, summed in this order and clamped to 0..1."""
    c = F.col
    parts = [
        _steps((c("content_chars") >= 1800, 0.22), (c("content_chars") >= 900, 0.18), (c("content_chars") >= 450, 0.12), (c("content_chars") >= 220, 0.07), (c("content_chars") >= fixed.MIN_CONTENT_CHARS, 0.03)),
        _steps((c("paragraph_count") >= 5, 0.12), (c("paragraph_count") >= 3, 0.09), (c("paragraph_count") == 2, 0.06), (c("paragraph_count") == 1, 0.03)),
        _steps((c("long_paragraph_count") >= 3, 0.08), (c("long_paragraph_count") >= 1, 0.04)),
        _steps((c("paragraph_count") < 3, 0.0), (c("paragraph_cv").between(0.12, 1.8), 0.04), ((c("paragraph_cv") < 0.04) & (c("short_paragraph_ratio") >= 0.7), -0.05), (c("paragraph_cv") > 2.5, -0.02)),
        _steps((T.meaningful_length(title) >= 3, 0.05)),
        _steps((c("terminal_count") >= 2, 0.06), (c("terminal_ending"), 0.04)),
        _steps((c("letter_number_ratio") >= 0.55, 0.05), (c("letter_number_ratio") < 0.35, -0.12)),
        _steps((c("repeated_line_ratio") >= 0.45, -0.15), (c("repeated_line_ratio") >= 0.25, -0.08)),
        _steps((c("article_container_present"), 0.08)),
        _steps((c("article_text_ratio") >= 0.55, 0.06), ((c("article_text_ratio") > 0) & (c("article_text_ratio") < 0.15), -0.07)),
        _steps((c("link_density") <= 0.12, 0.07), (c("link_density") >= 0.55, -0.25), (c("link_density") >= 0.35, -0.12)),
        _steps((c("text_to_html_ratio") >= 0.03, 0.04), ((c("text_to_html_ratio") > 0) & (c("text_to_html_ratio") < 0.001), -0.05)),
        _steps((c("paragraph_count_dom") >= 4, 0.05)),
        _steps((c("dom_depth").between(3, 60), 0.02)),
        _steps(((c("form_count") >= 2) & (c("content_chars") < 1000), -0.08)),
        _steps((c("interactive_density") >= 0.25, -0.08)),
        _steps(((c("content_chars") < 1200) & ~c("terminal_ending"), -0.05)),
    ]
    total = F.lit(0.35)
    for p in parts:
        total = total + p
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def teaser_reason(text: Column, title: Column, seen: Column | None = None) -> Column:
    """Why a text is a teaser; empty where it isn't. seen: the folded window of title and text, where a column has it."""
    c = F.col
    seen = T.window(title, text) if seen is None else seen
    chars = c("content_chars")
    count = F.when(c("paragraph_count_dom") > 0, c("paragraph_count_dom")).otherwise(c("paragraph_count"))
    mismatch = (c("jsonld_article_body_chars") >= 800) & (chars < 1600) & (c("jsonld_article_body_chars") >= F.greatest(chars * F.lit(2.2), (chars + 500).cast("double")))
    hidden, gated = c("hidden_prose_count") >= 1, c("paywall_attribute_count") >= 1
    access_ui = (c("password_input_count") > 0) | ((c("modal_count") > 0) & (c("form_count") > 0)) | hidden | (gated & mismatch)
    sparse = (chars < 1200) & (count <= 3)
    abrupt = (chars < 1200) & (T.rstrip(text).rlike(r"(?:…|\.{3})\z") | (~c("terminal_ending") & (chars >= 180)))
    return (
        F.when(T.has_any(seen, fixed.TEASER_MARKERS), "teaser_markers")
        .when(mismatch & (access_ui | hidden | abrupt), "teaser_schema_mismatch")
        .when(sparse & access_ui & ((c("cta_count") >= 1) | (c("link_density") >= 0.2)), "teaser_access_shell")
        .when(sparse & gated & hidden, "teaser_clipped_content")
        .when((chars < 700) & (c("form_count") >= 1) & (c("cta_count") >= 2) & (c("link_density") >= 0.25), "teaser_login_shell")
        .otherwise("")
    )


def navigation_shell(text: Column, title: Column, seen: Column | None = None) -> Column:
    c = F.col
    seen = T.window(title, text) if seen is None else seen
    signals = sum((F.contains(seen, F.lit(m)).cast("int") for m in fixed.NAVIGATION_SIGNALS), F.lit(0))
    marked = F.contains(T.fold(title), F.lit("do not delete")) & (signals >= 3)
    listed = (c("paragraph_count") >= 8) & (c("shorter_paragraph_ratio") >= 0.75) & (c("repeated_line_ratio") >= 0.2)
    return marked | listed | structural_navigation()


def structural_navigation() -> Column:
    c = F.col
    return (
        ((c("link_count") >= 8) & (c("link_density") >= 0.55) & (c("paragraph_count_dom") <= 2))
        | ((c("navigation_text_ratio") >= 0.58) & (c("article_text_ratio") < 0.35) & (c("paragraph_count_dom") <= 3))
        | ((c("list_item_count") >= 10) & (c("list_item_count") >= F.greatest(F.lit(4), c("paragraph_count_dom") * 4)) & (c("link_density") >= 0.35))
        | ((c("interactive_density") >= 0.25) & (c("paragraph_count_dom") <= 1) & (c("content_chars") < 1000))
    )


def short_newsflash(text: Column, title: Column) -> Column:
    c = F.col
    return (
        c("content_chars").between(fixed.MIN_NEWSFLASH_CHARS, fixed.MAX_NEWSFLASH_CHARS) & (T.meaningful_length(title) >= 3) & c("paragraph_count").between(1, 5)
        & (c("link_density") <= 0.22) & (c("form_count") == 0) & (c("password_input_count") == 0) & (c("terminal_ending") | (c("terminal_count") >= 1)) & (c("score") >= fixed.NEWSFLASH_SCORE)
        & ((T.numeric_density(text) >= 0.01) | T.time_or_market_signal(text) | (c("terminal_count") >= 2) | (c("content_chars") >= 220))
    )


def quality_gate(df: DataFrame, text: str, title: str | None = None, html: str | None = None, status: str | None = None, allow_partial: bool = False) -> DataFrame:
    """Adds the metrics and ok, paywall_suspected, reason, error_code, score.

    Order decides: access control, navigation, short texts, teasers, score. Structure metrics are read from
    columns of the names in STRUCTURE where there are any.
    """
    df = df.withColumn("_text", T.strip(F.col(text))).withColumn("_name", T.blank(F.col(title)) if title else F.lit(""))
    df = with_structure(text_metrics(df, "_text"))
    if html:
        df = df.withColumn("_source", F.when(T.blank(F.col(html)) == "", F.col("_text")).otherwise(F.col(html)))
    df = access_columns(df, "_source" if html else "_text", "_name", status)
    t, name, c = F.col("_text"), F.col("_name"), F.col
    df = df.withColumn("score", quality_score(name)).withColumn("_seen", T.window(name, t))
    df = df.withColumns({"_teaser": teaser_reason(t, name, c("_seen")), "_navigation": navigation_shell(t, name, c("_seen")), "_newsflash": short_newsflash(t, name)})
    short, teaser = c("content_chars") < fixed.MIN_CONTENT_CHARS, c("_teaser") != ""
    partial = F.lit(allow_partial)
    way = (
        F.when(c("access_detected"), 1).when(c("_navigation"), 2).when(teaser & (short | ~partial), 3).when(short, F.when(c("_newsflash"), 6).otherwise(4))
        .when(teaser, 5).when((c("score") >= fixed.PASS_SCORE) | c("_newsflash"), 6).otherwise(7)
    )
    df = df.withColumn("_way", way)
    w = c("_way")
    reason = (
        F.when(w == 1, "challenge_shell").when(w == 2, "navigation_shell").when(w == 3, c("_teaser")).when(w == 4, F.concat(F.lit("content_chars="), c("content_chars").cast("string"), F.lit(f" < {fixed.MIN_CONTENT_CHARS}")))
        .when(w == 5, "teaser_allowed_partial").when(w == 6, "pass").otherwise(F.concat(F.lit("structural_score="), F.format_string("%.3f", "score"), F.lit(f" < {fixed.PASS_SCORE:.3f}")))
    )
    out = {"ok": w.isin(5, 6), "paywall_suspected": w.isin(3, 5), "reason": reason, "error_code": F.when(w.isin(5, 6), "").when(w == 3, "PAYWALL_REMAINING").otherwise("EXTRACT_FAILED"), "score": F.when(w.isin(1, 2, 3), F.lit(0.0)).otherwise(c("score"))}
    return df.withColumns(out).drop("_text", "_name", "_source", "_seen", "_teaser", "_navigation", "_newsflash", "_way")


def merge_dom_metrics(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Fills structure metrics that are missing or zero from live-page columns: {live column: metric}."""
    return df.withColumns({to: F.coalesce(F.nullif(F.col(to), F.lit(0).cast(df.schema[to].dataType)), F.col(live).cast(df.schema[to].dataType)) for live, to in aliases.items() if live in df.columns and to in df.columns})
