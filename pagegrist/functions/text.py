"""Text functions as column expressions: whitespace, lengths, paragraphs, endings, titles, slugs, cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Unicode white space, written out so that it means the same in every engine.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def rounded(x: Column | str, places: int) -> Column:
    """Half away from zero of the scaled double, as SQL engines round one; Spark's own goes by the decimal that is printed (0.5203125)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * F.lit(10.0**places)) / F.lit(10.0**places)


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def fold(x: Column) -> Column:
    """Case folding: lower case, with sharp s as ss."""
    return F.replace(F.lower(blank(x)), F.lit("ß"), F.lit("ss"))


def strip(x: Column) -> Column:
    return F.regexp_replace(blank(x), rf"\A{SPACE}+|{SPACE}+\z", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(blank(x), rf"{SPACE}+\z", "")


def normalize_space(x: Column) -> Column:
    return strip(F.regexp_replace(blank(x), rf"{SPACE}+", " "))


def meaningful_length(x: Column) -> Column:
    """Characters that are neither white space nor control, format or unassigned ones."""
    return F.length(F.regexp_replace(blank(x), r"[\p{Z}\p{C}]+", ""))


def letter_number_ratio(x: Column) -> Column:
    n = meaningful_length(x)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(blank(x), r"[^\p{L}\p{N}]+", "")) / n)


def _line_ends(x: Column) -> Column:
    return F.replace(F.replace(blank(x), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def paragraphs(x: Column) -> Column:
    """Blocks between blank lines, or lines where there is one block at most; stripped, without empty ones."""
    raw = _line_ends(x)
    parts = lambda p: F.filter(F.transform(F.split(raw, p), strip), lambda s: s != "")
    blocks, lines = parts(rf"\n{SPACE}*\n+"), parts(r"\n")
    return F.when((F.size(blocks) <= 1) & (F.size(lines) > 1), lines).otherwise(blocks)


def once(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f uses it: expressions with lambdas aren't compiled, so nothing else shares them."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def paragraph_lengths(x: Column) -> Column:
    """Meaningful lengths of the paragraphs, without zeros.

    White space goes from the whole text at once, so that blank lines meet and a piece's length is its number of characters. Texts
    with other characters that don't count (format, control) are taken apart piece by piece.
    """
    lengths = lambda d, p: F.filter(F.transform(F.split(d, p), lambda s: F.length(F.replace(s, F.lit("\n"), F.lit("")))), lambda n: n > 0)
    by_line = lambda d, blocks: once(lengths(d, r"\n"), lambda lines: F.when(F.size(lines) > 1, lines).otherwise(blocks))
    plain = lambda d: once(lengths(d, r"\n{2,}"), lambda blocks: F.when(F.size(blocks) <= 1, by_line(d, blocks)).otherwise(blocks))
    by_piece = F.filter(F.transform(paragraphs(x), meaningful_length), lambda n: n > 0)
    return once(F.regexp_replace(_line_ends(x), rf"[{SPACE}&&[^\n]]+", ""), lambda d: F.when(d.rlike(r"[\p{C}&&[^\n]]"), by_piece).otherwise(plain(d)))


def mean(lengths: Column) -> Column:
    total = F.aggregate(lengths, F.lit(0.0), lambda a, n: a + n)
    return F.when(F.size(lengths) == 0, F.lit(0.0)).otherwise(total / F.size(lengths))


def variance(lengths: Column, average: Column) -> Column:
    """Of the population; 0 of fewer than two."""
    total = F.aggregate(lengths, F.lit(0.0), lambda a, n: a + (n - average) * (n - average))
    return F.when(F.size(lengths) <= 1, F.lit(0.0)).otherwise(total / F.size(lengths))


def count_if(lengths: Column, test) -> Column:
    return F.size(F.filter(lengths, test))


def terminal_count(x: Column) -> Column:
    return F.regexp_count(blank(x), F.lit(f"[{fixed.TERMINAL}]"))


def has_terminal_ending(x: Column) -> Column:
    closing = fixed.CLOSING.replace("]", r"\]").replace("[", r"\[")
    return blank(x).rlike(rf"[{fixed.TERMINAL}][\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}{closing}]*\z")


def repeated_line_ratio(x: Column) -> Column:
    """Share of lines of three meaningful characters or more that repeat an earlier one; 0 of fewer than four lines.

    Spaces and characters that don't count are settled over the whole text, not line by line.
    """

    def ratio(raw: Column) -> Column:
        shown = F.transform(F.split(fold(F.regexp_replace(raw, rf"[{SPACE}&&[^\n]]+", " ")), "\n"), lambda s: F.trim(s))
        counted = F.split(F.regexp_replace(raw, r"[\p{Z}\p{C}&&[^\n]]+", ""), "\n")
        long = F.filter(F.zip_with(shown, counted, lambda s, c: F.when(F.length(c) >= 3, s)), lambda s: s.isNotNull())
        return once(long, lambda kept: F.when(F.size(kept) < 4, F.lit(0.0)).otherwise(F.lit(1.0) - F.size(F.array_distinct(kept)) / F.size(kept)))

    few = lambda raw: F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit(""))) < 3
    return once(F.replace(blank(x), F.lit("\r"), F.lit("\n")), lambda raw: F.when(few(raw), F.lit(0.0)).otherwise(ratio(raw)))


def numeric_density(x: Column) -> Column:
    return F.regexp_count(blank(x), F.lit(r"\p{Nd}")) / F.greatest(meaningful_length(x), F.lit(1))


def time_or_market_signal(x: Column) -> Column:
    return blank(x).rlike(r"(?:\b[0-9]{1,2}:[0-9]{2}\b|\b[0-9]+(?:\.[0-9]+)?%\b|[$€£¥₹₩₽]|\b[A-Z]{2,6}\b|\bQ[1-4]\b)")


def truncated(x: Column, limit: int = fixed.MAX_MARKDOWN_CHARS) -> tuple[Column, Column]:
    """The first characters, and whether there were more."""
    return F.left(blank(x), F.lit(limit)), F.length(blank(x)) > limit


def slug(x: Column, limit: int = 80) -> Column:
    plain = F.regexp_replace(F.lower(blank(x)), r"[^\p{L}\p{N}_\s\p{Z}-]", "")
    joined = F.regexp_replace(plain, r"[-\s\p{Z}]+", "-")
    out = F.left(F.regexp_replace(joined, r"\A-+|-+\z", ""), F.lit(limit))
    return F.when(out == "", F.lit("article")).otherwise(out)


def batch_slug(title: Column, url: Column) -> Column:
    """A file name that stays apart for equal titles."""
    return F.concat(F.left(slug(title), F.lit(71)), F.lit("-"), F.left(F.sha2(blank(url), 256), F.lit(8)))


def escape_yaml(x: Column) -> Column:
    return F.replace(F.replace(blank(x), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))


def normalize_title(x: Column) -> Column:
    return normalize_space(fold(F.regexp_replace(blank(x), r"[^\p{L}\p{N}_\s\p{Z}]", " ")))


def clean_text(x: Column) -> Column:
    """Cut at the earliest prompt that doesn't stand first; places are counted in the folded text."""
    folded = fold(x)
    places = [F.nullif(F.greatest(F.instr(folded, m.lower().replace("ß", "ss")) - 1, F.lit(0)), F.lit(0)) for m in fixed.CLEAN_MARKERS]
    at = F.least(*places)
    return F.when(at.isNull(), blank(x)).otherwise(rstrip(F.left(blank(x), at)))


def window(title: Column, text: Column) -> Column:
    return fold(F.concat(blank(title), F.lit("\n"), F.left(blank(text), F.lit(fixed.TEASER_WINDOW))))


def has_any(x: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(x, F.lit(m.lower().replace("ß", "ss")))
    return out


def clipped(x: Column, limit: int) -> Column:
    return F.left(strip(F.replace(blank(x), F.lit("\n"), F.lit(" "))), F.lit(limit))


def image_filename(position: Column, url: Column) -> Column:
    """A stable name: position from 0, hash of the address, its suffix where that is an image's."""
    path = F.regexp_extract(blank(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    ext = F.regexp_extract(path, r"[^/](\.(?:jpg|jpeg|png|gif|webp|svg))$", 1)
    return F.concat(F.format_string("img_%03d_", position), F.left(F.md5(blank(url).cast("binary")), F.lit(8)), F.when(ext == "", F.lit(".jpg")).otherwise(ext))


def title_of(html: Column, metadata: Column | None = None) -> Column:
    """The text of the title element, that of the metadata where it has one, up to a bar or a spaced dash."""
    raw = normalize_space(F.regexp_extract(blank(html), r"(?i)<title[^>]*>([^<]+)</title>", 1))
    if metadata is not None:
        given = normalize_space(F.regexp_extract(blank(metadata), r"<title[^>]*>([^<]+)</title>", 1))
        raw = F.when(blank(metadata).rlike(r"<title[^>]*>[^<]+</title>"), given).otherwise(raw)
    return strip(F.split_part(F.split_part(raw, F.lit("|"), F.lit(1)), F.lit(" - "), F.lit(1)))


def discovery_datetime(x: Column) -> Column:
    """RFC 2822 or ISO 8601, else null; without a zone UTC."""
    rfc = F.regexp_replace(strip(x), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(strip(x)))
