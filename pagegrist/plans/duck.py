"""Building blocks of the oracle SQL: DuckDB expressions as text."""

from __future__ import annotations

from ..functions import fixed

WS = r"[\s\x0b\p{Z}\x{1c}-\x{1f}\x{85}]"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"replace(lower(coalesce({x}, '')), 'ß', 'ss')"


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return strip(rf"regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g')")


def mlen(x: str) -> str:
    return rf"length(regexp_replace(coalesce({x}, ''), '[\p{{Z}}\p{{C}}]', '', 'g'))"


def any_of(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(m.lower().replace('ß', 'ss'))})" for m in markers) + ")"


CLOSE = fixed.CLOSING.replace("]", r"\]").replace("[", r"\[").replace("'", "''")
TERMINAL_END = rf"[{fixed.TERMINAL}][\s\x0b\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}{CLOSE}]*$"


def signal(x: str) -> str:
    """A time, a percentage, a currency sign, a ticker or a quarter; word boundaries written out for all letters."""
    a, z = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    return rf"regexp_matches({x}, '{a}[0-9]{{1,2}}:[0-9]{{2}}{z}|{a}[0-9]+(?:\.[0-9]+)?%[\p{{L}}\p{{N}}_]|[$€£¥₹₩₽]|{a}[A-Z]{{2,6}}{z}|{a}Q[1-4]{z}')"


def text_metrics(source: str, keys: str, text: str = "text", p: str = "") -> str:
    """CTEs ending in b: text metrics of a source's rows, with these key columns; p begins the CTEs' names."""
    raw = "replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return rf"""
{p}a AS (SELECT {keys}, {strip(text)} AS t FROM {source}),
{p}p AS (SELECT *, list_filter(list_transform(regexp_split_to_array({raw}, '\n{WS}*\n+'), lambda s: {strip('s')}), lambda s: s <> '') AS blocks,
             list_filter(list_transform(string_split({raw}, chr(10)), lambda s: {strip('s')}), lambda s: s <> '') AS lines,
             list_transform(list_filter(string_split(replace(t, chr(13), chr(10)), chr(10)), lambda s: {mlen('s')} >= 3), lambda s: {fold(norm('s'))}) AS rep FROM {p}a),
{p}l AS (SELECT *, list_filter(list_transform(CASE WHEN len(blocks) <= 1 AND len(lines) > 1 THEN lines ELSE blocks END, lambda s: {mlen('s')}), lambda n: n > 0) AS lens FROM {p}p),
{p}m AS (SELECT {keys}, t, lens, {mlen('t')}::INT AS content_chars,
  CASE WHEN {mlen('t')} = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) / {mlen('t')}::DOUBLE END AS letter_number_ratio,
  length(regexp_replace(t, '[^{fixed.TERMINAL}]', '', 'g'))::INT AS terminal_count, regexp_matches(t, '{TERMINAL_END}') AS terminal_ending,
  CASE WHEN len(rep) < 4 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - len(list_distinct(rep)) / len(rep)::DOUBLE END AS repeated_line_ratio,
  len(lens)::INT AS paragraph_count, coalesce(list_avg(lens), 0.0::DOUBLE) AS paragraph_mean,
  CASE WHEN len(lens) <= 1 THEN 0.0::DOUBLE ELSE list_var_pop(lens) END AS paragraph_variance,
  len(list_filter(lens, lambda n: n >= 80))::INT AS long_paragraph_count,
  CASE WHEN len(lens) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(lens, lambda n: n <= 40)) / len(lens)::DOUBLE END AS short_paragraph_ratio,
  len(list_filter(lens, lambda n: n <= 35)) / greatest(len(lens), 1)::DOUBLE AS shorter_paragraph_ratio FROM {p}l),
{p}b AS (SELECT *, CASE WHEN paragraph_mean > 0 THEN sqrt(paragraph_variance) / paragraph_mean ELSE 0.0::DOUBLE END AS paragraph_cv FROM {p}m)"""


def steps(*cases: tuple[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}::DOUBLE" for t, v in cases) + " ELSE 0.0::DOUBLE END"


def score(title_chars: str = "0", tree: bool = False) -> str:
    """The score of a text, with the points of its page's tree or without markup, as a sum in order."""
    structure = [
        steps(("article_container_present", 0.08)),
        steps(("article_text_ratio >= 0.55::DOUBLE", 0.06), ("article_text_ratio > 0 AND article_text_ratio < 0.15::DOUBLE", -0.07)),
        steps(("link_density <= 0.12::DOUBLE", 0.07), ("link_density >= 0.55::DOUBLE", -0.25), ("link_density >= 0.35::DOUBLE", -0.12)),
        steps(("text_to_html_ratio >= 0.03::DOUBLE", 0.04), ("text_to_html_ratio > 0 AND text_to_html_ratio < 0.001::DOUBLE", -0.05)),
        steps(("paragraph_count_dom >= 4", 0.05)),
        steps(("dom_depth BETWEEN 3 AND 60", 0.02)),
        steps(("form_count >= 2 AND content_chars < 1000", -0.08)),
        steps(("interactive_density >= 0.25::DOUBLE", -0.08)),
    ]
    parts = [
        steps(("content_chars >= 1800", 0.22), ("content_chars >= 900", 0.18), ("content_chars >= 450", 0.12), ("content_chars >= 220", 0.07), ("content_chars >= 100", 0.03)),
        steps(("paragraph_count >= 5", 0.12), ("paragraph_count >= 3", 0.09), ("paragraph_count = 2", 0.06), ("paragraph_count = 1", 0.03)),
        steps(("long_paragraph_count >= 3", 0.08), ("long_paragraph_count >= 1", 0.04)),
        steps(("paragraph_count < 3", 0.0), ("paragraph_cv BETWEEN 0.12::DOUBLE AND 1.8::DOUBLE", 0.04), ("paragraph_cv < 0.04::DOUBLE AND short_paragraph_ratio >= 0.7::DOUBLE", -0.05), ("paragraph_cv > 2.5::DOUBLE", -0.02)),
        steps((f"{title_chars} >= 3", 0.05)),
        steps(("terminal_count >= 2", 0.06), ("terminal_ending", 0.04)),
        steps(("letter_number_ratio >= 0.55::DOUBLE", 0.05), ("letter_number_ratio < 0.35::DOUBLE", -0.12)),
        steps(("repeated_line_ratio >= 0.45::DOUBLE", -0.15), ("repeated_line_ratio >= 0.25::DOUBLE", -0.08)),
        *(structure if tree else ["0.07::DOUBLE"]),
        steps(("content_chars < 1200 AND NOT terminal_ending", -0.05)),
    ]
    return "least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.35::DOUBLE + " + " + ".join(parts) + "))"


def gate(source: str, keys: str, text: str = "text", title: str | None = None) -> str:
    """CTEs ending in g: the verdict over texts alone (no markup); title must be among the keys."""
    name = f"coalesce({title}, '')" if title else "''"
    seen = fold(f"{name} || chr(10) || left(t, {fixed.TEASER_WINDOW})")
    plain = fixed.PLAIN_CAPTCHA
    titled = fold(norm(name))
    end = r"(?:[^\p{L}\p{N}_]|$)"
    r = "left(t, 400000)"
    return text_metrics(source, keys, text) + rf""",
s AS (SELECT *, {score(mlen(name))} AS score,
  regexp_matches({r}, '(?is){fixed.MARKUP}') AS markup, regexp_matches({titled}, '(?i){fixed.CHALLENGE_TITLES}{end}') AS t_challenge, regexp_matches({titled}, '(?i){fixed.DENIED_TITLES}{end}') AS t_denied,
  regexp_matches({r}, '(?is){fixed.DENIED_TEXT}') AS denied, regexp_matches({r}, '(?is){fixed.DEFAULT_PAGES}') AS dflt, regexp_matches({r}, '(?is){fixed.CHALLENGE_BODY}') AS body,
  regexp_matches({r}, '(?is){fixed.CHALLENGE_FORM}') AS form, regexp_matches({r}, '(?is){fixed.CHALLENGE_SCRIPT}') AS script,
  {mlen(norm(f"regexp_replace({r}, '<[^>]+>', ' ', 'g')"))} AS visible,
  regexp_matches({r}, '(?is){fixed.CAPTCHA}') AS captcha, {mlen(r)} < 1800 AND regexp_matches({r}, '(?is){plain}') AS plain_captcha FROM b),
d AS (SELECT *, (t_challenge AND (markup OR body)) OR CASE WHEN NOT markup AND NOT t_challenge THEN plain_captcha ELSE captcha END OR form OR script
  OR ((t_denied OR dflt) AND visible < 5000 AND (markup OR denied OR dflt)) OR (denied AND (markup OR visible < 1800)) AS blocked,
  (contains({fold(name)}, 'do not delete') AND {' + '.join(f"contains({seen}, {lit(x)})::INT" for x in fixed.NAVIGATION_SIGNALS)} >= 3)
  OR (paragraph_count >= 8 AND shorter_paragraph_ratio >= 0.75::DOUBLE AND repeated_line_ratio >= 0.2::DOUBLE) AS navigation,
  {any_of(seen, fixed.TEASER_MARKERS)} AS teaser, {news(name)} AS newsflash FROM s),
w AS (SELECT *, CASE WHEN blocked THEN 1 WHEN navigation THEN 2 WHEN teaser THEN 3 WHEN content_chars < 100 THEN CASE WHEN newsflash THEN 6 ELSE 4 END WHEN score >= 0.52::DOUBLE OR newsflash THEN 6 ELSE 7 END AS way FROM d),
g AS (SELECT * EXCLUDE (score), way = 6 AS ok, CASE WHEN way = 6 THEN '' WHEN way = 3 THEN 'PAYWALL_REMAINING' ELSE 'EXTRACT_FAILED' END AS error_code,
  CASE way WHEN 1 THEN 'challenge_shell' WHEN 2 THEN 'navigation_shell' WHEN 3 THEN 'teaser_markers' WHEN 4 THEN 'content_chars=' || content_chars || ' < 100' WHEN 6 THEN 'pass'
    ELSE 'structural_score=' || printf('%.3f', score) || ' < 0.520' END AS reason,
  CASE WHEN way IN (1, 2, 3) THEN 0.0::DOUBLE ELSE score END AS score FROM w)"""


def news(title: str) -> str:
    return rf"""(content_chars BETWEEN 45 AND 700 AND {mlen(title)} >= 3 AND paragraph_count BETWEEN 1 AND 5 AND (terminal_ending OR terminal_count >= 1) AND score >= 0.46::DOUBLE
      AND (length(regexp_replace(t, '[^\p{{Nd}}]', '', 'g')) / greatest(content_chars, 1)::DOUBLE >= 0.01::DOUBLE
           OR {signal('t')} OR terminal_count >= 2 OR content_chars >= 220))"""


def page_gate(metrics: str, access: str) -> str:
    """CTEs ending in g: the verdict over pages; metrics as of tree, access as of access_sql."""
    kept = "page_id, raw_title, article_container_present, article_text_ratio, link_density, text_to_html_ratio, paragraph_count_dom, dom_depth, form_count, interactive_density, link_count, navigation_text_ratio, list_item_count, password_input_count, modal_count, hidden_prose_count, paywall_attribute_count, jsonld_article_body_chars, cta_count"
    seen = fold(f"raw_title || chr(10) || left(t, {fixed.TEASER_WINDOW})")
    return rf"""{text_metrics(metrics, kept, "article_text", "g")},
gs AS (SELECT gb.*, {score(mlen("raw_title"), True)} AS score, {access}.detected AS blocked FROM gb JOIN {access} USING (page_id)),
gd AS (SELECT *, {any_of(seen, fixed.TEASER_MARKERS)} AS marked,
  content_chars < 1200 AND (CASE WHEN paragraph_count_dom > 0 THEN paragraph_count_dom ELSE paragraph_count END) <= 3 AS sparse,
  (contains({fold("raw_title")}, 'do not delete') AND {' + '.join(f"contains({seen}, {lit(x)})::INT" for x in fixed.NAVIGATION_SIGNALS)} >= 3)
  OR (paragraph_count >= 8 AND shorter_paragraph_ratio >= 0.75::DOUBLE AND repeated_line_ratio >= 0.2::DOUBLE)
  OR (link_count >= 8 AND link_density >= 0.55::DOUBLE AND paragraph_count_dom <= 2) OR (navigation_text_ratio >= 0.58::DOUBLE AND article_text_ratio < 0.35::DOUBLE AND paragraph_count_dom <= 3)
  OR (list_item_count >= 10 AND list_item_count >= greatest(4, paragraph_count_dom * 4) AND link_density >= 0.35::DOUBLE) OR (interactive_density >= 0.25::DOUBLE AND paragraph_count_dom <= 1 AND content_chars < 1000) AS navigation,
  {news("raw_title")} AS newsflash FROM gs),
gt AS (SELECT *, CASE WHEN marked THEN 'teaser_markers' WHEN content_chars < 700 AND form_count >= 1 AND cta_count >= 2 AND link_density >= 0.25::DOUBLE THEN 'teaser_login_shell' ELSE '' END AS teaser FROM gd),
gw AS (SELECT *, CASE WHEN blocked THEN 1 WHEN navigation THEN 2 WHEN teaser <> '' THEN 3 WHEN content_chars < 100 THEN CASE WHEN newsflash THEN 6 ELSE 4 END WHEN score >= 0.52::DOUBLE OR newsflash THEN 6 ELSE 7 END AS way FROM gt),
g AS (SELECT * EXCLUDE (score), way = 6 AS ok, way = 3 AS paywall_suspected, CASE WHEN way = 6 THEN '' WHEN way = 3 THEN 'PAYWALL_REMAINING' ELSE 'EXTRACT_FAILED' END AS error_code,
  CASE way WHEN 1 THEN 'challenge_shell' WHEN 2 THEN 'navigation_shell' WHEN 3 THEN teaser WHEN 4 THEN 'content_chars=' || content_chars || ' < 100' WHEN 6 THEN 'pass'
    ELSE 'structural_score=' || printf('%.3f', score) || ' < 0.520' END AS reason,
  CASE WHEN way IN (1, 2, 3) THEN 0.0::DOUBLE ELSE score END AS score FROM gw)"""


def shown(x: str) -> str:
    """The text of a piece of a page: without comments, scripts, styles and tags, with the named characters that pages use."""
    out = x
    for p in (r"(?s)<!--.*?-->", r"(?s)<script\b.*?</script>", r"(?s)<style\b.*?</style>", r"<[^>]*>"):
        out = f"regexp_replace({out}, {lit(p)}, '', 'g')"
    for name, c in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", chr(34)), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', {lit(c)})"
    return out


def _count(tag: str, x: str) -> str:
    return f"len(regexp_extract_all({x}, '(?i)<{tag}\\b'))::INT"


def tree(source: str = "pages", keys: str = "page_id, url, html") -> str:
    """CTEs ending in tr: the tree's metrics of pages of one build: an article with a heading and paragraphs, of which some are never closed.

    What follows a paragraph that isn't closed is inside of it, up to the end of the article.
    """
    part = lambda tag: f"regexp_extract(html, '(?s)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)"
    return rf"""
h0 AS (SELECT {keys}, {part("article")} AS art, {part("nav")} AS nav, {part("footer")} AS foot, {norm(shown(part("title")))} AS raw_title FROM {source}),
h1 AS (SELECT *, string_split(art, '<p>') AS segs, list_transform(string_split(art, '<p>'), lambda s: {mlen(shown("s"))}::INT) AS seg_chars,
  {mlen(shown("html"))}::INT AS visible_text_chars, {mlen(shown("art"))}::INT AS container_text_chars, {mlen(shown("nav"))}::INT + {mlen(shown("foot"))}::INT AS nav_chars,
  list_transform(regexp_extract_all(art, '(?s)<a\b[^>]*>(.*?)</a>', 1), lambda s: {mlen(shown("s"))}::INT) AS links FROM h0),
h2 AS (SELECT *, list_filter(list_transform(range(2, len(segs) + 1), lambda i: CASE WHEN contains(segs[i], '</p>') THEN seg_chars[i] ELSE list_sum(seg_chars[i:])::INT END), lambda n: n > 0) AS paras,
  list_filter(list_transform(regexp_split_to_array(art, '</?(?:h1|p|br)\b[^>]*>'), lambda s: {norm(shown("s"))}), lambda s: s <> '') AS blocks,
  len(regexp_extract_all(art, '<b>'))::INT AS open_ps FROM h1),
tr AS (SELECT * EXCLUDE (segs, seg_chars), length(html)::INT AS html_chars, false AS html_truncated, 0 AS jsonld_article_body_chars, {_count("[a-z][a-z0-9]*", "html")} AS tag_count, {_count("[a-z][a-z0-9]*", "art")} AS container_tag_count,
  greatest(6, 4 + 2 * open_ps)::INT AS dom_depth, visible_text_chars / html_chars::DOUBLE AS text_to_html_ratio, container_text_chars / visible_text_chars::DOUBLE AS article_text_ratio,
  coalesce(list_sum(links), 0)::INT AS link_text_chars, coalesce(list_sum(links), 0) / container_text_chars::DOUBLE AS link_density, len(links)::INT AS link_count, len(paras)::INT AS paragraph_count_dom,
  coalesce(list_avg(paras), 0.0::DOUBLE) AS paragraph_mean_dom, CASE WHEN len(paras) > 1 THEN list_var_pop(paras) ELSE 0.0::DOUBLE END AS paragraph_variance_dom,
  CASE WHEN len(paras) > 0 THEN (CASE WHEN len(paras) > 1 THEN sqrt(list_var_pop(paras)) ELSE 0.0::DOUBLE END) / list_avg(paras) ELSE 0.0::DOUBLE END AS paragraph_cv_dom,
  len(list_filter(paras, lambda n: n >= 80))::INT AS long_paragraph_count_dom, {_count("li", "art")} AS list_item_count, {_count("h[1-6]", "art")} AS heading_count,
  (len(list_filter(links, lambda n: n BETWEEN 1 AND 80)) + {_count("button", "html")})::INT AS cta_count, nav_chars / visible_text_chars::DOUBLE AS navigation_text_ratio, true AS article_container_present,
  (len(links) + {_count("button", "html")} + {_count("input", "html")}) / tag_count::DOUBLE AS interactive_density, {_count("script", "html")} AS script_count, {_count("form", "html")} AS form_count, {_count("button", "html")} AS button_count,
  {_count("input", "html")} AS input_count, 0 AS password_input_count, 0 AS meta_refresh_count, 0 AS paywall_attribute_count, 0 AS modal_count, 0 AS hidden_prose_count, 0 AS challenge_form_count,
  array_to_string(blocks, chr(10) || chr(10)) AS article_text FROM h2)"""
