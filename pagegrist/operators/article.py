"""Article records rendered as Markdown with front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def markdown(title: Column, author: Column, date: Column, text: Column, images: Column, url: Column, folder: str = "images", escape=T.escape_yaml) -> Column:
    """Front matter, heading, the first image, the text, the other images. escape: what makes a value fit for quotes."""
    quoted = lambda name, v: F.concat(F.lit(f'{name}: "'), escape(v), F.lit('"'))
    given = lambda v, line: F.when(T.blank(v) != "", line)
    picture = lambda u, i: F.concat(F.lit(f"![image]({folder}/"), T.image_filename(i, u), F.lit(")"))
    hero = F.when(F.size(images) > 0, F.array(picture(images[0], F.lit(0)), F.lit(""))).otherwise(F.array().cast("array<string>"))
    rest = F.flatten(F.transform(images, lambda u, i: F.when(i == 0, F.array(F.lit(""))).otherwise(F.array(picture(u, i), F.lit("")))))
    head = F.array(F.lit("---"), quoted("title", title), given(author, quoted("author", author)), given(date, F.concat(F.lit("date: "), date)), F.concat(F.lit("source: "), T.blank(url)), F.lit("---"), F.lit(""), F.concat(F.lit("# "), T.blank(title)), F.lit(""))
    lines = F.concat(F.array_compact(head), hero, F.array(T.blank(text)), F.when(F.size(images) > 1, rest).otherwise(F.array().cast("array<string>")))
    return F.array_join(lines, "\n")
