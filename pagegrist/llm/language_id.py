"""Language identification of pages by Bayesian evidence fusion.

Four witnesses add up in log odds. The text: naive Bayes over hashed byte triplets of the visible text, learnt from a bounded
sample of labelled documents (``SAMPLE``) and tempered to ``WEIGHT`` triplets, as neighbours aren't independent. The
declared markup language: how often pages whose text says one language declare another, counted over all pages. The
address: shares of languages by host, smoothed towards those of the address suffix, these towards those of all
pages, all counted by grouped aggregation; a page's own vote is left out of its host's.

Defined results: a null page or one without text has a flat text likelihood, so the others decide; a null or odd
address has host and suffix ""; an absent or unknown declaration is "other"; ties go to the first language by
code; equal rows are judged as often as given; an empty table gives no row; without labelled documents the language
is null; columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sized_broadcast

#: Labelled documents learnt from at most; all their languages are told apart.
SAMPLE = 10_000
SLOTS, WEIGHT, PSEUDO = 1 << 14, 40, 20.0
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


def visible(page: str) -> str:
    """The text between the tags, without what isn't shown."""
    return " ".join(markup.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page))).split())


def triplets(text: str) -> np.ndarray:
    """Slots of the byte triplets of a lower-cased text with a space at both ends."""
    d = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(d) < 3 or not text:
        return np.zeros(0, np.int64)
    h = (d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(18)).astype(np.int64)


def learn(docs: DataFrame, rows: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a row of log likelihoods of the slots for each."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    few = labelled.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    few = labelled.join(F.broadcast(few.select("doc_id").distinct()), "doc_id", "left_semi")  # `rows` bounds the broadcast side

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in it:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in held:
                    held[lang] = np.zeros(SLOTS, np.int64)
                held[lang] += np.bincount(triplets(text), minlength=SLOTS)
        if held:
            yield pa.RecordBatch.from_pydict({"lang": list(held), "counts": [v.tobytes() for v in held.values()]})

    sums: dict[str, np.ndarray] = {}
    for r in few.select("lang", "text").coalesce(16).mapInArrow(counted, "lang string, counts binary").toLocalIterator():
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(bytes(r["counts"]), np.int64)
    langs = sorted(sums)
    if not langs:
        return [], np.zeros((0, SLOTS), np.float32)
    grid = np.array([sums[x] for x in langs], float) + 0.1
    return langs, np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)


def _heard(langs: list[str], table: np.ndarray):
    schema = pa.schema([("row", pa.int64()), ("text_lang", pa.int32()), ("n_chars", pa.int64()), ("heard", pa.list_(pa.float64()))])

    def heard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = np.ascontiguousarray(table.T)
        for batch in it:
            out = [pa.RecordBatch.from_arrays([c for c in batch.columns], schema=batch.schema)]
            best, chars, likely = [], [], []
            for page in batch.column("html").to_pylist():
                text = visible(page or "")
                slots = triplets(text)
                total = np.zeros(len(langs)) if not len(slots) else sum(across[slots[i : i + 65536]].sum(axis=0, dtype=float) for i in range(0, len(slots), 65536)) * (min(len(slots), WEIGHT) / len(slots))
                likely.append((total - total.max()).tolist())
                best.append(int(total.argmax()) if len(slots) else -1)
                chars.append(len(text))
            names = [n for n in batch.schema.names if n != "html"]
            columns = [out[0].column(n) for n in names] + [pa.array(best, pa.int32()), pa.array(chars, pa.int64()), pa.array(likely, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *schema.names[1:]])

    return heard


def identify(spark: SparkSession, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host, suffix, n_chars: one row per row of pages."""
    scratch = Scratch(spark, "language")
    langs, table = learn(docs)
    url, page = F.lower(F.col("url").cast("string")), F.col("html").cast("string")
    host = F.coalesce(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1), F.lit(""))
    opening = F.lower(F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    declared = F.when(opening.isin(langs), opening).otherwise("other") if langs else F.lit("other")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.coalesce(declared, F.lit("other")).alias("declared"), page.alias("html"))
    slim = slim.withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
    if not langs:
        return slim.selectExpr("page_id", "cast(null as string) as lang", "cast(null as double) as confidence", "cast(null as string) as text_lang", "declared", "host", "suffix", "cast(0 as bigint) as n_chars")
    seen = scratch.save(slim.select("page_id", "host", "suffix", "declared", "html").mapInArrow(_heard(langs, table), "page_id long, host string, suffix string, declared string, text_lang int, n_chars long, heard array<double>"))
    n = len(langs)
    votes = [F.count_if(F.col("text_lang") == i).cast("double") for i in range(n)]
    hosts = scratch.save(seen.groupBy("host", "suffix").agg(F.array(*votes).alias("by_host")))
    add = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    suffixes = hosts.groupBy("suffix").agg(add("by_host").alias("by_suffix"))
    whole = [float(x or 0) for x in hosts.agg(add("by_host").alias("a")).first()["a"]]
    prior = [(x + 1) / (sum(whole) + n) for x in whole]
    said = {(r["text_lang"], r["declared"]): r["m"] for r in seen.where("text_lang >= 0").groupBy("text_lang", "declared").agg(F.count("*").alias("m")).collect()}  # languages squared at most
    names = [*langs, "other"]
    chance = [[np.log((said.get((i, d), 0) + PSEUDO / len(names)) / (sum(said.get((i, e), 0) for e in names) + PSEUDO)) for i in range(n)] for d in names]
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)
    smoothed = lambda c, i, up: (F.col(c)[i] + F.lit(PSEUDO) * up) / (total(c) + F.lit(PSEUDO))
    priors = hosts.join(suffixes, "suffix").select("host", "by_host", F.array(*[smoothed("by_suffix", i, F.lit(prior[i])) for i in range(n)]).alias("up"))
    priors = scratch.save(priors)
    joined = seen.join(sized_broadcast(priors, priors.count()), "host")
    own = lambda i: (F.col("text_lang") == i).cast("double")
    left = total("by_host") - (F.col("text_lang") >= 0).cast("double")
    by_host = [F.log((F.col("by_host")[i] - own(i) + F.lit(PSEUDO) * F.col("up")[i]) / (left + F.lit(PSEUDO))) for i in range(n)]
    spoken = F.element_at(F.create_map(*[x for d, row in zip(names, chance) for x in (F.lit(d), F.array(*[F.lit(float(v)) for v in row]))]), F.col("declared"))
    fused = joined.withColumn("spoken", spoken).withColumn("odds", F.array(*[F.col("heard")[i] + F.col("spoken")[i] + by_host[i] for i in range(n)]))
    fused = fused.withColumn("top", F.array_max("odds"))
    name = F.array(*map(F.lit, langs))
    share = 1 / F.aggregate("odds", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return fused.select(
        "page_id", F.element_at(name, F.array_position("odds", F.col("top")).cast("int")).alias("lang"), share.alias("confidence"),
        F.when(F.col("text_lang") >= 0, F.element_at(name, F.col("text_lang") + 1)).alias("text_lang"), "declared", "host", "suffix", "n_chars",
    )
