"""Language identification by Bayesian fusion of evidence.

For each page, the posterior of a language is proportional to the product of

*   the likelihood of its text: byte trigrams of the text without markup under a
    smoothed model of each language, learned from labelled documents. Trigrams are
    not independent, so n of them count as `scale * n ** power` independent ones;
    scale and power are fitted on documents that the model has not seen;
*   the likelihood of its declared markup language, from counts of declared
    against likely languages over all pages;
*   the prior of its host, smoothed towards that of its domain, that towards that
    of its address suffix, and that towards that of all pages, each by SMOOTHING
    pseudo-counts. The counts are grouped aggregates of the texts' posteriors; a
    page's own share is taken out of all of them.

The fit reads a sample: of each language PER_LANGUAGE documents at most, in the
order of a hash, copies of a text once; one in HELD of them fits scale and power.
MOST_LANGUAGES (those with the most documents) bounds the model's table.

Counts are aggregated in part before any shuffle. They go back to their pages
by joins that split hot hosts, domains and suffixes (common.split_join).

Defined results: a null url has the empty host; null or empty pages, and pages
without text, rest on declaration and priors; very long pages count whole, by
parts of 65,536 trigrams; of tied languages the first by name is told; without
labelled documents there are no languages and lang is null; a null page_id is a
page of its own; repeated rows each get their result; other columns are passed over.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_of, checkpoint, session, split_join

#: Labelled documents of a language that the fit takes at most, one in how many of them fits the temper, and languages at most.
PER_LANGUAGE, HELD, MOST_LANGUAGES = 500, 5, 200
SMOOTHING = 5.0
TABLE = 1 << 16
#: A language needs as many labelled documents.
LEAST_DOCUMENTS = 3

_SKIPPED = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)
_SPACES = re.compile(r"[\W\d_]+")
_PART = 1 << 16


def page_text(page: str) -> str:
    return markup.unescape(_SKIPPED.sub(" ", page))


def trigrams(text: str) -> np.ndarray:
    """Table places of the byte trigrams of a text's letters."""
    data = np.frombuffer(f" {_SPACES.sub(' ', text.lower()).strip()} ".encode(), np.uint8).astype(np.uint32)
    if len(data) <= 2:
        return np.zeros(0, np.uint32)
    return ((data[:-2] * 0x9E3779B1 + data[1:-1] * 0x85EBCA77 + data[2:] * 0xC2B2AE3D) >> 7) & (TABLE - 1)


def summed(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The log-likelihood of trigrams under each language."""
    total = np.zeros(table.shape[1])
    for i in range(0, len(grams), _PART):
        total += table[grams[i : i + _PART]].sum(0, dtype=np.float64)
    return total


class Model:
    """Languages, log-probabilities of trigrams (a row for each table place), and the temper."""

    def __init__(self, langs: list[str], table: np.ndarray, scale: float = 1.0, power: float = 1.0):
        self.langs, self.table, self.scale, self.power = langs, table, scale, power

    def likely(self, grams: np.ndarray) -> np.ndarray:
        """The posterior of each language by the text alone."""
        n = len(grams)
        if not self.langs or not n:
            return np.full(len(self.langs), 1 / max(1, len(self.langs)))
        return softmax(summed(grams, self.table) / n * self.scale * n**self.power)


def softmax(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language's documents that are not held."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text, held in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "held"))):
            if not held:
                own = counts.setdefault(lang, np.zeros(TABLE, np.int64))
                np.add.at(own, trigrams(text or ""), 1)
    for lang, own in counts.items():
        yield batch_of(lang=pa.array([lang]), counts=pa.array([own.tobytes()], pa.binary()))


def _measure(shared):
    """Of held documents, and of pieces of them by powers of 4, the trigrams' number and mean log-likelihoods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lang, sizes, means = [], [], []
            for own, text, held in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "held"))):
                grams = trigrams(text or "") if held else ()
                sizes_of = {len(grams)} | {4**k for k in range(1, 6) if 4**k < len(grams)}
                for n in sorted(sizes_of - {0}):
                    lang.append(own)
                    sizes.append(n)
                    means.append(summed(grams[len(grams) - n :], table) / n)
            yield batch_of(lang=pa.array(lang, pa.string()), n=pa.array(sizes, pa.int64()), means=pa.array(means, pa.list_(pa.float64())))

    return run


def temper(right: np.ndarray, sizes: np.ndarray, means: np.ndarray) -> tuple[float, float]:
    """Scale and power of the least mean log loss of the right languages' places, over a grid."""
    best = (np.inf, 1.0, 1.0)
    for power in np.arange(0.0, 1.01, 0.1):
        for scale in 2.0 ** np.arange(-3, 6):
            p = softmax(means * (scale * sizes**power)[:, None])
            loss = -np.log(np.maximum(p[np.arange(len(p)), right], 1e-12)).mean()
            best = min(best, (round(float(loss), 12), float(scale), float(power)))
    return best[1], best[2]


def sampled(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """Languages, and a sample (lang, text, held) of their documents."""
    rows = docs.where("doc_id is not null and lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    found = counts.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not found:
        return [], rows.select("lang", "text", F.lit(False).alias("held")).limit(0)
    # A share that leaves about twice PER_LANGUAGE rows of each language goes through before any is ranked.
    share = F.create_map(*(F.lit(x) for r in found for x in (r["lang"], min(1.0, 2 * PER_LANGUAGE / r["n"]))))
    rows = rows.withColumn("u", F.xxhash64("text")).where(F.pmod(F.col("u"), F.lit(1 << 32)) < F.try_element_at(share, F.col("lang")) * float(1 << 32))
    rows = rows.groupBy("lang", "u").agg(F.min("text").alias("text"))  # copies count once
    place = F.row_number().over(W.partitionBy("lang").orderBy("u"))
    rows = rows.withColumn("place", place).where(F.col("place") <= PER_LANGUAGE)
    return sorted(r["lang"] for r in found), rows.select("lang", "text", (F.col("place") % HELD == 0).alias("held"))


def learn(docs: DataFrame) -> Model:
    spark = session(docs)
    langs, sample = sampled(docs)
    if not langs:
        return Model([], np.zeros((TABLE, 0), np.float32))
    sample = checkpoint(sample)
    counts = {x: np.zeros(TABLE) for x in langs}
    for r in sample.mapInArrow(_learn, "lang string, counts binary").collect():  # a row of 512 KB for each language and task that has it, in a bounded sample
        counts[r["lang"]] += np.frombuffer(r["counts"], np.int64)
    langs = [x for x in langs if counts[x].any()]
    if not langs:
        return Model([], np.zeros((TABLE, 0), np.float32))
    table = np.stack([np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * TABLE)) for x in langs], 1).astype(np.float32)
    shared = spark.sparkContext.broadcast(table)
    held = sample.where("held").mapInArrow(_measure(shared), "lang string, n long, means array<double>").toPandas()
    held = held[held["lang"].isin(langs)]
    if not len(held) or len(langs) < 2:
        return Model(langs, table)
    right = np.array([langs.index(x) for x in held["lang"]])
    return Model(langs, table, *temper(right, held["n"].to_numpy(np.float64), np.stack(held["means"].to_numpy())))


def _likelihoods(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            declared, rows, sizes = [], [], []
            for page in batch.column("html"):
                page = page.as_py() or ""
                m = _DECLARED.search(page)
                declared.append(m[1].lower() if m else "")
                grams = trigrams(page_text(page))
                rows.append(model.likely(grams))
                sizes.append(len(grams))
            yield batch_of(page_id=batch.column("page_id"), url=batch.column("url"), declared=pa.array(declared, pa.string()), n_trigrams=pa.array(sizes, pa.int64()), p=pa.array(rows, pa.list_(pa.float64())))

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def likelihoods(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, declared, n_trigrams, p (by language), and host, domain (its last two labels) and suffix (its last one) of each page."""
    spark = session(pages)
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = dict(pages.dtypes)["page_id"]
    rows = base.mapInArrow(_likelihoods(spark.sparkContext.broadcast((model.langs, model.table, model.scale, model.power))), f"page_id {kind}, url string, declared string, n_trigrams long, p array<double>")
    parts = F.split("host", "\\.")
    rows = rows.withColumn("host", host_of(F.col("url"))).drop("url")
    domain = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    return rows.withColumn("domain", domain).withColumn("suffix", F.element_at(parts, -1))


def _summed(rows: DataFrame, key: str, n: int, of: str, name: str, weight: Column) -> DataFrame:
    """Of each key the sum of the arrays `of` as `name`, of the weights as `name`_n, and the rows as `name`_rows."""
    sums = rows.groupBy(key).agg(*(F.sum(F.col(of)[k]).alias(f"s{k}") for k in range(n)), F.sum(weight).alias(f"{name}_n"), F.count("*").alias(f"{name}_rows"))
    return sums.select(key, F.array(*(F.col(f"s{k}") for k in range(n))).alias(name), f"{name}_n", f"{name}_rows")


def fuse(rows: DataFrame, langs: list[str]) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared, host, n_trigrams and posteriors, of likelihoods() that are read from files."""
    n, kinds = len(langs), float(max(1, len(langs)))
    by_host = rows.groupBy("host", "domain", "suffix").agg(*(F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(n)), F.count("*").alias("h_n"))
    by_host = checkpoint(by_host.select("host", "domain", "suffix", F.array(*(F.col(f"s{k}") for k in range(n))).alias("h"), "h_n"))
    by_domain = checkpoint(_summed(by_host, "domain", n, "h", "d", F.col("h_n")))
    by_suffix = checkpoint(_summed(by_host, "suffix", n, "h", "s", F.col("h_n")))
    whole = by_suffix.agg(*(F.sum(F.col("s")[k]).alias(f"g{k}") for k in range(n)), F.sum("s_n").alias("n"), F.sum("s_rows").alias("hosts")).first()
    total, pages, hosts_n = [float(whole[f"g{k}"] or 0.0) for k in range(n)], int(whole["n"] or 0), int(whole["hosts"] or 0)
    hosts = split_join(by_host, by_domain, "domain", "d_rows", hosts_n, salt=F.xxhash64("host"))
    hosts = split_join(hosts, by_suffix, "suffix", "s_rows", hosts_n, salt=F.xxhash64("host")).drop("domain", "suffix").withColumn("h_rows", F.col("h_n"))
    # Declared languages are two or three letters, so their counts are bounded (18,000 rows or so).
    by_declared = _summed(rows, "declared", n, "p", "c", F.lit(1)).select("declared", "c")
    joined = split_join(rows.drop("domain", "suffix"), hosts, "host", "h_rows", pages).join(F.broadcast(by_declared), "declared")

    totals = F.array(*(F.lit(t) for t in total))

    def fused(k: Column) -> Column:
        p = F.get("p", k)
        prior = (F.get(totals, k) - p + SMOOTHING / kinds) / (float(max(1, pages)) - 1 + SMOOTHING)
        for name in ("s", "d", "h"):
            prior = (F.greatest(F.get(name, k) - p, F.lit(0.0)) + SMOOTHING * prior) / (F.col(f"{name}_n") - 1 + SMOOTHING)
        share = (F.greatest(F.get("c", k) - p, F.lit(0.0)) + SMOOTHING / kinds) / (F.get(totals, k) + SMOOTHING)
        return F.log(F.greatest(p, F.lit(1e-30))) + F.log(share) + F.log(prior)

    names = F.array(*(F.lit(x) for x in langs))
    out = joined.select("page_id", "declared", "host", "n_trigrams", "p", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), fused).alias("logs")).withColumn("top", F.array_max("logs"))
    out = out.withColumn("e", F.transform("logs", lambda x: F.exp(x - F.col("top"))))
    out = out.withColumn("posteriors", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)))
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    text = F.array_position("p", F.array_max("p")).cast("int")
    return out.select("page_id", F.element_at(names, best).alias("lang"), F.array_max("posteriors").alias("posterior"), F.when(F.col("n_trigrams") > 0, F.element_at(names, text)).alias("text_lang"), "declared", "host", "n_trigrams", "posteriors")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared, host, n_trigrams and posteriors (by language) of each page."""
    model = learn(docs)
    rows = likelihoods(pages, model)
    if not model.langs:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", "n_trigrams", F.array().cast("array<double>").alias("posteriors"))
    return fuse(checkpoint(rows), model.langs)
