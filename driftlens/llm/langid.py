"""Language identification by Bayesian evidence fusion (op 3).

log P(language | row) = text + declared markup language + address suffix + host prior, up to a constant:

- *text*: log-likelihood of the whole text's byte trigrams under each language's model, divided by ``TEMPER`` because
  neighbouring trigrams overlap. Models are fitted on a bounded sample of each declared language (its distinct texts of the smallest hashes, ``SAMPLE_ROWS`` shared
  out evenly but ``LEAST_ROWS`` each at least; the driver gets their trigram counts, not their texts); trigrams go to ``BINS`` bins. A further class ``und`` gives every bin the same probability.
- *declared language*: right with probability ``TRUST``, else any other.
- *address suffix*: counts of (suffix, language) over all rows, smoothed.
- *host prior*: counts of (host, language) over all rows by grouped aggregation, smoothed towards those of the host's
  parent domain, these towards those of all rows, these towards equal shares (``STRENGTH`` rows' worth each time). The
  counts are of each row's best language by text and declaration alone.

A row is rejected if ``und`` has at least ``REJECT``: its letters fit no language; a short text hardly has that much evidence. A row whose declared language
has too little text in all for a model is never rejected. Defined results: a column of the name that is added is replaced; a null or empty text
is no evidence, so declaration and priors decide, and it stays; a null or unknown declaration, host or URL is none;
repeated rows are judged each; a table without rows, or without declared languages, gives ``und`` with nothing rejected.

Scale: two streaming passes over the text; only counts are shuffled, summed up before. The host priors are
joined salted, so that a host with a third of all rows is spread; Spark broadcasts them only when their written size is under its threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlens.llm.common import ship, through, written

SAMPLE_ROWS = 2000
BINS = 1 << 15
TEMPER = 3.0
TRUST = 0.9
STRENGTH = 20.0
REJECT = 0.5
UND_PRIOR = 0.01
LEAST_TRIGRAMS = 1000  # in the sample that a language must have
LEAST_ROWS = 100  # of each language, if it has so many
SALTS = 16
UND = "und"
FOLD = np.arange(256, dtype=np.uint32)
FOLD[65:91] += 32
FOLD[:65] = FOLD[91:97] = FOLD[123:128] = 32


def _bins(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the byte trigrams of all texts in a row, and where each text's begin; letters only, ASCII in lower case."""
    coded = [(" " + (t or "") + "  ").encode() for t in texts]
    data = FOLD[np.frombuffer(b"".join(coded), dtype=np.uint8)]
    data = np.concatenate([data, np.full(2, 32, dtype=np.uint32)])
    a, b, c = data[:-2], data[1:-1], data[2:]
    bins = ((a * np.uint32(0x01000193) ^ b) * np.uint32(0x01000193) ^ c) * np.uint32(0x9E3779B1) >> np.uint32(17)
    bins[(b == 32) & ((a == 32) | (c == 32))] = BINS  # no evidence
    return bins, np.cumsum([0] + [len(x) for x in coded[:-1]])


class Model:
    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages = languages  # und last
        self.table = table  # log-probabilities over BINS + 1 bins and languages

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Tempered log-likelihood of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        step, at = 1 << 18, 0
        while at < len(texts):  # some megabytes of text at a time
            to, size = at, 0
            while to < len(texts) and (size == 0 or size < step):
                size += len(texts[to] or "") + 1
                to += 1
            bins, starts = _bins(texts[at:to])
            for k in range(len(self.languages)):
                out[at:to, k] = np.add.reduceat(self.table[k][bins], starts)
            at = to
        return out / TEMPER


def train(docs: DataFrame, text: str = "text", declared: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Models of every declared language, from a bounded number of its distinct texts, those of the smallest hashes."""
    sample = docs.where(F.col(declared).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(declared).cast("string").alias("d"), F.xxhash64(declared, text).alias("h"))
    each = max(LEAST_ROWS, rows // max(1, sample.select("d").distinct().count()))
    # the hashes first, so that no task or driver holds more texts than the sample has; a row a language
    nth = F.row_number().over(Window.partitionBy("d").orderBy("h"))
    last = sample.select("d", "h").distinct().withColumn("nth", nth).where(F.col("nth") <= each).groupBy("d").agg(F.max("h").alias("last"))
    chosen = sample.join(F.broadcast(last), "d").where("h <= last").dropDuplicates(["d", "h"]).select("d", "t")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in through(batches):
            for d, texts in batch.groupby("d")["t"]:
                n = np.bincount(_bins(list(texts))[0], minlength=BINS + 1)[:BINS]
                at = np.flatnonzero(n)
                yield pd.DataFrame({"d": d, "bin": at, "n": n[at]})

    got = chosen.mapInPandas(count, "d string, bin long, n long").groupBy("d", "bin").agg(F.sum("n").alias("n")).toPandas()
    counts = {str(d): np.bincount(x["bin"], weights=x["n"], minlength=BINS) for d, x in got.groupby("d")}
    # a model of hardly any text would be as flat as und
    languages = [x for x in sorted(counts) if counts[x].sum() >= LEAST_TRIGRAMS]
    table = np.zeros((len(languages) + 1, BINS + 1), dtype=np.float64)
    for k, language in enumerate(languages):
        table[k, :BINS] = np.log((counts[language] + 0.02) / (counts[language].sum() + 0.02 * BINS))
    table[-1, :BINS] = -np.log(BINS) if languages else 0.0
    return Model([*languages, UND], table)


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1)), F.lit(""))


def declared_of(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))


def _declared_log(model: Model, declared) -> np.ndarray:
    """log P(declared | language); und declares any."""
    n = len(model.languages)
    place = {x: i for i, x in enumerate(model.languages[:-1])}
    at = np.array([place.get(str(d).lower(), -1) if d is not None else -1 for d in declared])
    out = np.full((len(at), n), np.log((1 - TRUST) / max(1, n - 2)))
    out[np.arange(len(at)), at] = np.log(TRUST)
    out[:, -1] = -np.log(max(1, n - 1))
    out[at < 0] = 0.0
    return out


def _posterior(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def host_priors(docs: DataFrame, model: Model, text: str, declared: str, host: Column) -> DataFrame:
    """host -> prior (array over the model's languages) and suffix likelihood, from all rows; one row a host."""

    @F.pandas_udf("int")
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, said in through(batches):
            logs = model.scores(list(texts)) + _declared_log(model, said)
            logs[:, -1] += np.log(UND_PRIOR)
            yield pd.Series(logs.argmax(axis=1), dtype="int32")

    n = len(model.languages)
    h = F.coalesce(host, F.lit(""))
    counted = docs.select(h.alias("host"), best(F.col(text), F.col(declared).cast("string")).alias("k")).groupBy("host", "k").agg(F.count("*").alias("n"))
    hosts = written(counted, "hosts")
    parent = F.when(F.instr("host", ".") > 0, F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).otherwise(F.lit(""))
    suffix = F.when(F.instr("host", ".") > 0, F.regexp_extract("host", r"([^.]+)$", 1)).otherwise(F.lit(""))
    leveled = hosts.withColumns({"parent": parent, "suffix": suffix})

    def level(keys: list[str], name: str) -> DataFrame:
        one = [F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(n)]
        return leveled.groupBy(*keys).agg(*one).select(*keys, F.array(*[F.col(f"c{k}").cast("double") for k in range(n)]).alias(name))

    def smooth(counts: str, towards: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(F.col(counts), towards, lambda c, p: (c + STRENGTH * p) / (total + STRENGTH))

    everything = level([], "all_c").select(smooth("all_c", F.array(*[F.lit((1 - UND_PRIOR) / max(1, n - 1))] * (n - 1), F.lit(UND_PRIOR))).alias("all_p"))
    parents = level(["parent"], "parent_c").join(F.broadcast(everything)).select("parent", smooth("parent_c", F.col("all_p")).alias("parent_p"))
    # P(suffix | language) as the language's share among rows of the suffix over its share among all rows
    suffixes = level(["suffix"], "suffix_c").join(F.broadcast(everything)).select(
        "suffix", F.when(F.col("suffix") != "", F.zip_with(smooth("suffix_c", F.col("all_p")), F.col("all_p"), lambda a, b: F.log(a / b))).otherwise(F.array(*[F.lit(0.0)] * n)).alias("suffix_l")
    )
    priors = level(["host", "parent", "suffix"], "host_c").join(parents, "parent").join(suffixes, "suffix")
    own = F.when(F.col("host") == "", F.col("parent_p")).otherwise(smooth("host_c", F.col("parent_p")))
    return written(priors.select("host", F.zip_with(F.transform(own, lambda p: F.log(p)), F.col("suffix_l"), lambda a, b: a + b).alias("evidence")), "priors")


def identified(docs: DataFrame, text: str = "text", declared: str = "lang", host: Column | None = None, key: str = "doc_id", into: str = "langid", rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with a column ``into``: struct(lang, posterior, keep). host: the row's host (default: its source)."""
    ship(docs.sparkSession)
    host = F.col("source").cast("string") if host is None else host
    model = train(docs, text, declared, rows)
    priors = host_priors(docs, model, text, declared, host)
    modelled = {x.lower() for x in model.languages[:-1]}

    @F.pandas_udf("lang string, posterior double, keep boolean")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, said, evidence in through(batches):
            if not len(texts):
                continue
            logs = model.scores(list(texts)) + _declared_log(model, said) + np.stack(list(evidence))
            p = _posterior(logs)
            k = p[:, :-1].argmax(axis=1) if p.shape[1] > 1 else np.zeros(len(p), dtype=int)
            top = p[np.arange(len(p)), k]
            unknown = np.array([d is not None and str(d).lower() not in modelled for d in said])
            keep = (p[:, -1] < REJECT) | unknown | (p.shape[1] == 1)
            yield pd.DataFrame({"lang": np.where(keep, np.array(model.languages, dtype=object)[k], UND), "posterior": top.round(6), "keep": keep})

    salted = priors.select(F.col("host").alias("__lid_host"), F.col("evidence").alias("__lid_evidence"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__lid_salt"))
    keyed = docs.withColumns({"__lid_h": F.coalesce(host, F.lit("")), "__lid_s": F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")})
    joined = keyed.join(salted, (F.col("__lid_h") == F.col("__lid_host")) & (F.col("__lid_s") == F.col("__lid_salt")))
    return joined.select(*[c for c in docs.columns if c.lower() != into.lower()], decide(F.col(text), F.col(declared).cast("string"), F.col("__lid_evidence")).alias(into))


def accepted(docs: DataFrame) -> DataFrame:
    """docs without the rows that language identification rejects; the same columns."""
    return identified(docs, into="__langid").where("__langid.keep").select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, declared, lang, posterior, keep of each document."""
    found = identified(docs.select("doc_id", "text", "lang", "source"), into="langid")
    return found.select("doc_id", F.col("lang").alias("declared"), "langid.lang", "langid.posterior", "langid.keep")
