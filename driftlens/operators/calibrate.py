"""Verdicts back into weights and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlens.functions import columns as X
from driftlens.functions import constants as K

_CH = [ch for ch, _ in K.CHANNELS]


def calibrated(samples: DataFrame, *, prior: dict[str, float] | None = None, prior_strength: float = 8.0) -> DataFrame:
    """samples (channels, useful) -> one row: n, lambda and a weight for each channel."""
    given = dict(K.CHANNELS) if prior is None else prior
    total = sum(given.values())
    prior = {ch: (given[ch] / total if total else 1 / len(_CH)) for ch in _CH}
    means = [F.avg(F.when(F.col("useful") == u, F.col(ch))).alias(f"{ch}_{int(u)}") for ch in _CH for u in (True, False)]
    one = samples.agg(F.count("*").alias("n"), *means)
    both = F.col(f"{_CH[0]}_1").isNotNull() & F.col(f"{_CH[0]}_0").isNotNull()
    pos = {ch: F.greatest(F.col(f"{ch}_1") - F.col(f"{ch}_0"), F.lit(0.0)) for ch in _CH}
    possum = sum((pos[ch] for ch in _CH[1:]), pos[_CH[0]])
    lam = F.when(both, F.col("n") / (F.col("n") + prior_strength)).otherwise(F.lit(0.0))
    raw = {ch: lam * F.when(possum > 0, pos[ch] / possum).otherwise(F.lit(prior[ch])) + (1 - lam) * F.lit(prior[ch]) for ch in _CH}
    mixed = {ch: F.when(both, raw[ch]).otherwise(F.lit(prior[ch])) for ch in _CH}
    norm = sum((mixed[ch] for ch in _CH[1:]), mixed[_CH[0]])
    return one.select("n", lam.alias("lambda"), *[(mixed[ch] / norm).alias(f"w_{ch}") for ch in _CH])


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of append-only rows the last for each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def labeled(pairs: DataFrame, verdicts: DataFrame, tags: DataFrame) -> DataFrame:
    """pairs (pair_key, score) with label: the registry's verdict, else a tag of the fire id, else untagged."""
    v = verdicts.select("pair_key", "verdict")
    t = tags.select(F.col("id").alias("fire_id"), F.col("verdict").alias("tag"))
    withid = pairs.withColumn("fire_id", X.fire_id(F.lit("pair"), "pair_key"))
    return withid.join(v, "pair_key", "left").join(t, "fire_id", "left").withColumn("label", X.resolve_label("verdict", "tag")).drop("verdict", "tag")


def doctor(rows: DataFrame) -> DataFrame:
    """label, n, mean_score."""
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def discrimination(rows: DataFrame) -> DataFrame:
    """One row: whether useful pairs score above the others."""
    one = rows.agg(*[F.avg(F.when(F.col("label") == x, F.col("score"))).alias(a) for x, a in (("useful", "useful"), ("not-useful", "not_useful"))])
    return one.withColumn("verdict", F.when(F.col("useful").isNull() | F.col("not_useful").isNull(), "need-both").when(F.col("useful") > F.col("not_useful"), "discriminates").otherwise("not-discriminating"))


def precision_at(rows: DataFrame, ks: tuple[int, ...] = (5, 10), order: str = "pair_key") -> DataFrame:
    """k, real, labelled among the k best; a k beyond the number of rows gives none."""
    top = rows.orderBy(F.col("score").desc(), order).limit(max(ks))
    ranked = top.withColumn("rk", F.row_number().over(Window.orderBy(F.col("score").desc(), order)))  # at most max(ks) rows
    ks_ = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    inside = ranked.select("rk", "label", ks_).where("rk <= k").groupBy("k").agg(
        F.count("*").alias("n"), F.count_if(F.col("label").isin("useful", "mixed")).alias("real"), F.count_if(F.col("label") != "untagged").alias("labelled")
    )
    return inside.where("n = k and labelled > 0").select("k", "real", "labelled")


def ablation(labels: DataFrame, *, least: int = 5, pulls: float = 0.50) -> DataFrame:
    """detector x lang x variety, detector x lang and detector: counts of verdicts, precision and what follows."""
    cells = labels.groupingSets([["detector", "lang", "variety"], ["detector", "lang"], ["detector"]], "detector", "lang", "variety").agg(
        F.grouping_id().cast("int").alias("level"), F.count_if(F.col("verdict") == "drift").alias("drift"), F.count_if(F.col("verdict") == "contracted-twin-ok").alias("twin"), F.count_if(F.col("verdict") == "false-alarm").alias("fa")
    )
    n = F.col("drift") + F.col("twin") + F.col("fa")
    precision = F.when(n > 0, (F.col("drift") + F.col("twin")) / n).otherwise(F.lit(0.0))
    return cells.withColumn("n", n).withColumn("precision", precision).withColumn("call", F.when(F.col("n") < least, "insufficient").when(F.col("precision") >= pulls, "pulls-weight").otherwise("prune?"))


def fires_by_kind(fires: DataFrame) -> DataFrame:
    return fires.groupBy("kind").agg(F.count("*").alias("n"))


def scan_stats(files: DataFrame, extensions: list[str]) -> DataFrame:
    """ext, files, taken: how many files of each extension there are, and whether an extractor reads them."""
    ext = F.lower(F.regexp_extract("file", r"(\.[^./]*)$", 1))
    return files.groupBy(ext.alias("ext")).agg(F.count("*").alias("files")).withColumn("taken", F.col("ext").isin(extensions))


def boundary_bite(sigs: DataFrame, left: str, right: str) -> DataFrame:
    """One row: how many rows each boundary takes; a side with none cannot bite."""
    from driftlens.operators.prepare import within

    return sigs.agg(F.count_if(within(left)).alias("left"), F.count_if(within(right)).alias("right")).withColumn("bites", (F.col("left") > 0) & (F.col("right") > 0))
