"""Every query of the library with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import columns as X
from driftlens.operators import calibrate, passes, prose, rank, registry, touchpoint
from driftlens.operators.prepare import within
from driftlens.plans import code
from driftlens.plans.oracles import ORACLES as OWN
from driftlens.sources import adapters as A
from driftlens.sources.tables import spread

__all__ = ["ORACLES", "QUERIES"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(code.QUERIES)
ORACLES: dict[str, str] = OWN | code.ORACLES
r6 = lambda c: F.round(c, 6).alias(c)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark, d):
    return A.doc_lines(A.table(spark, d, "documents"))


@query
def rank_documents(spark, d):
    docs = _docs(spark, d)
    return rank.rank(docs, docs, top=None).select("left_key", "right_key", r6("score"))


@query
def rank_boundary(spark, d):
    docs = _docs(spark, d)
    return rank.rank(docs.where(within("src1*/**")), docs.where(within("src0/*,src2/*,src3/*")), top=None).select("left_key", "right_key", r6("score"))


@query
def rank_distance_boost(spark, d):
    docs = _docs(spark, d)
    return rank.rank(docs, docs, top=None, boost=True).select("left_key", "right_key", r6("score"), r6("dist_boost"))


@query
def nearest_document(spark, d):
    docs = _docs(spark, d)
    return rank.nearest(docs, docs).select("left_key", "right_key", r6("score"), "rank")


@query
def name_stem_documents(spark, d):
    return passes.name_stem_candidates(A.doc_words(A.table(spark, d, "documents"))).select("left_key", "right_key", r6("stem_jaccard"), r6("jaccard"), "cross_file")


@query
def signature_parts(spark, d):
    return passes.signature_candidates(A.part_signatures(A.table(spark, d, "part"))).select("left_key", "right_key", "sig", "group_size", "cross_file", r6("jaccard"))


@query
def key_set_pages(spark, d):
    return passes.key_set_candidates(A.page_links(A.table(spark, d, "pages"))).select("left_key", "right_key", r6("jaccard"), "cross_file")


@query
def derivation_pages(spark, d):
    return passes.derivation_candidates(A.page_derivations(A.table(spark, d, "pages"))).select("left_key", "right_key", r6("jaccard"), "cross_file", "variety")


@query
def value_sites_parts(spark, d):
    return passes.value_site_candidates(A.part_values(A.table(spark, d, "part"))).select("left_key", "right_key", "value", r6("jaccard"), "cross_file")


@query
def call_context(spark, d):
    found = passes.call_context_candidates(A.customer_context(A.table(spark, d, "customer")))
    return found.select("left_key", "right_key", r6("caller_jaccard"), r6("shape_jaccard"), "cross_file", r6("jaccard"))


def _seams(spark, d):
    """Rows of parts and the number of tasks for them."""
    part = spread(A.table(spark, d, "part"), 50_000)
    return {"sigs": A.part_seams(part), "parts": part.rdd.getNumPartitions()}


@query
def touchpoint_seams(spark, d):
    return touchpoint.seam_groups(**_seams(spark, d)).select("symbol", "fanout", r6("rarity"), F.array_join("members", " ").alias("members"))


@query
def touchpoint_clusters(spark, d):
    found = touchpoint.clusters(**_seams(spark, d), top=None)
    return found.select(F.array_join("members", " ").alias("members"), F.array_join("shared", " ").alias("shared"), r6("score"))


def _counts(spark, d):
    return prose.word_counts(A.table(spark, d, "documents"), text=F.col("text"))


def _with_places(terms):
    places = F.array_join(F.transform("locs", lambda x: F.concat_ws(":", x["path"], x["line"].cast("string"))), " ")
    return terms.withColumn("locs", places)


@query
def word_tally(spark, d):
    return _with_places(prose.content_words(A.table(spark, d, "documents"), path=F.col("doc_id").cast("string"), text=F.col("text")))


@query
def compound_tally(spark, d):
    return _with_places(prose.compounds(A.table(spark, d, "pages"), path=F.col("page_id").cast("string"), text=F.col("url")))


@query
def vocab_violations(spark, d):
    allowed = A.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), 1)).alias("term")).select(F.lower("term").alias("term"))
    return prose.violations(_counts(spark, d), allowed).select("term", "count")


@query
def stem_clusters(spark, d):
    return prose.stem_clusters(_counts(spark, d))


@query
def strip_non_prose(spark, d):
    t = X.strip_non_prose("text")
    return A.table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t.cast("binary")).alias("digest"))


def _vectors(spark, d):
    return A.table(spark, d, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("term"), (F.col("label") + 1).alias("count"), F.col("embedding").alias("vec"))


@query
def synonym_pairs(spark, d):
    return prose.synonym_pairs(_vectors(spark, d), threshold=0.35, skip_morphology=False).select("left", "right", F.round("cosine", 5).alias("cosine"))


@query
def synonym_components(spark, d):
    return prose.synonym_components(prose.synonym_pairs(_vectors(spark, d), threshold=0.40, skip_morphology=False))


@query
def calibrate_weights(spark, d):
    li = A.table(spark, d, "lineitem")
    s = li.select((F.col("l_discount") * 10).alias("strings"), (F.col("l_tax") * 10).alias("writes"), (F.col("l_quantity") / 50).alias("name"), (F.col("l_linenumber") % 5 / 5).alias("calls"), F.lit(0.1).alias("ret"), (F.col("l_returnflag") == "R").alias("useful"))
    return calibrate.calibrated(s).select("n", r6("lambda"), *[r6(f"w_{c}") for c in X.CHANNEL_SETS])


def _labeled(spark, d):
    v = A.verdicts(A.table(spark, d, "documents"), A.table(spark, d, "labels"))
    return v.withColumn("label", X.resolve_label("verdict", F.lit(None).cast("string")))


@query
def doctor_labels(spark, d):
    return calibrate.doctor(_labeled(spark, d)).select("label", "n", r6("mean_score"))


@query
def precision_at_k(spark, d):
    return calibrate.precision_at(_labeled(spark, d))


@query
def ablation_matrix(spark, d):
    return calibrate.ablation(_labeled(spark, d)).select("detector", "lang", "variety", "drift", "twin", "fa", r6("precision"), "call")


@query
def latest_wins(spark, d):
    e = A.table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), "event_id", F.col("event_type").alias("verdict"))
    return calibrate.latest(e, ["id"], "event_id").select("id", "verdict")


@query
def first_wins(spark, d):
    return A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("verdict"))


@query
def fire_ids(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", X.fire_id(F.lit("pair"), F.concat("source", F.lit("::doc"), F.col("doc_id").cast("string"))).alias("id"))


@query
def json_key_shapes(spark, d):
    shape = F.array_join(F.array_sort(F.json_object_keys("props")), ",")
    return A.table(spark, d, "events").groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


@query
def opposed_verbs(spark, d):
    verbs = F.explode(X.words("add remove start stop complete get set find search".split()))
    n = A.table(spark, d, "events").select("event_type").distinct().select("event_type", verbs.alias("verb")).select(F.concat_ws("_", "verb", "event_type").alias("name"))
    # a few dozen names
    return n.select(F.col("name").alias("left")).join(F.broadcast(n.select(F.col("name").alias("right"))), F.col("left") < F.col("right")).select("left", "right", X.opposed("left", "right").alias("opposed"))


@query
def op_type_documents(spark, d):
    w = A.table(spark, d, "documents").select("doc_id", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1), "_").alias("name"))
    none = F.array().cast("array<string>")
    return w.select("doc_id", X.op_type(X.stem_tokens("name"), none, none).alias("op"))


@query
def test_path_flags(spark, d):
    path = F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/$", "")
    return A.table(spark, d, "pages").select("page_id", X.is_test_path(path).alias("is_test"))


@query
def role_cardinality(spark, d):
    roles = [{"role": "gears", "predicate": "name:/gear$/ file:Brand#4", "expected": 3, "baseline": []}, {"role": "nothing", "predicate": "name:/^nothing/", "expected": 1, "baseline": []}]
    return registry.cardinality(A.part_values(A.table(spark, d, "part")), roles)


@query
def registry_fresh(spark, d):
    docs = _docs(spark, d)
    found = rank.rank(docs, docs, top=None)
    none = spark.createDataFrame([], "pair_key string")
    families = [{"glob1": "src1/*", "name1": "*", "glob2": "src1/*", "name2": "*"}, {"glob1": "src2/*", "name1": "*", "glob2": "src3/*", "name2": "*"}]
    return registry.fresh(found, none, families).select("left_key", "right_key", r6("score"))


@query
def scan_stats(spark, d):
    files = A.table(spark, d, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("file"))
    return calibrate.scan_stats(files, [".html", ".py"])


@query
def boundary_bite(spark, d):
    return calibrate.boundary_bite(A.doc_lines(A.table(spark, d, "documents").select("doc_id", "source", "lang", F.lit("").alias("text"))), "src1*/**", "srv*/**")
