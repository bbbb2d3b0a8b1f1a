"""The driver's tables as FUNCSIG rows, each whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators.prepare import prepared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(docs: DataFrame) -> DataFrame:
    """A document is a function: its lines of four bytes or more are what it emits, source/lang its file."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.octet_length(x) >= 4)
    return prepared(docs.select(F.concat_ws("/", "source", "lang").alias("file"), name.alias("qualname"), name.alias("name"), F.lit(10).alias("n_lines"), lines.alias("strings")))


def doc_words(docs: DataFrame) -> DataFrame:
    """A document is a function named by all its words of four letters or more."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)
    q = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return prepared(docs.select(F.concat_ws("/", "source", "lang").alias("file"), q.alias("qualname"), F.array_join(words, "_").alias("name"), F.lit(10).alias("n_lines")))


def page_links(pages: DataFrame) -> DataFrame:
    """A page is a table whose keys are its links; it reads them and returns its host."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    name = F.concat(F.lit("page"), F.col("page_id").cast("string"))
    return prepared(pages.select(host.alias("file"), name.alias("qualname"), name.alias("name"), F.lit(10).alias("n_lines"), links.alias("ret_keys"), links.alias("reads"), F.lit("table").alias("kind")))


def page_derivations(pages: DataFrame) -> DataFrame:
    links = page_links(pages)
    return links.withColumns({"kind": F.lit(""), "ret_keys": F.array("file"), "s_ret": F.array("file")})


def part_values(part: DataFrame) -> DataFrame:
    """A part is a value site: brand and size are its literal, its name the site's."""
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    return prepared(part.select(F.col("p_brand").alias("file"), key.alias("qualname"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.lit(1).alias("n_lines"), F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("value"), F.lit("value-site").alias("kind")))


def part_signatures(part: DataFrame) -> DataFrame:
    """A part is a function whose signature names its brand, size and type."""
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    sig = F.concat(F.lit("("), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(","), F.col("p_size").cast("string"), F.lit(")=>"), F.col("p_type"))
    return prepared(part.select(F.col("p_type").alias("file"), key.alias("qualname"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.lit(10).alias("n_lines"), sig.alias("sig")))


def part_seams(part: DataFrame) -> DataFrame:
    """A part is a function that calls a private helper of its brand and size and emits one of its price."""
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    call = F.concat(F.lit("_make_"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"))
    word = F.concat(F.lit("price"), F.floor(F.col("p_retailprice") * 10).cast("long").cast("string"))
    return prepared(part.select(F.col("p_type").alias("file"), key.alias("qualname"), key.alias("name"), F.lit(10).alias("n_lines"), F.array(call).alias("calls"), F.array(word).alias("strings")))


def customer_context(customers: DataFrame) -> DataFrame:
    """Customers call a fetcher and a reader of their group; what follows a call depends on the customer's number."""
    n = F.col("c_custkey")
    each = lambda verb, tag: F.struct(F.concat(F.lit(verb + "_g"), (n % 400).cast("string")).alias("callee"), F.concat(F.lit("arg-count:"), tag.cast("string")).alias("tag"))
    calls = customers.select(F.concat(F.lit("user_u"), n.cast("string")).alias("name"), F.explode(F.array(each("fetch", n % 3), each("read", F.when(n % 5 == 0, n % 4).otherwise(n % 3)))).alias("e")).select("name", "e.*")
    # every user and every handler is a row; the users carry the calls
    users = calls.groupBy("name").agg(F.array_sort(F.collect_set("callee")).alias("calls"))
    tags = calls.groupBy("name", "callee").agg(F.array_sort(F.collect_set("tag")).alias("tags")).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("callee", "tags"))).alias("call_result_shapes"))
    callers = users.join(tags, "name").select(F.lit("users").alias("file"), F.col("name").alias("qualname"), "name", F.lit(1).alias("n_lines"), "calls", "call_result_shapes")
    callees = calls.select(F.col("callee").alias("name")).distinct().select(F.lit("handlers").alias("file"), F.col("name").alias("qualname"), "name", F.lit(10).alias("n_lines"))
    return prepared(callers.unionByName(callees, allowMissingColumns=True))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels as verdicts: toxic ones are drift, good ones accepted twins, the others false alarms."""
    verdict = F.when(F.col("toxic") == 1, "drift").when(F.col("quality") == 1, "contracted-twin-ok").otherwise("false-alarm")
    key = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return labels.join(docs.select("doc_id", "lang", "source", "n_chars"), "doc_id").select(F.col("source").alias("detector"), "lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("variety"), key.alias("pair_key"), (F.col("n_chars") % 1000 / 1000).alias("score"), verdict.alias("verdict"))
