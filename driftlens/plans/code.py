"""Queries of the extractors and the gate. Source files are written from the driver's tables, so SQL knows what must be found in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import constants as K
from driftlens.operators import gate, rank
from driftlens.operators.prepare import prepared
from driftlens.sources import adapters as A
from driftlens.sources import extract
from driftlens.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GO = """package parts

import (
	"context"
	th "example.org/things"
)

const (
	PART_{size} = {size}
	plain = "{brand}"
)

var Sizes = map[string]string{{"{name}": "{type}", "size {size}": "{brand}"}}

type Part struct {{ state State; cache map[string]int }}

func (p *Part) Make{key}(ctx context.Context, a, b int, rest ...string) (*th.Thing, error) {{
	p.state.size = {size}
	p.cache["{brand}"] = a
	thing, err := loadThing(ctx, "{name}", p.kind.name)
	if err != nil {{
		return nil, wrap("cannot load {type}", err)
	}} else if a > PART_{size} {{
		p.state.late = b
	}}
	switch a {{
	case {size}:
		p._impl.handle_{size}()
	}}
	return Point{{Label: thing, Size: b}}, nil
}}
"""
PYTHON = '''LIMIT_{size} = {size}
TABLE_{key} = {{"{name}": "{type}", "size": 1}}


class Part:
    def make_{key}(self, ctx: Context, *names: str, deep: int = 3) -> Thing:
        """Makes {brand}."""
        self.state.size = ctx.limits.top
        self.cache["{brand}"] += LIMIT_{size}
        if deep > {size}:
            self._impl.handle_{size}(names)
        return {{"label": load_thing("{name}"), "size": deep}}

    async def plain(self): pass
'''
SCHEMA = "-- a note\nCREATE TABLE IF NOT EXISTS part_{key} (\n  key_{key} int PRIMARY KEY, /* size, */ size_{size} decimal(10, 2) DEFAULT (1 + 2),\n  CONSTRAINT c CHECK (a IN (1, 2)), \"name\" text -- , more\n);\ncreate table one (a int);\n"


def _filled(template: str) -> Column:
    """The template with a part's values in it."""
    out = F.lit(template.replace("{{", "\u0001").replace("}}", "\u0002"))
    for k, c in {"key": F.col("p_partkey").cast("string"), "size": F.col("p_size").cast("string"), "brand": F.col("p_brand"), "name": F.col("p_name"), "type": F.col("p_type")}.items():
        out = F.replace(out, F.lit("{" + k + "}"), c)
    return F.translate(out, "\u0001\u0002", "{}")


def _files(spark: SparkSession, d: str, template: str, ext: str) -> DataFrame:
    return spread(A.table(spark, d, "part")).select(F.concat("p_brand", F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(ext)).alias("file"), _filled(template).alias("text"))


def query(oracle: str | None):
    def named(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return named


_SETS = ("strings", "writes", "reads", "ret_keys", "calls", "consts", "decl_consts")
_shown = lambda c: F.array_join(F.array_sort(c), "|").alias(c)
_shapes = lambda: F.array_join(F.array_sort(F.transform(F.map_entries("call_result_shapes"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+")))), "|").alias("shapes")
_sorted = lambda *xs: "array_to_string(list_sort(list_distinct([" + ", ".join(xs) + "])), '|')"
_FILE = "p_brand || '/p' || p_partkey || '{ext}'"
_S = "CAST(p_size AS VARCHAR)"


@query(f"""SELECT {_FILE.format(ext='.go')} AS file, 'Part.Make' || p_partkey AS qualname, '(context,int,int,...string)=>(*th.Thing,error)' AS sig, 17 AS line, 15 AS n_lines, true AS delegates,
    {_sorted('p_brand', 'p_name', "'cannot load ' || p_type")} AS strings, 'cache[]|state.late|state.size' AS writes, '_impl|cache|kind|kind.name|state' AS reads, 'Label|Size' AS ret_keys,
    {_sorted("'handle_' || p_size", "'loadThing'", "'wrap'")} AS calls, 'PART_' || p_size AS consts, 'PART_' || p_size AS decl_consts,
    {_sorted("'handle_' || p_size || '=arg-count:0'", "'loadThing=arg-count:3+ret-err-checked'", "'wrap=arg-count:2+ret-returned'")} AS shapes FROM part""")
def go_functions_parts(spark, d):
    found = extract.functions(_files(spark, d, GO, ".go"))
    return found.select("file", "qualname", "sig", "line", "n_lines", "delegates", *map(_shown, _SETS), _shapes())


@query(f"SELECT {_FILE.format(ext='.go')} AS file, 'Sizes' AS name, 13 AS line, {_sorted('p_name', chr(39) + 'size ' + chr(39) + ' || p_size')} AS ret_keys, {_sorted('p_type', 'p_brand')} AS strings FROM part")
def go_tables_parts(spark, d):
    return extract.symbols(_files(spark, d, GO, ".go")).where("kind = 'table'").select("file", "name", "line", _shown("ret_keys"), _shown("strings"))


@query(f"""WITH f AS (SELECT {_FILE.format(ext='.go')} AS file, 'Part.Make' || p_partkey || '#branch@' AS q, p_type, p_size FROM part)
    SELECT file, q || '21.1' AS qualname, 3 AS n_lines, 'cannot load ' || p_type AS strings, '' AS writes, 'wrap' AS calls FROM f
    UNION ALL SELECT file, q || '23.2', 3, '', 'state.late', '' FROM f UNION ALL SELECT file, q || '27.3', 2, '', '', 'handle_' || p_size FROM f""")
def go_branches_parts(spark, d):
    return extract.branches(_files(spark, d, GO, ".go")).select("file", "qualname", "n_lines", _shown("strings"), _shown("writes"), _shown("calls"))


@query(f"""WITH f AS (SELECT *, {_FILE.format(ext='.go')} AS file FROM part), v AS (
    SELECT file, 'PART_' || p_size AS name, {_S} AS value, 9 AS line FROM f WHERE p_size NOT IN (0, 1) UNION ALL SELECT file, 'plain', p_brand, 10 FROM f
    UNION ALL SELECT file, p_name, p_type, 13 FROM f UNION ALL SELECT file, 'size ' || p_size, p_brand, 13 FROM f)
    SELECT file, name, value, line FROM v""")
def go_values_parts(spark, d):
    return extract.value_sites(_files(spark, d, GO, ".go")).select("file", "name", "value", "line")


@query(f"""WITH f AS (SELECT *, {_FILE.format(ext='.py')} AS file FROM part)
    SELECT file, 'Part.make_' || p_partkey AS qualname, '(Context,str,int)=>Thing' AS sig, 6 AS line, 7 AS n_lines, true AS delegates, {_sorted('p_brand', 'p_name', "'label'", "'size'", "'Makes ' || p_brand || '.'")} AS strings,
    'cache[]|state.size' AS writes, '_impl|cache|limits|limits.top|state' AS reads, 'label|size' AS ret_keys, {_sorted("'handle_' || p_size", "'load_thing'")} AS calls, 'LIMIT_' || p_size AS consts FROM f
    UNION ALL SELECT file, 'Part.plain', '()=>?', 14, 1, false, '', '', '', '', '', '' FROM f""")
def python_functions_parts(spark, d):
    found = extract.functions(_files(spark, d, PYTHON, ".py"))
    return found.select("file", "qualname", "sig", "line", "n_lines", "delegates", *map(_shown, _SETS[:6]))


@query(f"SELECT {_FILE.format(ext='.py')} AS file, 'TABLE_' || p_partkey AS name, 2 AS line, {_sorted('p_name', chr(39) + 'size' + chr(39))} AS ret_keys, p_type AS strings FROM part")
def python_tables_parts(spark, d):
    return extract.symbols(_files(spark, d, PYTHON, ".py")).where("kind = 'table'").select("file", "name", "line", _shown("ret_keys"), _shown("strings"))


@query(f"SELECT {_FILE.format(ext='.sql')} AS file, 'part_' || p_partkey AS name, 2 AS line, {_sorted(chr(39) + 'key_' + chr(39) + ' || p_partkey', chr(39) + 'size_' + chr(39) + ' || p_size', chr(39) + 'name' + chr(39))} AS ret_keys FROM part")
def sql_schemas_parts(spark, d):
    return extract.symbols(_files(spark, d, SCHEMA, ".sql")).where("kind = 'sql-table'").select("file", "name", "line", _shown("ret_keys"))


@query("""WITH e AS (SELECT 'c' || o_custkey || '/o' || o_orderkey || '.json' AS file, 'o' || o_orderkey AS stem, o_custkey AS k FROM orders),
    s AS (SELECT file, stem AS name, 'id|items|k' || (k % 9) AS ret_keys FROM e UNION ALL SELECT file, stem || '.items', 'size|x' || (k % 5) FROM e)
    SELECT ret_keys, min(file) AS file, arg_min(name, file) AS name FROM s GROUP BY ret_keys""")
def json_shapes_orders(spark, d):
    """Of equal key sets the first by file."""
    o = spread(A.table(spark, d, "orders").select("o_orderkey", "o_custkey"), 100_000)
    key = F.col("o_custkey")
    text = F.format_string('{"id": %d, "k%d": null, "items": [{"size": 1, "x%d": [true]}, {"lone": 2}]}', "o_orderkey", key % 9, key % 5)
    files = o.select(F.concat(F.lit("c"), key.cast("string"), F.lit("/o"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("file"), text.alias("text"))
    return extract.symbols(files).where("kind = 'corpus-field'").select(_shown("ret_keys"), "file", "name")


@query(r"""SELECT page_id, length(html) AS n, length(html) - length(replace(html, chr(10), '')) AS lines, md5(regexp_replace(array_to_string(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1), ''), '\s', '', 'g')) AS digest FROM pages""")
def script_parts_pages(spark, d):
    masked = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else extract.script_parts(t)), "string")
    t = A.table(spark, d, "pages").select("page_id", masked("html").alias("t"))
    lines = F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))
    return t.select("page_id", F.length("t").cast("long").alias("n"), lines.cast("long").alias("lines"), F.md5(F.regexp_replace("t", r"[\t\n\f\r ]", "").cast("binary")).alias("digest"))


# --- all five channels ---------------------------------------------------------


def _part_functions(spark: SparkSession, d: str) -> DataFrame:
    """A part is a function with something in every channel; a third of the parts have no calls, some no results."""
    p = A.table(spark, d, "part")
    size, price = F.col("p_size").cast("string"), F.floor("p_retailprice").cast("long")
    strings = F.array_union(F.split("p_name", " "), F.array(F.concat(F.lit("price "), (price % 97).cast("string")), F.lit("in every part")))
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    return prepared(
        p.select(
            F.col("p_brand").alias("file"), key.alias("qualname"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_n"), (price % 89).cast("string")).alias("name"), F.lit(10).alias("n_lines"), F.col("p_partkey").cast("int").alias("line"),
            strings.alias("strings"), F.array(F.concat(F.lit("size."), size), F.concat(F.lit("price."), (price % 101).cast("string"))).alias("writes"),
            F.when(F.col("p_partkey") % 3 > 0, F.array(F.concat(F.lit("f"), (F.col("p_partkey") % 4).cast("string")), F.lit("common"))).otherwise(F.array()).alias("calls"),
            F.when(F.col("p_partkey") % 5 > 0, F.array(F.col("p_type"), F.concat(F.lit("r"), (price % 83).cast("string")))).otherwise(F.array()).alias("ret_keys"), (F.col("p_partkey") % 11 == 0).alias("delegates"),
        )
    )


def _all_pairs(least: float, tail: str) -> str:
    from driftlens.plans.oracles import jac, stems

    w = dict(K.CHANNELS)
    there = lambda c: f"(len(a.{c}) > 0 OR len(b.{c}) > 0)"
    sim = {c: jac(f"a.{c}", f"b.{c}") for c in ("strings", "writes", "calls", "ret")}
    sim["name"] = f"({jac('a.name', 'b.name')} * CASE WHEN a.deleg OR b.deleg THEN {K.DELEGATE_FACTOR} ELSE 1.0 END)"
    total = " + ".join(f"CASE WHEN {there(c)} THEN {w[c]}::DOUBLE * {sim[c]} ELSE 0.0 END" for c, _ in K.CHANNELS)
    weight = " + ".join(f"CASE WHEN {there(c)} THEN {w[c]}::DOUBLE ELSE 0.0 END" for c, _ in K.CHANNELS)
    anchored = f"(({sim['name']} >= {K.ANCHOR_NAME} AND NOT a.deleg AND NOT b.deleg) OR {sim['strings']} > 0 OR {sim['writes']} > 0 OR {sim['ret']} > 0)"
    return f"""WITH p AS (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part), n AS (SELECT *, replace(p_name, ' ', '_') || '_n' || (price % 89) AS nm FROM p),
    f AS (SELECT p_brand || '::p' || p_partkey AS key, list_distinct(list_concat(string_split(p_name, ' '), ['price ' || (price % 97), 'in every part'])) AS strings, ['size.' || p_size, 'price.' || (price % 101)] AS writes,
        {stems('nm')} AS name, CASE WHEN p_partkey % 3 > 0 THEN ['f' || (p_partkey % 4), 'common'] ELSE []::VARCHAR[] END AS calls, CASE WHEN p_partkey % 5 > 0 THEN [p_type, 'r' || (price % 83)] ELSE []::VARCHAR[] END AS ret, p_partkey % 11 = 0 AS deleg FROM n),
    s AS (SELECT a.key AS left_key, b.key AS right_key, ({total}) / ({weight}) AS score FROM f a JOIN f b ON a.key < b.key WHERE {anchored})
    SELECT left_key, right_key, round(score, 6) AS score FROM s WHERE score >= {least} {tail}"""


@query(_all_pairs(0.5, ""))
def rank_parts(spark, d):
    p = _part_functions(spark, d)
    return rank.rank(p, p, min_score=0.5, top=None).select("left_key", "right_key", F.round("score", 6).alias("score"))


@query(_all_pairs(0.5, "ORDER BY s.score DESC, left_key, right_key LIMIT 30"))
def rank_parts_top(spark, d):
    p = _part_functions(spark, d)
    return rank.rank(p, p, min_score=0.5).select("left_key", "right_key", F.round("score", 6).alias("score"))


# --- the gate ------------------------------------------------------------------


@query("""WITH c AS (SELECT o_orderkey AS k, 'src/o' || o_orderkey || '.go::f' AS l, 'src/o' || (o_orderkey + 1) || '.go::f' AS r, o_orderkey % 7 AS m, o_orderkey % 5 AS g FROM orders),
    live AS (SELECT 'src/o' || o_orderkey || '.go::f' AS key FROM orders WHERE o_orderkey % 10 > 0), there AS (SELECT 'src/o' || o_orderkey || '.go' AS file FROM orders WHERE o_orderkey % 20 > 0),
    e AS (SELECT k, l, r, g, l IN (SELECT key FROM live) AND r IN (SELECT key FROM live) AS alive, split_part(l, '::', 1) IN (SELECT file FROM there) AND split_part(r, '::', 1) IN (SELECT file FROM there) AS there FROM c WHERE m < 2)
    SELECT 'fresh' AS what, count(*) AS n FROM c WHERE m >= 2 UNION ALL SELECT 'known', count(*) FROM c WHERE m < 2 UNION ALL SELECT 'stale', count(*) FROM e WHERE NOT there
    UNION ALL SELECT 'ambiguous', count(*) FROM e WHERE there AND NOT alive UNION ALL SELECT 'unresolved', count(*) FROM e WHERE there AND alive AND g = 0 UNION ALL SELECT 'warnings', 0""")
def check_orders(spark, d):
    """Orders are candidates with the next order; two of seven are in the registry, some of them without a function or a file."""
    o = A.table(spark, d, "orders").select("o_orderkey")
    key = lambda c: F.concat(F.lit("src/o"), c.cast("string"), F.lit(".go::f"))
    c = o.select(key(F.col("o_orderkey")).alias("left_key"), key(F.col("o_orderkey") + 1).alias("right_key"), (F.col("o_orderkey") % 7).alias("m"), (F.col("o_orderkey") % 5).alias("g"))
    verdict = F.when(F.col("g") == 0, "drift two ways").otherwise("false-alarm")
    text = F.concat(F.lit("# notes\n- pair: `"), "left_key", F.lit("` | "), "right_key", F.lit("\n- verdict: "), verdict, F.lit("\n"))
    files = c.where("m < 2").select(F.concat(F.lit("registry.d/"), F.regexp_extract("left_key", "o([0-9]+)", 1), F.lit(".md")).alias("file"), text.alias("text"))
    live = o.where("o_orderkey % 10 > 0").select(key(F.col("o_orderkey")).alias("key"))
    there = o.where("o_orderkey % 20 > 0").select(F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit(".go")).alias("file"))
    return gate.summary(gate.check(c.select("left_key", "right_key", F.lit(1.0).alias("score")), live, there, files, [".go"]))


@query("SELECT count(*) AS n, count(*) FILTER (p_size % 2 = 0) AS signed FROM part")
def signature_coverage_parts(spark, d):
    p = A.part_signatures(A.table(spark, d, "part").where("p_size % 2 = 0")).unionByName(A.part_seams(A.table(spark, d, "part").where("p_size % 2 = 1")))
    return gate.signature_coverage(p)


@query("""WITH t AS (SELECT p_brand || '::p' || p_partkey AS key, p_size FROM part) SELECT key, 'extra' AS side FROM t WHERE p_size > 40 UNION ALL SELECT key, 'missing' FROM t WHERE p_size < 5""")
def role_difference_parts(spark, d):
    p = _part_functions(spark, d).withColumn("size", F.regexp_extract(F.element_at("writes", 1), r"(\d+)", 1).cast("int"))
    return gate.role_difference(p.where("size >= 5"), p.where("size <= 40"))
