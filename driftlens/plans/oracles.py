"""The same rows in DuckDB SQL, written from the semantics and without any of the engine's shortcuts."""

from __future__ import annotations

from driftlens.functions import constants as K

q = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"

DOC_LINES = """docs AS (SELECT source || '/' || lang || '::doc' || doc_id AS key, source || '/' || lang AS file, source AS src, 'doc' || doc_id AS name,
    list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: strlen(x) >= 4)) AS s FROM documents)"""

INTER = "len(list_intersect({a}, {b}))"
JACCARD = "(CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END)"


def jac(a: str, b: str) -> str:
    return JACCARD.format(a=a, b=b)


def _doc_pairs(cond: str = "a.key < b.key") -> str:
    """All pairs with a common line, with the score of the strings channel beside a name that never matches."""
    return f"""{DOC_LINES},
    toks AS (SELECT key, src, file, unnest(s) AS t FROM docs),
    met AS (SELECT DISTINCT a.key AS left_key, b.key AS right_key FROM toks a JOIN toks b ON a.t = b.t AND {cond}),
    sims AS (SELECT left_key, right_key, l.file AS lf, r.file AS rf, l.src AS ls, r.src AS rs, {jac('l.s', 'r.s')} AS j FROM met JOIN docs l ON l.key = left_key JOIN docs r ON r.key = right_key),
    scored AS (SELECT *, 0.3 * j / (0.3 + 0.22) AS score FROM sims)"""


def stems(name: str) -> str:
    toks = f"list_filter(string_split(lower(regexp_replace(regexp_replace(trim({name}), '^_+', ''), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_'), lambda x: x <> '')"
    peeled = f"(CASE WHEN len({toks}) > 1 AND list_contains({q(K.ROLE_PREFIXES)}, {toks}[1]) THEN {toks}[2:] ELSE {toks} END)"
    return f"list_distinct(list_filter({peeled}, lambda x: NOT list_contains({q(K.STEM_STOPWORDS)}, x)))"


def capped(token_cte: str, fanout: int = 8) -> str:
    return f"""few AS (SELECT t FROM {token_cte} GROUP BY t HAVING count(*) BETWEEN 2 AND {fanout}),
    met AS (SELECT DISTINCT a.key AS left_key, b.key AS right_key FROM {token_cte} a JOIN few USING (t) JOIN {token_cte} b ON a.t = b.t AND a.key < b.key)"""


LINKS = """pg AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS file, regexp_extract(url, '://([^/?#]*)', 1) || '::page' || page_id AS key,
    list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS s FROM pages)"""

PARTS = "SELECT p_type, p_brand, p_size, p_retailprice, 'p' || p_partkey AS k, replace(p_name, ' ', '_') AS name FROM part"

STEM_KEY = "CASE " + " ".join(f"WHEN ends_with({{last}}, '{s}') AND length({{last}}) - {len(s)} >= 3 THEN {{t}}[:length({{t}}) - {len(s)}]" for s in K.SUFFIXES) + " ELSE {t} END"
STRIP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '\A---\n(?s:.*?)\n---\n', ''), '(?s)```.*?```', '', 'g'), '`[^`]*`', '', 'g'), '(?m)^\s*>.*$', '', 'g'), '(?m)^#+\s+.*$', '', 'g')"


def terms(table: str, text: str, path: str, pattern: str, lower: bool, stop: list[str]) -> str:
    term = "lower(term)" if lower else "term"
    return f"""texts AS (SELECT CAST({path} AS VARCHAR) AS path, string_split({text}, chr(10)) AS ls FROM {table}),
    lines AS (SELECT path, unnest(ls) AS lt, unnest(range(1, len(ls) + 1)) AS line FROM texts),
    hits AS (SELECT path, line, unnest(regexp_extract_all(lt, '\\b{pattern.replace("'", "''")}\\b')) AS raw FROM lines),
    placed AS (SELECT {term.replace("term", "raw")} AS term, path, line, row_number() OVER (PARTITION BY {term.replace("term", "raw")} ORDER BY path, line) AS nth FROM hits),
    tally AS (SELECT term, count(*) AS count, count(DISTINCT path) AS files, min(path) AS first_path, string_agg(path || ':' || line, ' ' ORDER BY path, line) FILTER (nth <= 3) AS locs FROM placed GROUP BY 1),
    kept AS (SELECT * FROM tally WHERE NOT list_contains({q(stop)}, term))"""


WORDS = terms("documents", STRIP.format(t="text"), "doc_id", K.CONTENT_WORD, True, K.SYNONYM_STOP)
COMPOUNDS = terms("pages", STRIP.format(t="url"), "page_id", K.COMPOUND, False, [])
VERDICTS = """v AS (SELECT source AS detector, lang, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS variety, 'doc' || doc_id AS pair_key, (n_chars % 1000) / 1000.0::DOUBLE AS score,
    CASE WHEN toxic = 1 THEN 'drift' WHEN quality = 1 THEN 'contracted-twin-ok' ELSE 'false-alarm' END AS verdict,
    CASE WHEN toxic = 1 THEN 'useful' WHEN quality = 1 THEN 'mixed' ELSE 'not-useful' END AS label FROM labels JOIN documents USING (doc_id))"""
_PRIOR = dict(K.CHANNELS)
_SAMPLE = "s AS (SELECT l_discount * 10 AS strings, l_tax * 10 AS writes, l_quantity / 50 AS name, (l_linenumber % 5) / 5.0::DOUBLE AS calls, 0.1::DOUBLE AS ret, l_returnflag = 'R' AS useful FROM lineitem)"


def _calibrate() -> str:
    ch = list(_PRIOR)
    means = ", ".join(f"avg({c}) FILTER (useful) - avg({c}) FILTER (NOT useful) AS d_{c}" for c in ch)
    pos = " + ".join(f"greatest(d_{c}, 0)" for c in ch)
    w = lambda c: f"(lam * CASE WHEN possum > 0 THEN greatest(d_{c}, 0) / possum ELSE {_PRIOR[c]} END + (1 - lam) * {_PRIOR[c]})"
    total = " + ".join(w(c) for c in ch)
    cols = ", ".join(f"round({w(c)} / ({total}), 6) AS w_{c}" for c in ch)
    return f"WITH {_SAMPLE}, m AS (SELECT count(*) AS n, {means} FROM s), p AS (SELECT *, {pos} AS possum, n / (n + 8.0)::DOUBLE AS lam FROM m) SELECT n, round(lam, 6) AS lambda, {cols} FROM p"


def _op_type(stem: str) -> str:
    has = lambda xs: f"len(list_intersect({stem}, {q(xs)})) > 0"
    return f"CASE WHEN {has(K.INVERSE_SEARCH)} THEN 'inverse-search' WHEN {has(K.FORWARD_MAP)} THEN 'forward-map' WHEN {has(K.MEASURE)} THEN 'measure' ELSE '' END"


OPPOSED = q(["/".join(sorted(p)) for p in K.OPPOSED])
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"

ORACLES: dict[str, str] = {
    "rank_documents": f"WITH {_doc_pairs()} SELECT left_key, right_key, round(score, 6) AS score FROM scored WHERE score >= 0.18",
    "rank_boundary": f"WITH {_doc_pairs('''a.key <> b.key AND a.src LIKE 'src1%' AND (b.src IN ('src0', 'src2', 'src3'))''')} SELECT left_key, right_key, round(score, 6) AS score FROM scored WHERE score >= 0.18",
    "rank_distance_boost": f"""WITH {_doc_pairs()}, b AS (SELECT *, CASE WHEN lf = rf THEN 1.0 WHEN ls = rs THEN 1.0 ELSE 1 + 0.5 * 0.15 END AS boost FROM scored)
        SELECT left_key, right_key, round(least(1.0, score * boost), 6) AS score, round(boost, 6) AS dist_boost FROM b WHERE least(1.0, score * boost) >= 0.18""",
    "nearest_document": f"""WITH {_doc_pairs('a.key <> b.key')}, r AS (SELECT left_key, right_key, score, row_number() OVER (PARTITION BY left_key ORDER BY score DESC, right_key) AS rank FROM scored WHERE score >= 0.45)
        SELECT left_key, right_key, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
    "name_stem_documents": f"""WITH d AS (SELECT source || '/' || lang AS file, source || '/' || lang || '::doc' || doc_id AS key, array_to_string(regexp_extract_all(lower(text), '[a-z]{{4,}}'), '_') AS name FROM documents),
        st AS (SELECT key, file, {stems('name')} AS stem FROM d), tok AS (SELECT key, unnest(stem) AS t FROM st),
        met AS (SELECT a.key AS left_key, b.key AS right_key, count(*) AS n FROM tok a JOIN tok b ON a.t = b.t AND a.key < b.key GROUP BY ALL),
        j AS (SELECT left_key, right_key, n / (len(a.stem) + len(b.stem) - n)::DOUBLE AS j, a.file <> b.file AS cross_file FROM met JOIN st a ON a.key = left_key JOIN st b ON b.key = right_key)
        SELECT left_key, right_key, round(j, 6) AS stem_jaccard, round(j, 6) AS jaccard, cross_file FROM j WHERE j >= 0.6""",
    "signature_parts": f"""WITH p AS ({PARTS}), f AS (SELECT p_type || '::' || k AS key, p_type AS file, {stems('name')} AS stem, name, '(' || replace(p_brand, '#', '') || ',' || p_size || ')=>' || p_type AS sig FROM p),
        g AS (SELECT sig, count(*) AS group_size FROM f GROUP BY sig HAVING count(*) BETWEEN 2 AND 6)
        SELECT a.key AS left_key, b.key AS right_key, a.sig, group_size, a.file <> b.file AS cross_file, CASE WHEN {jac('a.stem', 'b.stem')} >= 0.34 THEN round({jac('a.stem', 'b.stem')}, 6) ELSE 0.0 END AS jaccard
        FROM g JOIN f a USING (sig) JOIN f b ON a.sig = b.sig AND a.key < b.key""",
    "key_set_pages": f"""WITH {LINKS}, big AS (SELECT * FROM pg WHERE len(s) >= 3), tok AS (SELECT key, unnest(s) AS t FROM big), {capped('tok')}
        SELECT left_key, right_key, round({jac('a.s', 'b.s')}, 6) AS jaccard, a.file <> b.file AS cross_file FROM met JOIN big a ON a.key = left_key JOIN big b ON b.key = right_key WHERE {jac('a.s', 'b.s')} >= 0.5""",
    "derivation_pages": f"""WITH {LINKS}, big AS (SELECT * FROM pg WHERE len(s) >= 3), tok AS (SELECT key, unnest(s) AS t FROM big), {capped('tok')}
        SELECT left_key, right_key, round({jac('a.s', 'b.s')}, 6) AS jaccard, a.file <> b.file AS cross_file, 'construct/construct' AS variety FROM met JOIN big a ON a.key = left_key JOIN big b ON b.key = right_key
        WHERE {jac('a.s', 'b.s')} >= 0.5 AND NOT (len(list_intersect(a.s, b.s)) BETWEEN 1 AND 3 AND len(list_filter(list_intersect(a.s, b.s), lambda x: contains(regexp_replace(x, '^this\\.', ''), '.'))) = 0)""",
    "value_sites_parts": f"""WITH p AS ({PARTS}), f AS (SELECT p_brand || '::' || k AS key, p_brand AS file, {stems('name')} AS stem, p_brand || '|' || p_size AS value FROM p),
        tok AS (SELECT key, value AS t FROM f), {capped('tok')}
        SELECT left_key, right_key, a.value, round({jac('a.stem', 'b.stem')}, 6) AS jaccard, a.file <> b.file AS cross_file FROM met JOIN f a ON a.key = left_key JOIN f b ON b.key = right_key WHERE {jac('a.stem', 'b.stem')} >= 0.01""",
    "touchpoint_seams": f"""WITH p AS ({PARTS}), f AS (SELECT p_type || '::' || k AS key, '_make_' || replace(p_brand, '#', '_') || '_' || p_size AS a, 'price' || CAST(floor(p_retailprice * 10) AS BIGINT) AS b FROM p),
        t AS (SELECT key, a AS symbol FROM f UNION ALL SELECT key, b FROM f)
        SELECT symbol, count(*) AS fanout, round(1.0 / count(*) * CASE WHEN symbol LIKE '\\_%' ESCAPE '\\' THEN 1.6 ELSE 1.0 END, 6) AS rarity, array_to_string(list_sort(list(key)), ' ') AS members FROM t GROUP BY symbol HAVING count(*) BETWEEN 2 AND 8""",
    "call_context": f"""WITH e AS (SELECT 'user_u' || c_custkey AS caller, 'fetch_g' || (c_custkey % 400) AS callee, 'arg-count:' || (c_custkey % 3) AS tag FROM customer
        UNION ALL SELECT 'user_u' || c_custkey, 'read_g' || (c_custkey % 400), 'arg-count:' || CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 4 ELSE c_custkey % 3 END FROM customer),
        cs AS (SELECT callee, list_distinct(list(t)) AS c FROM (SELECT callee, unnest({stems('caller')}) AS t FROM e) GROUP BY callee), sh AS (SELECT callee, list_distinct(list(tag)) AS s FROM e GROUP BY callee),
        f AS (SELECT 'handlers::' || callee AS key, callee AS name, {stems('callee')} AS stem, c, s FROM cs JOIN sh USING (callee)), tok AS (SELECT key, unnest(c) AS t FROM f), {capped('tok', 8)}
        SELECT left_key, right_key, round({jac('a.c', 'b.c')}, 6) AS caller_jaccard, round({jac('a.s', 'b.s')}, 6) AS shape_jaccard, false AS cross_file, CASE WHEN {jac('a.stem', 'b.stem')} >= 0.34 THEN round({jac('a.stem', 'b.stem')}, 6) ELSE 0.0 END AS jaccard
        FROM met JOIN f a ON a.key = left_key JOIN f b ON b.key = right_key WHERE {jac('a.c', 'b.c')} >= 0.5 AND {jac('a.s', 'b.s')} >= 0.5""",
    "word_tally": f"WITH {WORDS} SELECT term, count, files, first_path, locs FROM kept",
    "compound_tally": f"WITH {COMPOUNDS} SELECT term, count, files, first_path, locs FROM kept",
    "vocab_violations": f"WITH {WORDS} SELECT term, count FROM kept WHERE count >= 5 AND term NOT IN (SELECT DISTINCT lower(r) FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS r FROM benchmark))",
    "stem_clusters": f"WITH {WORDS}, k AS (SELECT *, {STEM_KEY.format(t='term', last='term')} AS stem FROM kept) SELECT stem, count(*) AS variants, CAST(sum(count) AS BIGINT) AS total, min(term) AS first_term FROM k GROUP BY stem HAVING count(*) >= 2 AND sum(count) >= 3",
    "strip_non_prose": f"SELECT doc_id, length({STRIP.format(t='text')}) AS n, md5({STRIP.format(t='text')}) AS digest FROM documents",
    "synonym_pairs": f"""WITH v AS (SELECT 'w' || vec_id AS term, label + 1 AS n, embedding AS e FROM embeddings), top AS (SELECT * FROM v ORDER BY n DESC, term LIMIT 1500)
        SELECT a.term AS left, b.term AS right, round({DOT.format(a='a.e', b='b.e')} / sqrt({DOT.format(a='a.e', b='a.e')}) / sqrt({DOT.format(a='b.e', b='b.e')}), 5) AS cosine FROM top a JOIN top b ON a.term < b.term
        WHERE {DOT.format(a='a.e', b='b.e')} / sqrt({DOT.format(a='a.e', b='a.e')}) / sqrt({DOT.format(a='b.e', b='b.e')}) >= 0.35""",
    "calibrate_weights": _calibrate(),
    "doctor_labels": f"WITH {VERDICTS} SELECT label, count(*) AS n, round(avg(score), 6) AS mean_score FROM v GROUP BY label",
    "precision_at_k": f"""WITH {VERDICTS}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, pair_key) AS rk FROM v), k AS (SELECT unnest([5, 10]) AS k)
        SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (label IN ('useful', 'mixed')) AS real, count(*) AS labelled FROM t JOIN k ON rk <= k GROUP BY k""",
    "ablation_matrix": f"""WITH {VERDICTS}, g AS (SELECT detector, lang, variety, count(*) FILTER (verdict = 'drift') AS drift, count(*) FILTER (verdict = 'contracted-twin-ok') AS twin, count(*) FILTER (verdict = 'false-alarm') AS fa
        FROM v GROUP BY GROUPING SETS ((detector, lang, variety), (detector, lang), (detector)))
        SELECT detector, lang, variety, drift, twin, fa, round((drift + twin) / (drift + twin + fa)::DOUBLE, 6) AS precision, CASE WHEN drift + twin + fa < 5 THEN 'insufficient' WHEN (drift + twin) / (drift + twin + fa)::DOUBLE >= 0.5 THEN 'pulls-weight' ELSE 'prune?' END AS call FROM g""",
    "latest_wins": "SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS verdict FROM events GROUP BY user_id",
    "first_wins": "SELECT o_custkey AS key, arg_min(o_orderstatus, o_orderkey) AS verdict FROM orders GROUP BY o_custkey",
    "fire_ids": "SELECT doc_id, substr(sha256('pair' || chr(0) || source || '::doc' || doc_id), 1, 10) AS id FROM documents",
    "json_key_shapes": "SELECT array_to_string(list_sort(json_keys(props)), ',') AS shape, count(*) AS n FROM events GROUP BY 1",
    "opposed_verbs": f"""WITH t AS (SELECT DISTINCT event_type AS e FROM events), v AS (SELECT unnest(['add', 'remove', 'start', 'stop', 'complete', 'get', 'set', 'find', 'search']) AS w), n AS (SELECT w || '_' || e AS name, w, e FROM v, t)
        SELECT a.name AS left, b.name AS right, a.e = b.e AND list_contains({OPPOSED}, a.w || '/' || b.w) AS opposed FROM n a JOIN n b ON a.name < b.name""",
    "op_type_documents": f"""WITH d AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z]{{4,}}'), '_') AS name FROM documents), s AS (SELECT doc_id, {stems('name')} AS stem FROM d)
        SELECT doc_id, {_op_type('stem')} AS op FROM s""",
    "test_path_flags": r"""WITH u AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/$', '') AS p FROM pages), b AS (SELECT page_id, p, string_split(p, '/') AS seg FROM u)
        SELECT page_id, len(list_intersect(list_transform(seg[1:len(seg) - 1], lambda x: lower(x)), ['tests', 'test', '__tests__', 'testdata', '__mocks__'])) > 0 OR regexp_matches(seg[len(seg)], '(_test\.go|_test\.py|_test\.rs)$') OR regexp_matches(seg[len(seg)], '^test_.*\.py$')
            OR seg[len(seg)] IN ('conftest.py', 'tests.rs', 'test.rs') OR regexp_matches(seg[len(seg)], '\.(test|spec)\.') AS is_test FROM b""",
    "role_cardinality": """WITH n AS (SELECT count(*) FILTER (p_name LIKE '%gear' AND p_brand = 'Brand#4') AS a, count(*) FILTER (p_name LIKE 'nothing%') AS b FROM part)
        SELECT 'gears' AS role, CAST(a AS BIGINT) AS found, 3 AS expected, a = 0 AS vacuous, a > 3 AS over, CAST(a AS BIGINT) AS novel FROM n UNION ALL SELECT 'nothing', CAST(b AS BIGINT), 1, b = 0, b > 1, CAST(b AS BIGINT) FROM n""",
    "registry_fresh": f"""WITH {_doc_pairs()} SELECT left_key, right_key, round(score, 6) AS score FROM scored WHERE score >= 0.18 AND NOT (ls = 'src1' AND rs = 'src1') AND NOT (ls || rs IN ('src2src3', 'src3src2'))""",
    "scan_stats": r"SELECT lower(regexp_extract(regexp_extract(url, '://([^?#]*)', 1), '(\.[^./]*)$', 1)) AS ext, count(*) AS files, lower(regexp_extract(regexp_extract(url, '://([^?#]*)', 1), '(\.[^./]*)$', 1)) IN ('.html', '.py') AS taken FROM pages GROUP BY 1",
    "boundary_bite": "SELECT count(*) FILTER (source LIKE 'src1%') AS \"left\", count(*) FILTER (source LIKE 'srv%') AS \"right\", false AS bites FROM documents",
}
