"""Scalar functions as Column expressions; none of them is a Python function at run time."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions import constants as K


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


# --- names -------------------------------------------------------------------


def norm_tokens(name) -> Column:
    """Lower-case parts of a name, cut at underscores and where a capital follows."""
    n = F.regexp_replace(F.regexp_replace(c(name), r"^\s+|\s+$", ""), "^_+", "")
    return F.filter(F.split(F.lower(F.regexp_replace(n, "([a-z0-9])([A-Z])", "$1_$2")), "_"), lambda x: x != "")


def stem_tokens(name) -> Column:
    """norm_tokens without one leading role word and without stop words, as a set."""

    def of(t: Column) -> Column:
        peeled = F.when((F.size(t) > 1) & F.array_contains(words(K.ROLE_PREFIXES), F.try_element_at(t, F.lit(1))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(1)))).otherwise(t)
        return F.array_except(peeled, words(K.STEM_STOPWORDS))

    return F.get(F.transform(F.array(norm_tokens(name)), of), 0)  # cut up once, however long the name


def receiver_of(qualname) -> Column:
    return F.regexp_extract(c(qualname), r"^(.+)\.[^.]*$", 1)


# --- sets --------------------------------------------------------------------


def jaccard(a, b) -> Column:
    """Of two sets; two empty ones have 0."""
    a, b = c(a), c(b)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def set_equal(a, b) -> Column:
    return (F.size(F.array_except(c(a), c(b))) == 0) & (F.size(F.array_except(c(b), c(a))) == 0)


def subset_of(a, b) -> Column:
    return F.size(F.array_except(c(a), c(b))) == 0


def pair_key(a, b) -> Column:
    return F.concat(F.least(c(a), c(b)), F.lit("\u0000"), F.greatest(c(a), c(b)))


def set_key(members) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c(members))), "\u0000")


def shared_label(a, b) -> Column:
    """The first four shared members in order, with dots if there are more."""
    both = F.array_sort(F.array_intersect(c(a), c(b)))
    return F.concat(F.array_join(F.slice(both, 1, 4), ","), F.when(F.size(both) > 4, F.lit(",…")).otherwise(F.lit("")))


# --- scores ------------------------------------------------------------------


def name_sim(stem_a, stem_b, delegates_a, delegates_b) -> Column:
    same = (F.size(c(stem_a)) > 0) & set_equal(stem_a, stem_b)
    s = F.when(same, F.lit(1.0)).otherwise(jaccard(stem_a, stem_b))
    return F.when(c(delegates_a) | c(delegates_b), s * F.lit(K.DELEGATE_FACTOR)).otherwise(s)


CHANNEL_SETS = {"strings": "s_strings", "writes": "s_writes", "name": "stem", "calls": "s_calls", "ret": "s_ret"}


def similarities(l: str = "l_", r: str = "r_") -> dict[str, Column]:  # noqa: E741
    """Similarity of each channel of a joined pair whose columns carry the prefixes l and r."""
    out = {}
    for ch, _ in K.CHANNELS:
        a, b = l + CHANNEL_SETS[ch], r + CHANNEL_SETS[ch]
        out[ch] = name_sim(a, b, l + "delegates", r + "delegates") if ch == "name" else jaccard(a, b)
    return out


def pair_score(sims: dict[str, Column], weights: dict[str, float] | None = None, l: str = "l_", r: str = "r_") -> Column:  # noqa: E741
    """Weighted mean over the channels that either side has, summed in a fixed order."""
    w = dict(K.CHANNELS) | (weights or {})
    total, wsum = F.lit(0.0), F.lit(0.0)
    for ch, _ in K.CHANNELS:
        there = (F.size(l + CHANNEL_SETS[ch]) > 0) | (F.size(r + CHANNEL_SETS[ch]) > 0)
        wsum = wsum + F.when(there, F.lit(float(w[ch]))).otherwise(F.lit(0.0))
        total = total + F.when(there, F.lit(float(w[ch])) * sims[ch]).otherwise(F.lit(0.0))
    return total / F.when(wsum == 0, F.lit(1.0)).otherwise(wsum)


def anchored(sims: dict[str, Column], l: str = "l_", r: str = "r_") -> Column:  # noqa: E741
    """Calls alone, or a weak name, do not make a candidate; weights have no say."""
    named = (sims["name"] >= K.ANCHOR_NAME) & ~(F.col(l + "delegates") | F.col(r + "delegates"))
    return named | (sims["strings"] > 0) | (sims["writes"] > 0) | (sims["ret"] > 0)


def dir_of(path) -> Column:
    """Directory of a relative path; '.' for a file at the root."""
    d = F.regexp_extract(c(path), r"^(.*)/[^/]*$", 1)
    return F.when(F.instr(c(path), "/") > 0, d).otherwise(F.lit("."))


def dir_hops(a, b) -> Column:
    """Segments of either directory after what both begin with."""
    x, y = F.split(dir_of(a), "/"), F.split(dir_of(b), "/")
    shorter = F.least(F.size(x), F.size(y))
    same = F.size(F.filter(F.sequence(F.lit(1), shorter), lambda k: F.slice(x, 1, k) == F.slice(y, 1, k)))
    return F.size(x) + F.size(y) - 2 * same


def distance_boost(file_a, line_a, file_b, line_b) -> Column:
    near = 1 + F.least(F.abs(c(line_a) - c(line_b)) / 300, F.lit(1.0)) * 0.10
    far = 1 + F.least(dir_hops(file_a, file_b) / 4, F.lit(1.0)) * 0.15
    return F.when(c(file_a) == c(file_b), near).otherwise(far)


# --- gates -------------------------------------------------------------------


def is_test_path(path) -> Column:
    p = c(path)
    segments = F.split(F.lower(p), "/")
    folders = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    base = F.try_element_at(F.split(p, "/"), F.lit(-1))
    named = base.rlike(r"(_test\.go|_test\.py|_test\.rs)$") | base.rlike(r"^test_.*\.py$") | base.isin("conftest.py", "tests.rs", "test.rs") | base.rlike(r"\.(test|spec)\.")
    return F.arrays_overlap(folders, words(K.TEST_DIRS)) | named


def is_seam(s) -> Column:
    s = c(s)
    shaped = s.rlike("^_?[a-zA-Z][a-zA-Z0-9_]*$") & ~s.startswith("__")
    private = s.startswith("_") & (F.length(s) >= 3)
    plain = ~s.startswith("_") & ~s.isin(K.COMMON_IDENTS) & s.rlike("^[a-z]") & (F.length(s) >= 4)
    return shaped & (private | plain)


def is_domain_const(s) -> Column:
    return (F.length(c(s)) >= 3) & c(s).rlike("^[A-Z][A-Z0-9_]*$")


def signature_informative(sig) -> Column:
    named = F.regexp_extract_all(c(sig), F.lit("([A-Z][A-Za-z0-9_]+)"), 1)
    return ~c(sig).isin("", "()=>?") & F.exists(named, lambda t: ~t.isin(K.GENERIC_TYPES))


def richness(sig) -> Column:
    return F.size(F.regexp_extract_all(c(sig), F.lit(r"([A-Z][A-Za-z0-9_]+|\[\]|<|\{)"), 1))


def opposed(name_a, name_b) -> Column:
    """Names that differ in one word each, the two being opposites."""
    a, b = F.array_distinct(norm_tokens(name_a)), F.array_distinct(norm_tokens(name_b))
    x, y = F.array_except(a, b), F.array_except(b, a)
    one = (F.size(x) == 1) & (F.size(y) == 1)
    pair = F.concat(F.least(F.try_element_at(x, F.lit(1)), F.try_element_at(y, F.lit(1))), F.lit("/"), F.greatest(F.try_element_at(x, F.lit(1)), F.try_element_at(y, F.lit(1))))
    return F.coalesce(F.when(one, pair.isin(["/".join(sorted(p)) for p in K.OPPOSED])), F.lit(False))


def flat_field(x: Column) -> Column:
    return F.instr(F.regexp_replace(x, r"^this\.", ""), ".") == 0


def structural_share(reads_a, reads_b) -> Column:
    both = F.array_intersect(c(reads_a), c(reads_b))
    return F.size(both).between(1, 3) & ~F.exists(both, lambda x: ~flat_field(x))


def op_type(stem, s_ret, s_writes) -> Column:
    return (
        F.when(F.arrays_overlap(c(stem), words(K.INVERSE_SEARCH)), "inverse-search")
        .when(F.arrays_overlap(c(stem), words(K.FORWARD_MAP)), "forward-map")
        .when(F.arrays_overlap(c(stem), words(K.MEASURE)), "measure")
        .when(F.size(c(s_ret)) > 0, "construct")
        .when(F.size(c(s_writes)) > 0, "mutate")
        .otherwise("")
    )


def opposed_ops(a, b) -> Column:
    pair = F.concat(F.least(c(a), c(b)), F.lit("|"), F.greatest(c(a), c(b)))
    return pair.isin("forward-map|inverse-search", "construct|measure")


def calls_each_other(l: str = "l_", r: str = "r_") -> Column:  # noqa: E741
    return F.array_contains(l + "s_calls", F.col(r + "name")) | F.array_contains(r + "s_calls", F.col(l + "name"))


def _field_copy(p: str) -> Column:
    w, both = F.size(p + "s_writes"), F.size(F.array_intersect(p + "s_writes", p + "s_reads"))
    return (w >= 2) & (both / w >= 0.6)


def false_alarm_hint(l: str = "l_", r: str = "r_") -> Column:  # noqa: E741
    ra, rb = receiver_of(l + "qualname"), receiver_of(r + "qualname")
    routed = lambda p: F.try_element_at(F.split(F.col(p + "file"), "/"), F.lit(-1)).isin(K.ROUTE_FILES) & F.col(p + "name").isin(K.ROUTE_NAMES)
    return F.when((ra != "") & (ra == rb), "same-receiver").when(routed(l) & routed(r), "sveltekit-handler").when(_field_copy(l) & _field_copy(r), "field-copy").otherwise("")


# --- text --------------------------------------------------------------------


def strip_non_prose(text) -> Column:
    """Front matter, fenced code, inline code, quoted lines and headings out, in that order."""
    t = F.regexp_replace(c(text), r"(?s)\A---\n.*?\n---\n", "")
    t = F.regexp_replace(t, "(?s)```.*?```", "")
    t = F.regexp_replace(t, "`[^`]*`", "")
    t = F.regexp_replace(t, r"(?m)^[\t\n\f\r ]*>.*$", "")
    return F.regexp_replace(t, r"(?m)^#+[\t\n\f\r ]+.*$", "")


def line_of(text, offset) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(c(text), F.lit(1), c(offset).cast("int"))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def stem_key(term) -> Column:
    """Term without the first listed suffix that leaves three letters of its last part."""
    t = c(term)
    last = F.try_element_at(F.split(t, "-"), F.lit(-1))
    return reduce(lambda other, s: F.when(last.endswith(s) & (F.length(last) - len(s) >= 3), F.substring(t, F.lit(1), F.length(t) - len(s))).otherwise(other), reversed(K.SUFFIXES), t)


def share_word_stem(a, b) -> Column:
    a, b = F.lower(c(a)), F.lower(c(b))
    pair = F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b))
    return (stem_key(a) == stem_key(b)) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (F.substring(a, 1, 4) == F.substring(b, 1, 4))) | pair.isin(["|".join(p) for p in sorted(K.irregular_pairs())])


def strip_comment_leader(text) -> Column:
    t = F.regexp_replace(c(text), r"^\s+|\s+$", "")
    for p in ("///", "//!", "//", "#", "/*", "*/", "*"):
        t = F.regexp_replace(F.regexp_replace(t, "^" + re.escape(p), ""), r"^\s+|\s+$", "")
    return t


def confession_register(text) -> Column:
    return F.when(F.regexp_replace(c(text), r"^\s+", "").rlike("^(//|#)"), "line").otherwise("prose")


def identifier_like(w) -> Column:
    return (F.instr(c(w), "_") > 0) | c(w).rlike("[a-z][A-Z]")


# --- paths, keys, labels -------------------------------------------------------


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a path glob; ** goes over folders, * and ? do not."""
    out, i = "^", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or (("\\" + glob[i]) if glob[i] in ".+()|^${}[]\\" else glob[i])
            i += 1
    return out + "$"


def match_any(path, globs: list[str]) -> Column:
    """False for no globs."""
    return reduce(lambda a, b: a | b, [c(path).rlike(glob_regex(g.strip())) for g in globs if g.strip()], F.lit(False))


def fire_id(kind, key) -> Column:
    return F.substring(F.sha2(F.concat(c(kind), F.lit("\u0000"), c(key)).cast("binary"), 256), 1, 10)


def lang_of(path) -> Column:
    ext = F.lower(F.regexp_extract(c(path), r"\.([A-Za-z0-9]+)$", 1))
    known = {"go": ["go"], "python": ["py"], "typescript": ["ts", "tsx", "mts", "cts"], "javascript": ["js", "jsx", "mjs", "cjs"], "rust": ["rs"]}
    return reduce(lambda other, x: F.when(ext.isin(x[1]), x[0]).otherwise(other), known.items(), F.lit("other"))


def variety_of(sig) -> Column:
    return F.regexp_extract(c(sig), r"\[([^\]]*)\]", 1)


def verdict_class(verdict) -> Column:
    return F.regexp_extract(F.regexp_replace(c(verdict), r"^\s+", ""), r"^(\S*)", 1)


def verdict_label(verdict) -> Column:
    v = verdict_class(verdict)
    return F.when(v == "drift", "useful").when(v == "false-alarm", "not-useful").when(v == "contracted-twin-ok", "mixed")


def resolve_label(verdict, tag) -> Column:
    return F.coalesce(verdict_label(verdict), c(tag), F.lit("untagged"))


def derivation_lean(file_a, file_b) -> Column:
    return F.when(dir_of(file_a) == dir_of(file_b), "collapse").otherwise("pin/cross-pkg")


def kebab(name) -> Column:
    return F.array_join(norm_tokens(name), "-")


def escape_data(text) -> Column:
    """Text of an annotation: per cent first, then line ends."""
    t = F.replace(c(text), F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(t, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def escape_property(text) -> Column:
    return F.replace(F.replace(escape_data(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def md_cell(text) -> Column:
    return F.replace(F.replace(c(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def trimmed(text) -> Column:
    return F.regexp_replace(c(text), r"^\s+|\s+$", "")


def normalize_verdict(text) -> Column:
    """Free text to a verdict's name: 'was drift' must not win over what it became."""
    low = F.lower(c(text))
    return F.when(low.contains("contracted-twin-ok"), "contracted-twin-ok").when(low.contains("false-alarm"), "false-alarm").when(low.contains("drift"), "drift").otherwise(trimmed(text))


def normalize_reviewed(text) -> Column:
    day = F.regexp_extract(c(text), r"(\d{4}-\d{2}-\d{2})", 1)
    return F.when(day != "", day).otherwise(trimmed(text))


# --- vectors -------------------------------------------------------------------


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, c(v).cast("array<double>")).otherwise(F.transform(c(v), lambda x: x.cast("double") / n))


def cosine(a, b) -> Column:
    """Of normalised vectors; 0 for different lengths."""
    return F.when(F.size(c(a)) != F.size(c(b)), F.lit(0.0)).otherwise(dot(a, b))
