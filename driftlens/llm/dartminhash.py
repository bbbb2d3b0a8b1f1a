"""Near-duplicate detection by DartMinHash and banded joins (op 8).

A text is the multiset of its shingles of five words (lower case, split at ASCII white space; a shorter text is one shingle),
each weighted by how often it occurs; similarity is weighted Jaccard, and texts of 0.8 or more are linked.

*Signature.* Each element owns a plane of weight and rank into which darts fall as a Poisson process of density one that
only hashes decide. The plane is cut into regions, unit strips of weight by strips of rank; the hash of (element, regions) gives the
number of darts in a region, and each dart's rank and coordinate (one of ``K``). Of the darts under an element's weight, each
coordinate keeps the earliest. About K ln K + 2 K darts fill a text's coordinates, whatever its length, so ranks are
searched up to that many divided by the total weight, and twice as far for the few texts with an empty coordinate. Two texts
agree in a coordinate with the probability of their similarity; of the dart there 16 bits are stored.

*Join.* Equal texts are one node (MD5 of the text). ``K / ROWS`` bands of ``ROWS`` coordinates make buckets. (1) Every node of a bucket is held
against the bucket's smallest node; (2) signatures drop the pairs that are far off (5 standard deviations); (3) the
rest is verified on the whole texts; (4) components. (5) Buckets whose nodes then lie in different components: all pairs across
components are tried as well, so no link that shares a bucket is lost. In small buckets a join makes the pairs, and (2) to (4) follow.
Pairs of a large bucket grow with its square, so they never become rows: nodes outside the bucket's largest component meet
all others in blocks of ``BLOCK`` nodes and ``HELD`` bytes of elements, and a block is verified at once by the elements of the whole texts, one
sweep a node; what it returns are links between components, fewer than its nodes. No task gets an unbounded group. A pair of
similarity 0.8 shares no bucket with probability 5e-8. Classes are components.

Defined results: null and empty texts are equal texts (one class); repeated rows are copies; null ids are never
a class id unless a class has none else; the class id is the smallest id of the class. A table without rows gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import ship, through, written

K, ROWS = 128, 4
WORDS = 5
THRESHOLD = 0.8
SLACK = 5.0  # standard deviations below THRESHOLD at which signatures rule a pair out
SMALL, BLOCK = 24, 512
HELD = 4 << 20  # bytes of elements in a block
SALTS = 8
CHUNK, TEXTS = 1 << 18, 128  # characters and texts that are hashed at a time
BITS = 1 << 24  # of the bitmap that saves moving texts
DARTS = K * math.log(K) + 2 * K
EDGES = [0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, *[2.0**i for i in range(60)]]  # of the strips of rank


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


_MUL = 0x9E3779B97F4A7C15
_grown: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _grown or len(_grown[0]) < n:
        size = max(n, 2 * CHUNK)
        back = pow(_MUL, -1, 1 << 64)
        _grown[:] = [np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, m, dtype=np.uint64)])) for m in (_MUL, back)]
    return _grown[0][:n], _grown[1][:n]


def elements(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, element) of all elements; an element is a shingle and how many like it came before in its text."""
    coded = [(t or "").lower().encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(coded), dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.concatenate([[True], blank[:-1]])
    start = np.nonzero(~blank & before)[0]
    end = np.nonzero(blank & ~before)[0]
    powers, back = _powers(len(data) + 1)
    mixed = _mix(data.astype(np.uint64) + np.uint64(0x51ED270B))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed * powers[: len(data)], dtype=np.uint64)])
    word = _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    text = np.searchsorted(np.cumsum([len(c) for c in coded]), start, side="right")
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    place = np.arange(len(word)) - first[text]
    # shingles of texts with enough words, then one for each shorter text
    head = np.nonzero(place <= n[text] - WORDS)[0]
    shingle = np.zeros(len(head), dtype=np.uint64)
    for j in range(WORDS):
        shingle = _mix(shingle * np.uint64(_MUL) + word[head + j])
    short = np.nonzero((n > 0) & (n < WORDS))[0]
    lone = np.zeros(len(short), dtype=np.uint64)
    for j in range(WORDS - 1):
        more = n[short] > j
        lone[more] = _mix(lone[more] * np.uint64(_MUL) + word[first[short[more]] + j])
    who = np.concatenate([text[head], short])
    what = np.concatenate([shingle, lone])
    # by text, then element: what ties is equal; numpy sorts small whole numbers in linear time
    order = np.argsort(what)
    order = order[np.argsort(who[order].astype(np.min_scalar_type(len(texts))), kind="stable")]
    who, what = who[order], what[order]
    new = np.ones(len(who), dtype=bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    at = np.arange(len(who))
    seen = at - np.maximum.accumulate(np.where(new, at, 0))
    return who, _mix(what + seen.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_cdfs: dict[int, np.ndarray] = {}


def _poisson(u: np.ndarray, strip: int) -> tuple[np.ndarray, np.ndarray]:
    """Which regions have darts, and how many: regions in the given strip of rank."""
    if strip not in _cdfs:
        mean = EDGES[strip + 1] - EDGES[strip]
        top = int(mean + 12 * math.sqrt(mean) + 24)
        logs = [k * math.log(mean) - mean - math.lgamma(k + 1) for k in range(top)]
        _cdfs[strip] = np.cumsum(np.exp(logs))
    has = np.flatnonzero(u >= _cdfs[strip][0])
    return has, np.searchsorted(_cdfs[strip], u[has], side="right")


def signatures(texts: list[str | None]) -> np.ndarray:
    """K coordinates (uint16) of each text; texts without words have zeros."""
    who, what = elements(texts)
    weight = np.bincount(who, minlength=len(texts))
    out = np.zeros((len(texts), K), dtype=np.uint16)
    todo, far = np.nonzero(weight)[0], DARTS
    while len(todo):
        number = np.full(len(texts), -1)
        number[todo] = np.arange(len(todo))
        mine = number[who] >= 0
        owner, element = number[who[mine]], what[mine]
        reach = far / weight[todo]
        until = reach[owner]
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for strip in range(len(EDGES) - 1):
            near = until > EDGES[strip]
            if not near.all():
                owner, element, until = owner[near], element[near], until[near]
            if not len(owner):
                break
            base = _mix(element + np.uint64((strip + 1) * 0xA0761D6478BD642F % 2**64))
            has, count = _poisson(_unit(base), strip)
            own, base, end = (np.repeat(x[has], count) for x in (owner, base, until))
            k = (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
            dart = _mix(base + (k + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
            rank = EDGES[strip] + (EDGES[strip + 1] - EDGES[strip]) * _unit(_mix(dart ^ np.uint64(0x8EBC6AF09C88C6E3)))
            hit = np.flatnonzero(rank < end)
            dart = dart[hit]
            darts.append((own[hit] * K + (dart % np.uint64(K)).astype(np.int64), rank[hit], dart))
        place, rank, dart = (np.concatenate(x) for x in zip(*darts))
        earliest = np.full(len(todo) * K, np.inf)
        np.minimum.at(earliest, place, rank)
        filled = earliest < np.inf
        kept = np.zeros(len(todo) * K, dtype=np.uint64)
        first = np.flatnonzero(rank == earliest[place])
        kept[place[first]] = dart[first]
        full = filled.reshape(-1, K).all(axis=1)
        out[todo[full]] = (kept.reshape(-1, K)[full] >> np.uint64(40)).astype(np.uint16)
        todo, far = todo[~full], far * 2
    return out


def similarity(a: str | None, b: str | None) -> float:
    """Weighted Jaccard of the shingles of two texts; 1 for two texts without words.

    Shingles are compared by 64-bit hashes: in texts of a million words each, the odds that any two differing ones agree are below 1e-6.
    """
    who, what = elements([a, b])
    x, y = what[who == 0], what[who == 1]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _by_portions(of):
    """A function on texts from one that takes some at a time and gives bytes of each."""

    @F.pandas_udf("binary")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in through(batches):
            out, held, size = [], [], 0
            for t in [*s, None]:
                held.append(t)
                size += len(t or "")
                if size > CHUNK or len(held) >= TEXTS or len(out) + len(held) == len(s) + 1:
                    out += of(held)
                    held, size = [], 0
            yield pd.Series(out[: len(s)], dtype=object)

    return each


def _signature_udf():
    return _by_portions(lambda texts: [x.tobytes() for x in signatures(texts)])


def _elements_udf():
    def of(texts: list[str | None]) -> list[bytes]:
        who, what = elements(texts)
        return [x.tobytes() for x in np.split(what, np.searchsorted(who, np.arange(1, len(texts))))]

    return _by_portions(of)


def _estimate_udf():
    @F.pandas_udf("double")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), dtype="<u2").reshape(-1, K) for s in (a, b))
        return pd.Series((x == y).mean(axis=1))

    return agree


def _similarity_udf():
    @F.pandas_udf("double")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in through(batches):
            yield pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")

    return similar


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


LEAST = THRESHOLD - SLACK * math.sqrt(THRESHOLD * (1 - THRESHOLD) / K)


def nodes_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each different text: node, id (smallest), sig. Written."""
    ship(docs.sparkSession)
    rows = docs.select(text_key(F.col(text)).alias("node"), F.col(key).cast("long").alias("id"), _signature_udf()(F.col(text)).alias("sig"))
    return written(rows.groupBy("node").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), "nodes")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of every band; texts without words are in none."""
    filled = nodes.where(F.col("sig") != F.lit(bytes(2 * K)))
    size = 2 * ROWS
    banded = filled.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(K // ROWS - 1))).alias("band"))
    return banded.select("node", F.xxhash64("band", F.substring("sig", F.col("band") * size + 1, F.lit(size))).alias("bucket"))


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that their signatures do not rule out."""
    sig = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    held = pairs.join(sig("a"), "a").join(sig("b"), "b")
    return held.where(_estimate_udf()("sig_a", "sig_b") >= LEAST).select("a", "b")


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose node is wanted, and a few more: a bitmap of BITS bits (2 MB at any size of wanted) goes to every task.

    Once it is full it lets all rows through, so it only saves moving texts and never decides anything.
    """
    at = lambda: F.pmod(F.xxhash64("node"), F.lit(BITS))
    bits = wanted.select(F.bitmap_bucket_number(at()).alias("part"), F.bitmap_bit_position(at()).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    placed = rows.withColumns({"__part": F.bitmap_bucket_number(at()), "__bit": F.bitmap_bit_position(at())}).join(F.broadcast(bits), F.col("__part") == F.col("part"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.withColumn("__byte", byte).where(F.col("__byte").bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0).select(*rows.columns)


def _texts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(node, text) of the nodes wanted, and a few more."""
    return _marked(docs.select(text_key(F.col(text)).alias("node"), F.col(text).alias("text")), wanted).dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Pairs (a, b) whose whole texts are similar enough. pairs: written."""
    texts = written(_texts(docs, text, pairs.select(F.explode(F.array("a", "b")).alias("node"))), "texts")
    of = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    held = pairs.join(of("a"), "a").join(of("b"), "b")
    return held.where(_similarity_udf()("text_a", "text_b") >= THRESHOLD).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; label: the smallest node of its component. edges (a, b): written.

    Labels spread over edges and jump along themselves until none changes; each round is a written table.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        spread = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(spread, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        moved = written(met.join(jump, "low").select("node", F.least("low", "lower").alias("new"), "label"), "labels")
        if moved.where(F.col("new") != F.col("label")).limit(1).count() == 0:
            return labels
        labels = moved.select("node", F.col("new").alias("label"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, labels): the different texts, and the class of those that are similar to another one."""
    nodes = nodes_of(docs, key, text)
    buckets = written(_buckets(nodes), "buckets")
    # a bucket of one node takes no part; sums are made in each task before the shuffle
    held = buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = written(held, "shared")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = lambda b: b.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    members = written(salted(buckets).join(shared.select("bucket", "first", "n", salts), ["bucket", "salt"]).select("bucket", "node", "first", "n"), "members")
    stars = members.where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    tried = written(stars, "stars")
    first = written(_verified(written(_plausible(tried, nodes), "pairs"), docs, text), "links")
    labels = components(first)
    apart = written(_apart(members, labels), "apart")
    small, large = apart.where(F.col("n") <= SMALL), apart.where(F.col("n") > SMALL)
    found = []
    if small.limit(1).count():
        found.append(_verified(written(_across(small, nodes).join(tried, ["a", "b"], "left_anti"), "across"), docs, text))
    if large.limit(1).count():
        found.append(_in_blocks(large, docs, text))
    if not found:
        return nodes, labels
    more = written(reduce(DataFrame.union, found), "links")
    if more.limit(1).count() == 0:
        return nodes, labels
    return nodes, components(written(first.union(more), "links"))


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, n, label) of the buckets whose nodes lie in different components."""
    labeled = members.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))
    mixed = labeled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    return labeled.join(mixed, "bucket", "left_semi")


def _across(small: DataFrame, nodes: DataFrame) -> DataFrame:
    """Plausible pairs a < b of nodes that share a bucket and lie in different components."""
    x, y = (small.select("bucket", F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in "ab")
    pairs = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b"))).select("a", "b").distinct()
    return _plausible(pairs, nodes)


def _in_blocks(large: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links (a, b) that join all components with a link in a bucket of large, each verified on the whole texts."""
    wanted = written(large.select("node").distinct(), "wanted")
    texts = _texts(docs, text, wanted).join(wanted, "node", "left_semi")
    held = written(texts.select("node", _signature_udf()("text").alias("sig"), _elements_udf()("text").alias("elements")), "elements")

    # nodes of the bucket's largest component need not meet each other: they have blocks of their own, after those of the rest
    sums = large.join(held.select("node", F.length("elements").alias("size")), "node").groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    total = sums.groupBy("bucket").agg(F.max(F.struct("n", "size", "label")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / HELD)).cast("int")
    one = parts(F.col("n"), F.col("size")) == 1
    rest = F.when(one, 1).otherwise(parts(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")))
    shape = total.select("bucket", F.col("most.label").alias("most"), rest.alias("rest"), F.when(one, 0).otherwise(parts(F.col("most.n"), F.col("most.size"))).alias("own"))
    main = F.col("label") == F.col("most")
    spot = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    block = F.when(main & (F.col("own") > 0), F.col("rest") + spot(F.col("own"))).otherwise(spot(F.col("rest")))
    placed = large.join(shape, "bucket").select("bucket", "node", "label", main.alias("main"), block.alias("block"), "rest", "own")
    # each block of the rest meets each block once
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("block") < F.col("rest"), F.col("rest") + F.col("own")).otherwise(F.col("rest")) - 1)).alias("other")
    met = placed.join(held, "node").select("bucket", "node", "label", "main", "sig", "elements", "block", other)
    met = met.select("bucket", "node", "label", "main", "sig", "elements", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return met.groupBy("bucket", "i", "j").applyInPandas(_block_links, "a binary, b binary").distinct()


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links between the nodes of block i outside the main component and the rest of the group: as many as join all components that have any."""
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    asked = (group["block"] == i) & ~group["main"]
    group = group.assign(later=~asked).sort_values(["later", "node"], ignore_index=True)
    sig = np.frombuffer(b"".join(group["sig"]), dtype="<u2").reshape(-1, K)
    label, node = pd.factorize(group["label"])[0], group["node"].to_numpy()
    size = group["elements"].str.len().to_numpy() // 8
    start = np.cumsum(size) - size
    codes, out = None, []
    for r in range(int(asked.sum())):
        at = r + 1 if i == j else int(asked.sum())
        near = (label[at:] != label[r]) & ((sig[at:] == sig[r]).sum(axis=1) >= LEAST * K)
        if not near.any():
            continue
        if codes is None:
            codes = np.unique(np.frombuffer(b"".join(group["elements"]), dtype="<u8"), return_inverse=True)[1].astype(np.int32)
            mark = np.zeros(int(codes.max()) + 1, dtype=np.uint8)
        mine = codes[start[r] : start[r] + size[r]]
        mark[mine] = 1
        both = np.add.reduceat(mark[codes[start[at] :]], start[at:] - start[at], dtype=np.int64)
        mark[mine] = 0
        for c in at + np.flatnonzero(near & (both / (size[r] + size[at:] - both) >= THRESHOLD)):
            if label[c] != label[r]:
                out.append((min(node[r], node[c]), max(node[r], node[c])))
                label[label == label[c]] = label[r]
    return pd.DataFrame(out, columns=["a", "b"], dtype=object)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and class_id of each row: the smallest id of all documents linked to it, over any number of links."""
    nodes, labels = links(docs, key, text)
    labeled = nodes.select("node", "id").join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    # nodes without links are their own class; only the others are grouped
    named = written(labeled.join(labeled.groupBy("label").agg(F.min("id").alias("class_id")), "label").select("node", "class_id"), "classes")
    rows = docs.select(F.col(key), text_key(F.col(text)).alias("node"))
    return rows.join(named, "node").select(key, "class_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class, that of the smallest id (null last; then of the smallest MD5 of the text); the same columns."""
    nodes, labels = links(docs, key, text)
    id_text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    labeled = nodes.join(labels, "node", "left").select(F.coalesce("label", "node").alias("label"), F.struct(F.col("id").isNull().alias("none"), "id", "node").alias("who"))
    kept = written(labeled.groupBy("label").agg(F.min("who").alias("who")).select(F.col("who.node").alias("__node"), id_text(F.col("who.id")).alias("__id")), "kept")
    keyed = docs.withColumns({"__node": text_key(F.col(text)), "__id": id_text(F.col(key).cast("long"))})
    # rows of one id and text are alike; of those one is kept, in the partitions that the join has made
    return keyed.join(kept, ["__node", "__id"], "left_semi").dropDuplicates(["__node", "__id"]).select(*docs.columns)
