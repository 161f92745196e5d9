"""Near-duplicates by ProbMinHash, banding and exact verification.

A text is the bag of its shingles of five words (lower case, letters, digits and
underscores), weighted by their counts. Every shingle is a Poisson process whose rate is
its weight: its points come in rising order, each falls on one of the signature's places,
and the smallest point of a place decides it. A shingle stops as soon as its next point is
larger than all places hold. Two signatures agree at a place with the probability Jaccard
similarity of the bags; for equal weights that is the plain one.

Equal texts (by their words) are one node. Places are cut into bands; nodes that agree in
a band share a bucket. In each bucket all nodes are held against one centre, and pairs are
verified by the exact probability Jaccard similarity, 0.8 or more. Nodes of buckets that then
still hold several components are banded anew, with more places to a band (``STRONG_ROWS``),
so that texts of which the first bands knew too little no longer meet: texts of similarity
0.4 share such a bucket in 5 cases of a hundred, those of 0.8 miss each other in one of a
million. Nodes that meet there, if they are of several components still, are joined to
families; a family is dealt into blocks of bounded size, and each pair of blocks is one
group: there the nodes of different components are held against each other by matrix
products, and only links that join components come out. So no pair of a bucket that could
join two components is left out, no group is expanded into rows for all its pairs, and no
task holds more than two blocks. Blocks of one and the same component are not compared.
Components of verified links are the classes.

Buckets, centres and components that hold over a 10,000th of all rows are joined in parts.

Defined cases: a text of under five words is one shingle; null texts and texts without a
word are classes of their own; rows with equal texts are copies, also with equal ids; the
class id is the least doc_id of the class (null only if it has no other); an empty table
gives no rows; the columns of the input are kept by ``drop_near_copies``, which keeps the
row with that least id, and one row of it if it is repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.common import bound_batches, hot_keys, join_spread, settle, table, tidy
from loomdoc.llm.graph import components

WORDS, LEAST = 5, 0.8
#: 24 bands of 4 places: two texts of similarity 0.8 share no bucket in 3 of a million cases.
BANDS, ROWS = 24, 4
#: 75 bands of 8 places, for the nodes that the first bands leave open: 0.8 misses in 1 of a million cases.
STRONG_BANDS, STRONG_ROWS = 75, 8
#: Nodes, and shingles of them together, in a block of a family.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1_000_000
#: Ids that are broadcast to pick documents (about 30 bytes each in a task's table); more go through a join.
MOST_IDS = 200_000
MOST_CACHED = 1_000_000
#: Texts that take their points together.
TOGETHER = 256

_WORD = re.compile(r"\w+")
_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MOST_CACHED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


@cache
def _known() -> _Hashes:
    return _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str | None) -> np.ndarray:
    known = _known()
    return np.array([known[w] for w in _WORD.findall(text.lower())], _U) if text else np.zeros(0, _U)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, rising, and their counts."""
    if not len(words):
        return np.zeros(0, _U), np.zeros(0, np.int32)
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    s = np.full(n, k, _U)
    for j in range(k):
        s = _mix(s * _U(0x9E3779B97F4A7C15) + words[j : j + n])
    keys, counts = np.unique(s, return_counts=True)
    return keys, counts.astype(np.int32)


def digest(words: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """128 bits of a text's words as two signed longs."""
    if not len(words):
        return None, None
    d = xxhash.xxh3_128_digest(words.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], places: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash of each bag (keys, weights): the deciding shingle of each place; all bags take their points together."""
    sizes = np.array([len(k) for k, _ in bags], int)
    keys = np.concatenate([k for k, _ in bags]) if len(bags) else np.zeros(0, _U)
    weights = np.concatenate([w for _, w in bags]).astype(float) if len(bags) else np.zeros(0)
    of = np.repeat(np.arange(len(bags)), sizes)
    least = np.full(len(bags) * places, np.inf)
    decided = np.zeros(len(bags) * places, _U)
    x, alive, step = np.zeros(len(keys)), np.arange(len(keys)), 0
    while len(alive):
        step += 1
        r = _mix(keys[alive] + _U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        u = ((r >> _U(11)).astype(float) + 0.5) / float(1 << 53)
        x[alive] -= np.log(u) / weights[alive]
        at = of[alive] * places + (_mix(r ^ _U(0xD1B54A32D192ED03)) % _U(places)).astype(int)
        point = x[alive]
        np.minimum.at(least, at, point)
        won = least[at] == point
        decided[at[won]] = keys[alive[won]]
        limit = least.reshape(len(bags), places).max(1)
        alive = alive[point < limit[of[alive]]]
    return decided.reshape(len(bags), places)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity of two bags with rising keys: the sum over common i of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    i = np.flatnonzero(b[0][at] == a[0]) if len(b[0]) else at[:0]
    if not len(i):
        return 0.0
    if a[1].max() == b[1].max() == 1:
        return len(i) / (len(a[0]) + len(b[0]) - len(i))
    x, y = a[1][i].astype(float), b[1][at[i]].astype(float)
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    # For i: x_j counts where x_j / y_j is at least ratio_i, else ratio_i * y_j; what only one side has counts on that side.
    xs = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0.0]])
    ys = np.concatenate([[0.0], np.cumsum(y[order])])
    at = np.searchsorted(ratio[order], ratio, "left")
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    return float((x / (only_x + xs[at] + ratio * (ys[at] + only_y))).sum())


def banded(bags: list[tuple[np.ndarray, np.ndarray]], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The hash of each band of each bag's signature; bags go through in parts."""
    out = np.zeros((len(bags), bands), _U)
    for i in range(0, len(bags), TOGETHER):
        sig = signatures(bags[i : i + TOGETHER], bands * rows).reshape(-1, bands, rows)
        band = np.broadcast_to(np.arange(bands, dtype=_U), sig.shape[:2])
        for r in range(rows):
            band = _mix(band * _U(0x9E3779B97F4A7C15) + sig[:, :, r])
        out[i : i + TOGETHER] = band
    return out.view(np.int64)


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest and bands of each text."""
    for batch in batches:
        for i in range(0, len(batch), TOGETHER):
            b = batch.iloc[i : i + TOGETHER]
            words = [word_hashes(t if isinstance(t, str) else None) for t in b["text"]]
            d = [digest(w) for w in words]
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "d1": pd.array([x for x, _ in d], "Int64"), "d2": pd.array([y for _, y in d], "Int64"), "bands": list(banded([shingles(w) for w in words]))})


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest and shingles of each text, as bytes."""
    for b in batches:
        for i in range(0, len(b), TOGETHER):
            out = []
            for t in b["text"].iloc[i : i + TOGETHER]:
                w = word_hashes(t if isinstance(t, str) else None)
                if len(w):
                    k, c = shingles(w)
                    out.append((*digest(w), k.tobytes(), c.tobytes()))
            yield pd.DataFrame(out, columns=["d1", "d2", "keys", "counts"])


def _bag(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, _U), np.frombuffer(counts, np.int32)


def _stronger(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), TOGETHER):
            part = b.iloc[i : i + TOGETHER]
            bands = banded([_bag(k, c) for k, c in zip(part["keys"], part["counts"], strict=True)], STRONG_BANDS, STRONG_ROWS)
            yield pd.DataFrame({"node": part["node"].to_numpy(), "root": part["root"].to_numpy(), "bands": list(bands)})


def _verified(least: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = [similarity(_bag(ka, ca), _bag(kb, cb)) >= least - 1e-12 for ka, ca, kb, cb in zip(p["ka"], p["ca"], p["kb"], p["cb"], strict=True)]
            yield p.loc[keep, ["a", "b"]]

    return verify


def overlap(a: list[np.ndarray], b: list[np.ndarray], weights: tuple[list[np.ndarray], list[np.ndarray]] | None = None) -> np.ndarray:
    """For each of a and b the sum over common keys of the product of weights (1 if none are given), by dense products of slices of the keys."""
    both = [np.concatenate(x) if x else np.zeros(0, _U) for x in (a, b)]
    shared = np.intersect1d(np.unique(both[0]), np.unique(both[1]), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for k, bags in enumerate((a, b)):
        row = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
        col = np.searchsorted(shared, both[k])
        hit = col < len(shared)
        hit[hit] = shared[col[hit]] == both[k][hit]
        w = np.concatenate(weights[k])[hit] if weights else np.ones(int(hit.sum()), np.float32)
        order = np.argsort(col[hit], kind="stable")
        sides.append((row[hit][order], col[hit][order], w[order]))
    step = 4096
    for lo in range(0, len(shared), step):
        parts = []
        for (row, col, w), n in zip(sides, (len(a), len(b)), strict=True):
            i, j = np.searchsorted(col, [lo, lo + step])
            m = np.zeros((n, step), np.float32)
            m[row[i:j], col[i:j] - lo] = w[i:j]
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def joining(nodes: np.ndarray, roots: np.ndarray, sides: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """Links between nodes of the two sides (0 and 1; of one side, if there is only one) that join the components which their roots name."""
    left = np.flatnonzero(sides == 0)
    right = np.flatnonzero(sides == 1) if (sides == 1).any() else left
    up: dict[int, int] = {}

    def top(r: int) -> int:
        while up.get(r, r) != r:
            up[r] = r = up.get(up[r], up[r])
        return r

    found: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        a, b = top(int(roots[i])), top(int(roots[j]))
        if a != b:
            up[a] = b
            found.append((int(nodes[i]), int(nodes[j])))

    keys = [k for k, _ in bags]
    sizes = np.array([len(k) for k in keys], float)
    plain = np.array([c.max(initial=1) == 1 for _, c in bags])
    common = overlap([keys[i] for i in left], [keys[j] for j in right])
    other = roots[left][:, None] != roots[right][None]
    exact = plain[left][:, None] & plain[right][None]
    near = common >= (least - 1e-9) * (sizes[left][:, None] + sizes[right][None] - common)
    for i, j in np.argwhere(other & exact & near):
        link(left[i], right[j])
    if not exact.all():
        # The sum of sqrt(p q) over the shares p, q of common shingles is at least their probability Jaccard similarity.
        roots_of = [np.sqrt(c / c.sum()).astype(np.float32) for _, c in bags]
        bound = overlap([keys[i] for i in left], [keys[j] for j in right], ([roots_of[i] for i in left], [roots_of[j] for j in right]))
        rest = np.argwhere(other & ~exact & (bound >= least - 1e-4))
        for i, j in rest[np.argsort(-bound[rest[:, 0], rest[:, 1]], kind="stable")]:
            i, j = left[i], right[j]
            if top(int(roots[i])) != top(int(roots[j])) and similarity(bags[i], bags[j]) >= least - 1e-12:
                link(i, j)
    return found


def _joined(least: float):
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        bags = [_bag(k, c) for k, c in zip(rows["keys"], rows["counts"], strict=True)]
        return pd.DataFrame(joining(rows["node"].to_numpy(), rows["root"].to_numpy(), rows["side"].to_numpy(), bags, least), columns=["a", "b"])

    return join


def _open(buckets: DataFrame) -> DataFrame:
    """node, root and bucket of the buckets (bucket, node, root) that hold several components."""
    split = settle(buckets.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo != hi"), "split")
    return join_spread(buckets, split.select("bucket"), "bucket", "node", hot_keys(split, "bucket", "n", buckets.count()))


def _family_links(buckets: DataFrame, roots: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """What the centres left open: links between components that meet in a bucket of three nodes or more, and in one of stronger bands."""
    named = settle(buckets.where("n > 2").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "named")
    first = settle(_open(named).select("node", "root").distinct(), "first")
    none = first.selectExpr("node as a", "node as b").limit(0)
    if first.isEmpty():
        return none
    strong = settle(first.join(bags, "node").select("node", "root", "keys", "counts").mapInPandas(_stronger, "node long, root long, bands array<long>").select("node", "root", F.explode("bands").alias("bucket")), "strong")
    open_ = settle(_open(strong), "open")
    if open_.isEmpty():
        return none
    centres = open_.groupBy("bucket").agg(F.min("node").alias("centre"))
    linked = open_.join(centres, "bucket").selectExpr("node as a", "centre as b").distinct()
    families = components(linked).select("node", F.col("root").alias("family"))
    sized = bags.select("node", (F.length("keys") / 8).alias("m"))
    nodes = settle(open_.select("node", "root").distinct().join(families, "node").join(sized, "node"), "members")  # a family has a bucket with two components, so two nodes

    def blocks(size: str = "count(*)") -> str:
        return f"cast(ceil(greatest({size} / {float(BLOCK_NODES)}, sum(m) / {float(BLOCK_SHINGLES)})) as int)"

    # A component that fills blocks of its own gets them; all smaller ones of a family share blocks.
    large = settle(nodes.groupBy("family", "root").agg(F.count("*").alias("n"), F.expr(blocks()).alias("own")).where(f"n >= {BLOCK_NODES}").select("family", "root", "own"), "large")
    placed = nodes.join(large, ["family", "root"], "left").withColumn("part", F.when(F.col("own").isNotNull(), F.col("root")))
    small = settle(nodes.join(large, ["family", "root"], "left_anti").groupBy("family").agg(F.expr(blocks()).alias("mixed")), "small")
    placed = placed.join(small, "family", "left").select(
        "node", "root", "family", F.concat_ws("/", F.coalesce(F.col("part").cast("string"), F.lit("-")), F.pmod(F.xxhash64("node"), F.coalesce("own", "mixed"))).alias("block"), F.coalesce(F.col("part").cast("string"), F.lit("-")).alias("of")
    )
    placed = settle(placed, "blocks")
    listed = settle(placed.select("family", "block", "of").distinct(), "listed")
    x, y = listed.select("family", F.col("block").alias("x"), F.col("of").alias("ox")), listed.select("family", F.col("block").alias("y"), F.col("of").alias("oy"))
    couples = x.join(y, "family").where("x <= y and (ox != oy or ox = '-')").select("family", "x", "y")  # pairs of blocks
    of_x = couples.select("family", "x", "y", F.col("x").alias("block"), F.lit(0).alias("side"))
    of_y = couples.where("x != y").select("family", "x", "y", F.col("y").alias("block"), F.lit(1).alias("side"))
    dealt = settle(of_x.union(of_y), "couples")
    rows = dealt.join(placed, ["family", "block"]).select("family", "x", "y", "side", "node", "root").join(bags, "node")
    return settle(rows.groupBy("family", "x", "y").applyInPandas(_joined(least), "a long, b long"), "links")


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids (column _id)."""
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def _links(bags: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a the centre, b) those that are near enough. A centre of many pairs has its bag copied to several tasks."""
    a = bags.select(F.col("node").alias("a"), F.col("keys").alias("ka"), F.col("counts").alias("ca"))
    b = bags.select(F.col("node").alias("b"), F.col("keys").alias("kb"), F.col("counts").alias("cb"))
    hot = hot_keys(pairs.groupBy("a").count(), "a", "count", pairs.count())
    return settle(join_spread(pairs.join(b, "b"), a, "a", "b", hot).select("a", "b", "ka", "ca", "kb", "cb").mapInPandas(_verified(least), "a long, b long"), "links")


def classes(docs: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): doc_id, d1, d2 of each row, and d1, d2, class_id, class_size, keeper (is this the class's kept text?) of each text that has words. d1 and d2 are 128 bits of a text's words."""
    bound_batches(docs.sparkSession)
    with tidy(docs.sparkSession) as keep:
        rows, nodes = _classes(docs.select("doc_id", F.col("text").cast("string").alias("text")), least)
        return keep(rows).select("doc_id", "d1", "d2"), keep(nodes)


def _classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    rows = settle(docs.mapInPandas(_described, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, d1 long, d2 long, bands array<long>"), "rows")
    # Equal texts are one node; its number is fixed by being written.
    texts = rows.where("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    texts = settle(texts.withColumn("node", F.monotonically_increasing_id()), "texts")

    held = texts.select("node", F.explode("bands").alias("bucket"))
    centres = settle(held.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1"), "centres")
    total = centres.agg(F.sum("n")).first()[0] or 0
    buckets = settle(join_spread(held, centres, "bucket", "node", hot_keys(centres, "bucket", "n", total)), "buckets")

    pairs = settle(buckets.where("node != centre").selectExpr("centre as a", "node as b").distinct(), "pairs")
    met = settle(texts.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "d1", "d2", "least_id"), "met")
    found = _picked(docs, met.select(F.col("least_id").alias("_id")).distinct()).mapInPandas(_bags, "d1 long, d2 long, keys binary, counts binary").dropDuplicates(["d1", "d2"])
    bags = settle(found.join(met.select("node", "d1", "d2"), ["d1", "d2"]).select("node", "keys", "counts"), "bags")

    links = _links(bags, pairs, least)
    roots = components(links)
    more = _family_links(buckets, roots, bags, least)
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    named = settle(texts.select("d1", "d2", "least_id", "copies", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    sums = settle(named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n")), "sums")
    hot = hot_keys(sums, "root", "n", named.count())
    owners = settle(join_spread(named, sums.drop("n"), "root", "node", hot), "owners")
    keepers = settle(owners.where("least_id <=> class_id").groupBy("root").agg(F.min("node").alias("kept")), "keepers")
    kept = join_spread(owners, keepers, "root", "node", hot)
    return rows, settle(kept.select("d1", "d2", "class_id", "class_size", (F.col("node") == F.col("kept")).alias("keeper")), "nodes")


def drop_near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One document of each class, with all its columns: that with the least id."""
    with tidy(docs.sparkSession) as keep:
        rows, nodes = classes(docs, least)
        wordless = rows.where("d1 is null").select(F.col("doc_id").alias("_id"))
        kept = keep(settle(nodes.where("keeper").select(F.col("class_id").alias("_id"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2")), "kept"))
        again = keep(settle(rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "again"))
        ids = kept.select("_id").union(wordless).distinct()
        repeated = not again.isEmpty()
        if repeated:
            ids = ids.join(again.select(F.col("_id").alias("_again")), F.col("_id").eqNullSafe(F.col("_again")), "left_anti")
        ids = keep(settle(ids, "ids"))
    once = _picked(docs, ids)
    if not repeated:
        return once

    @F.pandas_udf("d1 long, d2 long")
    def node_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame([digest(word_hashes(v if isinstance(v, str) else None)) for v in t], columns=["d1", "d2"]).astype("Int64")

    # Rows whose ids repeat: their texts decide which class they are of. A row travels as one value, whatever its columns are called.
    several = _picked(docs, again).select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("id"), node_of(docs["text"].cast("string")).alias("of"))
    bare = several.where("of.d1 is null").select("row.*")
    first = several.join(kept, F.col("id").eqNullSafe(F.col("_id")) & (F.col("of.d1") == F.col("_d1")) & (F.col("of.d2") == F.col("_d2")), "left_semi").dropDuplicates(["of"]).select("row.*")
    return once.unionByName(bare).unionByName(first)


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, nodes = classes(table(spark, sf_dir, "documents"))
    joined = rows.join(nodes, ["d1", "d2"], "left")
    return joined.select("doc_id", F.when(F.col("d1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
