r"""Benchmark decontamination by spaced seeds.

Words are the runs of letters and digits of the lower-cased text. A mask names the
positions of a window that count; the others may hold any word. The hashes of the counted
words at each place of a document are joined with those of the benchmark items; a hit
aligns the two texts. Hits of one alignment in one stretch of ``window`` places of the item
are taken together; around that stretch, with ``window`` places more on either side, the
words are compared place by place. An overlap is a run of ``window`` places (the whole item
if it is shorter) of which at least ``least`` hold equal words: substitutions are
tolerated, within the masks and around them.

No overlap is lost: each way of placing the substitutions that the rule accepts leaves the
counted places of some mask alone. Masks that do not reach that (``covers`` tries all ways)
are joined by pieces of the window that do by the pigeonhole principle, and items shorter
than the window have such pieces of their own length. ``op3_decontam`` itself searches items
shorter than a mask by all their words, as its SQL does; ``overlaps`` and the pipeline do not.

The benchmark's seeds are broadcast in parts of about ``MOST_SEEDS``, counted beforehand; a
larger benchmark takes more passes over the documents. The alignments found are broadcast
up to a counted ``MOST_HITS``, beyond that they are joined by a shuffle.

Defined cases: null and empty texts overlap nothing; items of under ``shortest`` words (a
parameter; 1 searches all) are no evidence and are not searched; rows and items with equal ids are one document and one item, which overlap if any of
their texts do; a null id is an id of its own; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.common import settle, table, tidy

#: Positions that count: together these two meet every pair of substitutions in 13 places.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: The masks of the SQL, which meet 73 of the 78 pairs.
SQL_MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 5, 7), (0, 2, 3, 5, 6, 7), (0, 1, 3, 4, 6, 7))
#: Counted words of a piece, and ways of placing substitutions that are tried.
PIECE, MOST_WAYS = 4, 100_000
WINDOW, LEAST, SHORTEST = 13, 0.8, 5
#: Seeds (24 bytes each), and alignments (40 bytes each), in one broadcast table.
MOST_SEEDS, MOST_HITS = 400_000, 400_000


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+", " ")), " ")


def _hash(words: str, at: str, mask: tuple[int, ...], kind: int) -> str:
    return f"xxhash64({kind}, " + ", ".join(f"get({words}, {at} + {k})" for k in mask) + ")"


def accepted(n: int, least: float) -> int:
    """How many of n places may hold other words."""
    return n - next(m for m in range(n + 1) if m >= least * n)


def covers(masks: tuple[tuple[int, ...], ...], n: int, others: int) -> bool:
    """Does each way of placing ``others`` substitutions in n places leave a mask alone, somewhere?"""
    placed = [frozenset(x + at for x in m) for m in masks for at in range(n - m[-1])]
    return comb(n, others) <= MOST_WAYS and all(any(m.isdisjoint(way) for m in placed) for way in combinations(range(n), others))


def pieces(n: int, others: int) -> list[tuple[int, ...]]:
    """Sets of places of which ``others`` substitutions leave one alone: of others + t parts they touch all but t at most. t is the least that gives PIECE places."""
    t = next(t for t in range(1, n - others + 1) if t * (n // (others + t)) >= min(PIECE, n - others) or t == n - others)
    cut = [n * i // (others + t) for i in range(others + t + 1)]
    return [tuple(x for i in chosen for x in range(cut[i], cut[i + 1])) for chosen in combinations(range(others + t), t)]


def _variants(spans: list[int], masks: tuple[tuple[int, ...], ...], window: int, least: float, whole_below: int) -> list[tuple[int, tuple[int, ...], int, int]]:
    """(kind, mask, item length or 0 for all from the window on, place in the item or -1 for all)"""
    moved = lambda m: tuple(x - m[0] for x in m)
    others = accepted(window, least)
    every = [m for m in masks if m[-1] < window]
    if not covers(tuple(every), window, others):
        every += [moved(m) for m in pieces(window, others)]
    out = [(m, 0, -1) for m in dict.fromkeys(every)]
    for n in spans:
        out += [(moved(m), n, m[0]) for m in ([tuple(range(n))] if n < whole_below else pieces(n, accepted(n, least)))]
    kinds = {m: k for k, m in enumerate(dict.fromkeys(m for m, _, _ in out))}
    return [(kinds[m], m, n, at) for m, n, at in out]


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, least: float = LEAST, whole_below: int = 0, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, matched and compared (words of the best run) of each overlap. Items of under ``whole_below`` words are searched by all their words."""
    known = items.select("item_id", words_of(F.col("text")).alias("w")).where(f"size(w) >= {shortest} and w[0] != ''")
    short = sorted(r[0] for r in known.where(f"size(w) < {window}").select(F.size("w")).distinct().collect())  # up to the window: a few numbers
    variants = _variants(short, masks, window, least, whole_below)
    full = max(m[-1] for _, m, _, _ in variants) + 1
    of_item = ", ".join(
        f"if({f'size(w) = {n} and i = {at}' if n else f'size(w) >= {window} and i + {m[-1]} < size(w)'}, {_hash('w', 'i', m, kind)}, null)" for kind, m, n, at in variants
    )
    seeds = settle(known.selectExpr("item_id", "w", "posexplode(w) as (i, _w)").selectExpr("item_id", "i", f"explode(array({of_item})) as seed").where("seed is not null"), "seeds")
    n = seeds.count()
    parts = max(1, ceil(n / MOST_SEEDS))

    # Only places and hashes leave a document's row here, never its words: a row of them for each place would be quadratic.
    of_place = ", ".join(_hash("w", "p", m, kind) for kind, m in dict.fromkeys((kind, m) for kind, m, _, _ in variants))
    places = docs.select("doc_id", words_of(F.col("text")).alias("w")).selectExpr("doc_id", f"posexplode(transform(sequence(0, size(w) - 1), p -> array({of_place}))) as (p, seeds)")
    places = places.selectExpr("doc_id", "p", "explode(seeds) as seed")
    hits = reduce(DataFrame.unionByName, (places.join(F.broadcast(seeds.where(f"pmod(hash(seed), {parts}) = {k}") if parts > 1 else seeds), "seed") for k in range(parts)))
    found = settle(hits.selectExpr("doc_id", "item_id", "p - i as shift", f"i div {window} as stretch").distinct(), "hits")

    few = found.count() <= MOST_HITS
    ids = found.select(F.col("doc_id").alias("_id")).distinct()
    held = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(F.col("doc_id").alias("_id"), words_of(F.col("text")).alias("w"))
    aligned = held.join(F.broadcast(found) if few else found, F.col("_id").eqNullSafe(F.col("doc_id"))).join(known.select(F.col("item_id").alias("_item"), F.col("w").alias("t")), F.col("item_id").eqNullSafe(F.col("_item")))
    aligned = aligned.selectExpr(
        "doc_id", "item_id", "w", "t", "shift", f"least(size(t), {window}) as run", f"cast(greatest(0, (stretch - 1) * {window}) as int) as lo", f"cast(least(size(t), (stretch + 2) * {window} + {full}) as int) as hi"
    ).where("hi - lo >= run")
    parted = aligned.selectExpr("doc_id", "item_id", "run", "shift", "lo", "slice(t, lo + 1, hi - lo) as part", "slice(w, greatest(0, lo + shift) + 1, hi - lo) as here")
    # explode(array(..)) keeps the comparison out of the loop that sums its runs.
    same = "transform(part, (x, j) -> if(get(here, cast(j + least(0, lo + shift) as int)) = x, 1, 0))"
    runs = "transform(sequence(0, size(same) - run), s -> aggregate(slice(same, s + 1, run), 0, (a, x) -> a + x))"
    summed = parted.selectExpr("doc_id", "item_id", "run", f"explode(array({same})) as same").selectExpr("doc_id", "item_id", "run", f"explode(array(array_max({runs}))) as matched")
    return summed.where(f"matched >= {least}D * run").groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("run").cast("long").alias("compared"))


def drop_leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents whose own text overlaps no item, with all their columns. Rows are told apart by id and a hash of the text, so that others with the same id, or with none, stay."""
    row = F.concat(F.coalesce(F.concat(F.lit("="), docs["doc_id"].cast("string")), F.lit("")), F.lit(":"), F.xxhash64(docs["text"].cast("string")).cast("string"))
    with tidy(docs.sparkSession) as keep:
        leaks = keep(settle(overlaps(docs.select(row.alias("doc_id"), "text"), items, **how).select(F.col("doc_id").alias("_leak")).distinct(), "leaks"))
    return docs.join(leaks, row == leaks["_leak"], "left_anti")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole_below=max(m[-1] for m in SQL_MASKS) + 1)


def _oracle() -> str:
    full = max(m[-1] for m in SQL_MASKS) + 1
    words = r"string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
    key = lambda m: " || ' ' || ".join(f"coalesce(w[i + {k + 1}], '')" for k in m)
    keys = "[" + ", ".join(f"'{n}:' || {key(m)}" for n, m in enumerate(SQL_MASKS)) + "]"
    return f"""
with items as (select item_id, {words} as w from benchmark where len({words}) >= {SHORTEST}),
docs as (select row_number() over () as r, doc_id, {words} as w from documents),
seeds as (
    select item_id, i, unnest({keys}) as k from (select item_id, w, unnest(range(len(w)))::int as i from items) where i + {full - 1} < len(w)
    union all select item_id, 0, 'short:' || len(w) || array_to_string(w, ' ') from items where len(w) < {full}),
shorts as (select distinct len(w)::int as n from items where len(w) < {full}),
places as (
    select r, i as p, unnest({keys}) as k from (select r, w, unnest(range(len(w)))::int as i from docs)
    union all select r, i, 'short:' || n || array_to_string(w[i + 1 : i + n], ' ') from (select r, w, unnest(range(len(w)))::int as i from docs), shorts where i + n <= len(w)),
hits as (select distinct r, item_id, p - i as shift, i // {WINDOW} as stretch from places join seeds using (k)),
part as (
    select r, doc_id, item_id, least(len(t.w), {WINDOW})::int as run, d.w as dw, t.w as tw, shift,
           greatest(0, (stretch - 1) * {WINDOW})::int as lo, least(len(t.w), (stretch + 2) * {WINDOW} + {full})::int as hi
    from hits join docs d using (r) join items t using (item_id)),
same as (select doc_id, item_id, run, list_transform(range(lo, hi), lambda j: case when j + shift >= 0 and dw[j + shift + 1] = tw[j + 1] then 1 else 0 end) as f from part),
best as (select doc_id, item_id, run, list_max(list_transform(range(0, len(f) - run + 1), lambda s: list_sum(f[s + 1 : s + run]))) as matched from same)
select doc_id, item_id, max(matched)::bigint as matched, max(run)::bigint as compared from best where matched >= {LEAST} * run group by all
"""


ORACLE = _oracle()
