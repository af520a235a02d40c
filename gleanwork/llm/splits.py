"""Splits that keep related records together.

Records hang together by a shared source or picture, directly or by way of others. Components are
found by frontier breadth-first search: adjacency lists are hash-partitioned, many seeds grow at once,
where two seeds' territories touch their labels are merged in the much smaller graph of seeds.
Components then fill the splits in the order of their hashes.

Defined results: null sources and pictures tie nothing; a record with neither stands for itself with
all lines of its id (of its own number if the id is null); an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.operators.pictures import with_picture
from gleanwork.plans.lineage import cut, left_lookup, small_side

#: A seed graph of at most so many edges is merged in one task; a larger one goes through the search again.
SEED_EDGES = 200_000
#: An adjacency list is kept in parts of about so many neighbours.
LIST = 100_000
#: The wanted splits are a table of parameters; more are refused.
MAX_SPLITS = 1000


def _key(c: str) -> Column:
    return F.struct(F.xxhash64(c), F.col(c))


def _spread(edges: DataFrame, most: int = LIST) -> tuple[DataFrame, DataFrame | None]:
    """``edges`` with ``part``, and (a, parts) of the vertices whose adjacency list is longer than ``most``.

    A long list is cut by the hash of its other end into parts of about ``most``, each for itself in the hash
    partitioning; there are at most edges / ``most`` such vertices.
    """
    hubs = cut(edges.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > most).select("a", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    if hubs.isEmpty():
        return edges.withColumn("part", F.lit(0)), None
    hubs = small_side(hubs)
    part = F.coalesce(F.expr("cast(pmod(xxhash64(b), parts) as int)"), F.lit(0))
    return edges.join(hubs, "a", "left").select("a", "b", part.alias("part")), hubs


def _grow(edges: DataFrame) -> DataFrame:
    """(v, seed): every vertex of symmetric ``edges`` (a, b) labelled by the seed that reached it first.

    Seeds are the vertices whose hash is the least among their neighbours, about one in (degree + 1)
    and at least one per component. Each round only the last round's vertices send their labels on.
    """
    lists, hubs = _spread(edges)
    lists = cut(lists.repartition("a", "part"))
    least = lists.groupBy("a").agg(F.min(_key("b")).alias("near"))
    frontier = cut(least.where(_key("a") < F.col("near")).select(F.col("a").alias("v"), F.col("a").alias("seed")))
    reached = frontier
    while True:
        asking = frontier.withColumn("parts", F.lit(1)) if hubs is None else frontier.join(hubs.withColumnRenamed("a", "v"), "v", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        asking = asking.select(F.col("v").alias("a"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "seed")
        told = lists.join(asking, ["a", "part"]).groupBy("b").agg(F.min("seed").alias("seed")).withColumnRenamed("b", "v")
        frontier = cut(told.join(reached, "v", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = cut(reached.unionByName(frontier))


def _merge_in_one_task(edges: DataFrame) -> DataFrame:
    """(v, label) of a graph counted to be small: union-find in a single task, no driver involved."""

    def merge(batches):
        up: dict[str, str] = {}

        def top(x: str) -> str:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = sorted((top(a), top(b)))
                up[b] = a
        if up:
            yield pa.RecordBatch.from_pydict({"v": list(up), "label": [top(x) for x in up]})

    return edges.coalesce(1).mapInArrow(merge, "v string, label string")


def components(links: DataFrame, seed_edges: int = SEED_EDGES) -> DataFrame:
    """(v, label) for every vertex of the string pairs (a, b): equal labels if and only if connected.

    The label is the least vertex of the component, whatever way the search took. Loops, repeats and either direction
    of a link make no difference. Each level of search leaves a graph of at most half the vertices, so
    that levels are at most logarithmic.
    """
    pair = links.where("a <> b and a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = _connected(pair, seed_edges)
    least = found.groupBy("label").agg(F.min("v").alias("least"))
    return cut(found.join(least, "label").select("v", F.col("least").alias("label")))


def _connected(pair: DataFrame, seed_edges: int) -> DataFrame:
    """(v, label) with any vertex of the component as label; ``pair`` has each link once, a < b."""
    edges = cut(pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    reached = _grow(edges)
    tell = lambda v, name: reached.select(F.col("v").alias(v), F.col("seed").alias(name))
    touching = cut(edges.where("a < b").join(tell("a", "x"), "a").join(tell("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    few = touching.limit(seed_edges + 1).count()
    if not few:
        return reached.withColumnRenamed("seed", "label")
    merged = (_merge_in_one_task(touching) if few <= seed_edges else _connected(touching, seed_edges)).withColumnRenamed("v", "seed")
    return reached.join(merged, "seed", "left").select("v", F.coalesce("label", "seed").alias("label"))


def _ties(train: DataFrame, alias: DataFrame) -> DataFrame:
    """Distinct (source, picture) of rows that have both."""
    return with_picture(train.select("source", "image_id"), alias).where("source is not null and picture is not null").select("source", "picture").distinct()


def _source_links(ties: DataFrame) -> DataFrame:
    """Sources of one picture, each tied to the least of them: a star instead of all pairs."""
    least = ties.groupBy("picture").agg(F.min("source").alias("a"), F.max("source").alias("z")).where("a <> z").select("picture", "a")
    return ties.join(least, "picture").where("source <> a").select("a", F.col("source").alias("b")).distinct()


def source_components(train: DataFrame, alias: DataFrame, seed_edges: int = SEED_EDGES) -> DataFrame:
    """(v, label) of the clean sources that are tied to another one."""
    return components(_source_links(cut(_ties(train, alias))), seed_edges)


def tied_sources(train: DataFrame, alias: DataFrame, block: int = 1000, seed_edges: int = SEED_EDGES) -> DataFrame:
    """(source_a, source_b): all pairs of different sources of one component, smaller text first.

    A component is cut into blocks of about ``block`` sources and paired block against block, so that
    a component that holds most sources is spread over many tasks.
    """
    c = source_components(train, alias, seed_edges)
    size = c.groupBy("label").agg(F.count("*").alias("n"))
    c = c.join(size, "label").withColumn("nb", F.ceil(F.col("n") / block).cast("int")).withColumn("k", F.expr("cast(pmod(xxhash64(v), nb) as int)"))
    left = c.select("label", F.col("v").alias("l"), F.col("k").alias("x"), F.explode(F.expr("sequence(k, nb - 1)")).alias("y"))
    right = c.select("label", F.col("v").alias("r"), F.col("k").alias("y"), F.explode(F.expr("sequence(0, k)")).alias("x"))
    pairs = left.join(right, ["label", "x", "y"]).where("x < y or l < r")
    return pairs.select(F.least("l", "r").alias("source_a"), F.greatest("l", "r").alias("source_b"))


BUCKETS = 4096


def _cuts(totals: dict[int, dict[int, int]], wanted: list[tuple[str, float]]) -> dict[int, list[int]]:
    """Per size class the first hash bucket after each split's stretch.

    Size classes (powers of two) are placed from the largest down. In each the buckets are handed out in
    hash order, to every split in proportion to the room that it still has, so that what a large component
    took too much is made good by the many smaller ones.
    """
    room = {name: share * sum(sum(t.values()) for t in totals.values()) for name, share in wanted}
    cuts = {}
    for size in sorted(totals, reverse=True):
        left = {name: max(r, 0.0) for name, r in room.items()}
        whole = sum(left.values())
        if not whole:
            left, whole = dict(wanted), 1.0
        n, ends, at = sum(totals[size].values()), [], 0.0
        for r in left.values():
            at += r / whole * n
            ends.append(at)
        cuts[size], split, before, names = [0] * len(wanted), 0, 0, list(left)
        for b in sorted(totals[size]):
            while split < len(ends) - 1 and before + totals[size][b] / 2 > ends[split]:
                split += 1
                cuts[size][split - 1] = b
            room[names[split]] -= totals[size][b]
            before += totals[size][b]
        for k in range(split, len(wanted)):
            cuts[size][k] = BUCKETS
    return cuts


def record_splits(train: DataFrame, alias: DataFrame, targets: DataFrame, seed_edges: int = SEED_EDGES) -> DataFrame:
    """(rec_no, component, split) for every row of ``train``.

    Components are classed by size (powers of two) and, in each class, split by the order of their hashes, cut at
    4,096 hash buckets: a component's split follows from its size and hash alone. Nothing but the rows per
    class and bucket reaches the driver, see :func:`_cuts`.
    """
    rows = with_picture(train.select("rec_no", "id", "source", "image_id"), alias)
    ties = cut(rows.where("source is not null and picture is not null").select("source", "picture").distinct())
    label = components(_source_links(ties), seed_edges).select(F.col("v").alias("source"), "label")
    lone = rows.where("source is null and picture is not null").select("picture").distinct()
    held = cut(ties.join(lone, "picture", "left_semi").groupBy("picture").agg(F.min("source").alias("by")))
    rows = rows.select("rec_no", "id", "source", F.when(F.col("source").isNull(), F.col("picture")).alias("picture"))
    rows = left_lookup(left_lookup(rows, held, "picture").withColumn("source", F.coalesce("source", "by")), label, "source")
    alone = F.coalesce(F.concat(F.lit("picture "), "picture"), F.concat(F.lit("id "), "id"), F.concat(F.lit("row "), F.col("rec_no").cast("string")))
    rows = cut(rows.select("rec_no", F.coalesce("label", "source", alone).alias("component")))

    bucket = F.shiftrightunsigned(F.xxhash64("component"), 52).cast("int")
    sizes = cut(rows.groupBy("component").agg(F.count("*").alias("n")).select("component", "n", F.floor(F.log2("n") + 1e-9).cast("int").alias("size"), bucket.alias("bucket")))
    given = targets.select("split", "share").where("share > 0").orderBy(F.desc("share"), "split").limit(MAX_SPLITS + 1).collect()
    if not 0 < len(given) <= MAX_SPLITS:
        raise ValueError(f"no split has a share, or more than {MAX_SPLITS} have")
    whole = sum(float(r.share) for r in given)
    wanted = [(r.split, float(r.share) / whole) for r in given]
    totals: dict[int, dict[int, int]] = {}
    for r in sizes.groupBy("size", "bucket").agg(F.sum("n").alias("n")).collect():  # at most 64 x BUCKETS rows
        totals.setdefault(r.size, {})[r.bucket] = r.n
    cuts = train.sparkSession.createDataFrame(list(_cuts(totals, wanted).items()), "size int, cuts array<int>")
    name = F.element_at(F.array(*(F.lit(n) for n, _ in wanted)), F.size(F.filter("cuts", lambda x: x <= F.col("bucket"))) + 1)
    chosen = cut(sizes.join(F.broadcast(cuts), "size").select("component", name.alias("split")))  # a row per power of two
    return rows.join(small_side(chosen), "component").select("rec_no", "component", "split")


def split_report(splits: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, wanted_share, n_rows, n_components, reached_share) for every wanted split."""
    got = splits.groupBy("split", "component").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_components"))
    out = targets.select("split", F.col("share").alias("wanted_share")).join(got, "split", "left").fillna(0, ["n_rows", "n_components"])
    return out.withColumn("reached_share", F.try_divide(F.col("n_rows").cast("double"), F.sum("n_rows").over(Window.partitionBy(F.lit(1)))))  # as many rows as splits
