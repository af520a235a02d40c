"""Same and nearly same things: hash bits, Hamming joins, priority matches, roles, aliases, co-occurrence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sign_bits(vector: str | Column) -> Column:
    """The signs of up to 64 numbers as the bits of a bigint, the first number lowest."""
    c = F.col(vector) if isinstance(vector, str) else vector
    return F.aggregate(F.transform(F.slice(c, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def band(bits: Column, i: int, n: int) -> Column:
    """The i-th of ``n`` bands of 64 bits."""
    at, width = 64 * i // n, 64 * (i + 1) // n - 64 * i // n
    return F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("bigint"))


def hamming_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, bits: str, radius: int) -> DataFrame:
    """(a_id, b_id, distance) of all pairs within ``radius`` bits.

    Of ``radius + 1`` bands two hashes within the radius agree on at least one, so an equi-join on
    (band number, band) finds every pair; a pair is kept where its first equal band meets, so that no
    distinct is needed. Rows of equal bits are joined as one: only distinct hashes are paired.
    """
    n = radius + 1
    bands = lambda d, c: d.select(F.col(bits).alias(c)).where(F.col(bits).isNotNull()).distinct().withColumn("_b", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), band(F.col(c), i, n).alias("v")) for i in range(n))))).select(c, "_b.i", "_b.v")
    x = F.col("_x").bitwiseXOR(F.col("_y"))
    earlier = lambda i: reduce(lambda p, q: p | q, (band(x, k, n) == 0 for k in range(i)), F.lit(False))
    first = reduce(lambda c, i: c.when(F.col("i") == i, ~earlier(i)), range(1, n), F.when(F.col("i") == 0, F.lit(True)))
    near = bands(a, "_x").join(bands(b, "_y"), ["i", "v"]).withColumn("distance", F.bit_count(x).cast("int")).where((F.col("distance") <= radius) & first).select("_x", "_y", "distance")
    j = near.join(a.select(F.col(a_id), F.col(bits).alias("_x")), "_x")
    return j.join(b.select(F.col(b_id), F.col(bits).alias("_y")), "_y").select(a_id, b_id, "distance")


def first_match(df: DataFrame, index: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with the ``name`` of the index row it meets by the first of ``keys`` that matches, and that key's place.
    Later keys are only looked up for what is left."""
    rest, found = df, []
    for i, k in enumerate(keys):
        look = index.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(name).alias("match"))
        j = rest.join(look, k, "left")
        found.append(j.where("match is not null").withColumn("matched_by", F.lit(i)).select(*df.columns, "match", "matched_by"))
        rest = j.where("match is null").select(*df.columns)
    return reduce(DataFrame.unionByName, found, rest.withColumns({"match": F.lit(None).cast("string"), "matched_by": F.lit(None).cast("int")}))


def joint_hits(a: DataFrame, b: DataFrame, a_id: str, b_id: str, first: str, second: str, radius: int, other: int) -> DataFrame:
    """(a_id, b_id, d_first, d_second) of rows within ``radius`` bits by the first hash and ``other`` by the second.

    Candidates come from the first hash's bands; the second is compared for those only.
    """
    near = hamming_pairs(a, b, a_id, b_id, first, radius).withColumnRenamed("distance", "d_first")
    j = near.join(a.select(a_id, F.col(second).alias("_x")), a_id).join(b.select(b_id, F.col(second).alias("_y")), b_id)
    return j.withColumn("d_second", F.bit_count(F.col("_x").bitwiseXOR(F.col("_y"))).cast("int")).where(F.col("d_second") <= other).select(a_id, b_id, "d_first", "d_second")


def nearest(a: DataFrame, b: DataFrame, a_id: str, b_id: str, bits: str, radius: int, mirror: str | None = None) -> DataFrame:
    """(a_id, b_id, distance): the nearest row of ``b`` within ``radius`` bits, by its own or its ``mirror`` hash; of equals the least id.
    Rows with none within the radius are there with nulls. Rows of the same id are not compared."""
    found = hamming_pairs(a, b, a_id, b_id, bits, radius)
    if mirror:
        found = found.unionByName(hamming_pairs(a.select(a_id, F.col(bits)), b.select(b_id, F.col(mirror).alias(bits)), a_id, b_id, bits, radius))
    best = found.where(F.col(a_id) != F.col(b_id)).groupBy(a_id).agg(F.min(F.struct("distance", b_id)).alias("x"))
    return a.select(a_id).distinct().join(best, a_id, "left").select(a_id, F.col(f"x.{b_id}").alias(b_id), "x.distance")


def outside(points: DataFrame, intervals: DataFrame, key: str, point: str, at: str, start: str, stop: str, bin_size: int) -> DataFrame:
    """Points (named by ``point``) that no interval of their key covers."""
    hit = covering(points.select(key, point, at), intervals.select(key, start, stop), key, at, start, stop, bin_size)
    return points.join(hit.select(point).distinct(), point, "left_anti")


def covered_by_one(points: DataFrame, intervals: DataFrame, key: str, point: str, at: str, start: str, stop: str, label: str, bin_size: int) -> DataFrame:
    """(point, label) of points whose covering intervals all have one label; the others are ambiguous and left out."""
    hit = covering(points.select(key, point, at), intervals.select(key, start, stop, label), key, at, start, stop, bin_size)
    return hit.groupBy(point).agg(F.min(label).alias(label), F.max(label).alias("_z")).where(F.col(label) == F.col("_z")).drop("_z")


def without_broken_groups(df: DataFrame, group: str, held: Column) -> DataFrame:
    """Rows of groups none of whose rows is held; rows without group stand alone."""
    bad = df.where(F.col(group).isNotNull() & held).select(group).distinct()
    return df.join(bad, group, "left_anti").where(F.col(group).isNotNull() | ~F.coalesce(held, F.lit(False)))


def roles(sets: DataFrame, fit: DataFrame, watched: DataFrame, ident: str, picture: str) -> DataFrame:
    """(set_name, n, in_fit, in_watched, role): rows that share an id or a picture with the fitted and the
    watched rows; null and empty pictures are shared with none."""
    real = lambda d, c: d.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").select(F.col(c)).distinct()
    d = sets
    for name, other in (("fit", fit), ("watched", watched)):
        for c in (ident, picture):
            d = d.join(real(other, c).withColumn(f"_{name}_{c}", F.lit(True)), c, "left")
    hit = lambda name: F.coalesce(F.col(f"_{name}_{ident}"), F.col(f"_{name}_{picture}"), F.lit(False))
    g = d.groupBy("set_name").agg(F.count("*").alias("n"), F.count_if(hit("fit")).alias("in_fit"), F.count_if(hit("watched")).alias("in_watched"))
    return g.withColumn("role", F.when(F.col("in_fit") > 0, "seen").when(F.col("in_watched") > 0, "watched").otherwise("test"))


def intersections(sets: DataFrame, name: str, item: str) -> DataFrame:
    """(a, b, n) of the sets, a < b, that share items: counted from each item's own few sets, not from all pairs of sets."""
    d = sets.where(F.col(item).isNotNull()).select(name, item).distinct()
    a, b = d.select(F.col(name).alias("a"), item), d.select(F.col(name).alias("b"), item)
    return a.join(b, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def cooccurrence(df: DataFrame, picture: str, thing: str, least: int = 1) -> DataFrame:
    """(a, b, n): in how many pictures two things occur together, a < b."""
    d = df.where(F.col(picture).isNotNull() & F.col(thing).isNotNull()).select(picture, thing).distinct()
    pairs = d.select(picture, F.col(thing).alias("a")).join(d.select(picture, F.col(thing).alias("b")), picture).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without_contradictions(edges: DataFrame, opposite: dict[str, str]) -> DataFrame:
    """Edges (a, relation, b) whose opposite relation and whose reversal are not stated of the same two."""
    flip = F.col("relation")
    for x, y in opposite.items():
        flip = F.when(F.col("relation") == x, y).otherwise(flip)
    e = edges.distinct()
    same = e.select("a", flip.alias("relation"), "b").where(F.col("relation").isin(*opposite))
    back = e.select(F.col("b").alias("a"), "relation", F.col("a").alias("b"))
    return e.join(same, ["a", "relation", "b"], "left_anti").join(back, ["a", "relation", "b"], "left_anti")


def covering(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, stop: str, bin_size: int) -> DataFrame:
    """Points with the intervals of their key that cover them (``start <= at <= stop``).

    Both sides are cut into bins of ``bin_size``, an interval standing in each bin it touches, so that the
    join is an equi-join on (key, bin) and a long key is spread over its bins.
    """
    p = points.withColumn("_bin", F.floor(F.col(at) / bin_size))
    i = intervals.where(F.col(start) <= F.col(stop)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(stop) / bin_size))))
    return p.join(i, [key, "_bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(stop))).drop("_bin")


def merged_ranges(df: DataFrame, key: str, start: str, stop: str, gap: int, span: int | None = None, bin_size: int = 86_400) -> DataFrame:
    """(key, start, stop, members): neighbours at most ``gap`` apart read as one range; with ``span`` a
    range is cut where it would grow beyond it, at multiples of ``span`` from its first start.

    Rows are ordered inside bins of ``bin_size`` of a key; what earlier bins hand on, their greatest stop and how many ranges
    they began, is taken over the bins, so that a long key is spread over its bins.
    """
    d = df.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).withColumn("_bin", F.floor(F.col(start) / bin_size))
    bins = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda x: F.col(f"d.{key}").eqNullSafe(F.col(f"{x}.{key}")) & (F.col("d._bin") == F.col(f"{x}._bin"))
    reach = d.groupBy(key, "_bin").agg(F.max(stop).alias("_m")).withColumn("_carry", F.max("_m").over(bins)).select(key, "_bin", "_carry")
    d = d.alias("d").join(reach.alias("r"), same("r"), "left").select("d.*", "_carry")
    w = Window.partitionBy(key, "_bin").orderBy(start, stop)
    before = F.greatest(F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    d = d.withColumn("_new", F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0))
    begun = d.groupBy(key, "_bin").agg(F.sum("_new").alias("_m")).withColumn("_base", F.coalesce(F.sum("_m").over(bins), F.lit(0))).select(key, "_bin", "_base")
    d = d.alias("d").join(begun.alias("r"), same("r"), "left").select("d.*", "_base").withColumn("_g", F.col("_base") + F.sum("_new").over(w))
    by = [key, "_g"]
    if span is not None:
        first = d.groupBy(*by).agg(F.min(start).alias("_first"))
        d = d.alias("d").join(first.alias("r"), F.col(f"d.{key}").eqNullSafe(F.col(f"r.{key}")) & (F.col("d._g") == F.col("r._g"))).select("d.*", "_first").withColumn("_c", F.floor((F.col(start) - F.col("_first")) / span))
        by.append("_c")
    return d.groupBy(*by).agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("members")).drop("_g", "_c")


def nearest_before(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, bin_of: Column | None = None) -> DataFrame:
    """As-of: each left row with the ``value`` of the last right row of its key at or before it; a union and
    one window, so that no left row meets more than its own key's rows once.

    With ``bin_of``, a whole number that never falls as ``at`` grows (a day, say), the window is one bin of a key, and
    the last value before a bin is handed on over the bins: a long key is many tasks.
    """
    both = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_s": F.lit(1)}).unionByName(right.select(*by, at, F.col(value).alias("_v"), F.lit(0).alias("_s")), allowMissingColumns=True)
    both = both.withColumn("_bin", F.lit(0) if bin_of is None else bin_of)
    w = Window.partitionBy(*by, "_bin").orderBy(at, "_s").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last("_v", ignorenulls=True).over(w)
    if bin_of is None:
        return both.withColumn(f"{value}_before", own).where("_s = 1").drop("_v", "_s", "_bin")
    last = both.groupBy(*by, "_bin").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(at, "_s"))).alias("_l"))
    last = last.withColumn("_carry", F.last("_l", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))).select(*by, "_bin", "_carry")
    met = reduce(lambda p, q: p & q, (F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_bin")))
    d = both.withColumn("_own", own).where("_s = 1").alias("d").join(last.alias("r"), met, "left").select("d.*", "_carry")
    return d.withColumn(f"{value}_before", F.coalesce("_own", "_carry")).drop("_v", "_s", "_bin", "_own", "_carry")
