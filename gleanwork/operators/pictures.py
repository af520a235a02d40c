"""One name for one picture and one spelling for one source.

A picture's name is ``collection:number``. Letter case, zeros in front, spaces, separators, a path, a
file ending and the mark of a mirrored copy make no difference; digits alone belong to the collection
of the row's own source; aliases are followed to their end. Null, empty values, placeholders, digits
alone without a source, aliases whose end is null and aliases that run in a circle name no picture:
the result is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.plans.lineage import cut, left_lookup, settle

# Words of a path or an ending that name no collection.
_ENDINGS = "jpg|jpeg|png|gif|webp|bmp|tif|tiff"
_MIRROR = "flip|flipped|mirror|mirrored"
_FOLDERS = "images|image|imgs|img|pictures|photos"


def clean_source(c: str | Column) -> Column:
    """``collection/batch`` in lower case; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.lower(c), r"^[^a-z0-9]+|[^a-z0-9]+$", "")
    s = F.regexp_replace(s, r"[^a-z0-9]+", "/")
    return F.when(s != "", s)


def collection_of(source: Column) -> Column:
    """The first part of a clean source."""
    return F.substring_index(source, "/", 1)


def picture_name(image_id: str | Column, source: Column | None = None) -> Column:
    """``collection:number`` as written, aliases not followed; null where no picture is named."""
    c = F.col(image_id) if isinstance(image_id, str) else image_id
    s = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    s = F.regexp_replace(s, rf"( ({_ENDINGS}|{_MIRROR}))+$", "")
    s = F.regexp_replace(s, rf"(?<= |^)({_FOLDERS}) ", "")
    number = F.regexp_extract(s, r"(?:^|[a-z ])0*([0-9]+)$", 1)
    name = F.regexp_extract(s, r"([a-z]+) ?[0-9]+$", 1)
    own = F.lit(None).cast("string") if source is None else collection_of(source)
    return F.when(number == "", None).when(name != "", F.concat(name, F.lit(":"), number)).when(s.rlike("^[0-9]+$"), F.concat(own, F.lit(":"), number))


def alias_ends(alias: DataFrame) -> DataFrame:
    """(alias, end) with each alias once, followed by pointer doubling; ``end`` is null where it names no picture.

    Of an alias with several targets the latest counts, of equal times the greater name. Rounds are
    the logarithm of the longest chain; what still moves after as many as the table allows runs in a circle.
    """
    ends = (
        alias.select(picture_name("alias_id").alias("alias"), picture_name("image_id").alias("end"), F.col("added_at").alias("at"))
        .where("alias is not null")
        .groupBy("alias")
        .agg(F.max_by("end", F.struct("at", F.coalesce("end", F.lit("")))).alias("end"))
    )
    ends = settle(ends)
    for _ in range(ends.count().bit_length() + 1):
        onward = ends.select(F.col("alias").alias("end"), F.col("end").alias("onward"), F.lit(True).alias("more"))
        step = settle(ends.join(onward, "end", "left").select("alias", F.when(F.col("more"), F.col("onward")).otherwise(F.col("end")).alias("end"), "more"))
        ends = step.select("alias", "end")
        if step.where("more").isEmpty():
            return ends
    live = ends.select(F.col("alias").alias("end"), F.lit(True).alias("circle"))
    return cut(ends.join(live, "end", "left").select("alias", F.when(F.col("circle"), None).otherwise(F.col("end")).alias("end")))


def with_picture(df: DataFrame, alias: DataFrame | None, out: str = "picture") -> DataFrame:
    """``df`` with clean ``source`` and the picture of ``image_id`` in column ``out``."""
    df = df.withColumn("source", clean_source("source"))
    df = df.withColumn(out, picture_name("image_id", F.col("source")))
    if alias is None:
        return df
    ends = alias_ends(alias).select(F.col("alias").alias(out), F.col("end").alias("_end"), F.lit(True).alias("_known"))
    return left_lookup(df, ends, out).withColumn(out, F.when(F.col("_known"), F.col("_end")).otherwise(F.col(out))).drop("_end", "_known")
