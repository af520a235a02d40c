"""Scans and sinks of decision data."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SAMPLE = "id string, source string, kind string, axis string, image_id string, image string, state_text string, type string, instructions string, criteria string, questions string, gold array<struct<key:string,p:double>>"
RECORD = "run_id string, sample_id string, qid string, image_id string, source string, kind string, axis string, type string, options array<string>, gold array<struct<key:string,p:double>>, gold_answer string, probabilities array<struct<key:string,p:double>>, prediction string, p_prediction double, control string, correct boolean, latency_ms double"


def filesystem(path: str):
    """(file system, path in it) of a local path or of an address such as ``hdfs://`` or ``s3://``."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, broken: str = "FAILFAST") -> DataFrame:
    """JSON lines with a fixed schema (no pass for inference); blank lines are skipped, gzip is read as it is.
    ``broken``: ``FAILFAST`` raises at a bad line, ``PERMISSIVE`` keeps it in ``_corrupt_record``."""
    if broken == "PERMISSIVE":
        schema += ", _corrupt_record string"
    return spark.read.schema(schema).option("mode", broken).json(path)


def bad_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file, line, text) of the lines of JSON files that do not fit ``schema``: where to look, line numbers from 1.

    Lines are numbered inside each file by its own splits' order, which plain text scans keep; blank lines count but are never bad.
    """
    d = spark.read.option("wholetext", False).text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), "_metadata.file_block_start", F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    d = d.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("file_block_start", "_id")))
    parsed = F.from_json("text", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return d.where((F.trim("text") != "") & parsed["_bad"].isNotNull()).select("file", "line", "text")


def matching(spark: SparkSession, path: str, pattern: str, kind: str = "parquet") -> DataFrame:
    """The files of a folder, at any depth, whose names match, as one table."""
    return spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def only_ids(df: DataFrame, ids: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Some columns of the rows whose id is wanted; the scan reads those columns only and the ids filter it at run time."""
    return df.select(*dict.fromkeys([on, *columns])).join(ids.select(on).distinct(), on, "left_semi").select(*columns)


def answered_questions(questions: DataFrame, answers: DataFrame, on: str = "question_id") -> DataFrame:
    """Questions with their annotations; an id that is there twice on a side gives every combination, as a join does."""
    extra = [c for c in answers.columns if c not in questions.columns]
    return questions.join(answers.select(on, *extra), on)


def instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, boxes) of instance files (``images``, ``annotations``, ``categories`` in one JSON): (image_id, width, height) and
    (image_id, name, x, y, w, h, area) of all annotations that are not of a crowd."""
    schema = "images array<struct<id:bigint,width:int,height:int>>, annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int>>, categories array<struct<id:bigint,name:string>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    names = d.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("name")).distinct()
    a = d.select(F.explode("annotations").alias("a")).select("a.*").where(F.coalesce("iscrowd", F.lit(0)) == 0)
    boxes = a.join(names, "category_id").select("image_id", "name", *(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")), "area")
    return d.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.width", "i.height"), boxes


def cells(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(file, row, col, value) of delimited files as a matrix of trimmed cells, from 0; quotes keep separators together."""
    d = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("row", "line")).where("line <> ''")
    outside = rf'{re.escape(separator)}(?=(?:[^"]*"[^"]*")*[^"]*$)'
    c = d.select("file", "row", F.posexplode(F.split("line", outside)).alias("col", "v"))
    return c.select("file", "row", "col", F.replace(F.regexp_replace(F.trim("v"), '^"|"$', ""), F.lit('""'), F.lit('"')).alias("value"))


def segments(spark: SparkSession, path: str, schema: str, video: str, start: str) -> DataFrame:
    """(video, n, segments): the segments of a CSV by video, in the order of their starts; a video's own segments."""
    d = spark.read.schema(schema).option("header", True).csv(path).where(F.col(video).isNotNull())
    rest = [c for c in d.columns if c != video]
    return d.groupBy(video).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(start, *(c for c in rest if c != start)))).alias("segments"))


def write_jsonl(df: DataFrame, path: str, split: str | None = None) -> None:
    """JSON lines, one folder per value of ``split``; the committer makes the result appear whole or not at all."""
    w = df.write.mode("error")
    (w.partitionBy(split) if split else w).json(path)


def with_row_key(df: DataFrame, out: str = "row_key") -> DataFrame:
    """A parquet scan's rows with ``file/row``, stable however the scan is split."""
    return df.withColumn(out, F.concat_ws("/", F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1), F.col("_metadata.row_index").cast("string")))


def read_list_csv(spark: SparkSession, path: str, schema: str, lists: list[str]) -> DataFrame:
    """CSV whose ``lists`` columns hold lists written in brackets, as arrays of text."""
    d = spark.read.schema(schema).option("header", True).csv(path)
    item = lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")
    return d.withColumns({c: F.filter(F.transform(F.split(F.regexp_replace(c, r"^\s*\[|\]\s*$", ""), ","), item), lambda x: x != "") for c in lists})


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files under ``path``."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return d.select("path", "length", F.sha2("content", 256).alias("sha256"))


def check_hashes(found: DataFrame, listed: DataFrame) -> DataFrame:
    """(name, problem): files of a manifest (name, sha256) that are missing or differ, and files it does not list."""
    f = found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("sha256").alias("_f"))
    j = f.join(listed, "name", "full_outer")
    return j.select("name", F.when(F.col("_f").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("_f") != F.col("sha256"), "differs").alias("problem")).where("problem is not null")


def renames(paths: DataFrame, pattern: str, to: str) -> DataFrame:
    """(path, target, clashes): targets of a renaming rule and how many other paths have the same one."""
    t = paths.select("path", F.regexp_replace("path", pattern, to).alias("target"))
    n = t.groupBy("target").agg((F.count("*") - 1).alias("clashes"))
    return t.join(n, "target").select("path", "target", "clashes")


def binary_argument(given: Column) -> Column:
    """A picture given as a data URI or as base64 text, as binary; null if it is neither."""
    body = F.when(given.startswith("data:"), F.regexp_extract(given, r"(?s)^data:[^,]*;base64,(.*)$", 1)).otherwise(given)
    clean = F.regexp_replace(body, r"\s", "")
    return F.when((clean != "") & clean.rlike(r"^[A-Za-z0-9+/]+=*$") & (F.length(clean) % 4 == 0), F.unbase64(clean))


def html_elements(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, tag, node_id, label, in_menu) of the elements of pages that carry an ``id``.

    A streaming parse per page inside Arrow batches; broken mark-up gives what could be read.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, pos int, tag string, node_id string, label string, in_menu boolean"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                for row in _elements(page or ""):
                    at.append(i)
                    rows.append(row)
            if rows:
                types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *cols], [key, "pos", "tag", "node_id", "label", "in_menu"])

    return df.select(key, F.col(html).cast("string")).mapInArrow(parse, schema)


def _elements(page: str) -> list[tuple]:
    from html.parser import HTMLParser

    out: list[list] = []
    open_: list[tuple[str, list | None, bool]] = []

    class Parser(HTMLParser):
        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            menu = tag in ("nav", "menu") or a.get("role") in ("menu", "dialog", "listbox") or bool(open_ and open_[-1][2])
            row = None
            if a.get("id"):
                row = [len(out), tag, a["id"], a.get("aria-label") or a.get("alt") or a.get("title") or "", menu]
                out.append(row)
            if tag not in ("br", "img", "input", "hr", "meta", "link"):
                open_.append((tag, row, menu))

        def handle_endtag(self, tag):
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    del open_[i:]
                    break

        def handle_data(self, data):
            row = next((r for _, r, _ in reversed(open_) if r is not None), None)
            if row is not None and data.strip():
                row[3] = f"{row[3]} {data.strip()}".strip()

    p = Parser()
    p.feed(page)
    p.close()
    return [tuple(r) for r in out]


class ZipMembers(DataSource):
    """Python data source ``zip_members``: the members of zip archives, one partition per range of members.

    Options: ``path`` (several parted by ``,``), ``pattern`` (a glob of names), ``perPartition``. The
    directory of each archive is read once when the scan is planned; a partition seeks to its members.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, name string, length bigint, content binary"

    def reader(self, schema):
        return _ZipReader(self.options)


class _Range(InputPartition):
    def __init__(self, path: str, members: list[tuple[str, int, int, int, int]]):
        self.path, self.members = path, members


class _ZipReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.pattern = options.get("pattern", "*")
        self.per = int(options.get("perPartition", "256"))

    def partitions(self) -> list[InputPartition]:
        import fnmatch
        import zipfile

        out: list[InputPartition] = []
        for p in self.paths:
            at, inner = filesystem(p)
            with at.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                m = [(i.filename, i.header_offset, i.compress_size, i.compress_type, i.file_size) for i in z.infolist() if not i.is_dir() and fnmatch.fnmatch(i.filename, self.pattern)]
            m.sort(key=lambda x: x[1])
            out += [_Range(p, m[k : k + self.per]) for k in range(0, len(m), self.per)]
        return out

    def read(self, part):
        where, inner = filesystem(part.path)
        with where.open_input_file(inner) as f:
            for name, at, packed, how, size in part.members:
                f.seek(at + 26)
                n, extra = struct.unpack("<HH", f.read(4))
                f.seek(at + 30 + n + extra)
                data = f.read(packed)
                yield part.path, name, size, zlib.decompress(data, -15) if how == 8 else data


def stable_id(*parts: object) -> str:
    """A short id from parts, the same everywhere."""
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]
