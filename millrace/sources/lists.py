"""Sources: lists of addresses (JSON, CSV, TXT), progress logs, payload snapshots, keyword maps, optional JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from millrace.functions.text import distinct_ignoring_case, first_set, split_list

#: Keys under which a list holds an address, the first that is there counts.
URL_KEYS = ("url", "URL", "link", "href", "website")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): addresses of a list by its ending; only those that begin with http."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "json":
        out = _from_json(spark, path)
    elif ending == "csv":
        out = _from_csv(spark, path)
    elif ending == "txt":
        out = spark.read.text(path).select(F.trim("value").alias("url"))
    else:
        raise ValueError(f"a list of addresses is .json, .csv or .txt, not .{ending}")
    return out.where(F.col("url").startswith("http"))


def _from_json(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    texts = F.from_json("value", ArrayType(StringType()))
    inner = F.coalesce(F.get_json_object("value", "$.urls"), F.get_json_object("value", "$.URLs"))
    items = F.coalesce(texts, F.from_json(inner, ArrayType(StringType())))
    item = F.col("item")
    record = F.from_json(item, MapType(StringType(), StringType()))
    found = F.coalesce(*[record[k] for k in URL_KEYS])
    return whole.select(F.explode(items).alias("item")).select(F.trim(F.when(item.startswith("{"), found).otherwise(item)).alias("url"))


def _from_csv(spark: SparkSession, path: str) -> DataFrame:
    head = spark.read.text(path).limit(1).collect()
    # A heading is a whole cell; an address that merely contains one of the words is no heading.
    titled = bool(head) and any(c.strip().strip('"') in URL_KEYS for c in head[0][0].split(","))
    df = spark.read.option("header", titled).csv(path)
    here = [F.col(f"`{c}`") for k in URL_KEYS for c in df.columns if c == k]
    return df.select(F.trim(F.coalesce(*here) if here else F.col(df.columns[0])).alias("url"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Records (map<string,string>) of a log whose lines are arrays of records; broken lines are skipped."""
    lines = spark.read.text(path)
    return lines.select(F.explode(F.from_json("value", ArrayType(MapType(StringType(), StringType())))).alias("record"))


EMPLOYEE = StructType([StructField(n, StringType()) for n in ("firstName", "lastName", "linkedinUrl", "headline", "about", "topSkills", "photo")] + [
    StructField("location", StringType()),
    StructField("experience", ArrayType(StructType([StructField("position", StringType()), StructField("companyName", StringType()), StructField("duration", StringType()), StructField("location", StringType()), StructField("skills", ArrayType(StringType()))]))),
])


def read_employees(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot of an employee payload (JSON lines) with an explicit schema; a place may be a text or an object."""
    df = spark.read.schema(EMPLOYEE).json(path)
    return df.withColumn("location", _place())


def _place() -> Column:
    """A place that may be a text or an object."""
    return F.coalesce(F.get_json_object("location", "$.linkedinText"), F.get_json_object("location", "$.parsed.text"), F.get_json_object("location", "$.full"), F.when(~F.col("location").startswith("{"), F.col("location")))


PROFILE = "linkedinUrl string, url string, originalQuery struct<query: string>, headline string, about string, location string, photo string, profilePicture string, topSkills string, skills array<string>, experience array<struct<position: string, companyName: string, duration: string, location: string, skills: array<string>>>"


def read_profile_payload(spark: SparkSession, path: str) -> DataFrame:
    """(url, asked_url, headline, about, location, image_url, skills, experience): snapshots of profiles (JSON lines).

    Skills may be texts or objects with a name, top skills one text with bullets; a picture may be a text or an object.
    """
    df = spark.read.schema(PROFILE).json(path)
    own = F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.title"))).otherwise(x))
    top = F.coalesce(split_list(F.col("topSkills"), "•"), F.array().cast("array<string>"))
    image = F.coalesce(F.get_json_object("profilePicture", "$.url"), F.when(~F.col("profilePicture").startswith("{"), F.col("profilePicture")), F.col("photo"))
    return df.select(first_set(F.col("linkedinUrl"), F.col("url")).alias("url"), F.col("originalQuery.query").alias("asked_url"), "headline", "about", _place().alias("location"), image.alias("image_url"), distinct_ignoring_case(F.filter(F.concat(top, own), lambda x: x.isNotNull() & (x != ""))).alias("skills"), "experience")


SEARCH = "searchQuery struct<term: string>, organicResults array<struct<url: string, title: string, description: string, snippet: string>>"


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    """(term, pos, url, title, snippet): the results of searches (JSON lines), one row each, in their order."""
    rows = spark.read.schema(SEARCH).json(path).select(F.col("searchQuery.term").alias("term"), F.posexplode("organicResults").alias("pos", "r"))
    return rows.select("term", "pos", "r.url", "r.title", first_set(F.col("r.description"), F.col("r.snippet")).alias("snippet"))


def get_by_id(df: DataFrame, id_: int, key: str = "id") -> DataFrame:
    """The one row with an id; LookupError if there is none."""
    row = df.where(F.col(key) == id_).limit(1)
    if row.isEmpty():
        raise LookupError(f"no row with {key} {id_}")
    return row


TAXONOMY = "capabilities array<struct<name: string, children: array<string>>>, industries array<struct<name: string, children: array<string>>>"


def read_taxonomy(spark: SparkSession, folder: str, slug: str) -> DataFrame | None:
    """(kind, parent, name) of both levels of a firm's own taxonomy, ``<folder>/<slug>.json``; None if it has none."""
    path = f"{folder.rstrip('/')}/{slug}.json"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    tree = spark.read.schema(TAXONOMY).option("multiLine", True).json(path)
    trees = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(k, F.array().cast("array<struct<name: string, children: array<string>>>")).alias("nodes")) for k in ("capabilities", "industries")])
    nodes = tree.select(F.inline(trees)).select("kind", F.explode("nodes").alias("n"))
    both = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("parent"), F.col("n.name").alias("name"))), F.transform(F.coalesce("n.children", F.array().cast("array<string>")), lambda c: F.struct(F.col("n.name").alias("parent"), c.alias("name"))))
    return nodes.select("kind", F.inline(both))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Already-fetched pages (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_jdbc(spark: SparkSession, url: str, table_name: str, key: str, low: int, high: int, parts: int = 16) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric key."""
    return spark.read.jdbc(url, table_name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)
