"""Documents from folders, pinned snapshots of URLs, and manifests; their records and health."""

from __future__ import annotations

import tomllib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph
from . import markup


#: Unsupported files of a folder that have a warning each.
TOLD = 12


def ingest(spark: SparkSession, sources: list[str], snapshots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and records of all sources: files and folders are read, URLs come from their pinned `snapshots`. No sources,
    and a URL without a snapshot, are errors."""
    if not sources:
        raise ValueError("no sources: name files, folders, URLs or a manifest of them")
    urls = [s for s in sources if s.lower().startswith(("http://", "https://"))]
    docs = records = None
    for root in [s for s in sources if s not in urls]:
        own, facts = workspace(spark, root)
        docs, records = (own, facts) if docs is None else (docs.unionByName(own), records.unionByName(facts))
    if urls:
        found = snapshots.where(F.col("url").isin(*urls)) if snapshots is not None else None
        missing = sorted(set(urls) - {r["url"] for r in found.select("url").collect()}) if found is not None else urls  # the sources that a caller names
        if missing:
            raise ValueError(f"no snapshot of {', '.join(missing[:5])}: fetch it and pin it first")
        own = snapshot_documents(found)
        raw = F.sha2("body", 256)
        facts = found.select(F.col("url").alias("path"), F.lit("url").alias("source_type"), "content_type", F.lit(True).alias("supported"), raw.alias("raw_sha256"), F.sha2(text.normalize(F.col("body")), 256).alias("normalized_sha256"), "retrieved_at", F.array().cast("array<string>").alias("warnings"))
        docs, records = (own, facts) if docs is None else (docs.unionByName(own, True), records.unionByName(facts, True))
    return docs, records


def health(docs: DataFrame, records: DataFrame) -> DataFrame:
    """The health of ingested sources: `graph.source_health` over the records of supported files and their documents."""
    unsupported = records.where("NOT supported").count()
    read = records.where("supported").select("path", "source_type", "warnings").join(docs.select(F.col("source").alias("path"), "text"), "path", "left")
    return graph.source_health(read, F.col("source_type"), F.col("warnings"), unsupported)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length, content, supported) of all files below a folder."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(f"no such source: {root}. Name a file or a folder that all executors can read, or pin a URL first") from None
    return files.withColumn("supported", markup.suffix(F.col("path")).isin(*markup.SUFFIXES))


def workspace(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and records of all files: source_type, hashes, times and warnings. Unsupported files have a record with
    a warning and no document."""
    files = listing(spark, root)
    read = markup.file_text(files.where("supported"))
    facts = files.select("path", "supported", F.sha2("content", 256).alias("raw_sha256"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieved_at"), "length")
    known = facts.join(read, "path", "left")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    unsupported = F.array(F.concat(F.lit("unsupported file: "), F.element_at(F.split("path", "/"), -1)))
    records = known.select(
        "path", F.lit("file").alias("source_type"), markup.content_type(F.col("path")).alias("content_type"), "supported", "raw_sha256", F.when(F.col("supported"), sha).alias("normalized_sha256"), "retrieved_at", F.when(F.col("supported"), F.col("warnings")).otherwise(unsupported).alias("warnings")
    )
    number_of = F.row_number().over(Window.partitionBy("supported", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).orderBy("path"))
    records = records.withColumn("warnings", F.when(F.col("supported") | (number_of <= TOLD), F.col("warnings")).otherwise(F.array().cast("array<string>")))
    name = text.slug(F.col("path"))
    number = F.concat(F.lit("doc:workspace:"), F.substring(name, -64, 64), F.lit(":"), F.substring(sha, 1, 12))
    docs = known.where("supported").select(number.alias("id"), text.title(F.col("text"), F.element_at(F.split("path", "/"), -1)).alias("title"), F.col("path").alias("source"), text.domain_of_path(F.col("path")).alias("domain"), "text", F.create_map(F.lit("source_type"), F.lit("file"), F.lit("raw_sha256"), F.col("raw_sha256")).alias("metadata"))
    return docs, records


def pinned(snapshots: DataFrame, fetched: DataFrame, refresh: bool = False) -> DataFrame:
    """Snapshots of URLs (url, body, content_type, etag, last_modified, retrieved_at): those that are pinned stay, unless
    they are refreshed; new ones are added."""
    if refresh:
        return fetched.unionByName(snapshots.join(fetched.select("url"), "url", "left_anti"))
    return snapshots.unionByName(fetched.join(snapshots.select("url"), "url", "left_anti"))


#: Endings of a pinned body and of the headers beside it.
BODY, HEADERS = ".body", ".headers.json"
_HEADERS = "url string, content_type string, etag string, last_modified string, retrieved_at string, sha256 string"


def pin(snapshots: DataFrame, path: str) -> None:
    """Write snapshots (url, body, content_type, etag, last_modified, retrieved_at) as a table of pinned copies with the hash
    of each body, below `path`."""
    snapshots.select("url", "body", "content_type", "etag", "last_modified", "retrieved_at").withColumn("sha256", F.sha2("body", 256)).write.mode("overwrite").parquet(path)


def pinned_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots (url, body, content_type, etag, last_modified, retrieved_at, path) of a folder of bodies, each `name`.body
    with its headers in `name`.headers.json, and the drift (path, url, warnings): bodies without headers, headers without a
    body, headers that are no JSON, and bodies whose hash is no longer the pinned one; those are no snapshots.

    Spark plans the files over tasks; bodies are read only where a query asks for them, and nothing is fetched."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    name = lambda ending: F.regexp_extract("path", f"^(.*){ending.replace('.', chr(92) + '.')}$", 1)
    bodies = files.option("pathGlobFilter", f"*{BODY}").load(path).select(name(BODY).alias("path"), F.col("content").alias("raw"), F.lit(True).alias("_body"))
    heads = files.option("pathGlobFilter", f"*{HEADERS}").load(path).select(name(HEADERS).alias("path"), F.from_json(F.decode("content", "UTF-8"), _HEADERS + ", broken string", {"columnNameOfCorruptRecord": "broken"}).alias("h"), F.lit(True).alias("_head"))
    met = bodies.join(heads, "path", "full_outer")
    told = [
        (F.col("_body").isNull(), "no body"), (F.col("_head").isNull(), "no headers"), (F.col("_head") & (F.col("h").isNull() | F.col("h.broken").isNotNull() | F.col("h.url").isNull()), "headers cannot be read"),
        (F.col("_body") & F.col("h.sha256").isNotNull() & (F.col("h.sha256") != F.sha2("raw", 256)), "body differs from the pin"),
    ]
    warned = met.withColumn("warnings", F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in told]), lambda x: x.isNotNull()))
    good = warned.where(F.size("warnings") == 0)
    body = F.decode("raw", "UTF-8")
    snapshots = good.select("h.url", body.alias("body"), "h.content_type", "h.etag", "h.last_modified", "h.retrieved_at", "path")
    return snapshots, warned.where(F.size("warnings") > 0).select("path", F.col("h.url").alias("url"), "warnings")


def materialised(manifest: DataFrame, snapshots: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the documents of a manifest's verified entries as a corpus snapshot below `path`: those that have a snapshot and
    do not differ from their pins. Returns the documents and what `drift` tells."""
    from ..plans import store

    found = drift(manifest, snapshots)
    good = snapshots.join(found.join(manifest.select("id", "url"), ["id", "url"]).where(F.size("warnings") == 0).select("url").distinct(), "url", "left_semi")
    store.write_snapshot(snapshot_documents(good), path, records=found)
    return store.read_snapshot(manifest.sparkSession, path), found


def snapshot_documents(snapshots: DataFrame) -> DataFrame:
    page = F.lower("content_type").contains("html")
    read = markup.html_text(snapshots.select("*", F.when(page, F.col("body")).otherwise(F.lit("")).alias("html")))
    body = text.normalize(F.when(page, F.col("text")).otherwise(F.col("body")))
    sha = F.substring(F.sha2(body, 256), 1, 12)
    return read.select(F.concat(F.lit("doc:workspace:"), F.substring(text.slug(F.col("url")), -64, 64), F.lit(":"), sha).alias("id"), text.title(body, F.col("url")).alias("title"), F.col("url").alias("source"), text.url_authority(F.col("url")).alias("domain"), body.alias("text"), F.create_map(F.lit("source_type"), F.lit("url"), F.lit("content_type"), F.col("content_type"), F.lit("etag"), F.col("etag")).alias("metadata"))


def drift(manifest: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(id, url, warnings): pinned hashes of a manifest (id, url, expected_raw_sha256, expected_normalized_sha256) that the
    snapshots no longer have, and entries without a snapshot."""
    s = snapshots.select("url", F.sha2("body", 256).alias("raw"), F.sha2(text.normalize(F.col("body")), 256).alias("plain"), F.lit(True).alias("there"))
    m = manifest.join(s, "url", "left")
    moved = lambda pin, now: F.col("there") & F.col(pin).isNotNull() & (F.col(pin) != F.col(now))
    told = [(F.col("there").isNull(), "no snapshot"), (moved("expected_raw_sha256", "raw"), "raw bytes differ from the pin"), (moved("expected_normalized_sha256", "plain"), "text differs from the pin")]
    return m.select("id", "url", F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in told]), lambda x: x.isNotNull()).alias("warnings"))


def manifest_sources(path: str) -> list[str]:
    """Sources of a TOML manifest: a list of texts or tables with url, path or source, or lists of paths and urls."""
    with open(path, "rb") as f:
        given = tomllib.load(f)
    found = [s if isinstance(s, str) else s.get("url") or s.get("path") or s.get("source") for s in given.get("sources", [])]
    return [s for s in [*found, *given.get("paths", []), *given.get("urls", [])] if s]
