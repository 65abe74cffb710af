"""Readers of documents: folders, zip files, label tables and terminologies."""

from __future__ import annotations

import io
import json
import urllib.request
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from phrasewerk.operators.lines import name_filter
from phrasewerk.sources.config import load, server


def folder(spark: SparkSession, path: str, extension: str = "txt", subfolders: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """(name, content[, label]): whole files with the extension of *path* and below, or of some subfolders; name is the stem.

    With *categories* the label is the file's folder, and only files of these folders stay, case ignored.
    """
    paths = [f"{path.rstrip('/')}/{s}" for s in subfolders] if subfolders else path
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").text(paths, wholetext=True)
    if categories is not None:
        label = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
        files = files.withColumn("label", label).where(F.lower("label").isin([c.lower() for c in categories]))
        return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("name"), F.col("value").alias("content"), "label")
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("name"), F.col("value").alias("content"))


def zipped(spark: SparkSession, path: str, extension: str = "txt", encoding: str = "utf-8") -> DataFrame:
    """(name, content): members of zip files with the extension, directories left out; a zip file is read by one task."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: list[tuple[str, str]] = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if not m.is_dir() and m.filename.endswith(f".{extension}"):
                            stem = m.filename.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                            held.append((stem, z.read(m).decode(encoding, "replace")))
                            if sum(len(c) for _, c in held) > 16_000_000:  # characters
                                yield pd.DataFrame(held, columns=["name", "content"])
                                held = []
            yield pd.DataFrame(held, columns=["name", "content"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "name string, content string")


def renamed(documents: DataFrame, names: dict[str, str], label: str | None = None) -> DataFrame:
    """*documents* with columns renamed (a missing one is an error) and the label taken from a column."""
    missing = [c for c in names if c not in documents.columns]
    if missing:
        raise KeyError(", ".join(missing))
    out = documents.withColumnsRenamed(names)
    return out.withColumn("label", F.col(label)) if label and label in out.columns else out


def read(spark: SparkSession, source: str | DataFrame, names: dict[str, str] | None = None, label: str | None = None) -> DataFrame:
    """Documents of a table at hand, a zip file, a JSON-lines file, a Parquet table or a folder."""
    if isinstance(source, DataFrame):
        found = source
    elif source.endswith(".zip"):
        found = zipped(spark, source)
    elif source.endswith((".json", ".jsonl")):
        found = spark.read.json(source)
    elif source.endswith(".parquet"):
        found = spark.read.parquet(source)
    else:
        found = folder(spark, source)
    return renamed(found, names, label) if names or label else found


def negation_rules(spark: SparkSession, path: str) -> DataFrame:
    """(trigger, kind) of lines "phrase<TAB><TAB>[TAG]"; unknown tags are none."""
    tags = {"[PREN]": "preceding", "[PREP]": "preceding", "[POST]": "following", "[POSP]": "following", "[PSEU]": "pseudo", "[CONJ]": "termination"}
    rows = spark.read.text(path).select(F.split("value", "\t\t", 2).alias("p")).where(F.size("p") == 2)
    kinds = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    return rows.select(F.trim(F.get("p", F.lit(0))).alias("trigger"), F.coalesce(F.try_element_at(kinds, F.trim(F.get("p", F.lit(1)))), F.lit("none")).alias("kind"))


def terminology(spark: SparkSession, path: str) -> DataFrame:
    """(id, term, synonyms, categories) of a JSON file of any file system: {terms: [...]}, {term: {...}} or a list; anything else is empty."""
    if path.endswith((".yml", ".yaml")):
        data = load(path)
    else:
        data = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()) or "[]")  # one file
    if isinstance(data, dict):
        data = data["terms"] if isinstance(data.get("terms"), list) else [{"term": k, **v} for k, v in data.items() if isinstance(v, dict)]
    entries = [e for e in data if isinstance(e, dict) and e.get("term")] if isinstance(data, list) else []
    rows = [(str(e.get("id") or e["term"]), e["term"], list(e.get("synonyms") or []), entry_categories(e)) for e in entries]
    return spark.createDataFrame(rows, "id string, term string, synonyms array<string>, categories array<string>")


def entry_categories(entry: dict) -> list[str]:
    """What an entry is restricted to: its categories or its category, as a list; none for neither."""
    found = entry.get("categories") or entry.get("category") or []
    return [str(found)] if isinstance(found, str) else [str(x) for x in found]


def with_label_of(documents: DataFrame, getter: Callable[[str], str | None], stem: str = "name") -> DataFrame:
    """*documents* with label from a function of the stem, called in batches; null stems have none."""

    @F.pandas_udf("string")
    def label(stems: pd.Series) -> pd.Series:
        return stems.map(lambda x: None if x is None else getter(x))

    return documents.withColumn("label", label(F.col(stem)))


class DocumentServer(DataSource):
    """Pages of a document server as a table: format "document_server" with the options url, port, index, size, other_id and pages.

    A page is <url>:<port>/<index>/_search?from=<n>&size=<size>, or the file page-<k>.json below a file: url; it holds
    hits.hits with _id and _source. Each partition is a range of pages, so pages are read in parallel and again if a
    task is lost.
    """

    @classmethod
    def name(cls) -> str:
        return "document_server"

    def schema(self) -> str:
        return "hit_id string, source string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))


class _Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        size, total = int(self.options.get("size", 30)), server_count(self.options)
        pages, tasks = -(-total // size), int(self.options.get("tasks", 8))
        step = max(1, -(-pages // tasks))
        return [InputPartition((a, min(a + step, pages))) for a in range(0, pages, step)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        size, other = int(self.options.get("size", 30)), self.options.get("other_id") or "id"
        for page in range(*partition.value):
            for hit in _get(_page_url(self.options, page, size)).get("hits", {}).get("hits", []):
                source = hit.get("_source") or {}
                own = source.get(other) or source.get("id") or hit.get("_id")
                yield str(own), json.dumps(source, ensure_ascii=False)


def _base(options: dict) -> str:
    url = options["url"].rstrip("/")
    return url if url.startswith("file:") else f"{url}:{options.get('port', '9008')}/{options.get('index', 'documents').strip('/')}"


def _page_url(options: dict, page: int, size: int) -> str:
    base = _base(options)
    return f"{base}/page-{page}.json" if base.startswith("file:") else f"{base}/_search?from={page * size}&size={size}"


def _get(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=30) as r:
        return json.load(r)


def server_count(options: dict) -> int:
    """The number of documents that a server holds; an error if it can't be asked."""
    base = _base(options)
    return int(_get(f"{base}/count.json" if base.startswith("file:") else f"{base}/_count").get("count", 0))


def server_reachable(config: dict) -> str | None:
    """The first of url and alternate_url under which the server holds documents; None if neither does."""
    for key in ("url", "alternate_url"):
        if config.get(key):
            try:
                if server_count({**config, "url": config[key]}) > 0:
                    return config[key]
            except (OSError, ValueError):
                continue
    return None


def served(spark: SparkSession, config: dict, names: list[str] | None = None, inverse: bool = False) -> DataFrame:
    """(id, name, content, label) of a document server's documents, fields renamed by replace_keys, name filter applied."""
    config = server(config)
    spark.dataSource.register(DocumentServer)
    options = {k: str(v) for k, v in config.items() if k in ("url", "port", "index", "size", "other_id", "tasks") and v is not None}
    rows = spark.read.format("document_server").options(**options).load()
    back = {v: k for k, v in config["replace_keys"].items()}
    field_of = lambda c: F.get_json_object("source", f"$.{back.get(c, c)}")
    docs = rows.select(F.col("hit_id").alias("id"), field_of("name").alias("name"), field_of("content").alias("content"), F.get_json_object("source", f"$.{config['label_key']}").alias("label"))
    return name_filter(docs, names, inverse) if names else docs


def http_terminology(*_: object) -> DataFrame:
    """Terminologies behind HTTP are not there."""
    raise NotImplementedError("terminologies are read from files")
