"""Files -> DataFrames of documents. Files are split by Spark where the format allows it (line separators), else one file is one task's work, which
streams its records."""

from __future__ import annotations

import email
import gzip
import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions.markup import Markup

if TYPE_CHECKING:
    from lexigrove.collection import Collection

DOCUMENTS = "path string, docno string, text string, content string, metadata map<string,string>"

#: Extension -> file class.
EXTENSIONS = {
    "html": "html", "htm": "html", "xml": "xml", "warc": "warc", "trecweb": "trecweb", "trectext": "trectext", "trec": "trectext",
    "mbox": "mbox", "txt": "txt", "pdf": "pdf",
}


@dataclass(frozen=True)
class FileClass:
    """How files of a class are read: by which reader, with which tokenizer (word or char) and which markup rules."""

    reader: str
    markup: Markup = field(default_factory=Markup)
    tokenizer: str = "word"


#: Tags of news collections that stand for others.
_CONFLATED = {("hl", None, None): "headline", ("head", None, None): "headline", ("ttl", None, None): "title", ("dd", None, None): "date", ("date_time", None, None): "date"}
_HTML = Markup(metadata=frozenset({"docno", "title"}))
_TREC = Markup(index=frozenset({"author", "headline", "title", "date", "text"}), metadata=frozenset({"docno", "title", "author"}), conflate=_CONFLATED)

CLASSES = {
    "html": FileClass("file", _HTML),
    "xml": FileClass("file"),
    "txt": FileClass("file"),
    "warc": FileClass("warc", _HTML),
    "warcchar": FileClass("warc", replace(_HTML, characters=True), "char"),
    "trecweb": FileClass("tagged", _HTML),
    "trectext": FileClass("tagged", replace(_TREC, include=frozenset({"text", "headline", "title", "author", "date"}))),
    "trecchar": FileClass("tagged", replace(_TREC, include=frozenset({"text", "headline", "title", "author", "date"}), characters=True), "char"),
    "trecalt": FileClass("tagged", replace(_TREC, index=frozenset({"text"}), include=frozenset({"text"}))),
    "mbox": FileClass("mbox"),
}

#: Extractors of formats that this build has no library for: kind -> function(bytes) -> (text, metadata). See register.
EXTRACTORS: dict[str, Callable[[bytes], tuple[str, dict[str, str]]]] = {}


def register(kind: str, extract: Callable[[bytes], tuple[str, dict[str, str]]]) -> None:
    """Makes documents() read whole files of a kind, such as pdf, by a function of the user."""
    EXTRACTORS[kind] = extract


def file_class(path: str) -> str | None:
    name = path.lower().removesuffix(".gz")
    return EXTENSIONS.get(name.rsplit(".", 1)[-1])


def tagged_documents(spark: SparkSession, path: str, kind: str = "trectext") -> DataFrame:
    """<DOC>..</DOC> documents of a file or a tree of files; content is what follows </DOCHDR> (trecweb) or the text between tags of text (trectext).

    Lines end with </DOC>, so that large files are split. Documents without DOCNO have a NULL docno.
    """
    rows = spark.read.option("lineSep", "</DOC>").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    body = F.regexp_extract("value", r"(?s)<DOC>(.*)", 1)
    rows = rows.select("path", body.alias("b")).filter("b <> ''")
    docno = F.nullif(F.trim(F.regexp_extract("b", r"(?s)<DOCNO>(.*?)</DOCNO>", 1)), F.lit(""))
    header = F.trim(F.regexp_extract("b", r"(?s)<DOCHDR>(.*?)</DOCHDR>", 1))
    title = F.trim(F.regexp_extract("b", r"(?is)<(?:title|headline)>(.*?)</(?:title|headline)>", 1))
    content = F.regexp_extract("b", r"(?s)</DOCHDR>(.*)", 1) if kind == "trecweb" else F.regexp_extract("b", r"(?s)<TEXT>(.*)</TEXT>", 1)
    url = F.regexp_extract(header, r"^\s*(\S+)", 1)
    meta = F.map_filter(F.create_map(F.lit("docno"), docno, F.lit("url"), url, F.lit("title"), title, F.lit("dochdr"), header), lambda k, v: v != "")
    return rows.select("path", docno.alias("docno"), F.concat(F.lit("<DOC>"), "b", F.lit("</DOC>")).alias("text"), F.trim(content).alias("content"), meta.alias("metadata"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Plain, HTML or XML files, one document each; the path is its docno."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select("path", F.col("path").alias("docno"), "text", F.col("text").alias("content"), F.create_map(F.lit("docno"), F.col("path")).alias("metadata"))


#: Records of a file that are handed on at a time: so many, or so many characters.
BATCH_RECORDS, BATCH_CHARS = 1000, 16_000_000

Record = tuple[str | None, dict[str, str], str]


def parse_warc(data: io.BufferedIOBase) -> Iterator[Record]:
    """(record id, headers, body) of response records, read one after the other; lengths are those of the header lines, a broken record ends the file."""
    while line := data.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := data.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        size = headers.get("content-length", "")
        if not size.isdigit():
            return
        body = data.read(int(size))
        if len(body) < int(size):
            return
        if headers.get("warc-type") in ("response", "resource", "conversion"):
            cut = re.compile(rb"\r?\n\r?\n").search(body) if body.startswith(b"HTTP/") else None
            yield headers.get("warc-trec-id") or headers.get("warc-record-id"), headers, body[cut.end() if cut else 0 :].decode("utf-8", "replace")


def parse_mbox(data: io.BufferedIOBase) -> Iterator[Record]:
    """A message from each line that begins with `From ` to the next, read one after the other."""

    def message(lines: list[bytes]) -> Iterator[Record]:
        if b"".join(lines).strip():
            m = email.message_from_bytes(b"".join(lines))
            pieces = [p.get_payload(decode=True) or b"" for p in m.walk() if p.get_content_maintype() == "text"]
            yield m.get("Message-ID"), {k.lower(): str(m[k]) for k in ("Subject", "From", "To", "Date") if m[k]}, b"\n".join(pieces).decode("utf-8", "replace")

    lines: list[bytes] = []
    while line := data.readline():
        if line.startswith(b"From "):
            yield from message(lines)
            lines = []
        else:
            lines.append(line)
    yield from message(lines)


def _opened(path: str) -> io.BufferedIOBase:
    """A buffered stream of a file of any file system that Arrow knows, unpacked if it is gzip."""
    system, name = arrow_fs.FileSystem.from_uri(path)
    raw = io.BufferedReader(system.open_input_stream(name, compression=None), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def record_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """warc or mbox files -> documents. Spark lists the files and hands their paths out; a task reads its files as streams, so that no file is ever whole in memory."""
    parser = {"warc": parse_warc, "mbox": parse_mbox}[kind]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = lambda rows: pd.DataFrame(rows, columns=["path", "docno", "text", "content", "metadata"])
        for b in batches:
            for p in b["path"]:
                rows, size = [], 0
                with _opened(p) as data:
                    for i, h, t in parser(data):
                        rows.append((p, i, t, t, {**h, "docno": i or ""}))
                        size += len(t)
                        if len(rows) >= BATCH_RECORDS or size >= BATCH_CHARS:
                            yield out(rows)
                            rows, size = [], 0
                yield out(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInPandas(work, DOCUMENTS)


def extracted_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Whole files by the extractor registered for their kind, one document each."""
    extract = EXTRACTORS[kind]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [extract(bytes(data)) for data in b["content"]]
            yield pd.DataFrame({"path": b["path"], "docno": b["path"], "text": [t for t, _ in made], "content": [t for t, _ in made], "metadata": [{**m, "docno": p} for p, (_, m) in zip(b["path"], made)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(work, DOCUMENTS)


def collection(spark: SparkSession, path: str, kind: str | None = None, **options) -> Collection:
    """The files of a class as a searchable collection, by its tokenizer and markup rules."""
    from lexigrove.collection import Collection

    kind = kind or file_class(path) or "txt"
    docs = documents(spark, path, kind).withColumn("url", F.col("metadata")["url"])
    return Collection.tagged(docs.filter("docno is not null"), "docno", "text", CLASSES[kind].markup, url="url", **options)


def documents(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Documents of any known class; kind defaults to that of the extension."""
    kind = kind or file_class(path) or "txt"
    if kind in EXTRACTORS:
        return extracted_files(spark, path, kind)
    reader = CLASSES[kind].reader if kind in CLASSES else None
    if reader == "tagged":
        return tagged_documents(spark, path, "trecweb" if kind == "trecweb" else "trectext")
    if reader in ("warc", "mbox"):
        return record_files(spark, path, reader)
    if reader == "file":
        return whole_files(spark, path)
    raise ValueError(f"no reader for {kind!r} in this build; give it one by register()")


def frames(spark: SparkSession, path: str) -> list[str]:
    """Question openings for reformulate, a line each, in the file's order; a configuration file that the driver reads."""
    return [line.strip() for row in spark.read.option("wholetext", "true").text(path).collect() for line in row[0].split("\n") if line.strip()]


def headwords(spark: SparkSession, path: str) -> DataFrame:
    """(word, stem) of a dictionary's lines `word stem` or `word` (its own stem), lower-cased; for the stemmer by dictionary."""
    v = F.split(F.lower(F.trim("value")), r"\s+")
    rows = spark.read.text(path).select(v.alias("v")).filter(F.col("v")[0] != "")
    return rows.select(F.col("v")[0].alias("word"), F.coalesce(F.get("v", F.lit(1)), F.col("v")[0]).alias("stem")).groupBy("word").agg(F.min("stem").alias("stem"))


def offset_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(docno, kind, id, name, begin, length, value, parent) of tab-separated lines of tags over byte offsets; short or broken lines are left out."""
    names = "docno string, kind string, id long, name string, begin long, length long, value long, parent long"
    return spark.read.option("sep", "\t").option("mode", "DROPMALFORMED").schema(names).csv(path).filter("docno is not null and name is not null and begin is not null")


def annotated_fields(positions: DataFrame, docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Field extents of TAG annotations: offsets become the positions of the tokens they touch. positions(doc_id, pos, begin, end)."""
    a = annotations.filter("kind = 'TAG'").join(docs.select("doc_id", F.col("ext_id").alias("docno")), "docno").select("doc_id", "id", "name", F.col("begin").alias("b"), (F.col("begin") + F.col("length")).alias("e"), "value", "parent")
    hit = a.join(positions, "doc_id").filter("begin < e and end > b")
    return hit.groupBy("doc_id", "id", "name", "value", "parent").agg(F.min("pos").cast("int").alias("begin"), (F.max("pos") + 1).cast("int").alias("end")).select(
        "doc_id", F.lower("name").alias("field"), "begin", "end", F.col("value").alias("number"), F.col("id").cast("int").alias("ordinal"), F.coalesce("parent", F.lit(0)).cast("int").alias("parent")
    )


def with_metadata(docs: DataFrame, external: DataFrame) -> DataFrame:
    """docs with (docno, key, value) rows in their metadata; a key that a document has already keeps its value."""
    more = external.groupBy(F.col("docno").alias("ext_id"), "key").agg(F.min("value").alias("value")).groupBy("ext_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("more"))
    rows = docs.join(more, "ext_id", "left")
    extra = F.map_filter(F.coalesce("more", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("metadata", k))
    return rows.withColumn("metadata", F.map_concat("metadata", extra)).select(*docs.columns)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples lines; literals without quotes and language, brackets taken off. Lines that are no triple are left out."""
    m = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"\S*)\s*\.\s*$'
    rows = spark.read.text(path).filter(F.col("value").rlike(m))
    part = lambda k: F.regexp_replace(F.regexp_replace(F.regexp_extract("value", m, k), r'^"(.*)"\S*$', "$1"), r"^<|>$", "")
    return rows.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))


def objects(t: DataFrame, subject: str | None = None, predicate: str | None = None) -> DataFrame:
    rows = t
    if subject is not None:
        rows = rows.filter(F.col("s") == subject)
    if predicate is not None:
        rows = rows.filter(F.col("p") == predicate)
    return rows


def parameter_queries(text: str) -> list[dict]:
    """number, text, type, working_set and feedback documents of the queries of a parameter file."""
    import xml.etree.ElementTree as E

    root = E.fromstring(text)
    out = []
    for k, q in enumerate(root.iter("query")):
        get = lambda n, q=q: [x.text.strip() for x in q.findall(n) if x.text]
        body = (get("text") or [(q.text or "").strip()])[0]
        out.append({"number": (get("number") or [str(k)])[0], "text": body, "type": (get("type") or ["structured"])[0], "working_set": get("workingSetDocno"), "feedback": get("feedbackDocno")})
    return out


def topics(text: str) -> list[dict]:
    """number, type, query, description and subtopics of a topic file."""
    import xml.etree.ElementTree as E

    return [
        {
            "number": t.get("number"),
            "type": t.get("type"),
            "query": (t.findtext("query") or "").strip(),
            "description": (t.findtext("description") or "").strip(),
            "subtopics": [{"number": s.get("number"), "type": s.get("type"), "text": (s.text or "").strip()} for s in t.findall("subtopic")],
        }
        for t in E.fromstring(text).iter("topic")
    ]


def entity_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(target_id, entity_type, group_name) of a topic file {"targets": [...]}."""
    schema = "targets array<struct<target_id:string,entity_type:string,group:string>>"
    rows = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.explode("targets").alias("t"))
    return rows.select("t.target_id", "t.entity_type", F.col("t.group").alias("group_name"))
