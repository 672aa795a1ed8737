"""Annotated XML: text with inline marks becomes nodes, passages, mentions and annotations.

Mixed content keeps its order only in an event parser, so one runs inside ``mapInPandas``, a document at
a time, with external entities off. Deviation: a paragraph inside an annotation does not end the passage.
"""

from __future__ import annotations

import re
import xml.sax
import xml.sax.handler

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.functions.text import index_tokens
from stratum.operators.storage import cut_lineage, number_rows, running_total

KEPT = ("sort", "num", "name", "id", "ref", "namealias")
_NOT_SOURCE = re.compile("번역|역문|주석")
_NODE = "struct<id:string,parent_id:string,level_no:int,type:string,value:string,wangmyeong:string,reign_year:string,title:string,path:string,seq:int>"
_MENTION = "struct<type:string,surface:string,char_offset:int,attrs:map<string,string>>"
_NOTE = "struct<type:string,text:string>"
_PASSAGE = f"struct<node_id:string,seq:int,text:string,mentions:array<{_MENTION}>,annotations:array<{_NOTE}>>"
SCHEMA = f"path string, nodes array<{_NODE}>, passages array<{_PASSAGE}>"


class _Document(xml.sax.handler.ContentHandler):
    def __init__(self):
        super().__init__()
        self.nodes, self.passages, self.open, self.stack, self.kinds = [], [], [], [], []
        self.children: dict = {}
        self.order: dict = {}
        self.fresh_title = self.title = self.passage = self.mention = self.note = None
        self.note_depth = self.inner = 0

    def startElement(self, name, a):
        a = dict(a)
        if re.fullmatch("level[1-6]", name):
            parent = self.open[-1] if self.open else None
            key = parent["id"] if parent else "ROOT"
            seq = self.children.get(key, 0)
            self.children[key] = seq + 1
            ident = a.get("id") or f"{key}_{seq}"
            path = f"{parent['path']}/{ident}" if parent else ident
            node = {"id": ident, "parent_id": parent["id"] if parent else None, "level_no": int(name[5]), "type": a.get("type"), "value": a.get("value"), "wangmyeong": a.get("왕명"), "reign_year": a.get("재위년도"), "title": None, "path": path, "seq": seq}
            self.nodes.append(node)
            self.open.append(node)
            self.fresh_title = node
        elif name == "content":
            self.kinds.append(a.get("type") or "")
        elif name == "paragraph" and self.passage is not None:
            self.inner += 1
        elif name == "paragraph" and self.stack and self.stack[-1] == "content" and self.open and not _NOT_SOURCE.search(self.kinds[-1]):
            node = self.open[-1]["id"]
            seq = self.order.get(node, 0)
            self.order[node] = seq + 1
            self.passage = {"node_id": node, "seq": seq, "text": "", "mentions": [], "annotations": []}
        elif name == "mainTitle" and self.fresh_title is not None:
            self.title = ""
        elif name == "annotation" and self.passage is not None:
            if not self.note_depth:
                self.note = {"type": a.get("type"), "text": ""}
            self.note_depth += 1
        elif name == "index" and self.passage is not None and not self.note_depth:
            kept = {k: a[k] for k in KEPT if k in a}
            self.mention = {"type": a.get("type") or "기타", "surface": "", "char_offset": len(self.passage["text"]), "attrs": kept or None}
        self.stack.append(name)

    def characters(self, text):
        if self.title is not None:
            self.title += text
        if self.note_depth:
            self.note["text"] += text
        elif self.passage is not None:
            t = re.sub(r"\s+", "", text)
            self.passage["text"] += t
            if self.mention is not None:
                self.mention["surface"] += t

    def endElement(self, name):
        self.stack.pop()
        if re.fullmatch("level[1-6]", name):
            self.open.pop()
        elif name == "content":
            self.kinds.pop()
        elif name == "paragraph" and self.passage is not None:
            if self.inner:
                self.inner -= 1
                return
            if self.passage["text"]:
                self.passages.append(self.passage)
            self.passage = self.mention = None
        elif name == "mainTitle" and self.title is not None:
            self.fresh_title["title"] = self.title.strip()
            self.title = self.fresh_title = None
        elif name == "annotation" and self.note_depth:
            self.note_depth -= 1
            if not self.note_depth:
                text = re.sub(r"\s+", " ", self.note["text"]).strip()
                if text:
                    self.passage["annotations"].append(self.note | {"text": text})
                self.note = None
        elif name == "index" and self.mention is not None and not self.note_depth:
            if self.mention["surface"]:
                self.passage["mentions"].append(self.mention)
            self.mention = None


def parse_document(text: str) -> tuple[list[dict], list[dict]]:
    """(nodes, passages) of one document; malformed XML is an error."""
    h = _Document()
    p = xml.sax.make_parser()
    p.setFeature(xml.sax.handler.feature_external_ges, False)
    p.setFeature(xml.sax.handler.feature_external_pes, False)
    p.setContentHandler(h)
    p.feed(text)
    p.close()
    return h.nodes, h.passages


def corpus_code(path: Column) -> Column:
    """The part of a file's name before its first underscore."""
    return F.regexp_extract(path, r"([^/_]+)[^/]*$", 1)


def corpus_name(folder: Column) -> Column:
    """A folder's name without leading numbers and what is in brackets."""
    return F.trim(F.regexp_replace(F.regexp_extract(folder, r"([^/]+)/*$", 1), r"^[0-9._-]+|[(\[].*$", ""))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, nodes, passages) of every .xml file of a folder; an error if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").load(folder).select("path", "content")
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no XML files in {folder}")

    def run(frames):
        import pandas as pd

        for f in frames:
            done = [parse_document(c.decode("utf-8")) for c in f["content"]]
            yield pd.DataFrame({"path": f["path"], "nodes": [d[0] for d in done], "passages": [d[1] for d in done]})

    return files.mapInPandas(run, SCHEMA)


def corpus_tables(docs: DataFrame, corpus_id: int, first_passage: int = 1) -> dict[str, DataFrame]:
    """node, passage, mention and annotation tables, passages numbered in file and document order."""
    p = docs.select("path", F.posexplode("passages").alias("i", "p"))
    # a document's passages follow one another, so only documents are put in order
    sizes = number_rows(docs.select("path", F.size("passages").cast("long").alias("k")), ["path"])
    before = running_total(sizes, "n", "k")
    p = p.join(before.select("path", "before"), "path").withColumn("passage_id", F.col("before") + F.col("i") + F.lit(first_passage))
    tokens = index_tokens(F.col("p.text"), "han")
    node = docs.select("path", F.posexplode("nodes").alias("i", "n"))
    last = Window.partitionBy("n.id").orderBy(F.desc("path"), F.desc("i"))
    node = node.withColumn("k", F.row_number().over(last)).filter("k = 1").select(F.lit(corpus_id).alias("corpus_id"), F.col("n.id").alias("node_id"), *[F.col(f"n.{c}").alias(c) for c in ("parent_id", "level_no", "type", "value", "wangmyeong", "reign_year", "title", "path", "seq")])
    m = p.select("passage_id", F.col("p.node_id").alias("node_id"), F.posexplode("p.mentions").alias("pos", "m"))
    return {
        "node": node,
        "passage": p.select(F.lit(corpus_id).alias("corpus_id"), "passage_id", F.col("p.node_id").alias("node_id"), F.col("p.seq").alias("seq"), F.col("p.text").alias("text"), tokens.alias("tokens"), F.size(tokens).alias("char_count")),
        "mention": m.select(F.lit(corpus_id).alias("corpus_id"), "passage_id", "node_id", F.col("pos"), F.col("m.type").alias("type"), F.col("m.surface").alias("surface"), F.col("m.char_offset").alias("char_offset"), F.col("m.attrs").alias("attrs")),
        "annotation": p.select("passage_id", F.explode("p.annotations").alias("a")).select(F.lit(corpus_id).alias("corpus_id"), "passage_id", F.col("a.type").alias("type"), F.col("a.text").alias("text")),
    }


#: Tables of a corpus that lie in partitions by corpus_id.
OWN_TABLES = ("corpus", "node", "passage", "mention", "annotation")


def ingest(spark: SparkSession, folder: str, corpus_id: int, entity: DataFrame, out: str | None = None, name: str | None = None, first_passage: int | None = None) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Tables of a corpus with its entities resolved, and their counts.

    With ``out`` the corpus's partitions are overwritten there and then the entities are put in place, last of
    all, so a failed run leaves the old ones. Entities are never removed. Passages are numbered from above all
    that ``out`` holds, so no two corpora share a number.
    """
    from stratum.operators.state import resolve_entities

    if first_passage is None:
        have = _stored(spark, out, "passage") if out else None
        first_passage = 1 + ((have.agg(F.max("passage_id")).first()[0] or 0) if have is not None else 0)
    t = corpus_tables(read_documents(spark, folder), corpus_id, first_passage)
    seen = t["mention"].withColumn("place", F.col("passage_id") * 1_000_000 + F.col("pos"))
    every = cut_lineage(resolve_entities(entity, seen.select("type", "surface", F.col("place").alias("pos"))))
    t["mention"] = t["mention"].join(every, ["type", "surface"])
    t["entity"] = every
    counts = {k: v.count() for k, v in t.items()} | {"new_entity": every.count() - entity.count()}
    t["corpus"] = spark.createDataFrame([(corpus_id, name or f"corpus {corpus_id}", folder)], "corpus_id int, name string, folder string")
    if out:
        for k in OWN_TABLES:
            t[k].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_id").parquet(f"{out}/{k}")
        every.write.mode("overwrite").parquet(f"{out}/entity_next")
        _put_in_place(spark, f"{out}/entity_next", f"{out}/entity")
        t = {k: spark.read.parquet(f"{out}/{k}").filter(F.col("corpus_id") == corpus_id) for k in OWN_TABLES} | {"entity": spark.read.parquet(f"{out}/entity")}
    return t, counts


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _stored(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    p, fs = _files(spark, f"{out}/{name}")
    return spark.read.parquet(f"{out}/{name}") if fs.exists(p) else None


def _put_in_place(spark: SparkSession, new: str, old: str) -> None:
    """``new`` takes the name ``old``; what was there goes only once the new table is written whole."""
    (n, fs), (o, _) = _files(spark, new), _files(spark, old)
    fs.delete(o, True)
    if not fs.rename(n, o):
        raise OSError(f"{new} could not be renamed")
