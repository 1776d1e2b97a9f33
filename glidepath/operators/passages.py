"""Documents to passages: sections at headings, paragraphs packed up to a size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glidepath.sources.catalog import Catalog, stored

_HEADING = re.compile(r"^(#{1,4})\s+(.+?)\s*#*\s*$")
_FENCE = re.compile(r"^\s*(```|~~~)")
_MARKS = re.compile(r"[`*]")
_BLANK = re.compile(r"\n\s*\n")
_PASSAGE = pa.schema([("name", pa.string()), ("source", pa.string()), ("pos", pa.int32()), ("text", pa.string())])


def _sections(text: str) -> Iterator[tuple[str, str]]:
    """(heading, body) pairs; a heading inside a code fence is body text."""
    heading, body, fenced = "", [], False
    for line in text.splitlines():
        fenced ^= bool(_FENCE.match(line))
        hit = None if fenced else _HEADING.match(line)
        if hit:
            yield heading, "\n".join(body)
            heading, body = _MARKS.sub("", hit.group(2)).strip(), []
        else:
            body.append(line)
    yield heading, "\n".join(body)


def _pieces(body: str, fits) -> Iterator[str]:
    """Paragraphs; one that does not fit comes line by line."""
    for para in map(str.strip, _BLANK.split(body)):
        if fits(para):
            if para:
                yield para
        else:
            yield from (line for line in map(str.strip, para.splitlines()) if line)


def passages_of(name: str, text: str, max_words: int, max_chars: int, min_words: int) -> Iterator[tuple[str, str]]:
    """(source, passage) pairs of one document. Sizes are counted as pieces are added."""
    def fits(piece: str) -> bool:
        return len(piece) <= max_chars and len(piece.split()) <= max_words

    for heading, body in _sections(text):
        source = f"{name} §{heading}" if heading else name
        held, words, chars = [], 0, 0
        packed = []
        # a line over the limit is cut into consecutive pieces, so no text is lost
        cut = (line[i:i + max_chars] for line in _pieces(body, fits) for i in range(0, len(line), max_chars))
        for piece in cut:
            n = len(piece.split())
            if held and (words + n > max_words or chars + 2 + len(piece) > max_chars):
                packed.append((words, held))
                held, words, chars = [], 0, 0
            chars += len(piece) + (2 if held else 0)
            held.append(piece)
            words += n
        if held:
            packed.append((words, held))
        yield from ((source, "\n\n".join(p)) for n, p in packed if n >= min_words)


def _batch(rows: list[tuple[str, str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), _PASSAGE.types)], schema=_PASSAGE)


def chunk_docs(docs: DataFrame, max_words: int = 250, max_chars: int = 1500, min_words: int = 12, held_chars: int = 1 << 20) -> DataFrame:
    """`name, source, pos, text` passages of documents `name, text`, one document at a time.

    A worker takes one text out of its Arrow batch at a time and hands passages on from `held_chars` characters, whatever the batch holds.
    """
    def run(batches):
        for batch in batches:
            held, size = [], 0
            for name, text in zip(batch.column(0), batch.column(1)):
                name = name.as_py()
                for i, (source, p) in enumerate(passages_of(name, text.as_py() or "", max_words, max_chars, min_words)):
                    held.append((name, source, i, p))
                    size += len(p)
                    if size >= held_chars:
                        yield _batch(held)
                        held, size = [], 0
            if held:
                yield _batch(held)
    return docs.select("name", "text").mapInArrow(run, "name string, source string, pos int, text string")


def embed_input(source="source", text="text"):
    """What an embedding model reads: the source line gives a short passage its topic."""
    return F.concat_ws("\n", source, text)


# --- an index that follows its documents ----------------------------------------------------------------------------------------

def document_hashes(docs: DataFrame) -> DataFrame:
    """name, doc_hash: what decides whether a document's passages are made again. Null texts count as empty."""
    return docs.select("name", F.sha2(F.coalesce("text", F.lit("")), 256).alias("doc_hash"))


def change_set(hashes: DataFrame, held: DataFrame | None) -> DataFrame:
    """name, doc_hash, load (the one whose passages stay valid, if any) and action: insert, keep, replace or delete.

    `held` has a row per indexed document (name, doc_hash, load). Names are compared, texts do not move.
    """
    if held is None:
        return hashes.withColumns({"load": F.lit(None).cast("int"), "action": F.lit("insert")})
    old = held.select("name", F.col("doc_hash").alias("_old"), F.col("load").cast("int").alias("load"))
    action = (F.when(F.col("_old").isNull(), "insert").when(F.col("doc_hash").isNull(), "delete")
              .when(F.col("doc_hash") == F.col("_old"), "keep").otherwise("replace"))
    return hashes.join(old, "name", "full").select("name", "doc_hash", "load", action.alias("action"))


def update_index(cat: Catalog, docs: DataFrame, load: int, **sizes) -> DataFrame:
    """Brings the tables `passages` and `passage_docs` up to the documents (name, text; names are unique) and returns the change set.

    Only new and changed documents are cut into passages, as one numbered load; passages of kept ones stay where they are, whichever load
    they came with. `passage_docs` says for each document which load is its own, so passages of changed and deleted documents are no
    longer read. Loads are numbered upwards; a load that is run again replaces itself.
    """
    earlier = cat.read("passage_docs").where(F.col("at_load") < load) if cat.exists("passage_docs") else None
    newest = earlier.agg(F.max("at_load").alias("n")).first()["n"] if earlier is not None else None
    held = None if newest is None else earlier.where((F.col("at_load") == newest) & F.col("name").isNotNull())
    changes = stored(change_set(document_hashes(docs), held), "passage-changes")
    fresh = changes.where(F.col("action").isin("insert", "replace"))
    made = chunk_docs(docs.join(fresh.select("name"), "name", "left_semi"), **sizes)
    cat.append_load("passages", made, load)
    live = changes.where(F.col("action") != "delete").select(
        "name", "doc_hash", F.when(F.col("action") == "keep", F.col("load")).otherwise(F.lit(load)).alias("load"), F.lit(load).alias("at_load"))
    # a row without a name marks the load, also one that leaves no document
    mark = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("doc_hash"),
                                             F.lit(load).alias("load"), F.lit(load).alias("at_load"))
    live.unionByName(mark).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("at_load").parquet(cat.path("passage_docs"))
    return changes


def current_passages(cat: Catalog) -> DataFrame:
    """The passages of the documents as of the newest load, with the load each came with."""
    docs = cat.read("passage_docs")
    newest = docs.agg(F.max("at_load").alias("n")).first()["n"]
    return cat.read("passages").join(docs.where(F.col("at_load") == newest).select("name", "load"), ["name", "load"])


def embed_inputs(cat: Catalog, load: int) -> DataFrame:
    """What an embedding model has still to read: the passages that came with one load, each under the hash of its input."""
    rows = cat.read_load("passages", load).withColumn("input", embed_input())
    return rows.select("name", "pos", "input", F.sha2("input", 256).alias("input_hash"))
