"""Files in and out: pages of binary files, processed artifacts as JSON, answers of a language model."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import strip

PAGES = "path string, page_number int, text string, tables array<string>"
#: Pages that leave a decoder together.
PAGES_AT_ONCE = 64
ARTIFACT = """document struct<id: string, filename: string, dataset: string, document_type: string, file_hash: string, created_at: string, page_count: int, file_size: bigint>,
chunks array<struct<id: string, document_id: string, page_number: int, section: string, content_type: string, text: string>>,
observations array<struct<id: string, document_id: string, entity_name: string, concept_name: string, value_type: string, value: double, unit: string, text_value: string,
normalized_value: double, normalized_unit: string, period_type: string, period_label: string, assertion_status: string, confidence: double, needs_review: boolean, review_reason: string,
evidence: array<struct<document_id: string, page_number: int, section: string, chunk_id: string, quote: string>>>>,
relationships array<struct<id: string, observation_a: string, observation_b: string, relationship_type: string, confidence: double>>"""


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", hashed: bool = True) -> DataFrame:
    """Files with path, size in MB (2 decimals) and, if wanted, content hash; the content is read only for the hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    named = files.select("path", F.round(F.col("length") / 1048576, 2).alias("size_mb"), *([F.sha2("content", 256).alias("file_hash")] if hashed else []))
    return named


def read_pages(spark: SparkSession, folder: str, decode: Callable[[bytes], Iterable], pattern: str = "*.pdf") -> DataFrame:
    """A row a page, numbered from 1, by an injected decoder: bytes to page texts, or to (text, tables) a page.

    A table is a list of rows of cells; it comes out as text, cells parted by " | ", a line a row.  Pages leave
    the worker as they are decoded.  A file that the decoder refuses gives one row with page_number 0 and a null text
    (behind the pages it gave before), so one bad file stops nothing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    types = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "page_number", "text", "tables"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                try:
                    for n, page in enumerate(decode(content), 1):
                        text, tables = (page, []) if isinstance(page, str) else page
                        held.append((path, n, text.strip(), [table_text(t) for t in tables]))
                        if len(held) == PAGES_AT_ONCE:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                            held = []
                except Exception:
                    held.append((path, 0, None, []))
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(run, PAGES)


def table_text(rows: list[list]) -> str:
    """A table's rows as lines, its cells parted by bars; empty cells stay empty."""
    return "\n".join(" | ".join("" if c is None else str(c) for c in row) for row in rows)


def read_artifacts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """documents, chunks, observations, evidence, relationships of all artifacts; files that are no artifact are skipped.

    Chunks without chunk_type come out as ``text``: the stored key is content_type, which reading back ignores.
    """
    raw = spark.read.schema(ARTIFACT).option("multiLine", True).option("mode", "PERMISSIVE").json(folder).where("document.id is not null")
    part = lambda c: raw.select(F.explode(c).alias("x")).select("x.*")
    chunks = part("chunks").withColumn("chunk_type", F.lit("text")).drop("content_type")
    held = part("observations")
    evidence = held.select(F.col("id").alias("observation_id"), F.explode("evidence").alias("v")).select("observation_id", "v.*")
    return {"documents": raw.select("document.*"), "chunks": chunks, "observations": held.drop("evidence"), "evidence": evidence, "relationships": part("relationships")}


def load_artifacts(spark: SparkSession, folder: str, store: str) -> int:
    """Replaces every table under ``store`` by what the artifacts hold, and returns the number of documents."""
    tables = read_artifacts(spark, folder)
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{store}/{name}.parquet")
    return spark.read.parquet(f"{store}/documents.parquet").count()


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """One row an artifact with its sizes, newest first."""
    raw = spark.read.schema(ARTIFACT).option("multiLine", True).json(folder).where("document.id is not null")
    sizes = [F.coalesce(F.size(c), F.lit(0)).alias(c) for c in ("chunks", "observations", "relationships")]
    return raw.select("document.id", "document.filename", "document.created_at", *sizes).orderBy(F.desc("created_at"))


def write_artifacts(documents: DataFrame, chunks: DataFrame, relationships: DataFrame, folder: str, observations: DataFrame | None = None) -> None:
    """One JSON object a document, in files partitioned by document; replaces only the documents given.

    ``chunks``, ``relationships`` and ``observations`` (with their evidence array) have a document_id.
    """
    out = documents.select("id", F.struct(*documents.columns).alias("document"))
    for name, part in (("chunks", chunks), ("observations", observations), ("relationships", relationships)):
        if part is not None:
            held = [c for c in part.columns if c != "document_id" or name != "relationships"]
            out = out.join(part.groupBy(F.col("document_id").alias("id")).agg(F.collect_list(F.struct(*held)).alias(name)), "id", "left")
    out = out.withColumnRenamed("id", "doc")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").json(folder)


def transient(error: str) -> tuple[bool, str]:
    """Whether a failed call is worth repeating, and why; a status is a number of its own."""
    low = error.lower()
    for pattern, reason in ((r"timeout|timed out", "timeout"), (r"\b429\b|rate limit", "rate_limit"), (r"\b50[0234]\b", "server"), (r"connection|reset", "connection")):
        if re.search(pattern, low):
            return True, reason
    return False, "permanent"


def clean_json(answer: str | None) -> list[dict]:
    """Observations in a model's answer: fences stripped, a list, one object, or {observations: [...]}; else []."""
    s = re.sub(r"^```[a-z]*\s*|\s*```$", "", (answer or "").strip())
    for text in (s, *(m[0] for p in (r"\{.*\}", r"\[.*\]") if (m := re.search(p, s, re.S)))):
        try:
            found = json.loads(text)
        except ValueError:
            continue
        found = found.get("observations", [found]) if isinstance(found, dict) else found
        return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []
    return []


def answer_of(prompt: str, models: list[Callable[[str], str | None]], tries: int = 3, cycles: int = 2, wait: float = 4.0, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The first answer of the models, asked in turn; null if none gives one.

    A model is asked again after a transient error, with growing waits (25 seconds at most); a refused request
    (400, 404) and any other error go to the next model; after all of them the round begins once more.
    """
    for cycle in range(1, cycles + 1):
        for call in models:
            for n in range(tries):
                try:
                    answer = call(prompt)
                except Exception as e:
                    if not transient(str(e))[0]:
                        break
                    if n < tries - 1:
                        sleep(min(25.0, wait * 1.8**n) * (1 + 0.1 * random.random()))
                    continue
                if answer:
                    return answer
                break
        if cycle < cycles:
            sleep(wait * 1.25 * cycle)
    return None


def ask(
    prompts: DataFrame, call: Callable[[str], str | None] | list[Callable[[str], str | None]] | None, key: str = "batch_id", tries: int = 3, cycles: int = 1, wait: float = 4.0
) -> DataFrame:
    """(key, prompt) to (key, answer) by an injected model, or by several, of which the later ones stand in.

    Without a model (offline) all answers are null.
    """
    schema = f"{key} string, answer string"
    models = [] if call is None else call if isinstance(call, list) else [call]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [answer_of(p, models, tries, cycles, wait) if models else None for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string())], names=[key, "answer"])

    return prompts.select(F.col(key).cast("string"), "prompt").mapInArrow(run, schema)


def batch_prompt(chunks: str = "chunks") -> Column:
    """A batch (batch_id, section, page_start, page_end and its chunks) as a model reads it."""
    head = F.format_string("=== BATCH %s | SECTION: %s | PAGES: %d - %d ===\n\n", "batch_id", "section", "page_start", "page_end")
    kind, section = (lambda c: F.coalesce(c["chunk_type"], F.lit("text"))), (lambda c: F.coalesce(c["section"], F.lit("")))
    each = lambda c: F.format_string('[CHUNK id="%s" page=%d type="%s" section="%s"]\n%s\n[/CHUNK]\n', c["id"], c["page_number"], kind(c), section(c), strip(F.coalesce(c["text"], F.lit(""))))
    return F.concat(head, F.array_join(F.transform(chunks, each), "\n"))
