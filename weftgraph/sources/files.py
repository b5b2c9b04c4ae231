"""Readers and writers: books, chunks, questions, aliases, logs, backups, ingest state."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftgraph.functions.sequential import chapters_of, spans_of
from weftgraph.functions.text import content_hash, era_of_book
from weftgraph.schema import ALIAS, CHUNK, EDGE, NODE, QUESTION


class DataError(ValueError):
    """Input that cannot be used; differs from input that is empty."""


def decoded(content: Column) -> Column:
    """UTF-8, else GB18030; one kind of line end; lines and the whole without outer white space."""

    def one(raw: bytes) -> str | None:
        for code in ("utf-8", "gb18030"):
            try:
                text = raw.decode(code)
            except UnicodeDecodeError:
                continue
            return "\n".join(x.strip() for x in re.split("\r\n|\r|\n", text)).strip()
        return None

    @pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(one)

    return run(content)


def read_books(spark: SparkSession, path: str, pattern: str = "*.txt", strict: bool = False) -> DataFrame:
    """book, text, fingerprint of every text file; a file in neither encoding has a null text, or if strict raises."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    book = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    out = raw.select(F.try_url_decode(book).alias("book"), decoded(F.col("content")).alias("text"), F.sha2("content", 256).alias("fingerprint"))
    if strict:
        _refuse(out.where("text IS NULL"), "books in no known encoding")
    return out


def _refuse(books: DataFrame, why: str) -> None:
    bad = [r["book"] for r in books.select("book").orderBy("book").limit(5).collect()]
    if bad:
        raise DataError(f"{why}: {', '.join(bad)}")


def build_chunks(books: DataFrame, path: str, size: int = 1500, overlap: int = 200) -> DataFrame:
    """Store the chunks of books by book; raises for a book whose era is not known, or that cannot be read."""
    _refuse(books.where("text IS NULL"), "books in no known encoding")
    _refuse(books.where(era_of_book(F.col("book")).isNull()), "books of no known era")
    chunks = chunk_books(books, size, overlap)
    write_chunks(chunks, path)
    return read_chunks(books.sparkSession, path)


def chunk_books(books: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """Chunks of books, chapter by chapter, numbered through each book."""
    c = books.select("book", F.posexplode(chapters_of(F.col("text"))).alias("part", "c"))
    c = c.select("book", "part", "c.chapter", F.col("c.text").alias("body")).withColumn("spans", spans_of(F.col("body"), size, overlap))
    c = c.select("book", "part", "chapter", "body", F.posexplode("spans").alias("k", "s"))
    n = F.row_number().over(Window.partitionBy("book").orderBy("part", "k")) - 1
    text = F.substring("body", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return c.select(
        F.format_string("%s::chunker-v2::%d", "book", n).alias("chunk_id"), F.format_string("%s::%d", "book", n).alias("logical_id"), "book",
        era_of_book(F.col("book")).alias("era"), "chapter", F.col("s.start").alias("offset"), F.col("s.end").alias("end"), content_hash(text).alias("content_hash"), text.alias("text"),
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("book").parquet(path)


def read_chunks(spark: SparkSession, path: str, books: list[str] | None = None, otherwise: str | None = None) -> DataFrame:
    """Stored chunks by book and id; a filter on books prunes the folders that are read.

    Where there are none, those of the chunk files of another folder, if one is named.
    """
    try:
        out = spark.read.parquet(path)
        out = out if books is None else out.where(F.col("book").isin(*books))
        if otherwise is None or out.limit(1).count():
            return out.orderBy("book", "chunk_id")
    except PySparkException:
        if otherwise is None:
            raise
    return read_chunk_files(spark, otherwise, books).orderBy("book", "chunk_id")


def read_chunk_files(spark: SparkSession, path: str, books: list[str] | None = None, default_era: str = "") -> DataFrame:
    """Chunks of JSON arrays in chunks_*.json, or else in chunks.json.

    A file is read if its name holds one of the books. What a chunk lacks of book and era it gets from
    the file's name; files that are no JSON array give none.
    """

    def of(pattern: str) -> DataFrame:
        raw = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
        name = F.regexp_extract(F.try_url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)), "^(?:chunks_?)?(.*)$", 1)
        return raw.select(name.alias("_file"), F.from_json("value", f"array<struct<{', '.join(_flat(CHUNK))}>>").alias("c"))

    found = of("chunks_*.json")
    if not found.limit(1).count():
        found = of("chunks.json")
    if books is not None:
        found = found.where(F.greatest(*[F.col("_file").contains(b) for b in books], F.lit(False)))
    rows = found.select("_file", F.explode("c").alias("c")).where("c.chunk_id IS NOT NULL").select("_file", "c.*")
    book = F.coalesce(F.nullif("book", F.lit("")), F.nullif("_file", F.lit("")))
    era = F.coalesce(F.nullif("era", F.lit("")), era_of_book(book), F.nullif(F.lit(default_era), F.lit("")))
    return rows.withColumns({"book": book, "era": era}).drop("_file")


def _flat(schema: str) -> list[str]:
    return [c.strip().replace(" ", ": ", 1) for c in schema.split(", ")]


def manifest(chunks: DataFrame) -> DataFrame:
    """Per book: chunks and characters."""
    return chunks.groupBy("book").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """An alias dictionary of a JSON array; none if the file is missing or no such array."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except PySparkException:
        return spark.createDataFrame([], ALIAS)
    return raw.select(F.explode(F.from_json("value", f"array<struct<{', '.join(_flat(ALIAS))}>>")).alias("a")).select("a.*")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array; raises for none, for missing fields and repeated ids."""
    out = spark.read.schema(QUESTION).json(path, multiLine=True)
    need = F.col("id").isNull() | F.col("question").isNull() | F.col("category").isNull() | F.col("answer_entities").isNull()
    n, bad, ids = out.agg(F.count("*"), F.count_if(need), F.count_distinct("id")).first()
    if not n or bad or ids != n:
        raise DataError(f"{n} questions, {bad} incomplete, {n - bad - ids} repeated")
    return out


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log with valid; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row"), "value").select("row.*", F.expr("try_parse_json(value) IS NOT NULL").alias("valid"))


def write_candidates(pairs: DataFrame, path: str, **about: str) -> None:
    """Candidates for review as CSV with an empty column decision, the best first, and columns of the same value about them all.

    Every file begins with a byte order mark, by which table programs know UTF-8.
    """
    out = pairs.withColumn("decision", F.lit("")).withColumns({k: F.lit(v) for k, v in about.items()})
    if "score" in pairs.columns:
        out = out.orderBy(F.desc("score"), *[c for c in pairs.columns if c != "score"])
    out.withColumnRenamed(out.columns[0], f"\ufeff{out.columns[0]}").write.mode("overwrite").option("header", True).csv(path)


def backup(nodes: DataFrame, edges: DataFrame, path: str, vectors: DataFrame | None = None) -> DataFrame:
    """Write the tables, and chunk vectors (chunk_id, embedding) if given, as JSON lines; returns their counts (kind, n)."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    if vectors is not None:
        vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).write.mode("overwrite").json(f"{path}/embeddings")
    return counts(nodes, edges, vectors)


def restore(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODE).json(f"{path}/nodes"), spark.read.schema(EDGE).json(f"{path}/edges")


def restore_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Chunk vectors of a backup; none if it has none."""
    try:
        return spark.read.schema("chunk_id string, embedding array<double>").json(f"{path}/embeddings")
    except PySparkException:
        return spark.createDataFrame([], "chunk_id string, embedding array<double>")


def counts(nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    kinds = {"nodes": nodes, "edges": edges} | ({} if vectors is None else {"embeddings": vectors})
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in kinds.items()])


def verified(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of counts agree."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
