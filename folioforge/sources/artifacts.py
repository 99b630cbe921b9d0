"""Stage artefacts as JSON tables with fixed schemas, and binary columns as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chapter_index INT, chunk_index INT, text STRING, char_start INT, char_end INT, part_index INT, part_title STRING, part_id STRING, source_order_indices ARRAY<INT>, boundary_strategy STRING"
#: Schemas of the artefacts, with the columns that must not be null.
SCHEMAS = {
    "chapters": ("book_id STRING, index INT, title STRING, text STRING", ("index", "title", "text")),
    "chunks": (f"book_id STRING, {CHUNK}", ("chapter_index", "chunk_index", "text")),
    "translations": (f"book_id STRING, chunk STRUCT<{CHUNK.replace(' INT', ': INT').replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY')}>, translated_text STRING, provider STRING, model STRING", ("chunk", "translated_text")),
    "audio_parts": ("book_id STRING, chapter_index INT, chunk_index INT, path STRING, duration_seconds DOUBLE, part_id STRING, provider STRING, model STRING, voice STRING", ("chapter_index", "chunk_index", "path")),
    "packaged": ("book_id STRING, output_kind STRING, format STRING, chapter_index INT, chapter_number INT, chapter_title STRING, path STRING, source_part_filenames ARRAY<STRING>", ("output_kind", "format", "path")),
    "manifest": ("run_id STRING, config_hash STRING, book STRUCT<source_pdf: STRING, title: STRING, author: STRING, language: STRING, source_format: STRING>, merged_audio_path STRING, total_llm_cost_usd DOUBLE, total_tts_cost_usd DOUBLE, total_cost_usd DOUBLE, extra MAP<STRING, STRING>", ("run_id", "config_hash")),
}


def write_artifact(df: DataFrame, kind: str, path: str) -> None:
    """Columns of the artefact's schema, one object a line."""
    names = [f.name for f in df.sparkSession.createDataFrame([], SCHEMAS[kind][0]).schema]
    df.select(*names).write.mode("overwrite").json(path, ignoreNullFields=False)


def read_artifact(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The artefact; a malformed line or a missing required value is an error when it is read."""
    schema, required = SCHEMAS[kind]
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in required:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{kind}: `{c}` is missing"))).otherwise(F.col(c)))
    return df


def write_files(df: DataFrame, folder: str, *, name_col: str, content_col: str) -> int:
    """Write a binary or string column as files, by the tasks that hold the rows; returns how many.

    A file is written under another name and renamed, so a task that runs again
    replaces its files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow.fs as fs

        system, root = fs.FileSystem.from_uri(folder)
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{root}/{name}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                temporary = f"{path}.{uuid.uuid4().hex}"
                with system.open_output_stream(temporary) as out:
                    out.write(content.encode() if isinstance(content, str) else content)
                system.move(temporary, path)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.select(name_col, content_col).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
