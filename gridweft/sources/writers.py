"""File sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.operators.ordering import running_index
from gridweft.session import discard, materialize


def write_named_files(df: DataFrame, path: str, name: str = "name", content: str = "content") -> int:
    """One file per row under its own name; returns the number of files.

    Spark's writers choose file names themselves, so each task writes its rows through the file system of the
    URI.  A file is written under a temporary name and then moved, so a repeated task replaces it whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        made: set[str] = set()
        for rows in batches:
            for file, data in zip(rows["name"], rows["content"]):
                target = f"{root}/{file}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/_{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(bytes(data))
                system.move(part, target)
            yield pd.DataFrame({"n": [len(rows)]})

    data = F.col(content).cast("binary")
    written = df.select(F.col(name).alias("name"), data.alias("content")).mapInPandas(run, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


NULL_LINE = "\\N"


def _write_by_id(df: DataFrame, order: str, columns: list[str], path: str, form: str) -> None:
    # ranges of id and order: the lines of an id follow one another, in one file or in few files in order of their numbers.
    # Finding the ranges reads all rows once more, so they are written first and not computed twice.
    kept = materialize(df.select(*dict.fromkeys(["table_id", order, *columns])), "lines-by-id")
    ranged = kept.repartitionByRange("table_id", order).sortWithinPartitions("table_id", order)
    ranged.select(*columns).write.partitionBy("table_id").format(form).save(path)
    discard(df.sparkSession, kept)


def quoted_line(text: Column) -> Column:
    """A text as one quoted line: line ends and backslashes are escaped, a null is a mark of its own without quotes."""
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit(NULL_LINE))


def write_linearized(df: DataFrame, path: str) -> None:
    """``table_id=<id>/``: line n is the n-th variation; a null text has a line too."""
    lines = df.withColumn("value", quoted_line(F.col("input")))
    _write_by_id(lines, "variation", ["table_id", "value"], path, "text")


def write_predictions(df: DataFrame, path: str) -> None:
    """Predicted sentences, one quoted line per variation in order, in a folder per table id."""
    lines = df.withColumn("value", quoted_line(F.col("prediction")))
    _write_by_id(lines, "variation", ["table_id", "value"], path, "text")


def write_metric_records(df: DataFrame, path: str) -> None:
    """One JSON object per prediction, in order of the variation, in a folder per table id."""
    _write_by_id(df, "variation", df.columns, path, "json")


def write_score_map(scores: DataFrame, path: str, key: str = "file", value: str = "score") -> None:
    """The parts, concatenated in order, are one JSON object ``{key: value, ...}`` sorted by key.

    Nothing is gathered: the entries are sorted by range, and only the first one has no comma in front.
    """
    numbered = running_index(scores.select(key, value), [key], "n")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col(key).alias("k"))), r'^\{"k":(.*)\}$', 1)
    number = F.coalesce(F.col(value).cast("string"), F.lit("null"))
    entry = F.concat(F.when(F.col("n") > 0, ",").otherwise("{"), quoted, F.lit(": "), number)
    lines = numbered.select("n", entry.alias("value"))
    end = numbered.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.when(F.col("n") > 0, "}").otherwise("{}").alias("value")
    )
    lines.unionByName(end).repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_coco(documents: DataFrame, path: str) -> None:
    """``split=<name>/``: one COCO document per line and shard."""
    documents.select("split", "images", "annotations").write.partitionBy("split").json(path)


def write_results(marked: DataFrame, path: str) -> None:
    """``image pred gt`` lines in ``is_correct=true`` and ``is_correct=false``; both together are all results."""
    line = F.concat_ws(" ", "image", "pred", "gt")
    marked.select("is_correct", line.alias("value")).write.partitionBy("is_correct").text(path)


def coordinate_line(coords: Column | str, score: Column | str | None = None) -> Column:
    """Comma-joined coordinates, with the score at the end if it is given."""
    coords = F.col(coords) if isinstance(coords, str) else coords
    parts = [F.array_join(coords.cast("array<string>"), ",")]
    if score is not None:
        parts.append((F.col(score) if isinstance(score, str) else score).cast("string"))
    return F.concat_ws(",", *parts)


def write_coordinates(df: DataFrame, path: str, coords: str = "coords", score: str | None = "score") -> None:
    """One folder per image with a line for each box or quad."""
    lines = df.select("image", coordinate_line(coords, score).alias("value"))
    lines.repartitionByRange("image").sortWithinPartitions("image").write.partitionBy("image").text(path)


def keyed_rows(df: DataFrame, order: list[str], value: Column) -> DataFrame:
    """``key, value``: rows under their running number, plus the row ``total_number``."""
    rows = running_index(df.withColumn("_value", value), order, "_key")
    rows = rows.select(F.col("_key").cast("string").alias("key"), F.col("_value").alias("value"))
    total = df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("total_number").alias("key"), "value")
    return rows.unionByName(total)


def crop_label_line(df: DataFrame, folder: str = "image", index: str = "index") -> Column:
    """``image/img_0001.jpg text lex_size lexicon``."""
    name = F.format_string(f"{folder}/img_%04d.jpg", F.col(index))
    return F.concat_ws(" ", name, "tag", F.col("lex_size").cast("string"), "lexicon")
