"""Single JSON and XML documents that are larger than a task: read in blocks, written from sorted pieces.

A JSON document is cut at any byte.  Each block is summed up first (quotes, and how much deeper it gets, once for either state at
its start); sums over the blocks before it then tell whether a block starts inside a string and how deep, so records are
found where they begin.  Spark moves a row per block for that; a record is read by the block in which it begins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridweft import schemas
from gridweft.session import discard, materialize, scratch_path
from gridweft.sources.readers import list_files

BLOCK = 4 << 20
_COPIED = 8 << 20
_ROWS_OUT = 1 << 22  # characters of records in one batch
_BACKSLASH, _QUOTE = ord("\\"), ord('"')


def _open(path: str) -> tuple:
    """File system and path; Spark's paths are not escaped, addresses are."""
    from urllib.parse import quote

    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(path if "://" in path or path.startswith("file:") else f"file://{path}", safe=":/@"))


def _read(file, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def _backslashes_before(file, start: int) -> int:
    """Length of the run of backslashes that ends just before ``start``."""
    n, size = 0, 64
    while n < start:
        some = _read(file, max(0, start - n - size), min(size, start - n))
        run = len(some) - len(some.rstrip(b"\\"))
        n += run
        if run < len(some):
            break
        size *= 2
    return n


def _marks(data: bytes, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes that are not escaped, of all brackets, and 1 or -1 for each bracket."""
    text = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(text == _QUOTE)
    escaped = (text[quotes - 1] == _BACKSLASH) & (quotes > 0)
    if before and len(quotes) and quotes[0] == 0:
        escaped[0] = True
    if escaped.any():
        other = np.concatenate([[-1 - before], np.flatnonzero(text != _BACKSLASH)])
        asked = quotes[escaped]
        last = other[np.searchsorted(other, asked) - 1]
        quotes = np.sort(np.concatenate([quotes[~escaped], asked[(asked - 1 - last) % 2 == 0]]))
    opening, closing = (text == ord("{")) | (text == ord("[")), (text == ord("}")) | (text == ord("]"))
    brackets = np.flatnonzero(opening | closing)
    return quotes, brackets, np.where(opening[brackets], 1, -1)


def _summary(file, start: int, end: int) -> tuple[int, int, int]:
    """Number of quotes, and the change of depth for a block that starts outside and inside a string."""
    quotes, brackets, steps = _marks(_read(file, start, end - start), _backslashes_before(file, start))
    odd = np.searchsorted(quotes, brackets) % 2 == 1
    return len(quotes), int(steps[~odd].sum()), int(steps[odd].sum())


def _contents(file, start: int, end: int, inside: int, depth: int, records: bool) -> tuple[list[tuple[int, str]], list[tuple[int, bytes]]]:
    """Keys of the document, and objects two levels down, that begin in a block; reads on where one goes beyond the end."""
    before, size, total = _backslashes_before(file, start), end - start, file.size()
    while True:
        data = _read(file, start, size)
        whole = start + len(data) >= total
        quotes, brackets, steps = _marks(data, before)
        outside = (np.searchsorted(quotes, brackets) + inside) % 2 == 0
        brackets, steps = brackets[outside], steps[outside]
        after = depth + np.cumsum(steps)
        # a string opens at each second quote; its depth is that after the last bracket before it
        opens = np.arange(inside, len(quotes), 2)
        opens = opens[quotes[opens] < end - start]
        levels = np.concatenate([[depth], after])[np.searchsorted(brackets, quotes[opens])]
        keys, open_end = [], False
        for i in opens[levels == 1]:
            if i + 1 == len(quotes):
                open_end = True
                break
            rest = data[quotes[i + 1] + 1 : quotes[i + 1] + 65].lstrip()
            behind = quotes[i + 1] + 65
            while not rest and behind < len(data):
                rest, behind = data[behind : behind + 4096].lstrip(), behind + 4096
            if not rest:
                open_end = True
                break
            if rest.startswith(b":"):
                keys.append((int(quotes[i]), json.loads(data[quotes[i] : quotes[i + 1] + 1])))
        found = []
        if records:
            curly = np.frombuffer(data, np.uint8)[brackets] == ord("{")
            first = brackets[(steps == 1) & (after == 3) & curly]
            first, last = first[first < end - start], brackets[(steps == -1) & (after == 2)]
            to = np.searchsorted(last, first, "right")
            open_end |= bool((to == len(last)).any())
            found = [(int(a), data[a : last[j] + 1]) for a, j in zip(first, to) if j < len(last)]
        if whole or not open_end:
            return keys, found
        size *= 2


def _by_block(blocks: DataFrame, schema: str, work: Callable[..., Iterator[dict]], n_tasks: int) -> DataFrame:
    """``work(file, block)`` for each block, dealt over ``n_tasks`` tasks; the files are read where the work is done."""
    target = StructType.fromDDL(schema)
    names = target.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                system, path = _open(block["path"])
                with system.open_input_file(path) as file:
                    rows, held = [], 0
                    for row in work(file, block):
                        rows.append({n: row.get(n) for n in names})
                        held += len(row.get("record") or "")
                        if held > _ROWS_OUT:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kinds = {"string": pa.string(), "bigint": pa.int64()}
    arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in target.fields])
    return blocks.repartition(n_tasks, "path", "start").mapInArrow(run, schema)


_BLOCK = "path string, start bigint, end bigint"


def read_json_records(spark: SparkSession, path: str, glob: str = "*.json", block: int = BLOCK) -> DataFrame:
    """``file, section, offset, record``: the objects two levels down in each document, as JSON text, with their key of the document.

    For COCO these are the images and annotations.  The documents are valid JSON in UTF-8, of any layout; no task holds more than
    a block and the record at its end.
    """
    files = list_files(spark, path, glob).filter("length > 0")
    n_blocks = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / block)), F.lit(0))).first()[0]
    tasks = max(1, min(int(n_blocks), 100_000))
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / block))).alias("b"))
    blocks = blocks.select("path", (F.col("b") * block).alias("start"), F.least((F.col("b") + 1) * block, "length").alias("end"))

    def summed(file, b):
        quotes, plain, quoted = _summary(file, b["start"], b["end"])
        yield {**b, "quotes": quotes, "plain": plain, "quoted": quoted}

    def keyed(file, b):
        keys, _ = _contents(file, b["start"], b["end"], b["inside"], b["depth"], records=False)
        yield {**b, "last_key": keys[-1][1] if keys else None}

    def cut(file, b):
        keys, found = _contents(file, b["start"], b["end"], b["inside"], b["depth"], records=True)
        places = [place for place, _ in keys]
        for at, record in found:
            n = int(np.searchsorted(places, at)) if places else 0
            yield {"path": b["path"], "section": keys[n - 1][1] if n else b["section"], "offset": b["start"] + at, "record": record.decode()}

    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(c: Column) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")

    sums = _by_block(blocks, f"{_BLOCK}, quotes bigint, plain bigint, quoted bigint", summed, tasks)
    states = sums.withColumn("inside", sum_before(F.col("quotes")) % 2)
    states = states.withColumn("depth", sum_before(F.when(F.col("inside") == 1, F.col("quoted")).otherwise(F.col("plain"))))
    states = states.select("path", "start", "end", "inside", "depth")
    known = _by_block(states, f"{_BLOCK}, inside bigint, depth bigint, last_key string", keyed, tasks)
    known = known.withColumn("section", F.last("last_key", ignorenulls=True).over(before)).drop("last_key")
    rows = _by_block(known, "path string, section string, offset bigint, record string", cut, tasks)
    return rows.select(F.col("path").alias("file"), "section", "offset", "record")


def read_coco_records(spark: SparkSession, path: str, glob: str = "*.json", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``file`` and the fields of the images, and the same for annotations, of COCO documents of any size."""
    records = read_json_records(spark, path, glob, block)

    def section(name: str) -> DataFrame:
        fields = F.from_json("record", schemas.COCO[name].dataType.elementType)
        return records.filter(F.col("section") == name).select("file", fields.alias("r")).select("file", "r.*")

    return section("images"), section("annotations")


def read_xml_elements(spark: SparkSession, path: str, tag: str, schema: StructType) -> DataFrame:
    """One row per element ``tag`` of XML documents, cut at its end tags, so documents of any size are split over tasks.

    The elements do not hold one another, have an end tag of their own, and no end tag stands in a comment or CDATA section.
    """
    pieces = spark.read.option("lineSep", f"</{tag}>").text(path)
    start = F.regexp_instr("value", F.lit(rf"<{tag}[\s>]"))
    element = F.concat(F.substr("value", start), F.lit(f"</{tag}>"))
    return pieces.filter(start > 0).select(F.from_xml(element, schema).alias("r")).select("r.*")


def write_documents(pieces: DataFrame, path: str, order: list[str], name: str = "name", value: str = "value") -> int:
    """One file per name: its pieces, a line each, in order.  Returns the number of files.

    The pieces are sorted by range and written by Spark; then a task per file copies its parts, a few megabytes at a time,
    under a temporary name and moves the file when it is whole, so a repeated task replaces it.
    """
    spark = pieces.sparkSession
    parts = scratch_path(spark, "document-parts")
    ranged = pieces.repartitionByRange(name, *order).sortWithinPartitions(name, *order)
    ranged.select(F.col(name).alias("name"), F.col(value).alias("value")).write.partitionBy("name").text(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        target_system, root = _open(path)
        for batch in batches:
            for row in batch.to_pylist():
                target_system.create_dir(root, recursive=True)
                made = f"{root}/_{uuid.uuid4().hex}"
                with target_system.open_output_stream(made) as out:
                    for part in row["parts"]:
                        system, source = _open(part)
                        with system.open_input_stream(source) as lines:
                            while some := lines.read(_COPIED):
                                out.write(some)
                target_system.move(made, f"{root}/{row['name']}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    listed = list_files(spark, parts, "part-*")
    folder = F.replace(F.regexp_extract("path", r"/name=([^/]*)/[^/]*\z", 1), F.lit("+"), F.lit("%2B"))
    names = listed.groupBy(F.url_decode(folder).alias("name")).agg(F.sort_array(F.collect_list("path")).alias("parts"))
    n = max(1, listed.select(folder).distinct().count())
    made = names.repartition(n, "name").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    discard(spark, parts)
    return made


def write_coco_documents(images: DataFrame, annotations: DataFrame, path: str, split: str = "split") -> int:
    """``instances_<split>.json``: one valid COCO document per split, however large.

    Both frames have the columns of their records, with an ``id`` of its own for each, and the split.
    """
    shown = F.concat(F.lit("instances_"), F.col(split), F.lit(".json")).alias("name")

    def section(df: DataFrame, place: int) -> DataFrame:
        fields = [c for c in df.columns if c != split]
        return df.select(shown, F.lit(place).alias("place"), F.col("id").cast("bigint").alias("id"), F.to_json(F.struct(*fields)).alias("_r"))

    # the records are read three more times: for the first of each section, for the ranges and for their pieces
    records = materialize(section(images, 1).unionByName(section(annotations, 3)), "coco-records")
    # a row for each section of a document; a join by name would send a whole document to one task
    firsts = F.broadcast(records.groupBy("name", "place").agg(F.min("id").alias("_first")))
    line = F.concat(F.when(F.col("id") == F.col("_first"), "").otherwise(","), "_r")
    pieces = records.join(firsts, ["name", "place"]).select("name", "place", "id", line.alias("value"))
    names = records.select("name").distinct()
    frame = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(v).alias("value")) for p, v in ((0, '{"images": ['), (2, '], "annotations": ['), (4, "]}"))])
    frame = names.select("name", F.explode(frame).alias("f")).select("name", "f.place", F.lit(0).cast("bigint").alias("id"), "f.value")
    made = write_documents(frame.unionByName(pieces), path, ["place", "id"])
    discard(images.sparkSession, records)
    return made


def write_xml_documents(elements: DataFrame, path: str, order: list[str], root: str = "Annotations") -> int:
    """One document per ``name`` from rows ``name, xml`` and the columns of their order."""
    elements = materialize(elements, "xml-elements")
    tags = F.array(*[F.struct(F.lit(p).alias("_place"), F.lit(v).alias("xml")) for p, v in ((0, f"<{root}>"), (2, f"</{root}>"))])
    ends = elements.select("name").distinct().select("name", F.explode(tags).alias("e")).select("name", "e.*")
    rows = elements.withColumn("_place", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    made = write_documents(rows, path, ["_place", *order], value="xml")
    discard(elements.sparkSession, elements)
    return made
