"""Map extracts (`elements` JSON) as addresses, named ways and entrances."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import address

ELEMENT = (
    "type string, id bigint, lat double, lon double, "
    "center struct<lat: double, lon: double>, tags map<string, string>, "
    "geometry array<struct<lat: double, lon: double>>"
)
DOCUMENT = f"elements array<struct<{ELEMENT}>>"
LABEL_TAGS = ["name", "ref", "loc_name", "description"]


def read_elements(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Elements of whole-document extracts, or of one-element-per-line files.

    A document is one JSON value and so one task; `read_divided` reads a large
    one by several.
    """
    if lines:
        return spark.read.schema(ELEMENT).json(path)
    docs = spark.read.option("multiLine", True).schema(DOCUMENT).json(path)
    return docs.select(F.inline("elements"))


# --- one large document by several tasks --------------------------------------------------

#: Objects lie at this depth: in the root object, in its list of elements.
_INSIDE = 2
_MARKS = re.compile(r'["{}\[\]\\]')


def _scan(piece: str, quoted: bool, depth: int, cuts: list[tuple[int, int]] | None = None) -> tuple[bool, int, int]:
    """(in a string, depth, elements begun) after a piece; `cuts` gets (place, +1 or -1) where an element opens or closes."""
    begun, skip = 0, -1
    for m in _MARKS.finditer(piece):
        at, c = m.start(), m[0]
        if at == skip:
            continue
        if quoted:
            if c == "\\":
                skip = at + 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            if c == "{" and depth == _INSIDE:
                begun += 1
                if cuts is not None:
                    cuts.append((at, 1))
            depth += 1
        elif c in "}]":
            depth -= 1
            if c == "}" and depth == _INSIDE and cuts is not None:
                cuts.append((at + 1, -1))
    return quoted, depth, begun


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, str]]:
    """(block, whether it is new, piece with its brace) of the rows of a task; a block's rows follow one another."""
    last = None
    for b in batches:
        for path, start, value in zip(*(b.column(c).to_pylist() for c in ("path", "start", "value")), strict=True):
            yield (path, start), (path, start) != last, value + "}"
            last = path, start


def read_divided(spark: SparkSession, path: str) -> DataFrame:
    """Elements of whole-document extracts, each document read in as many blocks as Spark cuts its file into.

    Text is cut at closing braces, so blocks begin behind one. What a block
    does to the reader's state (in a string or not, depth) is found for both
    ways it may begin; one row a block is enough to know how each begins. Then
    every block yields the elements in it, and the two parts of an element that
    a border divides are put together. Documents are an object with one list
    of objects, `elements`, and nothing but values beside it; a document that is
    cut off yields its whole elements.
    """
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Depth is only a difference here: whether a brace opens an element is known in the second pass.
        key, ends = None, []

        def row() -> pa.RecordBatch:
            (q0, d0), (q1, d1) = ends
            return pa.RecordBatch.from_pylist([{"path": key[0], "start": key[1], "q0": q0, "d0": d0, "q1": q1, "d1": d1}], schema)

        for block, new, piece in _runs(batches):
            if new:
                if key is not None:
                    yield row()
                key, ends = block, [(False, 0), (True, 0)]
            ends = [_scan(piece, q, d)[:2] for q, d in ends]
        if key is not None:
            yield row()

    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("q0", pa.bool_()), ("d0", pa.int64()), ("q1", pa.bool_()), ("d1", pa.int64())])
    blocks = text.mapInArrow(effects, "path string, start long, q0 boolean, d0 long, q1 boolean, d1 long")
    begins: dict[tuple[str, int], tuple[bool, int]] = {}
    state, before = (False, 0), None
    for r in blocks.orderBy("path", "start").collect():        # one row a block
        if r.path != before:
            state, before = (False, 0), r.path
        begins[r.path, r.start] = state
        state = (r.q1, state[1] + r.d1) if state[0] else (r.q0, state[1] + r.d0)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quoted, depth, part, number, out = False, 0, "", 0, []
        key = None
        for block, new, piece in _runs(batches):
            if new:
                if key is not None and depth > _INSIDE:
                    out.append((*key, number, part, True))
                key, (quoted, depth), part, number = block, begins[block], "", 0
            cuts: list[tuple[int, int]] = []
            inside = depth > _INSIDE
            quoted, depth, _ = _scan(piece, quoted, depth, cuts)
            at = 0
            for place, way in cuts:
                if way > 0:
                    at, inside = place, True
                else:
                    out.append((*block, number, part + piece[at:place], False))
                    part, at, inside, number = "", place, False, number + 1
            if inside:
                part += piece[at:]
            if len(out) >= 1000:
                yield _rows(out)
        if key is not None and depth > _INSIDE:
            out.append((*key, number, part, True))
        if out:
            yield _rows(out)

    found = text.mapInArrow(elements, "path string, start long, number int, value string, open boolean")
    # The first of a block may be the end of what the block before left open, and so on.
    edge = (F.col("number") == 0) | F.col("open")
    w = Window.partitionBy("path").orderBy("start", "number")            # a few rows a block
    ends = found.where(edge).withColumn("group", F.coalesce(F.sum(F.when(~F.col("open"), 1).otherwise(0)).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = ends.groupBy("path", "group").agg(F.array_sort(F.collect_list(F.struct("start", "number", "value"))).alias("parts"))
    whole = found.where(~edge).select("value").unionByName(joined.select(F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value")))
    return whole.select(F.from_json("value", ELEMENT).alias("e")).select("e.*").where("type is not null")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_()), strict=True)],
                                      ["path", "start", "number", "value", "open"])


# --- elements as tables -----------------------------------------------------------------------


def parse_elements(raw: DataFrame, column: str = "value") -> DataFrame:
    """Elements of JSON documents held in a text column."""
    doc = F.from_json(F.col(column), DOCUMENT)
    return raw.select(F.inline(doc["elements"]))


def _tag(name: str):
    return F.trim(F.coalesce(F.try_element_at("tags", F.lit(name)), F.lit("")))


def addresses(elements: DataFrame) -> DataFrame:
    """Elements with house number, street and a point or centre."""
    house, street = _tag("addr:housenumber"), _tag("addr:street")
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    lat = F.when(both, F.col("lat")).otherwise(F.col("center.lat"))
    lon = F.when(both, F.col("lon")).otherwise(F.col("center.lon"))
    raw = F.concat(house, F.lit(" "), street)
    return (
        elements.where((house != "") & (street != ""))
        .select("id", address(raw).alias("normalized"), raw.alias("raw"),
                lat.alias("lat"), lon.alias("lon"))
        .where((F.col("normalized") != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    )


def ways(elements: DataFrame) -> DataFrame:
    """Named ways with at least two points."""
    return elements.where(
        (F.col("type") == "way") & (_tag("name") != "") & (F.size("geometry") >= 2)
    ).select(F.col("id").alias("way_id"), _tag("name").alias("name"), "geometry")


def entrances(elements: DataFrame) -> DataFrame:
    """Entrance nodes with the first non-empty of the label tags."""
    label = F.coalesce(*[F.nullif(_tag(t), F.lit("")) for t in LABEL_TAGS], F.lit(""))
    return elements.where(
        (F.col("type") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    ).select(F.col("id").alias("entrance_id"), label.alias("label"), "lat", "lon")


READERS = {"addresses": addresses, "ways": ways, "entrances": entrances}


def read_osm(spark: SparkSession, path: str, kind: str, lines: bool = False, divided: bool = False) -> DataFrame:
    return READERS[kind](read_divided(spark, path) if divided else read_elements(spark, path, lines))


def parse_landmarks(raw: DataFrame, column: str = "value") -> DataFrame:
    """(name, lat, lon) from JSON maps name -> [lat, lon]."""
    m = F.from_json(F.col(column), "map<string,array<double>>")
    return raw.select(F.explode(m).alias("name", "p")).select(
        "name", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon"))


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    return parse_landmarks(spark.read.text(path, wholetext=True))
