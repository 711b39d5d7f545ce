"""Existing lines: features of a GeoJSON collection in, filtered layers out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for nothing.
NOTHING = ["", "NOT AVAILABLE", "NOT APPLICABLE", "UNKNOWN", "N/A", "NONE"]
VERTEX = "array<struct<lng: double, lat: double>>"
PROPERTIES = "ID: string, TYPE: string, STATUS: string, OWNER: string, VOLTAGE: double, VOLT_CLASS: string, INFERRED: string, SUB_1: string, SUB_2: string, SOURCEDATE: bigint, VAL_DATE: bigint"
FEATURE = f"struct<properties: struct<{PROPERTIES}>, geometry: struct<type: string, coordinates: string>>"


def some_text(column: Column) -> Column:
    text = F.trim(column)
    return F.when(~F.upper(text).isin(NOTHING), text)


def epoch_date(ms: Column) -> Column:
    return F.when(ms > 0, F.to_date(F.timestamp_millis(ms)))


def paths(kind: Column, coordinates: Column) -> Column:
    """Vertices of each path of a LineString or MultiLineString, from the text of its coordinates."""
    one = F.array(F.from_json(coordinates, "array<array<double>>"))
    many = F.from_json(coordinates, "array<array<array<double>>>")
    return F.transform(F.when(kind == "LineString", one).otherwise(many), lambda p: F.transform(p, lambda v: F.struct(v[0].alias("lng"), v[1].alias("lat"))))


def read_lines(collections: DataFrame) -> DataFrame:
    """Texts of feature collections (text) to lines; features that are no lines or have no id are left out, of one id the first stays."""
    schema = f"struct<features: array<{FEATURE}>>"
    rows = collections.select(F.col("text"), F.monotonically_increasing_id().alias("file_")).select("file_", F.posexplode(F.from_json("text", schema)["features"]).alias("at_", "f"))
    p = lambda c: F.col(f"f.properties.{c}")
    kind = F.col("f.geometry.type")
    rows = rows.where(kind.isin("LineString", "MultiLineString") & some_text(p("ID")).isNotNull())
    lines = rows.select(
        F.struct("file_", "at_").alias("place_"), F.trim(p("ID")).alias("id"), some_text(p("OWNER")).alias("owner"), F.upper(some_text(p("OWNER"))).alias("owner_norm"),
        F.when(p("VOLTAGE") > 0, p("VOLTAGE")).alias("kv"), some_text(p("VOLT_CLASS")).alias("volt_class"), some_text(p("STATUS")).alias("status"), some_text(p("TYPE")).alias("line_type"),
        F.when(p("INFERRED") == "Y", True).when(p("INFERRED") == "N", False).alias("inferred"), some_text(p("SUB_1")).alias("sub_1"), some_text(p("SUB_2")).alias("sub_2"),
        epoch_date(p("SOURCEDATE")).alias("source_date"), epoch_date(p("VAL_DATE")).alias("val_date"), paths(kind, F.col("f.geometry.coordinates")).alias("geom"),
    )
    names = [c for c in lines.columns if c not in ("place_", "id")]
    first = lines.groupBy("id").agg(F.min_by(F.struct(*names), "place_").alias("x"))
    return first.select("id", "x.*")


def with_box(lines: DataFrame) -> DataFrame:
    vertices = F.flatten("geom")
    of = lambda f, c: f(F.transform(vertices, lambda v: v[c]))
    return lines.withColumns({"west": of(F.array_min, "lng"), "south": of(F.array_min, "lat"), "east": of(F.array_max, "lng"), "north": of(F.array_max, "lat")})


def filter_lines(lines: DataFrame, box: tuple[float, float, float, float] | None = None, min_kv: float | None = None, owners: list[str] | None = None) -> DataFrame:
    """Lines whose envelope meets ``box`` (west, south, east, north), of at least ``min_kv`` and of one of ``owners``; a line without a voltage fails the second."""
    if box is not None:
        west, south, east, north = box
        if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
            raise ValueError("a box is west, south, east, north in degrees")
        lines = with_box(lines).where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)).drop("west", "south", "east", "north")
    if min_kv is not None:
        lines = lines.where(F.col("kv") >= min_kv)
    return lines if owners is None else lines.where(F.col("owner_norm").isin([o.strip().upper() for o in owners]))


#: Degrees by which a simplified line may leave the one it stands for.
TOLERANCE = 0.0002


def kept_vertices(path: list[tuple[float, float]], tolerance: float) -> list[int]:
    """Places of the vertices of a path that stay: its ends, and between two that stay the farthest of those farther than the tolerance from the way between."""
    stay, spans = {0, len(path) - 1}, [(0, len(path) - 1)]
    while spans:
        a, b = spans.pop()
        (x0, y0), (x1, y1) = path[a], path[b]
        dx, dy = x1 - x0, y1 - y0
        size, far, at = dx * dx + dy * dy, tolerance * tolerance, None
        for i in range(a + 1, b):
            x, y = path[i][0] - x0, path[i][1] - y0
            t = max(0.0, min(1.0, (x * dx + y * dy) / size)) if size else 0.0
            off = (x - t * dx) ** 2 + (y - t * dy) ** 2
            if off > far:
                far, at = off, i
        if at is not None:
            stay.add(at)
            spans += [(a, at), (at, b)]
    return sorted(stay)


def simplify(lines: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Lines (id, geom: paths of lng, lat, ...) with the vertices that a tolerance in degrees asks for; ends stay, empty paths are left out.

    One line is worked on at a time; equal ids keep their own rows.
    """
    schema = lines.select("id", "geom").schema

    def thin(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for geom in b.column("geom").to_pylist():
                paths = [[(v["lng"], v["lat"]) for v in path] for path in geom or [] if path]
                out.append(None if geom is None else [[{"lng": p[i][0], "lat": p[i][1]} for i in kept_vertices(p, tolerance)] for p in paths])
            columns = [pa.array(out, b.schema.field("geom").type) if f.name == "geom" else b.column(f.name) for f in b.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return lines.mapInArrow(thin, lines.schema) if len(lines.columns) > 2 else lines.select("id", "geom").mapInArrow(thin, schema)


def features(lines: DataFrame) -> DataFrame:
    """Each line as the text of a feature (id, kv, feature), vertices to five places; a collection is these in the order of kV, nulls first, then id."""
    rounded = F.transform("geom", lambda path: F.transform(path, lambda v: F.array(F.round(v["lng"], 5), F.round(v["lat"], 5))))
    shape = F.struct(F.lit("MultiLineString").alias("type"), rounded.alias("coordinates"))
    shown = F.struct(*[F.col(c) for c in lines.columns if c != "geom" and not isinstance(lines.schema[c].dataType, (T.ArrayType, T.StructType))])
    return lines.select("id", "kv", F.to_json(F.struct(F.lit("Feature").alias("type"), shown.alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"}).alias("feature"))


def collections(lines: DataFrame, by: str) -> DataFrame:
    """The features of each group as the text of one collection, by kV, nulls first, then id: the group, n, collection."""
    own = lines.select("id", F.col(by).alias("group_")).distinct().join(features(lines), "id")
    order = F.struct(F.col("kv").isNotNull().alias("has"), "kv", "id", "feature")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["feature"]), ",")
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), listed, F.lit("]}"))
    return own.groupBy(F.col("group_").alias(by)).agg(F.count(F.lit(1)).alias("n"), text.alias("collection"))


def in_list_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy(F.col("kv").asc_nulls_first(), "id")


def replace_lines(lines: DataFrame, path: str) -> DataFrame:
    """The whole layer swapped: written as a new table over the old one."""
    lines.write.mode("overwrite").parquet(path)
    return lines.sparkSession.read.parquet(path)


def load_if_empty(spark: SparkSession, lines: DataFrame, path: str) -> DataFrame:
    """The stored layer if it has any row, else ``lines``, stored."""
    from pyspark.errors import AnalysisException

    try:
        there = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return replace_lines(lines, path)
    return replace_lines(lines, path) if there.isEmpty() else there
