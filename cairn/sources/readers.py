"""Readers of map elements, layer features, register lists, workbooks and entity documents. Files are fetched beforehand:
executors read them from the file system that Spark sees, and never call a service."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import ascii_slug, clean, decomposed_ascii, first_present

ELEMENTS = (
    "elements array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, "
    "geometry: array<struct<lat: double, lon: double>>, bounds: struct<minlat: double, minlon: double, maxlat: double, maxlon: double>, "
    "tags: map<string, string>>>"
)
#: What a region's map query asks for.
ELEMENT_FILTERS = (
    ("historic", None), ("tourism", "museum|gallery|artwork|viewpoint"), ("amenity", "theatre|marketplace|place_of_worship"), ("place", "neighbourhood"),
    ("man_made", None), ("waterway", None), ("natural", None), ("leisure", "park"), ("highway", "pedestrian"),
)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """One row an element of documents {"elements": [...]}; documents without the list give none."""
    return spark.read.schema(ELEMENTS).option("multiLine", True).json(path).select(F.inline("elements"))


def element_query(box: tuple[float, float, float, float], filters: tuple[tuple[str, str | None], ...] = ELEMENT_FILTERS, timeout: int = 60) -> str:
    """The query text for a box (south, west, north, east): every filter for nodes, ways and relations."""
    where = ",".join(map(str, box))
    tests = [f'["{key}"]' if values is None else f'["{key}"~"{values}"]' for key, values in filters]
    wanted = "\n".join(f"  {kind}{test}({where});" for test in tests for kind in ("node", "way", "relation"))
    return f"[out:json][timeout:{timeout}];\n(\n{wanted}\n);\nout body center geom tags;"


def features(spark: SparkSession, path: str, name_field: str | None, label: str) -> DataFrame:
    """feature_id, label, kind, coordinates (JSON), properties of a collection's features that have a geometry."""
    schema = "features array<struct<id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("features")).where("geometry is not null")
    prop = lambda key: clean(F.try_element_at("properties", F.lit(key)))
    own = F.when(clean(F.col("id")) != "0", clean(F.col("id")))
    named = [prop(name_field)] if name_field else []
    return rows.select(F.coalesce(own, prop("OBJECTID"), F.lit("")).alias("feature_id"), F.coalesce(*named, prop("HBDIST"), F.lit(label)).alias("label"), F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("coordinates"), "properties")


def point_features(rows: DataFrame) -> DataFrame:
    """Features that are points, with lon and lat."""
    at = F.from_json("coordinates", "array<double>")
    return rows.where("kind = 'Point'").withColumns({"lon": F.get(at, F.lit(0)), "lat": F.get(at, F.lit(1))})


def polygon_features(rows: DataFrame) -> DataFrame:
    """One row for each part of polygon and multipolygon features: its outer ring and its holes, as arrays of struct x, y."""
    one = F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("kind") == "Polygon", F.array(one)).otherwise(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    ring = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    found = rows.where("kind in ('Polygon', 'MultiPolygon')").withColumn("_part", F.explode(parts)).where("size(_part) > 0")
    holes = F.transform(F.slice("_part", F.lit(2), F.size("_part")), ring)
    return found.withColumns({"ring": ring(F.get("_part", F.lit(0))), "holes": holes}).drop("_part")


def national_register(spark: SparkSession, path: str) -> DataFrame:
    """Register rows of a CSV list that have a name and a state; the city as a slug."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*(c.strip().lstrip("﻿") for c in raw.columns))
    get = lambda c: clean(F.col(f"`{c}`")) if c in raw.columns else F.lit(None).cast("string")
    rows = raw.select(
        get("Ref#").alias("reference_number"), get("Property Name").alias("property_name"), get("State").alias("state"), get("County").alias("county"),
        ascii_slug(decomposed_ascii(F.coalesce(get("City"), F.lit("")))).alias("city"), get("Street & Number").alias("street_address"), get("Category of Property").alias("category_of_property"),
        get("Listed Date").alias("listed_date"), get("External Link").alias("external_link"), get("Other Names").alias("other_names"),
    )
    return rows.where("property_name is not null and state is not null")


def in_region(rows: DataFrame, state: str, city: str) -> DataFrame:
    return rows.where((F.upper("state") == state.upper()) & (F.col("city") == city))


def name_candidates() -> Column:
    """A register row's name and its other names."""
    others = F.filter(F.transform(F.split(F.coalesce("other_names", F.lit("")), "[;,]"), lambda n: F.trim(n)), lambda n: n != "")
    return F.concat(F.array("property_name"), others)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(cell: str) -> int:
    n = 0
    for c in re.sub("[^A-Z]", "", cell.upper()):
        n = n * 26 + ord(c) - 64
    return n


def _sheets(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Sheet, row number and cells by column of a workbook: rows that aren't all blank."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_LINK)].lstrip("/")
            root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
            for number, row in enumerate(root.iter(f"{_MAIN}row")):
                cells: dict[int, str] = {}
                for at, c in enumerate(row.iter(f"{_MAIN}c"), 1):
                    value = c.find(f"{_MAIN}v")
                    text = shared[int(value.text)] if c.get("t") == "s" and value is not None else "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                    cells[_column_number(c.get("r", "")) or at] = text.strip()
                if any(cells.values()):
                    yield sheet.get("name", ""), number, [cells.get(i, "") for i in range(1, max(cells) + 1)]


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """sheet, sheet_order, row, cells (map by header) of workbooks. A sheet's first row that isn't blank is its header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, order = [], {}
            for content in batch["content"]:
                headers: dict[str, list[str]] = {}
                for sheet, number, cells in _sheets(content):
                    order.setdefault(sheet, len(order))
                    if sheet not in headers:
                        headers[sheet] = cells
                    else:
                        out.append((sheet, order[sheet], number, dict(zip(headers[sheet], cells, strict=False))))
            yield pd.DataFrame(out, columns=["sheet", "sheet_order", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "sheet string, sheet_order int, row int, cells map<string, string>")


def _header(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def best_sheet(rows: DataFrame, wanted: list[list[str]]) -> DataFrame:
    """The rows of the sheet whose headers meet the most of the wanted lists; of equals the first."""
    keys = F.transform(F.map_keys("cells"), _header)
    score = sum((F.arrays_overlap(keys, F.array(*map(F.lit, w))).cast("int") for w in wanted), F.lit(0))
    best = rows.groupBy("sheet").agg(F.max(score).alias("score"), F.min("sheet_order").alias("sheet_order")).orderBy(F.col("score").desc(), "sheet_order").limit(1)
    return rows.join(best.select("sheet"), "sheet", "left_semi")


#: Headers under which a state register's fields are found, the first that has a value.
STATE_HEADERS = {
    "reference_number": ("Ref#", "Ref #", "SR#", "SR No.", "SR No", "Register Number", "Number", "Property ID"),
    "property_name": ("Property Name", "Name of Property", "Name", "Resource Name", "Historic Property"),
    "state": ("State", "STATE"),
    "county": ("County", "COUNTY"),
    "city": ("City", "City ", "Community", "Town"),
    "street_address": ("Street & Number", "Address", "Location"),
    "category_of_property": ("Category of Property", "Property Type", "Type"),
    "listed_date": ("Listed Date", "Listing Date", "Date Listed", "STATE\nREGISTER", "STATE REGISTER"),
    "external_link": ("External Link",),
    "other_names": ("Other Names", "Alternate Name", "Alias"),
    "state_register_year": ("STATE\nREGISTER", "STATE REGISTER"),
}


def state_register(rows: DataFrame, state: str = "NEW MEXICO") -> DataFrame:
    """Register rows of a sheet that have a name and a year in the state's register."""
    out = rows.select(*(first_present(*(F.try_element_at("cells", F.lit(h)) for h in hs)).alias(k) for k, hs in STATE_HEADERS.items()))
    out = out.withColumns({"city": ascii_slug(decomposed_ascii(F.coalesce("city", F.lit("")))), "state": F.coalesce("state", F.lit(state))})
    return out.where("property_name is not null and state_register_year is not null")


def entities(spark: SparkSession, path: str) -> DataFrame:
    """entity_id, label, description, title of {"entities": {...}} documents: English if there is any, else the first language."""
    value = "map<string, struct<value: string>>"
    schema = f"entities map<string, struct<labels: {value}, descriptions: {value}, sitelinks: map<string, struct<title: string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("entities").alias("entity_id", "e"))

    def pick(field: str) -> Column:
        values = F.filter(F.transform(F.map_values(f"e.{field}"), lambda v: v["value"]), lambda v: v != "")
        return F.coalesce(F.nullif(F.try_element_at(f"e.{field}", F.lit("en"))["value"], F.lit("")), F.get(values, F.lit(0)))

    return rows.select("entity_id", pick("labels").alias("label"), pick("descriptions").alias("description"), F.replace(F.try_element_at("e.sitelinks", F.lit("enwiki"))["title"], F.lit(" "), F.lit("_")).alias("title"))


def entity_id(tag: Column) -> Column:
    """An entity's id from a tag; null unless it is one."""
    t = F.trim(tag)
    return F.when(t.startswith("Q"), t)


def article_title(tag: Column) -> Column:
    """An article's title from a tag with or without its language."""
    return F.replace(F.regexp_replace(F.trim(tag), "^[^:]*:", ""), F.lit(" "), F.lit("_"))


_EXPECTED = "expected_empty boolean, expected_any_names array<string>, forbidden_names array<string>, preferred_top_names array<string>, required_preferred_top_names_count int, min_results int, max_results int"
_CASES = (
    "cases array<struct<id string, label string, mode string, purpose string, category string, theme string, travel_mode string, region_hint string, limit int, center struct<lat: double, lon: double>, "
    f"radius_meters int, route_geometry struct<type: string, coordinates: array<array<double>>>, max_detour_meters int, max_extra_minutes int, expectations struct<{_EXPECTED}>>>"
)
_FIXTURES = (
    "fixtures array<struct<name string, description string, request struct<route_geometry struct<type: string, coordinates: array<array<double>>>, travel_mode string, category string, theme string, "
    "max_detour_meters int, max_extra_minutes int, region_hint string, limit int>, expected_non_empty boolean, expected_any_names array<string>, forbidden_names array<string>>>"
)


def _line(geometry: Column) -> Column:
    return F.transform(geometry["coordinates"], lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of JSON files as operators.evaluation takes them, with label and purpose. A limit that isn't given is 5; lists that aren't given are null, which expects nothing. A file without cases gives no rows."""
    c = spark.read.schema(_CASES).option("multiLine", True).json(path).select(F.inline("cases"))
    e = F.col("expectations")
    return c.select(
        F.col("id").alias("case_id"), "label", "purpose", F.col("mode").alias("kind"), F.col("center.lon").alias("lon"), F.col("center.lat").alias("lat"), F.col("radius_meters").alias("radius_m"),
        _line(F.col("route_geometry")).alias("line"), F.col("max_detour_meters").alias("max_detour_m"), F.col("max_extra_minutes").alias("max_extra_min"), "category", F.col("travel_mode").alias("mode"), "theme",
        F.col("region_hint").alias("city"), F.coalesce("limit", F.lit(5)).alias("limit"), F.coalesce(e["expected_empty"], F.lit(False)).alias("expect_empty"), e["expected_any_names"].alias("expected"),
        e["forbidden_names"].alias("forbidden"), e["preferred_top_names"].alias("preferred"), e["required_preferred_top_names_count"].alias("required_preferred"), e["min_results"].alias("least"), e["max_results"].alias("most"),
    )


def route_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """The older files of routes alone, in the columns of evaluation_cases: a route that expects results needs one of them."""
    c = spark.read.schema(_FIXTURES).option("multiLine", True).json(path).select(F.inline("fixtures"))
    r, none = F.col("request"), lambda t: F.lit(None).cast(t)
    filled = F.coalesce("expected_non_empty", F.lit(True))
    return c.select(
        F.col("name").alias("case_id"), F.col("name").alias("label"), F.col("description").alias("purpose"), F.lit("route").alias("kind"), none("double").alias("lon"), none("double").alias("lat"), none("int").alias("radius_m"),
        _line(r["route_geometry"]).alias("line"), r["max_detour_meters"].alias("max_detour_m"), r["max_extra_minutes"].alias("max_extra_min"), r["category"].alias("category"), r["travel_mode"].alias("mode"), r["theme"].alias("theme"),
        r["region_hint"].alias("city"), F.coalesce(r["limit"], F.lit(5)).alias("limit"), (~filled).alias("expect_empty"), F.col("expected_any_names").alias("expected"),
        F.col("forbidden_names").alias("forbidden"), none("array<string>").alias("preferred"), none("int").alias("required_preferred"), none("int").alias("least"), none("int").alias("most"),
    )
