"""Feature and context tables as CSV, run records, digests."""

from __future__ import annotations

import csv
import functools
import io
import json
import platform
import zipfile
from importlib.metadata import version
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.settings import BINS
from treeline.sources.names import field_id

#: Identifiers stay text, since their leading zeroes matter.
FEATURE_SCHEMA = "Source string, File string, Class int, ID string, FieldID string, Type string, Altitude int, SensorToken string, TreeKey string, PointCount long, TreeHeight double, CorePointCount long, VRI double, GlobalPF50 double, CorePF50 double, TA50 double, PGF50 double, GridValidCells int, CPC90 double, " + ", ".join(f"p{k + 1} double" for k in range(BINS))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table with its identifiers as text and fields in their short form."""
    return read_csv(spark, path, FEATURE_SCHEMA).withColumn("FieldID", field_id(F.col("FieldID")))


def read_table(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A context table: CSV, with all columns as text, or a sheet of an XLSX workbook (by name or number), which is small by its kind."""
    if path.lower().endswith((".xlsx", ".xlsm")):
        rows = sheet_rows(spark.read.format("binaryFile").load(path).select("content").first()[0], sheet)
        names = [c or f"column{k}" for k, c in enumerate(rows[0])] if rows else []
        wide = [tuple((row + [None] * len(names))[: len(names)]) for row in rows[1:]]
        return spark.createDataFrame(wide, ", ".join(f"`{c}` string" for c in names) or "none string")
    if path.lower().endswith(".xls"):
        raise ValueError(f"Workbooks of the old binary kind can't be read: {path}")
    return spark.read.csv(path, header=True)


def sheet_rows(content: bytes, sheet: str | int = 0) -> list[list[str | None]]:
    """The cells of one sheet as text, row by row."""
    book, ns = zipfile.ZipFile(io.BytesIO(content)), {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    text = lambda node: "".join(t.text or "" for t in node.iterfind(".//m:t", ns))
    read = lambda name: ElementTree.fromstring(book.read(name))
    shared = [text(s) for s in read("xl/sharedStrings.xml").iterfind("m:si", ns)] if "xl/sharedStrings.xml" in book.namelist() else []
    sheets = read("xl/workbook.xml").findall(".//m:sheet", ns)
    chosen = [s for k, s in enumerate(sheets) if sheet in (k, s.get("name"))]
    if not chosen:
        raise ValueError(f"The workbook has no sheet {sheet}")
    targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
    target = targets[chosen[0].get(link)].lstrip("/")
    out = []
    for row in read(target if target.startswith("xl/") else f"xl/{target}").iterfind(".//m:row", ns):
        cells: dict[int, str | None] = {}
        for k, c in enumerate(row.iterfind("m:c", ns)):
            letters = "".join(x for x in c.get("r", "") if x.isalpha())
            place = functools.reduce(lambda n, x: 26 * n + ord(x) - 64, letters, 0) - 1 if letters else k
            value = c.find("m:v", ns)
            cells[place] = text(c) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
        out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return out


def rating_columns(rows: DataFrame, named: list[str] | None = None) -> list[str]:
    """The repeated ratings of a table: the named columns, or up to four whose names say so and that are half numbers, or else four that are mostly numbers."""
    if named:
        if missing := [c for c in named if c not in rows.columns]:
            raise ValueError(f"Rating columns that aren't there: {missing}")
        return named
    counts = rows.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{c}`").try_cast("double")).alias(f"c{k}") for k, c in enumerate(rows.columns)]).first()
    least = lambda share: max(5, int(share * counts["rows"]))
    numbers = {c: counts[f"c{k}"] for k, c in enumerate(rows.columns)}
    speaking = [c for c, n in numbers.items() if any(w in c.lower() for w in ("rating", "grade", "score", "hlb")) and n >= least(0.5)]
    found = speaking if len(speaking) >= 3 else [c for c, n in numbers.items() if n >= least(0.8)]
    if len(found) < 3:
        raise ValueError("Three repeated rating columns or more are needed; name them")
    return found[:4]


def shared_domain(rows: DataFrame, dataset: str) -> DataFrame:
    """The datasets of the two fields that also have clouds, by name."""
    return rows.where(F.upper(F.col(dataset).cast("string")).rlike("BTMS|BTMN"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One file of this name, for interchange of a result table; rows come to the driver part by part, and the table is small by its kind."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(rows.columns)
        out.writerows(["" if v is None else v for v in r] for r in rows.toLocalIterator())


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, sha256`` of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def run_record(path: str, command: str, settings: dict, inputs: DataFrame) -> None:
    """Settings, versions and input digests of a run, as JSON."""
    listed = {r["path"]: r["sha256"] for r in inputs.orderBy("path").toLocalIterator()}
    packages = {p: version(p) for p in ("pyspark", "numpy", "pandas", "pyarrow")}
    Path(path).write_text(json.dumps({"command": command, "python": platform.python_version(), "packages": packages, "settings": settings, "inputs": listed}, indent=2, sort_keys=True), encoding="utf-8")


def sensor_status(path: str, done: bool, reason: str = "") -> None:
    """The mark that says whether sensor results belong to this run."""
    Path(path).write_text(json.dumps({"status": "complete" if done else "skipped", "reason": reason}, indent=2), encoding="utf-8")


def sensor_done(path: str) -> bool:
    """Whether there is such a mark and it says so."""
    return Path(path).is_file() and json.loads(Path(path).read_text(encoding="utf-8")).get("status") == "complete"


def provenance(spark: SparkSession, path: str) -> dict:
    """A stored JSON document, such as the archive's provenance with its profile fingerprint."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
