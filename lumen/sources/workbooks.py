"""S2 (re-aimed): many ``.xlsx`` workbooks read in one job.

``binaryFile`` lists the files; ``mapInPandas`` opens one workbook per task
with the standard library (an .xlsx is a zip of XML parts) and emits its first
sheet as a long relation (path, row, column, value). The header names are a
small set collected once; a pivot by (path, row) then builds the wide table,
and the same text typing as the CSV reader applies. ``.xls`` is not read.
"""

from __future__ import annotations

import re
import sys
import zipfile
import xml.etree.ElementTree as ET
from datetime import datetime, timedelta
from io import BytesIO

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.sources.csv import infer_types, pandas_header

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
LONG_SCHEMA = "path string, row long, col int, name string, value string"

# Built-in number formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
DAY_ZERO = datetime(1899, 12, 30)

# Workers need no copy of this package.
for _module in (__name__, "lumen.sources.csv", "lumen.functions.exprs"):
    cloudpickle.register_pickle_by_value(sys.modules[_module])


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.findall("m:numFmts/m:numFmt", NS)
           if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\\\.', "", f.get("formatCode", "")), re.I)}
    return {i for i, xf in enumerate(root.findall("m:cellXfs/m:xf", NS)) if int(xf.get("numFmtId", 0)) in DATE_FORMATS | own}


def _first_sheet_cells(data: bytes):
    """Yield (row, col, text) of the first sheet of one workbook."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")))
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        sheet = wb.find("m:sheets/m:sheet", NS)
        rid = sheet.get(f"{{{NS['r']}}}id")
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels.findall("pr:Relationship", NS) if r.get("Id") == rid)
        target = target.lstrip("/")
        target = target if target.startswith("xl/") else "xl/" + target
        ws = ET.fromstring(z.read(target))
        dates = _date_styles(z)
        for r_i, row in enumerate(ws.iter(f"{{{NS['m']}}}row")):
            r_num = int(row.get("r", r_i + 1)) - 1
            for c in row.findall("m:c", NS):
                kind = c.get("t")
                v = c.find("m:v", NS)
                if kind == "s" and v is not None:
                    text = shared[int(v.text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
                elif kind == "b" and v is not None:
                    text = "True" if v.text == "1" else "False"
                elif v is not None and kind in (None, "n") and int(c.get("s", -1)) in dates:
                    text = str(DAY_ZERO + timedelta(seconds=round(float(v.text) * 86_400)))
                elif v is not None:
                    text = v.text
                else:
                    continue
                yield r_num, _col_index(c.get("r")), text


def _explode_workbooks(batches):
    """Cells with the name that their own workbook's header gives them."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            cells = list(_first_sheet_cells(bytes(content)))
            header = {c: v for r, c, v in cells if r == 0}
            names = pandas_header([header.get(i, "") for i in range(max((c for _, c, _ in cells), default=-1) + 1)])
            yield pd.DataFrame([(path, r, c, names[c], v) for r, c, v in cells],
                               columns=["path", "row", "col", "name", "value"])


def workbook_cells(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path, row, col, name, value) for the first sheet of every .xlsx matched."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path_glob)
             .select("path", "content"))
    return files.mapInPandas(_explode_workbooks, LONG_SCHEMA)


def read_workbooks(spark: SparkSession, path_glob: str, infer: bool = True) -> DataFrame:
    """The first sheet of each workbook, first row as header, stacked by
    column name: workbooks may order their columns differently, a column that
    one lacks is missing in its rows. Date cells are ``yyyy-mm-dd hh:mm:ss``."""
    cells = workbook_cells(spark, path_glob)
    # One row for each column of the result.
    found = cells.groupBy("name").agg(F.min(F.struct("path", "col")).alias("first")).orderBy("first", "name")
    names = [r["name"] for r in found.collect()]
    if not names:
        return spark.createDataFrame([], "_empty string").limit(0)
    places = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    body = cells.where(F.col("row") > 0).withColumn("place", places[F.col("name")])
    wide = body.groupBy("path", "row").pivot("place", list(range(len(names)))).agg(F.first("value"))
    wide = wide.select(*[F.col(f"`{i}`").alias(n) for i, n in enumerate(names)])
    return infer_types(wide) if infer else wide
