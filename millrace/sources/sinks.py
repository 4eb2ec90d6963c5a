"""Sinks: CSV, JSON document, XLSX (standard library only), run summary, append of usage events."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An XLSX sheet holds this many rows, so the writer refuses more; larger exports go to CSV or Parquet.
XLSX_ROWS = 1_048_575


def write_csv(rows: DataFrame, path: str) -> None:
    """Distributed CSV with a header, ordered by name within the files."""
    rows.sortWithinPartitions(F.asc_nulls_last("name"), "id").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)


def company_documents(rows: DataFrame) -> DataFrame:
    """(company, document): one JSON document per company with its people by name."""
    person = F.struct(F.coalesce("name", F.lit("")).alias("name"), *[c for c in rows.columns if c not in ("name", "company")])
    grouped = rows.groupBy("company").agg(F.count(F.lit(1)).alias("people_count"), F.array_sort(F.collect_list(person)).alias("people"))
    return grouped.select("company", F.to_json(F.struct("company", "people_count", "people")).alias("document"))


def _cell(value, column: int, row: int, style: int = 0) -> str:
    name, n = "", column
    while n >= 0:
        name, n = chr(65 + n % 26) + name, n // 26 - 1
    return f'<c r="{name}{row}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape("" if value is None else str(value))}</t></is></c>'


def write_xlsx(rows: DataFrame, path: str, sheet: str = "People", widths: list[int] | None = None) -> int:
    """An XLSX file from an ordered, streamed result, with a bold heading, wrapped cells and column widths; returns the number of rows."""
    columns, n = rows.columns, 0
    kind = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{kind}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{kind}/package/2006/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{kind}/spreadsheetml/2006/main" xmlns:r="{kind}/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet[:31])}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{kind}/package/2006/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{kind}/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{kind}/spreadsheetml/2006/main"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<?xml version="1.0"?><worksheet xmlns="{kind}/spreadsheetml/2006/main">'.encode())
            if widths:
                out.write(("<cols>" + "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1)) + "</cols>").encode())
            out.write(b"<sheetData>")
            out.write(("<row r=\"1\">" + "".join(_cell(c, i, 1, 1) for i, c in enumerate(columns)) + "</row>").encode())
            for r in rows.orderBy(F.asc_nulls_last("name"), "id").toLocalIterator():
                n += 1
                if n > XLSX_ROWS:
                    raise ValueError(f"more than {XLSX_ROWS} rows; write CSV instead")
                out.write((f'<row r="{n + 1}">' + "".join(_cell(v, i, n + 1) for i, v in enumerate(r)) + "</row>").encode())
            out.write(b"</sheetData></worksheet>")
    return n


def pack_files(files: dict[str, bytes], path: str) -> None:
    """A ZIP of an export and photos, whose names the caller made."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(Path(name).name, data)


def flatten_records(records: DataFrame) -> DataFrame:
    """Records (pos, record map<string, string>) as a flat table: its columns are all keys, in the order they are first seen.

    The keys of a run are a heading, so they are few; only they come to the driver.
    """
    keys = records.select("pos", F.posexplode(F.map_keys("record")).alias("at", "key")).groupBy("key").agg(F.min(F.struct("pos", "at")).alias("first"))
    names = [r["key"] for r in keys.orderBy("first").collect()]
    return records.select("pos", *[F.col("record")[k].alias(k) for k in names])


def run_document(records: DataFrame, url: str, meta: dict[str, str]) -> DataFrame:
    """One JSON line a record beside a first line with address, notes and count, so that no run becomes one huge value."""
    head = records.agg(F.count(F.lit(1)).alias("count")).select(F.lit(-1).cast("long").alias("pos"), F.to_json(F.struct(F.lit(url).alias("url"), F.lit(json.dumps(meta, sort_keys=True)).alias("meta"), "count")).alias("line"))
    return head.unionByName(records.select(F.col("pos").cast("long").alias("pos"), F.to_json("record").alias("line")))


def with_metadata(events: DataFrame, columns: list[str]) -> DataFrame:
    """Events with the named columns packed into one JSON text ``metadata``; null ones are left out."""
    return events.withColumn("metadata", F.to_json(F.struct(*columns))).drop(*columns)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def run_summary(results: DataFrame) -> DataFrame:
    """(status, sites, records) of a run from (url, status, records)."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("sites"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))
