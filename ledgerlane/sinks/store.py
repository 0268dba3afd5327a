"""Tables of decisions and their exports: records by batch as Parquet, CSV and workbook files."""

from __future__ import annotations

import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import carry_review_state


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def _versions(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame | None:
    """The current version of each batch (or the one as of a number) and the last whole one up to it, from the log of finished writes."""
    log = _read_if_there(spark, f"{path}/versions")
    if log is not None and as_of is not None:
        log = log.filter(F.col("version") <= as_of)
    return None if log is None else log.groupBy("batch_id").agg(F.max("version").alias("version"), F.max(F.when(~_is_delta(log), F.col("version"))).alias("whole"))


def _is_delta(log: DataFrame) -> Column:
    return F.coalesce("delta", F.lit(False)) if "delta" in log.columns else F.lit(False)


def save_records(results: DataFrame, path: str, batch_id: str) -> None:
    """Replace a batch's decisions, carrying over the review states set before. Other batches aren't touched.

    A save is a new version of the batch: its rows are written first, and then one row to the log of versions, which
    makes it current. What was read before stays there, and a save that is cut off changes nothing. One writer a batch.
    """
    spark = results.sparkSession
    new = results.withColumns({"batch_id": F.lit(batch_id), "review_state": F.lit("OPEN"), "processed_at": F.current_timestamp()})
    known = _versions(spark, path)
    last = None if known is None else known.filter(F.col("batch_id") == batch_id).first()
    if last is None:
        old = spark.createDataFrame([], "batch_id string, record_id string, review_state string")
    else:
        old = read_records(spark, path, batch_id).select("batch_id", "record_id", "review_state")
    write_version(carry_review_state(new, old), path, batch_id, 1 if last is None else last.version + 1)


def upsert_records(results: DataFrame, path: str, batch_id: str) -> None:
    """Replace the decisions of some of a batch's records, carrying over their review states.

    Only these rows are written, as a version that changes the one before it; reading takes each record's last row. ``compact``
    writes the batch as a whole again. One writer a batch.
    """
    spark = results.sparkSession
    last = version_of(spark, path, batch_id)
    new = results.withColumns({"batch_id": F.lit(batch_id), "review_state": F.lit("OPEN"), "processed_at": F.current_timestamp()})
    if last:
        old = read_records(spark, path, batch_id).select("batch_id", "record_id", "review_state").join(results.select("record_id").distinct(), "record_id", "left_semi")
    else:
        old = spark.createDataFrame([], "batch_id string, record_id string, review_state string")
    write_version(carry_review_state(new, old), path, batch_id, last + 1, delta=last > 0)


def compact(spark: SparkSession, path: str, batch_id: str) -> None:
    """A batch's current rows as one whole version."""
    write_version(read_records(spark, path, batch_id), path, batch_id, version_of(spark, path, batch_id) + 1)


def write_version(rows: DataFrame, path: str, batch_id: str, version: int, delta: bool = False) -> None:
    rows.withColumns({"batch_id": F.lit(batch_id), "version": F.lit(version).cast("long")}).write.mode("append").partitionBy("batch_id", "version").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(batch_id, version, delta)], "batch_id string, version long, delta boolean").coalesce(1).write.mode("append").parquet(f"{path}/versions")


def save_review_states(records: DataFrame, path: str, batch_id: str) -> None:
    """Store a batch's records with the review states that they have now, as its next version."""
    last = _versions(records.sparkSession, path).filter(F.col("batch_id") == batch_id).first()
    write_version(records, path, batch_id, last.version + 1)


def read_records(spark: SparkSession, path: str, batch_id: str | None = None, as_of: int | None = None) -> DataFrame:
    """The current rows of all batches, or of one; or those as of a version's number."""
    versions = _versions(spark, path, as_of)
    if versions is None:
        raise FileNotFoundError(f"no records at {path}")
    # The rows' folders are named by text, which Spark may read as numbers.
    rows = spark.read.option("mergeSchema", True).parquet(f"{path}/rows").withColumn("batch_id", F.col("batch_id").cast("string"))
    if batch_id:
        versions = versions.filter(F.col("batch_id") == batch_id)
        rows = rows.filter(F.col("batch_id") == batch_id)
    known = rows.join(F.broadcast(versions.withColumnRenamed("version", "_last")), "batch_id").filter((F.col("version") >= F.coalesce("whole", F.lit(0))) & (F.col("version") <= F.col("_last")))
    if versions.filter(F.coalesce("whole", F.lit(0)) < F.col("version")).isEmpty():
        return known.drop("version", "_last", "whole")
    # Versions that change others: the last row of each record.
    kept = [c for c in rows.columns if c not in ("batch_id", "record_id", "version")]
    newest = known.groupBy("batch_id", "record_id").agg(F.max_by(F.struct(*kept), "version").alias("_r"))
    return newest.select("batch_id", "record_id", "_r.*").select(*[c for c in rows.columns if c != "version"])


def version_of(spark: SparkSession, path: str, batch_id: str) -> int:
    """The number of a batch's current version; 0 where nothing is stored."""
    known = _versions(spark, path)
    last = None if known is None else known.filter(F.col("batch_id") == batch_id).first()
    return 0 if last is None else last.version


def export_rows(results: DataFrame) -> DataFrame:
    """The flat export table of decisions, refused candidates as text."""
    refused = F.array_join(F.transform(F.filter("considered_candidates", lambda c: ~c.admissible), lambda c: F.concat(c.payment_id, F.lit(" ("), c.admissibility_reason, F.lit(")"))), "; ")
    return results.select(
        "record_id", "order_id", "reference_id", "amount_minor", "currency", F.to_date("order_date").cast("string").alias("order_date"), "status", "description", "outcome", "classification", "exception_type", "severity",
        "matched_payment_id", "candidate_count", "ai_invoked", "ai_confidence", F.coalesce(refused, F.lit("")).alias("rejected_candidates"), "reason", "recommended_action",
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def _column(k: int) -> str:
    name = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        name = chr(65 + r) + name
    return name


def write_workbook(rows: DataFrame, path: str, sheet: str = "Export", measured: int = 400, max_rows: int = 1_048_575) -> int:
    """One sheet with a bold, frozen, filtered header and widths by content. Rows stream through the driver one by one."""
    names, widths, count = rows.columns, [len(c) for c in rows.columns], 0
    cell = lambda k, n, value, style="": f'<c r="{_column(k)}{n}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    body = Path(f"{path}.rows")
    with body.open("w", encoding="utf-8") as out:
        for row in rows.toLocalIterator():
            if count == max_rows:
                raise ValueError(f"a sheet holds {max_rows} rows")
            count += 1
            if count <= measured:
                widths = [max(w, len(str(v))) if v is not None else w for w, v in zip(widths, row, strict=True)]
            out.write(f'<row r="{count + 1}">' + "".join(cell(k, count + 1, v) for k, v in enumerate(row) if v is not None) + "</row>")
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    columns = "".join(f'<col min="{k}" max="{k}" width="{min(52, max(10, w + 2))}" customWidth="1"/>' for k, w in enumerate(widths, 1))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            header = "".join(cell(k, 1, n, ' s="1"') for k, n in enumerate(names))
            out.write(f'<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>{columns}</cols><sheetData><row r="1">{header}</row>'.encode())
            with body.open("rb") as lines:
                while chunk := lines.read(1 << 20):
                    out.write(chunk)
            out.write(f'</sheetData><autoFilter ref="A1:{_column(len(names) - 1)}{count + 1}"/></worksheet>'.encode())
    body.unlink()
    return count
