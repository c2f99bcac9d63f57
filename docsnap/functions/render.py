"""Documents and actions as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsnap.schema import FILE, PATH


def iso_utc(moment: Column) -> Column:
    """ISO text in UTC, whatever the zone of the session; a fraction only where there is one."""
    micros = F.unix_micros(moment)
    seconds = F.make_dt_interval(secs=F.floor(micros / 1_000_000))
    wall = (F.expr("timestamp_ntz '1970-01-01 00:00:00'") + seconds).cast("string")
    fraction = F.pmod(micros, F.lit(1_000_000)).cast("string")
    return F.concat(
        F.translate(wall, " ", "T"),
        F.when(fraction != "0", F.concat(F.lit("."), F.lpad(fraction, 6, "0"))).otherwise(""),
        F.lit("+00:00"),
    )


def base64_text(data: Column) -> Column:
    """Base64 on one line."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def document_json(doc: Column) -> Column:
    """The nested document without its nulls; a folder document has only its path."""
    file = doc.getField("file")
    dates = {f.name for f in FILE.fields if f.dataType.typeName() == "timestamp"}
    file_fields = [
        (iso_utc(file.getField(n)) if n in dates else file.getField(n)).alias(n)
        for n in FILE.fieldNames()
    ]
    path = doc.getField("path")
    return F.to_json(
        F.struct(
            F.when(file.isNotNull(), F.struct(*file_fields)).alias("file"),
            F.struct(*[path.getField(n).alias(n) for n in PATH.fieldNames()]).alias("path"),
            doc.getField("meta").alias("meta"),
            doc.getField("content").alias("content"),
            base64_text(doc.getField("attachment")).alias("attachment"),
        )
    )


def action_json(op: Column, index: Column, doc_id: Column) -> Column:
    """The action line of a bulk request."""
    target = F.struct(index.alias("_index"), doc_id.alias("_id"))
    return F.to_json(
        F.struct(
            F.when(op == "index", target).alias("index"),
            F.when(op == "delete", target).alias("delete"),
        )
    )
