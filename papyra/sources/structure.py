"""Navigation and interaction of PDF files as tables, from a DataFrame of (doc_id, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structure
from .pdf import table


def outlines(pdfs: DataFrame) -> DataFrame:
    return table(pdfs, "path array<long>, depth long, title string, page_index long", structure.outlines)


def attachments(pdfs: DataFrame) -> DataFrame:
    return table(pdfs, "key string, file_name string, description string, body binary", structure.attachments)


def layers(pdfs: DataFrame) -> DataFrame:
    return table(pdfs, "num long, name string, visible boolean, locked boolean", structure.layers)


def form_fields(pdfs: DataFrame) -> DataFrame:
    return table(pdfs, "name string, type string, flags long, value string, read_only boolean", structure.fields)


def annotations(pdfs: DataFrame) -> DataFrame:
    return table(pdfs, "page_index long, place long, subtype string, rect array<double>, flags long, contents string, author string", structure.annotations)


def label_ranges(pdfs: DataFrame) -> DataFrame:
    return table(pdfs, "start long, style string, prefix string, first long", structure.label_ranges)


def signed(pdfs: DataFrame) -> DataFrame:
    return table(pdfs, "signed boolean", lambda d: [(structure.signed(d),)])


def escaped(c: Column) -> Column:
    """Text as XML holds it."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def form_xfdf(fields: DataFrame) -> DataFrame:
    """(doc_id, xfdf): the fields of each form as one XFDF text, by name."""
    line = F.concat(F.lit('<field name="'), escaped(F.col("name")), F.lit('"><value>'), escaped(F.coalesce("value", F.lit(""))), F.lit("</value></field>"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"])
    return fields.groupBy("doc_id").agg(F.concat(F.lit("<xfdf><fields>"), F.array_join(lines, ""), F.lit("</fields></xfdf>")).alias("xfdf"))
