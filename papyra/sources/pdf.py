"""PDF files as tables. Every function takes a DataFrame of (doc_id, content) and is lazy; one bad file
gives a row with recovery Failed, never a failed job. Files are read by Spark's binaryFile source."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.cos import Name, Ref, Stream
from ..functions.document import Document, operations, runs, text_file
from ..functions.interp import Interpreter
from ..functions.reading import object_counts as counts_of
from ..functions.reading import page_text as text_of_page
from ..functions.reading import structure_order
from ..functions.layout import banner
from ..functions.structure import has_xfa, text_of

#: Rows of a batch that is given, and rows whose values are Python's at one time.
BATCH_ROWS, SLICE_ROWS = 2000, 64
#: Tasks for each core where few bytes stand for much work.
TASKS_A_CORE = 4
INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id: the path, content) of the *.pdf files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def stream_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """The same for files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def mapped(rows: DataFrame, columns: list[str], schema: str, f) -> DataFrame:
    """f(values of columns) yields tuples of schema; results travel as Arrow batches of many rows."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(zip(*held), arrow)], schema=arrow)

        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                for values in zip(*(c.to_pylist() for c in b.slice(at, SLICE_ROWS).columns)):
                    held += f(*values)
                    if len(held) >= BATCH_ROWS:
                        yield batch()
                        held.clear()
        if held:
            yield batch()

    return rows.select(*columns).mapInArrow(run, schema)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly over all cores. Parquet splits by bytes and row groups: a million short rows, each of
    which becomes a file, would be one or two tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism))


def table(pdfs: DataFrame, schema: str, rows) -> DataFrame:
    """A table with doc_id and the columns of schema: rows(document) yields the tuples of each file."""

    def of(doc_id, content):
        return [(doc_id, *r) for r in rows(Document(content or b""))]

    return mapped(pdfs, ["doc_id", "content"], f"doc_id {dict(pdfs.dtypes)['doc_id']}, {schema}", of)


def made(rows: DataFrame, columns: list[str], f) -> DataFrame:
    """(doc_id, content): a file from each row; the first column is its id, f gets the others."""
    kind = dict(rows.dtypes)[columns[0]]
    return mapped(spread(rows.select(*columns)), columns, f"doc_id {kind}, content binary", lambda i, *values: [(i, f(*values))])


def changed(pdfs: DataFrame, f) -> DataFrame:
    """(doc_id, content): f(document) gives the new bytes of each file, or several of them."""

    def of(doc_id, content):
        got = f(Document(content or b""))
        return [(doc_id, x) for x in (got if isinstance(got, list) else [got])]

    return mapped(pdfs, ["doc_id", "content"], f"doc_id {dict(pdfs.dtypes)['doc_id']}, content binary", of)


def kind_of(v) -> str:
    for t, k in ((bool, "Bool"), (Ref, "Ref"), (Name, "Name"), (Stream, "Stream"), (int, "Int"), (float, "Real"), (bytes, "String"), (dict, "Dict"), (list, "Array")):
        if isinstance(v, t):
            return k
    return "Null"


def plain(v):
    """A value as JSON: names with a slash, references as "n g R", strings as Latin-1."""
    if isinstance(v, Ref):
        return f"{v.num} {v.gen} R"
    if isinstance(v, Name):
        return f"/{v}"
    if isinstance(v, bytes):
        return v.decode("latin-1")
    if isinstance(v, Stream):
        return plain(v.dict)
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, list) else v


def files(pdfs: DataFrame) -> DataFrame:
    def rows(d: Document):
        info = d.get(d.trailer.get("Info")) if "Info" in d.trailer else None
        root = d.get(d.trailer.get("Root")) if "Root" in d.trailer else None
        claimed = d.field(d.field(root, "Pages"), "Count")
        yield (
            len(d.data), d.version, d.recovery, d.notes, "Encrypt" in d.trailer, len(d.entries), len(d.pages()), claimed if isinstance(claimed, int) else None,
            *[text_of(d.field(info, k)) for k in INFO], len(d.revisions), text_of(d.field(root, "Lang")), bool(banner(d)), has_xfa(d),
            d.decoded(xmp)[0].decode("utf-8", "replace") if isinstance(xmp := d.field(root, "Metadata"), Stream) else None,
        )

    return table(pdfs, "n_bytes long, version string, recovery string, notes array<string>, encrypted boolean, n_objects long, n_pages long, claimed_pages long, " + ", ".join(f"{k.lower()} string" for k in INFO) + ", n_revisions long, lang string, damaged boolean, xfa boolean, xmp string", rows)


def objects(pdfs: DataFrame) -> DataFrame:
    """Every object with its kind and its value as JSON (parse_json gives a variant)."""

    def rows(d: Document):
        for n in sorted(d.entries):
            v = d.get(n)
            yield n, kind_of(v), json.dumps(plain(v)), v.raw if isinstance(v, Stream) else None

    return table(pdfs, "num long, kind string, value string, raw binary", rows)


def refs(pdfs: DataFrame, with_objects: bool = False) -> DataFrame:
    """Edges (src, dst, path) between objects; src 0 is the trailer. with_objects: also a row (num, null, null)
    for each object that can be read, so that one pass over the files gives both."""

    def walk(v, path: str):
        if isinstance(v, Ref):
            yield v.num, path
        elif isinstance(v, (dict, Stream)):
            for k, x in (v.dict if isinstance(v, Stream) else v).items():
                yield from walk(x, f"{path}/{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, f"{path}[{i}]")

    def rows(d: Document):
        for n, v in [(0, d.trailer), *((n, d.get(n)) for n in sorted(d.entries))]:
            if with_objects and n and v is not None:
                yield n, None, None
            for dst, path in walk(v, ""):
                yield n, dst, path

    return table(pdfs, "src long, dst long, path string", rows)


def pages(pdfs: DataFrame) -> DataFrame:
    def rows(d: Document):
        for i, p in enumerate(d.pages()):
            media, crop, turn = d.boxes(p)
            w, h = crop[2] - crop[0], crop[3] - crop[1]
            annots = d.field(p, "Annots")
            yield i, p["#num"], media, crop, turn, *((h, w) if turn % 180 else (w, h)), len(annots) if isinstance(annots, list) else 0

    return table(pdfs, "page_index long, num long, media array<double>, crop array<double>, rotation long, width double, height double, n_annots long", rows)


def content_ops(pdfs: DataFrame) -> DataFrame:
    def rows(d: Document):
        for i, p in enumerate(d.pages()):
            for seq, (op, args, a, b) in enumerate(operations(d.content(p))):
                yield i, seq, op, json.dumps([plain(x) for x in args]), a, b

    return table(pdfs, "page_index long, seq long, op string, operands string, span_start long, span_end long", rows)


def text_runs(pdfs: DataFrame) -> DataFrame:
    def rows(d: Document):
        for i, p in enumerate(d.pages()):
            for seq, r in enumerate(runs(d, p)):
                yield i, seq, *r

    return table(pdfs, "page_index long, seq long, text string, sx double, sy double, ex double, ey double, size double", rows)


def join_runs(text_runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Runs to text: a line break where the baseline moves or the text goes back, a space at a gap."""
    w = Window.partitionBy(*keys).orderBy(order)
    size = F.greatest("size", F.lag("size").over(w))
    down = F.abs(F.col("sy") - F.lag("ey").over(w)) > 0.55 * size
    back = F.col("sx") < F.lag("sx").over(w) - 0.5 * size
    gap = (F.col("sx") - F.lag("ex").over(w) > 0.25 * size) & ~F.col("text").rlike(r"^\s") & ~F.lag("text").over(w).rlike(r"\s$")
    sep = F.when(F.lag(order).over(w).isNull(), "").when(down | back, "\n").when(gap, " ").otherwise("")
    rows = text_runs.where("text <> ''").withColumn("part", F.concat(sep, "text"))
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "part"))).alias("parts"))
    return got.select(*keys, F.array_join("parts.part", "").alias("text"))


def page_text(pdfs: DataFrame, ordered: bool = False) -> DataFrame:
    """(page_index, text) of pages with text, as drawn or in reading order."""

    def rows(d: Document):
        structure = structure_order(d) if ordered else None
        for i, p in enumerate(d.pages()):
            if text := text_of_page(d, p, ordered, structure):
                yield i, text

    return table(pdfs, "page_index long, text string", rows)


def document_text(pdfs: DataFrame) -> DataFrame:
    """All pages' text by document, line breaks between pages."""

    def rows(d: Document):
        found = [t for p in d.pages() if (t := text_of_page(d, p))]
        return [("\n".join(found),)] if found else []

    return table(pdfs, "text string", rows)


def marks(pdfs: DataFrame) -> DataFrame:
    """What is drawn, in order: kind, box, bytes of the content, form, marked-content id, colours, text."""

    def rows(d: Document):
        for i, p in enumerate(d.pages()):
            for seq, m in enumerate(Interpreter(d, p).marks):
                yield i, seq, m.kind, list(m.box), m.start, m.end, m.form, m.mcid, m.artifact, m.fill and list(m.fill), m.stroke and list(m.stroke), m.text, m.name

    return table(pdfs, "page_index long, seq long, kind string, box array<double>, span_start long, span_end long, form string, mcid long, artifact boolean, fill array<double>, stroke array<double>, text string, name string", rows)


def object_counts(pdfs: DataFrame) -> DataFrame:
    """(page_index, kind, n) of page objects."""

    def rows(d: Document):
        for i, p in enumerate(d.pages()):
            for kind, n in counts_of(d, p).items():
                yield i, kind, n

    return table(pdfs, "page_index long, kind string, n long", rows)


def pdfs_from_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_page: int = 40, seal=None) -> DataFrame:
    """(doc_id, content): each text as a PDF file, one line of text to a line. Characters outside of
    Windows-1252 become question marks."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, ["doc_id", "text"], f"doc_id {dict(docs.dtypes)[id_col]}, content binary", lambda i, text: [(i, text_file((text or "").split("\n"), per_page, f"Document {i}", seal=seal))])
