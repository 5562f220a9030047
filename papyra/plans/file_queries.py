"""Queries that run an operator on generated files and read the result back, with the SQL on the source rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms, images, organize, protect, reading, samples
from ..functions import structure as structure_kernel
from ..functions.cos import Stream
from ..functions.document import Document, text_file
from ..functions.interp import Interpreter
from ..functions.pdf_function import Function
from ..operators import geometry as G
from ..operators import leaks
from ..operators import relational as R
from ..sources import pdf, structure
from .registry import query, t


def cards(spark: SparkSession, d: str) -> DataFrame:
    """A file of one to four pages for each supplier."""
    return pdf.made(t(spark, d, "supplier"), ["s_suppkey", "s_name", "s_nationkey"], lambda name, nation: text_file([f"{name} page {i}" for i in range(nation % 4 + 1)], 1, name))


def card_pages(pdfs: DataFrame) -> DataFrame:
    return pdf.page_text(pdfs)


K = "SELECT s_suppkey, s_name, s_nationkey % 4 + 1 AS k FROM supplier"
TEXT = "s_name || ' page ' ||"


@query(f"SELECT s_suppkey AS doc_id, i AS page_index, {TEXT} (i % k) AS text FROM (SELECT *, unnest(range(2 * k)) AS i FROM ({K}))")
def merge_documents(spark, d):
    return card_pages(pdf.changed(cards(spark, d), lambda x: organize.merge([x, x])))


@query(f"SELECT s_suppkey AS doc_id, least(2, k - 2 * j) AS n_pages, count(*) AS n FROM (SELECT *, unnest(range((k + 1) // 2)) AS j FROM ({K})) GROUP BY ALL")
def split_every(spark, d):
    return pdf.files(pdf.changed(cards(spark, d), lambda x: organize.split_every(x, 2))).groupBy("doc_id", "n_pages").agg(F.count("*").alias("n"))


@query(f"SELECT s_suppkey AS doc_id, i - 1 AS page_index, {TEXT} i AS text FROM (SELECT *, unnest(range(1, k)) AS i FROM ({K}))")
def delete_pages(spark, d):
    several = pdf.files(cards(spark, d)).where("n_pages > 1").select("doc_id")
    return card_pages(pdf.changed(cards(spark, d).join(several, "doc_id", "left_semi"), lambda x: organize.delete(x, [0])))


@query(f"SELECT s_suppkey AS doc_id, CAST(j AS BIGINT) AS page_index, {TEXT} CASE WHEN j = 0 THEN k - 1 ELSE 0 END AS text FROM ({K}), (VALUES (0), (1)) v(j)")
def extract_pages(spark, d):
    return card_pages(pdf.changed(cards(spark, d), lambda x: organize.extract(x, [len(x.pages()) - 1, 0])))


@query(f"SELECT s_suppkey AS doc_id, i AS page_index, {TEXT} (k - 1 - i) AS text FROM (SELECT *, unnest(range(k)) AS i FROM ({K}))")
def reorder_pages(spark, d):
    return card_pages(pdf.changed(cards(spark, d), lambda x: organize.reorder(x, list(reversed(range(len(x.pages())))))))


@query(f"SELECT s_suppkey AS doc_id, CAST(2 * k AS BIGINT) AS n_pages, CAST(k AS BIGINT) AS n_streams FROM ({K})")
def insert_pages_dedupe(spark, d):
    """A file inserted into itself: pages double, equal streams are kept once."""
    both = pdf.changed(cards(spark, d), lambda x: organize.insert(x, x, 1))
    streams = pdf.objects(both).groupBy("doc_id").agg(F.count_if(F.col("kind") == "Stream").alias("n_streams"))
    return pdf.files(both).select("doc_id", "n_pages").join(streams, "doc_id")


@query(f"SELECT s_suppkey AS doc_id, i AS page_index, CASE WHEN i = 1 THEN 200.0 ELSE 612.0 END AS width FROM (SELECT *, unnest(range(k + 1)) AS i FROM ({K}))")
def insert_blank_page(spark, d):
    return pdf.pages(pdf.changed(cards(spark, d), lambda x: organize.insert(x, organize.blank(200, 300), 1))).select("doc_id", "page_index", "width")


@query(f"SELECT s_suppkey AS doc_id, i AS page_index, CAST(CASE WHEN i = 0 THEN 270 ELSE 0 END AS BIGINT) AS rotation FROM (SELECT *, unnest(range(k)) AS i FROM ({K}))")
def rotate_page(spark, d):
    return pdf.pages(pdf.changed(cards(spark, d), lambda x: organize.rotate(x, 0, -90))).select("doc_id", "page_index", "rotation")


@query("SELECT p_partkey AS doc_id, greatest(p_size, 0.0) AS x0, least(p_size + 60.0, 612.0) AS x1, 20.0 AS y0, 792.0 AS y1 FROM part")
def crop_intersect(spark, d):
    """A crop box that is cut to the media box."""
    files = pdf.made(t(spark, d, "part"), ["p_partkey", "p_size"], lambda size: organize.crop(Document(text_file(["x"])), 0, [size, 20, size + 60, 900]))
    c = F.col("crop")
    return pdf.pages(files).select("doc_id", c[0].alias("x0"), c[2].alias("x1"), c[1].alias("y0"), c[3].alias("y1"))


@query(f"""SELECT s_suppkey AS doc_id, i AS idx, CASE WHEN i < 2 THEN ['i', 'ii'][i + 1] ELSE 'A-' || ['C', 'D'][i - 1] END AS label FROM (SELECT *, unnest(range(k)) AS i FROM ({K}))""")
def pdf_page_labels(spark, d):
    files = pdf.changed(cards(spark, d), lambda x: organize.set_labels(x, [(0, "r", "", 1), (2, "A", "A-", 3)]))
    return R.page_labels(pdf.pages(files).select("doc_id", F.col("page_index").alias("idx")), structure.label_ranges(files), ["doc_id"])


@query(f"SELECT s_suppkey AS doc_id, CAST(6 AS BIGINT) AS num FROM ({K})")
def free_objects(spark, d):
    """Objects that an incremental save takes away are null in the newest revision."""

    def without(x: Document) -> bytes:
        over = organize.Overlay(x)
        over.remove(6)
        return over.save_incremental()

    return pdf.objects(pdf.changed(cards(spark, d), without)).where("kind = 'Null'").select("doc_id", "num")


@query(f"SELECT s_suppkey AS doc_id, CAST(4 + 2 * k AS BIGINT) AS n_objects, CAST(1 AS BIGINT) AS n_revisions FROM ({K})")
def full_save(spark, d):
    """A full save leaves out what nothing refers to, and older revisions."""

    def anew(x: Document) -> bytes:
        over = organize.Overlay(x)
        over.add({"Orphan": True})
        return organize.Overlay(Document(over.save_incremental())).save_full()

    return pdf.files(pdf.changed(cards(spark, d), anew)).select("doc_id", "n_objects", "n_revisions")


@query(f"SELECT s_suppkey AS doc_id, i AS page_index, {TEXT} i AS text FROM (SELECT *, unnest(range(k)) AS i FROM ({K}))")
def object_streams(spark, d):
    """Files packed into an object stream under a cross-reference stream, read again."""
    return card_pages(pdf.changed(cards(spark, d), lambda x: organize.packed_file({n: x.get(n) for n in x.entries}, 1)))


@query(f"SELECT s_suppkey AS doc_id, i AS page_index, {TEXT} i AS text, true AS smaller FROM (SELECT *, unnest(range(k)) AS i FROM ({K}))")
def optimize(spark, d):
    plain = pdf.made(t(spark, d, "supplier"), ["s_suppkey", "s_name", "s_nationkey"], lambda name, nation: text_file([f"{name} page {i}" for i in range(nation % 4 + 1)], 1, name * 30, False))

    def rows(x: Document):
        data, found = organize.optimized(x)
        new = Document(data)
        for i, p in enumerate(new.pages()):
            yield i, reading.page_text(new, p), found["after"] <= found["before"]

    return pdf.table(plain, "page_index long, text string, smaller boolean", rows)


@query("SELECT CAST(0 AS BIGINT) AS n")
def pdf_dangling_refs(spark, d):
    """One pass over the files gives objects and references; the anti-join is theirs."""
    both = pdf.refs(pdf.pdfs_from_text(t(spark, d, "documents")), with_objects=True)
    have = both.where("dst is null").select("doc_id", F.col("src").alias("dst"))
    return R.dangling(both.where("dst is not null"), have, ["doc_id", "dst"]).agg(F.count("*").alias("n"))


@query(f"SELECT s_suppkey AS doc_id, unnest(range(1, 5 + 2 * k)) AS node FROM ({K})")
def reachable_objects(spark, d):
    """Objects that the trailer leads to; page trees have cycles (/Parent)."""
    edges = pdf.refs(cards(spark, d)).select("doc_id", "src", "dst")
    seen = R.reachable(edges, cards(spark, d).select("doc_id", F.lit(0).cast("long").alias("node")), ["doc_id"])
    return seen.where("node > 0")


# content


def drawings(spark: SparkSession, d: str) -> DataFrame:
    return pdf.made(t(spark, d, "part"), ["p_partkey", "p_name", "p_brand", "p_size"], lambda name, brand, size: samples.drawing(name, brand, size % 3))


@query("SELECT * FROM (SELECT p_partkey AS doc_id, unnest(['line', 'form', 'path']) AS kind, unnest([2::BIGINT, 1::BIGINT, CAST(p_size % 3 AS BIGINT)]) AS n FROM part) WHERE n > 0")
def object_counts(spark, d):
    return pdf.object_counts(drawings(spark, d)).select("doc_id", "kind", "n")


@query("SELECT p_partkey AS doc_id, unnest([NULL, 'Fm0']) AS form, unnest([p_name, translate(p_brand, 'AB', 'BA')]) AS text FROM part")
def objects_by_form(spark, d):
    """Text inside and outside of a form XObject, whose font exchanges A and B."""
    return pdf.marks(drawings(spark, d)).where("kind = 'text'").select("doc_id", "form", "text")


@query("SELECT p_partkey AS doc_id, p_name AS text, 6.0 * length(p_name) AS width FROM part")
def run_widths(spark, d):
    """A standard face without declared widths: Courier has 600 for all."""
    return pdf.text_runs(drawings(spark, d)).where("sy = 700").select("doc_id", "text", F.round(F.col("ex") - F.col("sx"), 6).alias("width"))


@query("SELECT p_partkey AS doc_id, 1.0 AS r, 0.0 AS g, CAST(20 * i + 20 AS DOUBLE) AS x0 FROM (SELECT p_partkey, unnest(range(p_size % 3)) AS i FROM part)")
def painted_paths(spark, d):
    return pdf.marks(drawings(spark, d)).where("kind = 'path'").select("doc_id", F.col("fill")[0].alias("r"), F.col("fill")[1].alias("g"), F.col("box")[0].alias("x0"))


@query("SELECT c_custkey AS doc_id, c_name || chr(10) || c_mktsegment || chr(10) || 'left' || chr(10) || 'right ' || c_nationkey || chr(10) || 'end' AS text FROM customer")
def reading_order(spark, d):
    """Columns drawn line by line across come out one after the other."""
    files = pdf.made(t(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"], lambda name, segment, nation: samples.columns([name, segment, "left"], [f"right {nation}", "end"]))
    return pdf.page_text(files, ordered=True).select("doc_id", "text")


@query("SELECT p_partkey AS doc_id, p_name AS text FROM part")
def word_spaces(spark, d):
    """Words parted only by gaps within one TJ."""
    return pdf.page_text(pdf.made(t(spark, d, "part"), ["p_partkey", "p_name"], lambda name: samples.kerned(name.split(" ")))).select("doc_id", "text")


@query("""SELECT doc_id, CAST(list_sum([strlen(x) FOR x IN p[1:i]]) + 3 * (i - 1) AS BIGINT) AS start FROM
(SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM (SELECT doc_id, string_split(lower(text), 'the') AS p FROM documents))""")
def find_hits(spark, d):
    """Where each match begins, in bytes."""
    hits = pdf.mapped(t(spark, d, "documents"), ["doc_id", "text"], "doc_id long, start long, end long", lambda i, text: [(i, a, b) for a, b in reading.find(text or "", "the")])
    return hits.select("doc_id", "start")


@query("""SELECT doc_id, i AS line, CAST(strlen(l) AS BIGINT) AS n_bytes FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE contains(lower(l), 'the')""")
def hit_lines(spark, d):
    """Lines that hold a needle, with the bytes of each."""
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return lines.where(R.find_count(F.col("l"), F.lit("the")) > 0).select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.octet_length("l").cast("long").alias("n_bytes"))


@query("""WITH a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
b AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE w <> '' GROUP BY ALL),
c AS (SELECT doc_id, CAST(sum(CASE WHEN b.n IS NULL THEN 0 ELSE least(a.n, b.n) END) AS BIGINT) AS common, CAST(sum(a.n) AS BIGINT) AS own FROM a LEFT JOIN b USING (w) GROUP BY 1)
SELECT doc_id, common, own, round(2.0::DOUBLE * common / (own + (SELECT sum(n) FROM b)), 9) AS f1 FROM c""")
def word_f1(spark, d):
    """Overlap of word bags: each document against the benchmark."""
    return R.f1(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "text").withColumn("f1", F.round("f1", 9))


@query("SELECT p_partkey AS doc_id, CAST(1 AS BIGINT) AS n, true AS shown FROM part")
def edit_content(spark, d):
    """A title moved by byte patches keeps its text; the squares are deleted."""

    def rows(x: Document):
        page = x.pages()[0]
        content, found = x.content(page), Interpreter(x, page).marks
        title = next(m for m in found if m.kind == "text" and m.form is None)
        spans = {(m.start, m.end): m for m in found if m.kind == "path"}
        patches = protect.moved(content, title, (1, 0, 0, 1, 0, -100)) + [p for m in spans.values() for p in protect.deleted(content, m)]
        new = Document(protect.edited(x, 0, patches))
        now = Interpreter(new, new.pages()[0]).marks
        yield sum(m.text == title.text and abs(m.line[1] - 600) < 1e-6 for m in now), not any(m.kind == "path" for m in now)

    return pdf.table(drawings(spark, d), "n long, shown boolean", rows)


# forms and annotations


@query("SELECT p_partkey AS doc_id, left(p_name, 10) AS value FROM part")
def fill_maxlen(spark, d):
    def filled(name: str) -> bytes:
        over = organize.Overlay(Document(samples.form({"title": ""}, {"title": 10})))
        forms.fill(over, "title", name)
        return over.save_incremental()

    return structure.form_fields(pdf.made(t(spark, d, "part"), ["p_partkey", "p_name"], filled)).select("doc_id", "value")


@query("SELECT p_partkey AS doc_id, unnest(['a', 'b', 'total']) AS name, unnest([CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR), '$' || format('{:,.2f}', p_partkey + p_size + 0.0)]) AS value FROM part")
def form_recalculate(spark, d):
    """A field that sums two others, in its number format, after one of them is filled."""
    scripts = {"total": {"C": 'AFSimple_Calculate("SUM", new Array ("a", "b"));', "F": 'AFNumber_Format(2, 0, 0, 0, "$", true);'}}

    def filled(key: int, size: int) -> bytes:
        over = organize.Overlay(Document(samples.form({"a": str(key), "b": "0", "total": ""}, scripts=scripts)))
        forms.fill(over, "b", str(size))
        return over.save_incremental()

    return structure.form_fields(pdf.made(t(spark, d, "part").withColumn("key", F.col("p_partkey")), ["p_partkey", "key", "p_size"], filled)).select("doc_id", "name", "value")


@query("SELECT l_orderkey, sum(l_linenumber) AS \"SUM\", product(l_linenumber) AS \"PRD\", sum(l_linenumber) / count(*) AS \"AVG\", min(l_linenumber) AS \"MIN\", max(l_linenumber) AS \"MAX\" FROM (SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem) GROUP BY 1")
def af_calculate(spark, d):
    return R.calculated(t(spark, d, "lineitem").withColumn("v", F.col("l_linenumber").cast("double")), ["l_orderkey"], "v")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'below' WHEN c_acctbal > 5000 THEN 'above' ELSE 'ok' END AS verdict FROM customer")
def af_validate(spark, d):
    return t(spark, d, "customer").select("c_custkey", R.range_verdict(F.col("c_acctbal"), "AFRange_Validate(true, 0, true, 5000)").alias("verdict"))


@query("SELECT c_custkey AS doc_id, 'Highlight' AS subtype, c_name || ' & <' || c_mktsegment || '>' AS contents, c_mktsegment AS author FROM customer")
def xfdf_roundtrip(spark, d):
    """An annotation to XFDF, and from it into another file."""

    def copied(name: str, segment: str) -> bytes:
        over = organize.Overlay(samples.text_document("x"))
        forms.add_annotation(over, 0, "Highlight", [10, 10, 90, 30], f"{name} & <{segment}>", segment, quads=[10, 10, 90, 10, 90, 30, 10, 30])
        other = organize.Overlay(samples.text_document("y"))
        forms.import_xfdf(other, forms.annotations_xfdf(Document(over.save_incremental())))
        return other.save_incremental()

    return structure.annotations(pdf.made(t(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"], copied)).select("doc_id", "subtype", "contents", "author")


@query("SELECT p_partkey AS doc_id FROM part WHERE (p_size & 2) = 0 AND (p_size & 4) <> 0")
def annotation_filter(spark, d):
    """Notes that are printed, by the flags in the files."""
    notes = structure.annotations(pdf.made(t(spark, d, "part"), ["p_partkey", "p_size"], lambda flags: samples.annotated([flags])))
    return notes.where(R.shown_annotation(F.col("flags"), printing=True)).select("doc_id")


@query("SELECT p_partkey AS doc_id, CAST(2 - (p_size % 2) AS BIGINT) AS n FROM part")
def delete_annotation(spark, d):
    """A note goes with the replies to it: of three, the second replies to the first in files of odd size."""

    def without(size: int) -> bytes:
        over = organize.Overlay(Document(samples.annotated([4, 4, 4], [None, 0 if size % 2 else None, None])))
        forms.delete_annotation(over, 0, 0)
        return over.save_full()

    return structure.annotations(pdf.made(t(spark, d, "part"), ["p_partkey", "p_size"], without)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS doc_id, p_name AS text, CAST(0 AS BIGINT) AS n_annots FROM part")
def flatten(spark, d):
    """A filled field drawn into its page."""

    def flat(name: str) -> bytes:
        over = organize.Overlay(Document(samples.form({"f": name})))
        forms.flatten(over, 0)
        return over.save_full()

    def rows(x: Document):
        for p in x.pages():
            if text := reading.page_text(x, p):
                yield text, len(x.field(p, "Annots") or [])

    return pdf.table(pdf.made(t(spark, d, "part"), ["p_partkey", "p_name"], flat), "text string, n_annots long", rows)


@query("SELECT s_suppkey AS doc_id, r_name || '.' || n_name || '.' || s_name AS name, 'v' AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def field_full_names(spark, d):
    files = pdf.made(_regions(spark, d), ["s_suppkey", "r_name", "n_name", "s_name"], lambda *names: samples.nested_fields(list(names), "v"))
    return structure.form_fields(files).select("doc_id", "name", "value")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


# navigation


@query("""SELECT s_suppkey AS doc_id, CAST(CASE WHEN s_acctbal > 0 THEN 270 WHEN n_nationkey % 2 = 0 THEN 90 * (n_nationkey % 4) ELSE 90 * (n_regionkey % 4) END AS BIGINT) AS rotation
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def inherit_attrs(spark, d):
    """The page's own rotation, else that of the nearest node above."""

    def file(balance: float, nation: int, region: int) -> bytes:
        return samples.nested_pages([90 * (region % 4), 90 * (nation % 4) if nation % 2 == 0 else None, 270 if balance > 0 else None])

    return pdf.pages(pdf.made(_regions(spark, d), ["s_suppkey", "s_acctbal", "n_nationkey", "r_regionkey"], file)).select("doc_id", "rotation")


@query("SELECT s_suppkey AS doc_id, s_name AS title, CAST(CASE WHEN s_nationkey % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS page_index FROM supplier")
def dest_default(spark, d):
    """A bookmark whose page is not in the file leads to the first."""
    files = pdf.made(t(spark, d, "supplier"), ["s_suppkey", "s_name", "s_nationkey"], lambda name, nation: samples.bookmarked(name, nation % 2 == 0))
    return structure.outlines(files).select("doc_id", "title", "page_index")


@query("""SELECT r_regionkey AS doc_id, '0' AS path, r_name AS title FROM region UNION ALL
SELECT n_regionkey, '0.' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1), n_name FROM nation""")
def outline_preorder(spark, d):
    """A file for each region: its name, and its nations below."""
    names = t(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    rows = t(spark, d, "region").join(names, F.col("r_regionkey") == F.col("n_regionkey"), "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    files = pdf.made(rows, ["r_regionkey", "r_name", "names"], lambda name, kids: structure_kernel.structured_file(name, [(name, kids)], {}, "", {}))
    return structure.outlines(files).select("doc_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "title")


# protection


@query(f"SELECT s_suppkey AS doc_id, i AS page_index, {TEXT} i AS text FROM (SELECT *, unnest(range(1, k)) AS i FROM ({K}))")
def redact(spark, d):
    """The first page's line under a box goes from the file, not only from sight."""
    return card_pages(pdf.changed(cards(spark, d), lambda x: protect.redacted(x, 0, [[0, 770, 612, 792]])[0]))


@query(f"SELECT s_suppkey AS doc_id, false AS leaks, true AS leaked FROM ({K})")
def redact_leaks(spark, d):
    def rows(x: Document):
        secret = reading.page_text(x, x.pages()[0])
        # the title holds the name, but not the page's whole line
        yield bool(protect.leaks(Document(protect.redacted(x, 0, [[0, 770, 612, 792]])[0]), [secret])), bool(protect.leaks(x, [secret]))

    return pdf.table(cards(spark, d), "leaks boolean, leaked boolean", rows)


@query(f"SELECT s_suppkey AS doc_id, i AS page_index, s_name || '  ' || i AS text FROM (SELECT *, unnest(range(k)) AS i FROM ({K}))")
def scrub_files(spark, d):
    return card_pages(pdf.changed(cards(spark, d), lambda x: protect.scrub(x, ["page"])))


@query("SELECT c_custkey AS doc_id, 'EmbeddedFiles,Info' AS taken, CAST(0 AS BIGINT) AS left_over FROM customer")
def sanitize(spark, d):
    files = pdf.made(t(spark, d, "customer"), ["c_custkey", "c_name"], lambda name: structure_kernel.structured_file(name, [(name, [])], {}, name, {"a.txt": name.encode()}))

    def rows(x: Document):
        data, taken = protect.sanitized(x)
        yield ",".join(taken), len(list(structure_kernel.attachments(Document(data))))

    return pdf.table(files, "taken string, left_over long", rows)


@query("SELECT s_suppkey AS doc_id, s_name AS name, true AS valid, s_nationkey % 2 = 1 AS extended FROM supplier")
def signatures(spark, d):
    """The digest over the signed range, and whether more was appended (in files of odd nations)."""

    def file(name: str, nation: int) -> bytes:
        x = Document(text_file([name]))
        data = protect.sign({n: x.get(n) for n in x.entries}, 1, 5, name)
        return data if nation % 2 == 0 else organize.append_revision(data, {4: {"Title": b"later"}})

    return pdf.table(pdf.made(t(spark, d, "supplier"), ["s_suppkey", "s_name", "s_nationkey"], file), "name string, valid boolean, extended boolean", protect.verified)


@query("SELECT doc_id, md5(replace(replace(text, 'the', ''), 'und', '')) AS digest FROM documents")
def scrub_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(R.scrub(F.col("text"), ["the", "und"])).alias("digest"))


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def leak_scan(spark, d):
    return leaks.leak_pairs(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


@query("SELECT p_partkey, (p_partkey & 4) <> 0 AS \"print\", (p_partkey & 8) <> 0 AS modify, (p_partkey & 16) <> 0 AS extract, (p_partkey & 32) <> 0 AS annotate FROM part")
def permissions_bits(spark, d):
    bits = R.permitted(F.col("p_partkey"))
    return t(spark, d, "part").select("p_partkey", *[bits[n].alias(n) for n in ("print", "modify", "extract", "annotate")])


_DENIED = ", ".join(f"CASE WHEN (p_partkey & {bit}) = 0 THEN '{name}' END" for name, bit in protect.RIGHTS.items())


@query(f"SELECT p_partkey, concat_ws(', ', {_DENIED}) AS denied FROM part")
def permissions_describe(spark, d):
    return t(spark, d, "part").select("p_partkey", R.denied(F.col("p_partkey")).alias("denied"))


# numbers


@query("SELECT p_partkey, 2.0 * p_size + 0.0 * p_retailprice + 3.0 AS x, 0.0 * p_size + 2.0 * p_retailprice + 4.0 AS y FROM part")
def matrix_apply(spark, d):
    x, y = G.apply(G.matrix(2, 0, 0, 2, 3, 4), F.col("p_size"), F.col("p_retailprice"))
    return t(spark, d, "part").select("p_partkey", x.alias("x"), y.alias("y"))


@query("SELECT p_partkey, CASE WHEN det <> 0 THEN d / det END AS a, CASE WHEN det <> 0 THEN -b / det END AS b, CASE WHEN det <> 0 THEN (c * f - d * e) / det END AS e FROM (SELECT *, a * d - b * c AS det FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, 2.0::DOUBLE AS b, 8.0::DOUBLE AS c, 1.0::DOUBLE AS d, p_retailprice AS e, 5.0::DOUBLE AS f FROM part))")
def matrix_inverse(spark, d):
    """Null where the matrix has no inverse (a size of 16 here)."""
    inv = G.inverse(G.matrix(F.col("p_size").cast("double"), 2, 8, 1, F.col("p_retailprice"), 5))
    return t(spark, d, "part").select("p_partkey", inv[0].alias("a"), inv[1].alias("b"), inv[4].alias("e"))


@query("SELECT p_size AS form, CAST(min(p_partkey % 100) AS BIGINT) AS x0, CAST(min(p_partkey % 70) AS BIGINT) AS y0, CAST(max(p_partkey % 100 + 5) AS BIGINT) AS x1, CAST(max(p_partkey % 70 + 5) AS BIGINT) AS y1 FROM part GROUP BY 1")
def bounds_union(spark, d):
    return G.union(_boxes(spark, d), ["form"])


def _boxes(spark: SparkSession, d: str, side: int = 5) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, d, "part").select(F.col("p_size").alias("form"), k.alias("id"), (k % 100).alias("x0"), (k % 70).alias("y0"), (k % 100 + side).alias("x1"), (k % 70 + side).alias("y1"))


BOX = "SELECT p_size AS form, p_partkey AS id, p_partkey % 100 AS x0, p_partkey % 70 AS y0, p_partkey % 100 + 5 AS x1, p_partkey % 70 + 5 AS y1 FROM part"


@query(f"SELECT o_orderkey, max(id) AS top FROM (SELECT o_orderkey, o_custkey % 100 AS x, o_orderkey % 70 AS y FROM orders) JOIN ({BOX}) ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1")
def hit_test(spark, d):
    """The topmost object whose box holds a point."""
    points = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("x"), (F.col("o_orderkey") % 70).alias("y"))
    return G.hits(points, _boxes(spark, d), [], 5.0).groupBy("o_orderkey").agg(F.max("id").alias("top"))


@query(f"SELECT a.form, a.id AS a, b.id AS b FROM ({BOX}) a JOIN ({BOX}) b ON a.form = b.form AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def overlapping_boxes(spark, d):
    return G.overlapping(_boxes(spark, d), ["form"], "id", 5.0)


@query("SELECT p_partkey, 0.0::DOUBLE AS x0, CAST(p_size AS DOUBLE) AS y0, 10.0::DOUBLE AS x1, CAST(p_size AS DOUBLE) AS y1, 0.0::DOUBLE AS x2, -1.0::DOUBLE AS y2, 10.0::DOUBLE AS x3, -1.0::DOUBLE AS y3 FROM part")
def quad_points(spark, d):
    """Four points in any order."""
    size = F.col("p_size").cast("double")
    quad = F.array(F.lit(10.0), F.lit(-1.0), F.lit(0.0), size, F.lit(0.0), F.lit(-1.0), F.lit(10.0), size)
    q = G.normalised_quad(quad)
    return t(spark, d, "part").select("p_partkey", *[q[2 * i + k].alias(f"{'xy'[k]}{i}") for i in range(4) for k in range(2)])


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber * 7 < 50 AS inside FROM lineitem")
def polygon_contains(spark, d):
    """A triangle under a falling line."""
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (50.0, 0.0), (0.0, 50.0))])
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.inside(points, F.col("l_quantity").cast("double"), F.col("l_linenumber") * 7.0).alias("inside"))


def evaluated(rows: DataFrame, keys: list[str], value: str, function) -> DataFrame:
    """(keys, y): the first output of a PDF function for each value."""
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", y double"
    return pdf.mapped(rows, [*keys, value], schema, lambda *v: [(*v[:-1], Function(Document(b""), function)([v[-1]])[0])])


def _evaluated(spark, d, function) -> DataFrame:
    return evaluated(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_discount", function)


def _exp(c0: float, c1: float, n: float) -> dict:
    return {"FunctionType": 2, "Domain": [0, 1], "C0": [c0], "C1": [c1], "N": n}


@query("SELECT l_orderkey, l_linenumber, round(0.25 + l_discount * l_discount * 0.5, 9) AS y FROM lineitem")
def exp_function(spark, d):
    return _evaluated(spark, d, _exp(0.25, 0.75, 2)).withColumn("y", F.round("y", 9))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount < 0.03 THEN l_discount / 0.03 ELSE 1.0 - (l_discount - 0.03) / 0.97 END, 9) AS y FROM lineitem")
def stitch_function(spark, d):
    """Type 3: each subdomain has a function of its own; its upper bound belongs to the next."""
    both = {"FunctionType": 3, "Domain": [0, 1], "Functions": [_exp(0, 1, 1), _exp(0, 1, 1)], "Bounds": [0.03], "Encode": [0, 1, 1, 0]}
    return _evaluated(spark, d, both).withColumn("y", F.round("y", 9))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount < 0.05 THEN l_discount * 20 ELSE 1.0 - (l_discount - 0.05) * 20 END, 9) AS y FROM lineitem")
def sampled_function(spark, d):
    """Type 0: three samples over 0 to 0.1."""
    f = Stream({"FunctionType": 0, "Domain": [0, 0.1], "Range": [0, 1], "Size": [3], "BitsPerSample": 8}, bytes([0, 255, 0]))
    return _evaluated(spark, d, f).withColumn("y", F.round("y", 9))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0.04 THEN sqrt(l_discount) ELSE 1.0 - l_discount * 3 END, 9) AS y FROM lineitem")
def calculator_function(spark, d):
    """Type 4."""
    f = Stream({"FunctionType": 4, "Domain": [0, 1], "Range": [0, 1]}, b"{ dup 0.04 gt { sqrt } { 3 mul 1 exch sub } ifelse }")
    return _evaluated(spark, d, f).withColumn("y", F.round("y", 9))


@query("SELECT s_suppkey AS doc_id, CAST(n AS BIGINT) AS width, CAST(2 AS BIGINT) AS height, CAST(list_sum([(s_suppkey + 7 * x) % 256 FOR x IN range(n)]) * 2 AS BIGINT) AS red FROM (SELECT s_suppkey, s_nationkey % 4 + 1 AS n FROM supplier)")
def extract_images(spark, d):
    """Pictures to a file and out of it."""

    def file(key: int, nation: int) -> bytes:
        row = [[(key + 7 * x) % 256, 0, 0, 255] for x in range(nation % 4 + 1)]
        return images.pdf_of_images([np.array([row, row], np.uint8)])

    def rows(x: Document):
        for p in x.pages():
            for _, pixels in images.page_images(x, p):
                yield pixels.shape[1], pixels.shape[0], int(pixels[:, :, 0].sum())

    files = pdf.made(t(spark, d, "supplier").withColumn("key", F.col("s_suppkey")), ["s_suppkey", "key", "s_nationkey"], file)
    return pdf.table(files, "width long, height long, red long", rows)


@query("SELECT s_suppkey AS doc_id, CAST(s_nationkey AS DOUBLE) AS mean, CAST(s_nationkey AS DOUBLE) AS worst, CASE WHEN s_nationkey > 10 THEN 1.0 ELSE 0.0 END AS over FROM supplier")
def image_compare(spark, d):
    """A gray picture against one lighter by the nation's number."""

    def measures(key: int, by: int):
        a = np.full((16, 16, 4), 100, np.uint8)
        found = images.compared(a, a + np.uint8(by), 10)
        return [(key, found["mean"], found["worst"], found["over"])]

    return pdf.mapped(t(spark, d, "supplier"), ["s_suppkey", "s_nationkey"], "doc_id long, mean double, worst double, over double", measures)


# sets, orders and reports


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS kept FROM documents GROUP BY 1")
def dedupe_streams(spark, d):
    return R.duplicates(t(spark, d, "documents"), "text", "doc_id")


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hash_functions(spark, d):
    found = R.digests(F.col("text"))
    return t(spark, d, "documents").select("doc_id", *[found[n].alias(n) for n in ("md5", "sha1", "sha256")])


@query("SELECT lang, count(*) AS n, avg(n_chars) AS mean, median(n_chars) AS median, min(n_chars) AS worst, CAST(count_if(n_chars < 500) AS BIGINT) AS below_0, CAST(count_if(n_chars < 2000) AS BIGINT) AS below_1 FROM documents GROUP BY 1")
def corpus_report(spark, d):
    return R.report(t(spark, d, "documents"), ["lang"], "n_chars", [500, 2000])


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def worst_pixels(spark, d):
    """A top-k report."""
    return R.worst(t(spark, d, "events").select("event_id", "value"), "value", "event_id", 20)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, CAST(sum(length(o_orderstatus)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - length(o_orderstatus) AS BIGINT) AS offset FROM orders")
def drawing_order(spark, d):
    return R.laid_out(t(spark, d, "orders"), ["o_custkey"], "o_orderkey", F.length("o_orderstatus")).select("o_custkey", "o_orderkey", "rank", "offset")


@query("""SELECT coalesce(s_suppkey, p_partkey) AS num, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE p_name END AS value FROM supplier FULL JOIN part ON s_suppkey = p_partkey
WHERE s_suppkey IS NULL OR s_nationkey <> 0""")
def overlay_upsert(spark, d):
    """Changed objects lie over the file's own, new ones are added, removed ones (of nation 0) go."""
    base = t(spark, d, "part").select(F.col("p_partkey").alias("num"), F.col("p_name").alias("value"))
    changes = t(spark, d, "supplier").select(F.col("s_suppkey").alias("num"), F.col("s_name").alias("value"), (F.col("s_nationkey") == 0).alias("gone"))
    return R.overlaid(base, changes, "num", "value")


@query("SELECT p_partkey AS doc_id, CAST(i AS BIGINT) AS num, CAST(i - 1 AS BIGINT) AS parent FROM part, (VALUES (11), (12)) v(i)")
def reply_chain(spark, d):
    """Notes that each reply to the one before."""

    def rows(x: Document):
        for n in sorted(x.entries):
            v = x.get(n)
            if isinstance(v, dict) and v.get("Type") == "Annot":
                yield n, v["IRT"].num if "IRT" in v else None, str(v["Subtype"])

    file = samples.annotated([4, 4, 4], [None, 0, 1])
    notes = pdf.table(pdf.made(t(spark, d, "part"), ["p_partkey"], lambda: file), "num long, parent long, subtype string", rows)
    return R.replies(notes, ["doc_id"]).select("doc_id", "num", "parent")


