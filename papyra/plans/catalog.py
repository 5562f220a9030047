"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structure as structure_kernel
from ..functions.crypto import sealed
from ..operators import relational as R
from ..sources import pdf, structure
from . import file_queries  # noqa: F401 - registers its queries
from .registry import CATALOG, query, t  # noqa: F401



def generated(spark: SparkSession, d: str) -> DataFrame:
    return pdf.pdfs_from_text(t(spark, d, "documents"))


CLEAN = "trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))"


@query(f"SELECT doc_id, length({CLEAN}) AS n_chars, md5({CLEAN}) AS digest FROM documents WHERE {CLEAN} <> ''")
def page_text(spark, d):
    """Texts to PDF files, and out of these again."""
    clean = F.trim(F.regexp_replace("text", "[ \\t\\n\\r\\x0b\\x0c]+", " "))
    return pdf.document_text(generated(spark, d)).select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("digest"))


LINES = "(length(text) - length(replace(text, chr(10), '')) + 1)"


@query(f"SELECT doc_id, CAST(ceil({LINES} / 40.0) AS BIGINT) AS n_pages, 'Clean' AS recovery, 'Document ' || doc_id AS title, false AS encrypted FROM documents")
def pdf_files(spark, d):
    return pdf.files(generated(spark, d)).select("doc_id", "n_pages", "recovery", "title", "encrypted")


@query(f"SELECT op, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['Tj', 'T*', 'BT', 'ET', 'Tf', 'TL', 'Td']) AS op, unnest([l, l, p, p, p, p, p]) AS n FROM (SELECT {LINES} AS l, CAST(ceil({LINES} / 40.0) AS BIGINT) AS p FROM documents)) GROUP BY op")
def pdf_ops_histogram(spark, d):
    return pdf.content_ops(generated(spark, d)).groupBy("op").agg(F.count("*").alias("n"))


@query(f"SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['Dict', 'Stream']) AS kind, unnest([4 + p, p]) AS n FROM (SELECT CAST(ceil({LINES} / 40.0) AS BIGINT) AS p FROM documents)) GROUP BY kind")
def pdf_objects_by_kind(spark, d):
    return pdf.objects(generated(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, i AS page_index, 612.0 AS width, 792.0 AS height, CAST(0 AS BIGINT) AS rotation FROM (SELECT doc_id, unnest(range(CAST(ceil({LINES} / 40.0) AS BIGINT))) AS i FROM documents)")
def pdf_pages(spark, d):
    return pdf.pages(generated(spark, d)).select("doc_id", "page_index", "width", "height", "rotation")


@query("SELECT doc_id, needle, CAST((length(lower(text)) - length(replace(lower(text), needle, ''))) / length(needle) AS BIGINT) AS n FROM documents, (VALUES ('the'), ('er'), ('und')) v(needle)")
def find_count(spark, d):
    docs = t(spark, d, "documents").withColumn("needle", F.explode(F.array(*map(F.lit, ("the", "er", "und")))))
    return docs.select("doc_id", "needle", R.find_count(F.col("text"), F.col("needle")).alias("n"))


_DIGIT = "(['{}'])[CAST(floor(n / {}) AS BIGINT) % 10 + 1]"
_ROMAN = " || ".join(_DIGIT.format("','".join(w), u) for w, u in ((R.THOUSANDS, 1000), (R.HUNDREDS, 100), (R.TENS, 10), (R.ONES, 1)))


@query(f"""SELECT idx, CASE WHEN idx < 3 THEN CAST(idx + 1 AS VARCHAR) WHEN idx < 300 THEN CASE WHEN n BETWEEN 1 AND 3999 THEN {_ROMAN} ELSE CAST(n AS VARCHAR) END
WHEN idx < 900 THEN 'A-' || n ELSE 'x' END AS label FROM (SELECT p_partkey AS idx, CASE WHEN p_partkey < 300 THEN p_partkey - 2 ELSE p_partkey - 295 END AS n FROM part)""")
def page_labels(spark, d):
    ranges = spark.createDataFrame([(3, "r", "", 1), (300, "D", "A-", 5), (900, None, "x", 1)], "start long, style string, prefix string, first long")
    return R.page_labels(t(spark, d, "part").select(F.col("p_partkey").alias("idx")), ranges)


@query("SELECT p_partkey, CAST((((CAST(floor((p_size * 37 - 900 + 45) / 90.0) AS BIGINT) * 90) % 360) + 360) % 360 AS INTEGER) AS rotation FROM part")
def rotate_normalise(spark, d):
    return t(spark, d, "part").select("p_partkey", R.right_angle(F.col("p_size") * 37 - 900).alias("rotation"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def xref_newest_wins(spark, d):
    return R.newest(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


EDGES = "SELECT 'r' || r_regionkey AS dst, 'root' AS src FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def dangling_refs(spark, d):
    parts = t(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    return R.dangling(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey").drop("l_partkey")


@query("SELECT conv_id, string_agg(part, '' ORDER BY turn) AS text FROM (SELECT conv_id, turn, CASE WHEN row_number() OVER w = 1 THEN '' ELSE chr(10) END || text AS part FROM conversations WHERE text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY 1")
def text_join(spark, d):
    """Turns as runs on lines of their own."""
    runs = t(spark, d, "conversations").select("conv_id", "turn", "text", F.lit(10.0).alias("size"), F.lit(0.0).alias("sx"), F.lit(50.0).alias("ex"), (-12.0 * F.col("turn")).alias("sy"), (-12.0 * F.col("turn")).alias("ey"))
    return pdf.join_runs(runs, ["conv_id"], "turn")


@query("""SELECT o_custkey, o_orderkey, coalesce(s < max(e) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps
FROM (SELECT o_custkey, o_orderkey, o_orderkey AS s, o_orderkey + 500 AS e FROM orders)""")
def patch_order(spark, d):
    rows = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 500).alias("end"))
    return R.sorted_patches(rows, ["o_custkey"]).select("o_custkey", "o_orderkey", "overlaps")


@query("""SELECT user_id, min(l) >= 0 AND sum(st) = 0 AS balanced, CAST(min(l) AS BIGINT) AS lowest FROM (SELECT user_id, st, sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS l
FROM (SELECT *, CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN -1 ELSE 0 END AS st FROM events)) GROUP BY 1""")
def balance_check(spark, d):
    return R.balance(t(spark, d, "events"), ["user_id"], "event_id", "click", "view", "event_type").select("user_id", "balanced", "lowest")


@query("SELECT l_orderkey, l_linenumber, (1 - l_discount) * (1 - l_tax) AS r, (1 - l_tax) * (1 - l_tax) AS g, (1 - 0.5) * (1 - l_tax) AS b FROM lineitem")
def cmyk_rgb(spark, d):
    x = R.cmyk_to_rgb(F.col("l_discount"), F.col("l_tax"), F.lit(0.5), F.col("l_tax"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for c, n in zip(x, "rgb")])


_BLEND = {"Multiply": "l_tax * l_discount", "Screen": "l_tax + l_discount - l_tax * l_discount", "Darken": "least(l_tax, l_discount)", "Lighten": "greatest(l_tax, l_discount)", "Difference": "abs(l_tax - l_discount)"}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"{s} AS {m}" for m, s in _BLEND.items()) + " FROM lineitem")
def blend_separable(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[R.blend(m, F.col("l_tax"), F.col("l_discount")).alias(m) for m in _BLEND])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    from ..streaming.events import tumbling

    return tumbling(t(spark, d, "events"), "1 hour")


def structured(spark: SparkSession, d: str) -> DataFrame:
    """A file for each customer: two sections, three form values, a note and an attachment."""

    def file(name, segment, nation):
        return structure_kernel.structured_file(name, [(segment, [name, str(nation)]), ("Späte Ω", [])], {"name": name, "segment": segment, "nation": str(nation)}, f"{name} & <{segment}>", {"note.txt": name.encode()})

    return pdf.made(t(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"], file)


@query("""SELECT c_custkey AS doc_id, unnest([c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR), 'Späte Ω']) AS title, unnest(['0', '0.0', '0.1', '1']) AS path,
CAST(unnest([0, 1, 1, 0]) AS BIGINT) AS depth, CAST(unnest([0, 0, 0, 1]) AS BIGINT) AS page_index FROM customer""")
def pdf_outline(spark, d):
    return structure.outlines(structured(spark, d)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


@query("SELECT c_custkey AS doc_id, 'note.txt' AS file_name, md5(c_name) AS digest FROM customer")
def pdf_attachments(spark, d):
    return structure.attachments(structured(spark, d)).select("doc_id", "file_name", F.md5("body").alias("digest"))


@query("SELECT c_custkey AS doc_id, unnest([c_mktsegment, 'Späte Ω']) AS name, unnest([false, true]) AS visible FROM customer")
def pdf_layers(spark, d):
    return structure.layers(structured(spark, d)).select("doc_id", "name", "visible")


@query("SELECT c_custkey AS doc_id, unnest(['form.name', 'form.segment', 'form.nation']) AS name, 'Tx' AS type, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value, true AS read_only FROM customer")
def pdf_form_fields(spark, d):
    return structure.form_fields(structured(spark, d)).select("doc_id", "name", "type", "value", "read_only")


@query("""SELECT c_custkey AS doc_id, '<xfdf><fields><field name="form.name"><value>' || c_name || '</value></field><field name="form.nation"><value>' || c_nationkey
|| '</value></field><field name="form.segment"><value>' || c_mktsegment || '</value></field></fields></xfdf>' AS xfdf FROM customer""")
def form_xfdf_export(spark, d):
    return structure.form_xfdf(structure.form_fields(structured(spark, d)))


@query("SELECT c_custkey AS doc_id, 'Text' AS subtype, c_name || ' & <' || c_mktsegment || '>' AS contents, CAST(4 AS BIGINT) AS flags FROM customer")
def pdf_annotations(spark, d):
    return structure.annotations(structured(spark, d)).select("doc_id", "subtype", "contents", "flags")


@query("SELECT c_custkey AS doc_id, false AS signed FROM customer")
def pdf_signed(spark, d):
    return structure.signed(structured(spark, d))


@query("SELECT l_orderkey, l_linenumber, 0.2126 * l_discount + 0.7152 * l_tax + 0.0722 * 0.5 AS y, CAST(floor(least(greatest(l_discount * 20.0 - 0.5, 0.0), 1.0) * 255.0 + 0.5) AS INTEGER) AS r8 FROM lineitem")
def luma(spark, d):
    r8 = F.floor(F.least(F.greatest(F.col("l_discount") * 20.0 - 0.5, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.luma(F.col("l_discount"), F.col("l_tax"), F.lit(0.5)).alias("y"), r8.alias("r8"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM
(SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""")
def events_session(spark, d):
    from ..streaming.events import sessions

    return sessions(t(spark, d, "events"), "30 minutes")


@query("SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events")
def stream_dedupe(spark, d):
    from ..streaming.events import deduplicated

    return deduplicated(t(spark, d, "events").select("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"), "ts"), ["user_id", "event_type", "hour"]).drop("ts")


@query(f"SELECT doc_id, md5({CLEAN}) AS digest FROM documents WHERE {CLEAN} <> ''")
def decrypt_roundtrip(spark, d):
    """Texts to encrypted files that open without a password, and out of these again."""
    clean = F.trim(F.regexp_replace("text", "[ \\t\\n\\r\\x0b\\x0c]+", " "))
    files = pdf.pdfs_from_text(t(spark, d, "documents"), seal=sealed)
    return pdf.document_text(files).select("doc_id", F.md5(clean).alias("digest"))
