"""PDF kernels, tables and catalog against independent facts and DuckDB."""

import glob
import os
import zlib

import duckdb
import pytest

from papyra.functions import cos, filters
from papyra.functions.document import Document, append_revision, operations, runs, text_file, to_unicode
from papyra.plans.catalog import CATALOG
from papyra.sources import pdf

SF = "/root/testdata/sf0.001"


def page_texts(doc):
    return ["".join(r[0] for r in runs(doc, p)) for p in doc.pages()]


def test_values_round_trip():
    v = {"A": [1, -2.5, None, True, b"(x\\)\r", cos.Name("B #")], "R": cos.Ref(3, 0)}
    assert cos.Reader(cos.write(v)).value() == v
    assert cos.Reader(b"(a\\101\\\nb(c))").value() == b"aAb(c)"
    assert cos.Reader(b"<4>").value() == b"@"
    assert cos.number(-0.0000001) == "0" and cos.number(1.50) == "1.5"


def test_filters():
    data = bytes(range(256)) * 9
    assert filters.flate(zlib.compress(data)) == (data, "")
    assert filters.flate(zlib.compress(data)[2:-4]) == (data, "")
    part, note = filters.flate(zlib.compress(data)[:40])
    assert data.startswith(part) and note
    assert filters.run_length(b"\x02abc\xfed\x80") == (b"abcddd", "")
    assert filters.ascii_hex(b"48 65 6>") == (b"He`", "")
    assert filters.ascii85(b"87cUR~>") == (b"Hell", "")
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == (b"-----A---B", "")
    assert filters.predict(b"\x02\x01\x01\x02\x01\x01", {"Predictor": 12, "Columns": 2})[0] == b"\x01\x01\x02\x02"


def test_text_file_reads_back():
    d = Document(text_file(["eins", "", "zwei (x)"] + ["l"] * 60))
    assert d.recovery == "Clean" and len(d.pages()) == 2 and page_texts(d)[0].startswith("einszwei (x)")


def test_revisions_and_repair():
    base = text_file(["a"])
    changed = append_revision(base, {6: cos.Stream({}, b"BT /F1 9 Tf (new) Tj ET")})
    assert changed.startswith(base) and page_texts(Document(changed)) == ["new"] and append_revision(base, {}) is base
    broken = base.replace(b"startxref\n", b"startxref\n9")
    assert Document(broken).recovery == "Rebuilt" and page_texts(Document(broken)) == ["a"]
    assert Document(b"no file").recovery == "Failed"


def test_content_operations():
    ops = list(operations(b"q 1 0 0 1 5 5 cm BI /W 1 ID xyz EI Q 7"))
    assert [o[0] for o in ops] == ["q", "cm", "BI", "Q", ""] and ops[2][1][1] == b"xyz"
    assert to_unicode(b"1 beginbfrange <01> <03> <0041> endbfrange 1 beginbfchar <09> <00660066> endbfchar") == {1: "A", 2: "B", 3: "C", 9: "ff"}


def test_tables(spark):
    rows = spark.createDataFrame([(1, text_file(["hello world"])), (2, b"junk"), (3, None)], "doc_id long, content binary")
    got = {r.doc_id: r for r in pdf.files(rows).collect()}
    assert got[1].recovery == "Clean" and got[2].recovery == "Failed" and got[3].n_pages == 0
    assert pdf.document_text(rows).collect()[0].text == "hello world"
    assert pdf.refs(rows).where("doc_id = 1 and src = 0").count() == 2


@pytest.mark.parametrize("name", list(CATALOG))
def test_catalog(spark, name):
    run, sql = CATALOG[name]
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    mine, other = run(spark, SF).toPandas(), con.execute(sql).df()
    cols = sorted(mine.columns)
    assert cols == sorted(other.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(mine) == rows(other)


def test_structure_of_odd_files():
    from papyra.functions import structure as st

    d = Document(st.structured_file("t", [("a", ["b"]), ("c", [])], {"x": "1"}, "n", {"f": b"z"}))
    assert [x[0] for x in st.outlines(d)] == [[0], [0, 0], [1]] and list(st.fields(d)) == [("form.x", "Tx", 1, "1", True)]
    loop = text_file(["a"])
    loop = append_revision(loop, {1: {"Type": cos.Name("Catalog"), "Pages": cos.Ref(2, 0), "Outlines": {"First": cos.Ref(50, 0)}}, 50: {"Title": b"x", "Next": cos.Ref(50, 0), "First": cos.Ref(50, 0)}})
    assert len(list(st.outlines(Document(loop)))) == 1
    for bad in (b"", b"no file", text_file([])):
        assert [list(f(Document(bad))) for f in (st.outlines, st.attachments, st.layers, st.fields, st.annotations)] == [[]] * 5
    assert not st.signed(d) and st.signed(Document(append_revision(loop, {51: {"FT": cos.Name("Sig"), "V": 1}})))
    assert st.calculation('AFSimple_Calculate("SUM", new Array ("a", "b"));') == ("SUM", ["a", "b"])
    assert st.value_range("AFRange_Validate(true, 1, false, 9)") == (1.0, None) and st.value_range("x") is None


def test_ciphers_against_published_vectors():
    from papyra.functions import crypto as c

    assert c.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and c.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        got = c.cbc_encrypt(bytes(range(n)), bytes(16), plain)
        assert got.hex() == want and c.cbc_decrypt(bytes(range(n)), bytes(16), got) == plain
    data = bytes(range(100))
    assert c.aes_open(b"k" * 16, c.aes_seal(b"k" * 16, data)) == data and c.aes_open(b"k" * 16, b"short") == b""
    assert c.aes_open(b"k" * 16, c.aes_seal(b"k" * 16, data)[:-5])[:80] == data[:80]


@pytest.mark.parametrize("aes", [False, True])
def test_encrypted_files(aes):
    from functools import partial

    from papyra.functions.crypto import sealed

    locked = text_file(["secret (1)"], title="t", seal=partial(sealed, aes=aes, user=b"u", owner=b"o"))
    assert b"secret" not in locked
    for password, fits in ((b"u", True), (b"o", True), (b"", False)):
        d = Document(locked, password)
        assert (page_texts(d) == ["secret (1)"]) == fits and (d.get(d.trailer["Info"])["Title"] == b"t") == fits
        assert any("password" in n for n in d.notes) != fits
    assert page_texts(Document(text_file(["open"], seal=partial(sealed, aes=aes)))) == ["open"]


def test_strong_passwords():
    """Revision 6: a handler's own entries, made as the algorithm says, open with either password."""
    from papyra.functions import crypto as c

    key, salts = bytes(range(32)), [bytes([i] * 8) for i in range(4)]
    for r in (5, 6):
        u = c._strong_hash(b"u", salts[0], b"", r) + salts[0] + salts[1]
        o = c._strong_hash(b"o", salts[2], u, r) + salts[2] + salts[3]
        d = {"V": 5, "R": r, "U": u, "O": o, "UE": c.cbc_encrypt(c._strong_hash(b"u", salts[1], b"", r), bytes(16), key), "OE": c.cbc_encrypt(c._strong_hash(b"o", salts[3], u, r), bytes(16), key)}
        assert [c.Handler(d, b"", p).key for p in (b"u", b"o", b"x")] == [key, key, None]


@pytest.fixture(scope="module")
def one_group(tmp_path_factory):
    """Parts and customers in one row group each, as a small Parquet file of many rows has them."""
    import pyarrow.parquet as pq

    d = str(tmp_path_factory.mktemp("one"))
    for name in ("part", "customer"):
        pq.write_table(pq.read_table(f"{SF}/{name}.parquet"), f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["q_object_counts", "q_objects_by_form", "q_painted_paths", "q_pdf_signed", "q_reply_chain", "q_run_widths", "q_fill_maxlen", "q_xfdf_roundtrip", "q_flatten", "q_form_recalculate"])
def test_files_are_made_on_all_cores(spark, one_group, name):
    from pyspark.sql import functions as F

    got = CATALOG[name][0](spark, one_group)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2, "files are made and read once"
    if name != "q_reply_chain":  # its rows are shuffled again, and few
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism


def test_replies_in_one_pass(spark):
    from papyra.operators import relational as R

    notes = spark.createDataFrame([(1, 10, None, "Text", "a"), (1, 11, 10, "Popup", "b"), (1, 12, 10, "Text", "c"), (1, 13, 99, "Text", "d"), (2, 11, 10, "Text", "e"), (None, 1, 1, "Text", "f")], "doc_id long, num long, parent long, subtype string, more string")
    got = R.replies(notes, ["doc_id"])
    assert got.columns == ["doc_id", "parent", "num", "subtype", "more", "parent_subtype"]
    assert sorted(map(tuple, got.collect())) == [(1, 10, 11, "Popup", "b", "Text"), (1, 10, 12, "Text", "c", "Text")]


def test_reader_of_tables_and_tokens():
    """Tables that are read by entries: odd spacing, a reference where a heading should be, several in a section."""
    base = text_file(["x"])
    assert Document(base).recovery == "Clean" and Document(base.replace(b" 00000 n \n", b" 00000 n\r\n")).recovery == "Clean"
    assert Document(base.replace(b"\n1 1\n", b"\n1 0 R\n")).recovery == "Rebuilt"
    odd = b"%c\n-1.5 +-3 9223372036854775807 999999999999999999 5 0 R 5 0 Rx /A#42 /B)>] {true"
    got, r = [], cos.Reader(odd)
    try:
        while True:
            got.append(r.value())
    except EOFError:
        pass
    assert got == [-1.5, 3, 2.0**63, 999999999999999999, cos.Ref(5, 0), 5, 0, "Rx", "AB", "B", "]", "{", True]
    d = Document(base)
    d.pages()[0]["changed"] = 1
    assert "changed" not in d.pages()[0]
