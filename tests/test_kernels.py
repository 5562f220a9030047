"""Kernels on files made in memory: fonts, functions, reading, page operations, forms, protection, pixels."""

import math
import zlib

import numpy as np
import pytest

from papyra.functions import filters, forms, images, layout, organize, protect, raster, reading, samples
from papyra.functions.cos import Name, Ref, Stream
from papyra.functions.document import Document, append_revision, text_file
from papyra.functions.fonts import Font, base_encoding, glyph_codes, glyph_text, split_name, standard_width
from papyra.functions.interp import Interpreter
from papyra.functions.pdf_function import Function
from papyra.functions.structure import label_ranges

EMPTY = Document(b"")


def texts(data):
    d = Document(data)
    return [reading.page_text(d, p) for p in d.pages()]


def test_glyphs_and_encodings():
    assert [glyph_text(n) for n in ("aacute", "Lslash", "fi", "uni00410042", "u1F600", "A.alt", "f_i", "nothing", "alpha", "zero")] == ["á", "Ł", "ﬁ", "AB", "😀", "A", "fi", None, "α", "0"]
    assert len(glyph_codes()) > 400
    assert base_encoding("StandardEncoding")[0x27] == "’" and base_encoding("StandardEncoding")[0xAE] == "ﬁ" and base_encoding("PDFDocEncoding")[0x80] == "•"
    assert base_encoding("WinAnsiEncoding")[0x80] == "€" and base_encoding("MacRomanEncoding")[0x80] == "Ä"
    assert split_name("ABCDEF+TimesNewRomanPS-BoldItalicMT") == ("Times", ["bold", "italic"]) and split_name("Foo-Condensed") is None
    assert standard_width("Helvetica", "A") == 667 and standard_width("ArialMT", "é") == 556 and standard_width("Courier-Bold", "x") == 600 and standard_width("Unknown", "x") is None


def test_font_widths_and_codes():
    f = Font(EMPTY, {"Subtype": Name("Type1"), "BaseFont": Name("X"), "FirstChar": 65, "Widths": [300, 400], "Encoding": {"Differences": [66, Name("eacute"), Name(".notdef")]}, "FontDescriptor": {"MissingWidth": 250}})
    assert [f.width(c) for c in (65, 66, 67)] == [300, 400, 250] and [f.text(c) for c in (65, 66, 67)] == ["A", "é", ""] and f.encode("Aé") == b"AB" and f.encode("C") is None
    cid = Font(EMPTY, {"Subtype": Name("Type0"), "DescendantFonts": [{"DW": 800, "W": [1, [10, 20], 5, 7, 30, 6, [99]]}], "ToUnicode": Stream({}, b"1 beginbfchar <0001> <0041> endbfchar")})
    assert [cid.width(c) for c in (1, 2, 3, 6)] == [10, 20, 800, 30] and cid.shown(b"\0\1\0\2") == ("A", 30) and cid.encode("A") == b"\0\1"


def test_functions():
    calc = lambda body, x, n=1: Function(EMPTY, Stream({"FunctionType": 4, "Domain": [-100, 100] * len(x), "Range": [-1000, 1000] * n}, body))(x)
    for body, x, want in (
        (b"{add}", [2, 3], 5), (b"{sub}", [2, 3], -1), (b"{mul}", [2, 3], 6), (b"{div}", [3, 2], 1.5), (b"{idiv}", [7, 2], 3), (b"{mod}", [-5, 3], -2), (b"{exp}", [9, 0.5], 3),
        (b"{ln}", [math.e], 1), (b"{log}", [100], 2), (b"{sqrt}", [16], 4), (b"{sin}", [30], 0.5), (b"{cos}", [60], 0.5), (b"{atan}", [-1, 0], 270), (b"{neg}", [4], -4), (b"{abs}", [-4], 4),
        (b"{ceiling}", [3.2], 4), (b"{floor}", [-3.2], -4), (b"{round}", [6.5], 7), (b"{truncate}", [-3.7], -3), (b"{cvi}", [3.9], 3), (b"{cvr}", [3], 3), (b"{dup add}", [4], 8),
        (b"{exch sub}", [2, 5], 3), (b"{pop}", [2, 5], 2), (b"{2 copy add add add}", [2, 5], 14), (b"{1 index add add}", [2, 5], 9), (b"{3 1 roll sub sub}", [1, 2, 3], 4),
        (b"{3 lt {7} {8} ifelse}", [2], 7), (b"{dup 3 ge {2 mul} if}", [4], 8), (b"{5 and}", [6], 4), (b"{5 or}", [6], 7), (b"{5 xor}", [6], 3), (b"{not}", [6], -7), (b"{2 bitshift}", [3], 12),
        (b"{eq {1} {0} ifelse}", [2, 2], 1), (b"{ne {1} {0} ifelse}", [2, 2], 0), (b"{gt {1} {0} ifelse}", [2, 3], 0), (b"{le true and {1} {0} ifelse}", [2, 3], 1), (b"{false {1} {0} ifelse}", [2], 0),
    ):
        assert calc(body, x)[0] == pytest.approx(want), body
    assert calc(b"{no such}", [1]) == [1.0] and calc(b"{{dup} dup}", [1]) is not None
    grid = Function(EMPTY, Stream({"FunctionType": 0, "Domain": [0, 1, 0, 1], "Range": [0, 1], "Size": [2, 2], "BitsPerSample": 4}, bytes([0x0F, 0x0F])))
    assert grid([0.5, 0.3]) == [0.5] and grid([1, 1]) == [1.0] and grid([-5, 0]) == [0.0]


def test_reading_order_and_gaps():
    d = Document(samples.columns(["one", "two"], ["three", "four"]))
    assert reading.page_text(d, d.pages()[0], ordered=True) == "one\ntwo\nthree\nfour"
    d = Document(samples.kerned(["some", "words", "here"]))
    assert reading.page_text(d, d.pages()[0]) == "some words here"
    spaced = samples.page_file(b"BT /F1 10 Tf 2 Tc 50 700 Td (wide) Tj ET", {"Font": {"F1": samples.font()}})
    assert texts(spaced) == ["wide"]  # letter spacing is no word space
    tagged = samples.page_file(b"BT /F1 9 Tf /P <</MCID 1>> BDC 50 700 Td (second) Tj EMC /P <</MCID 0>> BDC 0 -50 Td (first) Tj EMC /Artifact BMC 0 -50 Td (page 1) Tj EMC ET", {"Font": {"F1": samples.font()}}, {20: {"K": [21, Ref(21, 0)]}, 21: {"Pg": Ref(3, 0), "K": [0, 1, Ref(20, 0)]}})
    d = Document(append_revision(tagged, {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0), "StructTreeRoot": Ref(20, 0)}}))
    order = reading.structure_order(d)
    assert order == {3: [0, 1]} and reading.page_text(d, d.pages()[0], True, order) == "first\nsecond"


def test_finding():
    assert reading.find("Hello hello", "HELLO") == [(0, 5), (6, 11)] and reading.find("aaa", "aa") == [(0, 2)] and reading.find("abc", "") == []
    assert reading.find("xß É", "é") == [(4, 6)] and reading.find("İx", "x") == [(2, 3)]


def test_interpreter():
    form = Stream({"Subtype": Name("Form"), "BBox": [0, 0, 10, 10], "Matrix": [2, 0, 0, 2, 5, 5]}, b"0 0 20 20 re f /Fm0 Do")
    d = Document(samples.page_file(b"q 0.5 g 1 0 0 1 10 10 cm 0 0 5 5 re W n 0 0 50 50 re f Q 0 1 1 0 k 0 0 1 1 re f /Fm0 Do ZZ /S0 sh", {"XObject": {"Fm0": Ref(10, 0)}}, {10: form}))
    i = Interpreter(d, d.pages()[0])
    assert i.marks[0].box == (10, 10, 15, 15) and i.marks[0].fill == (0.5, 0.5, 0.5) and i.marks[1].fill == (1, 0, 0)
    assert "forms are nested too deep" in i.notes and i.unknown == ["ZZ"] and [m.kind for m in i.marks].count("form") == 12
    inner = next(m for m in i.marks if m.form == "Fm0" and m.kind == "path")
    assert inner.box == (5, 5, 25, 25)
    assert reading.hit(i.marks[:2], 12, 12) == 0 and reading.hit(i.marks[:2], 100, 0) is None


def test_damaged_files():
    base = text_file(["a (7 0 obj inside) b"], compress=False)
    broken = base.replace(b"startxref\n", b"startxref\n9")
    d = Document(broken)
    assert d.recovery == "Rebuilt" and 7 not in d.entries and texts(broken) == ["a (7 0 obj inside) b"]
    for turn, want in ((45, 90), (225, 270), (-90, 270), (44, 0), (360, 0)):
        x = Document(samples.nested_pages([turn]))
        assert x.boxes(x.pages()[0])[2] == want
    bomb = zlib.compress(bytes(300 << 20), 9)
    got, note = filters.flate(bomb, 5 << 20)
    assert len(got) == 5 << 20 and note.startswith("more than")
    for data in (b"", b"abc" * 100, bytes(range(256)) + b"x" * 300):
        assert filters.run_length(filters.run_length_encode(data)) == (data, "")
        assert filters.ascii_hex(filters.ascii_hex_encode(data))[0] == filters.ascii85(filters.ascii85_encode(data))[0] == data


def test_page_operations():
    d, e = Document(text_file(["a", "b", "c"], 1)), Document(text_file(["z"]))
    assert texts(organize.merge([d, e])) == ["a", "b", "c", "z"] and texts(organize.delete(d, [1])) == ["a", "c"] and texts(organize.extract(d, [2, 0, 9])) == ["c", "a"]
    assert [texts(x) for x in organize.split_every(d, 2)] == [["a", "b"], ["c"]] and texts(organize.insert(d, e, 1)) == ["a", "z", "b", "c"] and texts(organize.replace(d, 1, e)) == ["a", "z", "c"]
    with pytest.raises(ValueError):
        organize.delete(d, [0, 1, 2])
    with pytest.raises(ValueError):
        organize.crop(d, 0, [5, 5, 5, 9])
    labelled = Document(organize.set_labels(d, [(0, "r", "", 1), (2, None, "x", 1)]))
    assert list(label_ranges(labelled)) == [(0, "r", None, 1), (2, None, "x", 1)]
    assert organize.apply_patches(b"abcdef", [(2, 2, b"X"), (2, 4, b""), (0, 1, b"Z")]) == b"ZbXef"
    for bad in ([(0, 3, b""), (2, 4, b"")], [(5, 9, b"")]):
        with pytest.raises(ValueError):
            organize.apply_patches(b"abcdef", bad)
    packed = organize.packed_file({n: d.get(n) for n in d.entries}, 1)
    assert texts(packed) == ["a", "b", "c"] and Document(packed).recovery == "Clean"
    assert layout.without_insertions(b"aXbYc", [b"X", b"Y"]) == b"abc" and layout.without_insertions(b"a", [b"X"]) is None


def test_forms_and_annotations():
    f = forms.number_format('AFNumber_Format(2, 0, 0, 0, "$", true);')
    assert [f.text(v) for v in (1234.5, -1234.5, 0.0)] == ["$1,234.50", "-$1,234.50", "$0.00"] and forms.number_of("EUR -1 234.5") == -1234.5
    assert [forms.calculate(k, [2, 3, 4]) for k in ("SUM", "PRD", "AVG", "MIN", "MAX")] == [9, 24, 3, 2, 4] and forms.calculate("PRD", []) == 0
    over = organize.Overlay(Document(samples.form({"a": "1"}, scripts={"a": {"V": "AFRange_Validate(true, 0, true, 9)"}})))
    with pytest.raises(ValueError):
        forms.fill(over, "a", "10")
    with pytest.raises(KeyError):
        forms.fill(over, "b", "1")
    forms.fill(over, "a", "9")
    forms.reset(over)
    assert [x.value for x in forms.form_fields(over)] == [None]
    assert forms.normalised_quad([10, 0, 0, 5, 0, 0, 10, 5]) == [0, 5, 10, 5, 0, 0, 10, 0]
    for kind in ("Highlight", "Underline", "StrikeOut", "Squiggly", "Circle", "Square"):
        over = organize.Overlay(Document(text_file(["x"])))
        forms.add_annotation(over, 0, kind, [0, 0, 20, 10], "c")
        d = Document(over.save_full())
        n = forms.flatten(again := organize.Overlay(d), 0)
        flat = Document(again.save_full())
        assert n == 1 and any(m.kind == "path" for m in Interpreter(flat, flat.pages()[0]).marks), kind


def test_protection():
    d = Document(text_file(["secret 123", "open"], 1, "secret 123"))
    assert protect.leaks(d, ["secret 123", "no"]) == ["secret 123"] and protect.leaks(Document(protect.scrub(d, ["secret 123"])), ["secret 123"]) == []
    data, n = protect.redacted(d, 0, [[0, 770, 612, 792]])
    assert n == 1 and texts(data) == ["", "open"] and b"secret 123" not in Document(data).content(Document(data).pages()[0])
    signed = Document(protect.sign({k: d.get(k) for k in d.entries}, 1, 5, "me"))
    assert protect.verified(signed) == [("me", True, False)]
    forged = Document(signed.data.replace(b"me", b"mx", 1) if b"(me)" in signed.data else signed.data)
    assert protect.verified(forged)[0][1] is False
    assert protect.permissions(-1)["print"] and protect.denied(-1) == "" and "print" in protect.denied(-3904)


def test_passwords():
    from papyra.functions.crypto import prepared

    assert prepared("a\u00a0b\u00adc\u2168") == "a bcIX"


def test_pixels():
    d = Document(samples.page_file(b"1 0 0 rg 10 10 20 20 re f 0 0 1 RG 4 w 50 50 m 100 50 l S 0 g 10.5 60 1 10 re f", page={"MediaBox": [0, 0, 120, 100]}))
    px = raster.render(d, d.pages()[0])
    assert px.shape == (100, 120, 4) and px[80, 20].tolist() == [255, 0, 0, 255] and px[50, 75].tolist() == [0, 0, 255, 255] and px[0, 0].tolist() == [255] * 4 and 120 < px[35, 10, 0] < 135
    turned = Document(samples.page_file(b"0 0 10 5 re f", page={"MediaBox": [0, 0, 30, 20], "Rotate": 90}))
    out = raster.render(turned, turned.pages()[0])
    assert out.shape == (30, 20, 4) and out[2, 2, 0] == 0 and out[25, 15, 0] == 255
    blend = lambda mode: raster.blended(mode, np.array([[0.2, 0.5, 0.8]]), np.array([[0.6, 0.4, 0.9]]))[0].tolist()
    assert blend("Multiply") == pytest.approx([0.12, 0.2, 0.72]) and blend("Screen") == pytest.approx([0.68, 0.7, 0.98])
    assert np.dot(blend("Luminosity"), [0.3, 0.59, 0.11]) == pytest.approx(np.dot([0.6, 0.4, 0.9], [0.3, 0.59, 0.11]))
    assert np.dot(blend("Color"), [0.3, 0.59, 0.11]) == pytest.approx(np.dot([0.2, 0.5, 0.8], [0.3, 0.59, 0.11]))
    pic = np.random.default_rng(0).integers(0, 256, (20, 30, 4)).astype(np.uint8)
    assert (images.read_png(images.png(pic)) == pic).all()
    x = Document(images.pdf_of_images([pic]))
    assert all((p == pic).all() for _, p in images.page_images(x, x.pages()[0]))
    assert images.compared(pic, pic)["ssim"] == pytest.approx(1) and images.compared(pic, pic[1:]) is None and images.compared(pic, pic // 2)["ssim"] < 1
    assert raster.dashed([(0, 0), (10, 0)], [3, 2]) == [[(0, 0), (3, 0)], [(5, 0), (8, 0)]]
    assert raster.coverage([[(0, 0), (2, 0), (2, 1), (0, 1)]], 3, 2).tolist() == [[1, 1, 0], [0, 0, 0]]


def test_ccitt():
    bits = lambda s: bytes(int(s[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(s), 8))
    want = [1, 1, 1, 0, 0, 1, 1, 1]
    assert images.ccitt(bits("1000" + "11" + "1000"), {"Columns": 8, "Rows": 1}).tolist() == [want]
    assert images.ccitt(bits("001" + "1000" + "11" + "1" + "111"), {"K": -1, "Columns": 8, "Rows": 2}).tolist() == [want, want]
    assert images.ccitt(bits("001" + "1000" + "11" + "1" + "011" + "011" + "1"), {"K": -1, "Columns": 8, "Rows": 2, "BlackIs1": True}).tolist() == [[1 - v for v in want], [0, 0, 0, 0, 1, 1, 0, 0]]
    assert images.ccitt(b"", {"K": -1, "Columns": 8}, 2).shape == (2, 8)


def test_layout_and_sessions():
    lines, fits = layout.paragraph("the quick brown fox jumps over the lazy dog", "Courier", 10, 12, 0, 100, 100, 30, "Justify")
    assert [p.text for p in lines] == ["the quick brown", "fox jumps over"] and lines[0].word_space == 5 and not fits
    assert layout.paragraph("ab", "Courier", 10, 12, 0, 100, 100, align="Right")[0][0].x == 88
    d = Document(samples.drawing("Hello", "Brand", 1))
    page = d.pages()[0]
    mark = next(m for m in Interpreter(d, page).marks if m.text == "Hello")
    s = layout.Session(d, 0)
    s.apply(layout.retyped(d, page, s.content, mark, "World"))
    assert s.undo() and not s.undo() and s.save() is d.data and s.redo() and not s.redo()
    assert "World" in texts(s.save())[0]
    with pytest.raises(ValueError):
        layout.retyped(d, page, s.content, mark, "日")
    over = organize.Overlay(d)
    layout.add_artifact(over, 0, "Head", 50, 780, 8)
    assert "Head" not in texts(over.save_full())[0] and layout.shared_forms(d) == {10: [0]}
    assert len(layout.subset_tag(b"x")) == 6 and layout.free_name("F", {"F0", "F1"}) == "F2"


def test_relational_edges(spark):
    from pyspark.sql import functions as F

    from papyra.operators import geometry as G
    from papyra.operators import leaks
    from papyra.operators import relational as R

    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(3, 1), (5, 2), (100, 101)], "src long, dst long")
    assert {r.node for r in R.reachable(edges, spark.createDataFrame([(0,)], "node long")).collect()} == set(range(13))
    got = {r.n: r.s for r in spark.range(0, 19000, 1).select(F.col("id").alias("n"), R.letters(F.col("id")).alias("s")).where("n in (0, 1, 26, 27, 702, 703, 18278)").collect()}
    assert got == {0: "0", 1: "a", 26: "z", 27: "aa", 702: "zz", 703: "aaa", 18278: "zzz"}
    docs = spark.createDataFrame([(1, "a long secret phrase which is here, twice long secret phrase which is here"), (2, "nothing"), (3, None)], "doc_id long, text string")
    secrets = spark.createDataFrame([(7, "long secret phrase which is here"), (8, "absent from all of these texts, truly"), (9, None)], "item long, s string")
    assert leaks.leak_pairs(docs, secrets, "doc_id", "text", "item", "s").collect() == [(1, 7)]
    most, leaks.MAX_SECRETS = leaks.MAX_SECRETS, 0
    try:
        assert leaks.leak_pairs(docs, secrets, "doc_id", "text", "item", "s").collect() == [(1, 7)]
    finally:
        leaks.MAX_SECRETS = most
    m = G.concat(G.rotation(F.lit(90.0)), G.matrix(1, 0, 0, 1, 5, 0))
    x, y = G.apply(m, F.lit(1.0), F.lit(0.0))
    row = spark.range(1).select(x.alias("x"), y.alias("y"), G.angle(m).alias("a"), G.mean_scale(m).alias("s")).first()
    assert [round(v, 9) for v in row] == [5, 1, 90, 1]
    c = [F.lit(v) for v in (0.2, 0.5, 0.8)]
    row = spark.range(1).select(*[R.blend(mode, F.lit(0.2), F.lit(0.6)).alias(mode) for mode in ("ColorDodge", "ColorBurn", "SoftLight")], *[v.alias(f"l{i}") for i, v in enumerate(R.blend_hsl("Luminosity", c, [F.lit(0.6), F.lit(0.4), F.lit(0.9)]))]).first()
    want = raster.blended("Luminosity", np.array([[0.2, 0.5, 0.8]]), np.array([[0.6, 0.4, 0.9]]))[0]
    assert list(row) == pytest.approx([0.5, 0.0, float(raster.blended("SoftLight", np.array([[0.2] * 3]), np.array([[0.6] * 3]))[0][0]), *want])


def test_stream_of_events(spark, tmp_path):
    """The same operators on a stream: files in, windows and distinct rows out."""
    from papyra.streaming.events import deduplicated, tumbling

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, f in (("windows", lambda d: tumbling(d, "1 hour")), ("distinct", lambda d: deduplicated(d.select("user_id", "event_type", "ts"), ["user_id", "event_type", "ts"]))):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == f(events).count()


def test_command_line(tmp_path, capsys):
    from papyra.__main__ import main

    one = tmp_path / "one.pdf"
    one.write_bytes(text_file(["hello", "there"], 1, "T"))
    assert main(["info", str(one)]) == 0 and '"pages": 2' in capsys.readouterr().out
    assert main(["check", str(one)]) == 0 and main(["extract", str(one)]) == 0 and capsys.readouterr().out == "hello\fthere\n"
    assert main(["find", str(one), "--needle", "ER"]) == 0 and capsys.readouterr().out == "1 2 4\n"
    both, picture = tmp_path / "both.pdf", tmp_path / "p.png"
    assert main(["merge", str(one), str(one), "-o", str(both)]) == 0 and texts(both.read_bytes()) == ["hello", "there"] * 2
    assert main(["split", str(both), "--every", "3", "-o", str(both)]) == 0 and (tmp_path / "both-1.pdf").exists()
    assert main(["render", str(one), "-o", str(picture), "--scale", "0.5"]) == 0 and images.read_png(picture.read_bytes()).shape == (396, 306, 4)
    assert main(["pages", str(one)]) == 0 and main(["rotate", str(one), "-o", str(both)]) == 0


def test_font_programs():
    from papyra.functions.truetype import TrueType, boxes_font, cid_to_gid, embedded, subset

    f = TrueType(boxes_font({"A": 600, "B": 400, "é": 300}))
    assert f.map == {65: 1, 66: 2, 233: 3} and [f.width(g) for g in (1, 2, 3)] == [600, 400, 300]
    assert f.outline(1) == [[(0, 0, True), (600, 0, True), (600, 700, True), (0, 700, True)]] and f.outline(3)[0][0] == (50, 10, True)
    small = TrueType(subset(f, "é"))
    assert small.outline(2) == [] and small.outline(3) == f.outline(3) and small.outline(1) == f.outline(1)  # what it is composed of stays
    assert raster.coverage(f.polygons(1, 10), 8, 8).sum() == pytest.approx(6 * 7)
    over = organize.Overlay(Document(text_file(["x"])))
    ref = embedded(f, "AB", "Box", over.add)
    leaf = over.doc.pages()[0]
    own = dict(over.get(leaf["#num"]))
    own |= {"Resources": {"Font": {"F9": ref}}, "Contents": over.add(Stream({}, b"BT /F9 10 Tf 5 5 Td <00010002> Tj ET"))}
    over.set(leaf["#num"], own)
    d = Document(over.save_full())
    m = Interpreter(d, d.pages()[0]).marks[0]
    px = raster.render(d, d.pages()[0])
    assert px[792 - 6, 8, 0] == 0 and px[792 - 20, 8, 0] == 255  # the box of A, and nothing above it
    assert reading.resource_counts(d, d.pages()[0]) == {"Font": 1} and reading.located(["ab", "cdé"], [(1, 2), (3, 4)]) == [(0, 1, 2), (1, 1, 2)]
    assert m.text == "AB" and m.line[2] - m.line[0] == pytest.approx(10)
    assert cid_to_gid(EMPTY, {})(5) == 5 and cid_to_gid(EMPTY, {"CIDToGIDMap": Stream({}, b"\0\7\0\2")})(1) == 2
    assert TrueType(b"junk").map == {} and TrueType(b"").outline(3) == []


def test_file_facts(spark):
    from papyra.sources import pdf

    over = organize.Overlay(Document(text_file(["x"], title="T")))
    over.set(4, {"Title": b"T", "Creator": b"\xfe\xff\x00C", "ModDate": b"D:2020"})
    xmp = over.add(Stream({}, b"<x/>"))
    over.set(1, dict(over.get(1)) | {"Lang": b"de", "Metadata": xmp})
    r = pdf.files(spark.createDataFrame([(1, over.save_incremental()), (2, b"x")], "doc_id long, content binary")).orderBy("doc_id").collect()
    assert (r[0].title, r[0].creator, r[0].moddate, r[0].lang, r[0].xmp, r[0].n_revisions, r[0].damaged, r[0].xfa) == ("T", "C", "D:2020", "de", "<x/>", 2, False, False)
    assert r[1].recovery == "Failed" and r[1].damaged and r[1].title is None
    marks = pdf.marks(spark.createDataFrame([(1, samples.drawing("a", "b", 2))], "doc_id long, content binary")).collect()
    assert [m.kind for m in marks] == ["path", "path", "text", "form", "text"] and marks[0].fill == [1, 0, 0]
