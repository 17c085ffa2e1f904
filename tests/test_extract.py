"""Texts of office documents built in memory."""

import io
import struct
import time
import zipfile
import zlib

import pytest
from lodestack.sources.extract import columns, office97, ooxml, pdf
from lodestack.sources.extract.xmltext import element_text
from pyspark.sql import functions as F

RUN, PAR = "run", frozenset({"par"})


@pytest.mark.parametrize(
    "xml, want",
    [
        # only the element's own text, whatever the prefix
        ("<d><run>Übersicht</run>lost<run> 2024</run></d>", "Übersicht 2024"),
        ("<w:d xmlns:w='u'><w:run>合同</w:run><x:run>草稿</x:run></w:d>", "合同草稿"),
        # a line feed at the end of every paragraph, also of one without text
        ("<d><par><run>first</run></par><par/><par><run>third</run></par></d>", "first\n\nthird\n"),
        # references: named, decimal, hexadecimal; what isn't one stays
        ("<run>5 &gt; 3 &#38; 2 &#x3C; 4</run>", "5 > 3 & 2 < 4"),
        ("<run>R&amp;D &euro; &;</run>", "R&D &euro; &;"),
        ("<run>&#xD800;|&#x110000;|&#99999999999;</run>", "&#xD800;|&#x110000;|&#99999999999;"),
        # sections that aren't markup
        ("<d><run>a<![CDATA[1 < 2 &lt;]]>b</run></d>", "a1 < 2 &lt;b"),
        ("<d><!-- <run>no</run> --><?pi <run>no</run>?><run>yes</run></d>", "yes"),
        ("<!DOCTYPE d [<!ELEMENT run (#PCDATA)> <!ENTITY e '<run>no</run>'>]><d><run>yes</run></d>", "yes"),
        # quotes may hide the end of a tag
        ("<d><run note='1 > 0' x=\"a'>b\">kept</run></d>", "kept"),
        # line ends
        ("<run>one\r\ntwo\rthree</run>", "one\ntwo\nthree"),
        # damaged: what was read so far
        ("<d><par><run>cut of", "cut of"),
        ("<run>Mr &quo", ""),
        ("</d><run>after</run>", ""),
        ("<d><par>x</other><run>y</run>", "\n"),
        ("<d><run>out<run>in</run>gone</run></d>", "outin"),
        ("no markup at all", ""),
        ("", ""),
    ],
)
def test_xml(xml, want):
    assert element_text(xml, RUN, PAR) == want


def zipped(*entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries:
            z.writestr(name, text)
    return out.getvalue()


def test_ooxml():
    assert ooxml.docx(zipped(("word/document.xml", "<b><p><t>你好</t></p><p><t>Second</t></p></b>"))) == "你好\nSecond\n"
    slides = zipped(("ppt/slides/slide10.xml", "<p><a:t>B10</a:t></p>"), ("ppt/slides/slide2.xml", "<p><a:t>A2</a:t></p>"), ("ppt/notesSlides/notesSlide2.xml", "<p><a:t>N2</a:t></p>"), ("ppt/media/i.png", "x"))
    assert ooxml.pptx(slides) == "A2\n\nN2\n\nB10\n"
    sheet = zipped(("xl/sharedStrings.xml", "<sst><si><t>共享词</t></si></sst>"), ("xl/worksheets/sheet1.xml", "<ws><row><c><t>单元格</t></c></row></ws>"))
    assert ooxml.xlsx(sheet) == "共享词\n单元格\n"


def test_entry_limit(monkeypatch):
    big = zipped(("word/document.xml", "<t>" + "x" * 100 + "</t>"))
    monkeypatch.setattr(ooxml, "MOST_ENTRY", 23)
    assert ooxml.docx(big) == "x" * 20


def compound(**streams: bytes) -> bytes:
    """A compound file whose streams are padded to normal sectors."""
    size = 512
    bodies = {n: s.ljust(max(4096, -(-len(s) // size) * size), b"\0") for n, s in streams.items()}
    fat: list[int] = [0xFFFFFFFD]
    sectors: list[bytes] = [b""]
    starts = {}
    for name, body in bodies.items():
        starts[name] = len(sectors)
        parts = [body[i : i + size] for i in range(0, len(body), size)]
        for k, part in enumerate(parts):
            sectors.append(part)
            fat.append(len(sectors) if k < len(parts) - 1 else 0xFFFFFFFE)
    entries = [("Root Entry", 5, 0xFFFFFFFE, 0)] + [(n.replace("_", " "), 2, starts[n], len(bodies[n])) for n in bodies]
    raw = b""
    for name, kind, start, length in entries:
        text = name.encode("utf-16-le")
        raw += text.ljust(64, b"\0") + struct.pack("<HBB", len(text) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", start, length, 0)
    raw = raw.ljust(-(-len(raw) // size) * size, b"\0")
    first_dir = len(sectors)
    for i in range(0, len(raw), size):
        sectors.append(raw[i : i + size])
        fat.append(len(sectors) if i + size < len(raw) else 0xFFFFFFFE)
    assert len(fat) <= 128
    sectors[0] = struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat)))
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    header += struct.pack("<III", 1, first_dir, 0) + struct.pack("<IIIII", 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    header += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return header + b"".join(sectors)


def word(*pieces: tuple[bool, bytes], lcid=0x0409, flags=0) -> bytes:
    stream = bytearray(0x400)
    struct.pack_into("<H", stream, 0, 0xA5EC)
    struct.pack_into("<H", stream, 6, lcid)
    struct.pack_into("<H", stream, 10, flags)
    bounds, pcds = [0], b""
    for narrow, raw in pieces:
        at = len(stream)
        stream += raw
        bounds.append(bounds[-1] + (len(raw) if narrow else len(raw) // 2))
        pcds += struct.pack("<HIH", 0, (at << 1) | 0x40000000 if narrow else at, 0)
    plc = struct.pack(f"<{len(bounds)}i", *bounds) + pcds
    clx = b"\x01" + struct.pack("<H", 2) + b"zz" + b"\x02" + struct.pack("<i", len(plc)) + plc
    struct.pack_into("<ii", stream, 0x1A2, 0, len(clx))
    return compound(WordDocument=bytes(stream), **{"0Table": clx})


def test_doc():
    assert office97.doc(word((True, b"caf\xe9\r"), (False, "报告\x0b".encode("utf-16-le")))) == "café\n报告\n"
    assert office97.doc(word((True, "报告".encode("gb18030")), lcid=0x0804)) == "报告"
    fields = "a\x13 HYPERLINK \x14shown\x15b\x15c\x1ed"
    assert office97.doc(word((True, fields.encode()))) == "ashownbc-d"
    nested = "x\x13 A \x13 B \x14b\x15 \x14c\x13 D \x15\x15y\x13open"
    assert office97.doc(word((True, nested.encode()[:9]), (True, nested.encode()[9:]))) == "xcyopen"
    with pytest.raises(ValueError):
        office97.doc(word((True, b"x"), flags=0x0100))
    with pytest.raises(ValueError):
        office97.doc(b"nothing")


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def test_xls():
    sst = struct.pack("<II", 3, 3) + struct.pack("<HB", 2, 0) + b"ab" + struct.pack("<HBH", 3, 9, 1) + "报告书".encode("utf-16-le")[:4]
    more = b"\x01" + "书".encode("utf-16-le") + b"\0" * 4 + struct.pack("<HB", 4, 0) + b"wxyz"
    assert office97.xls(compound(Workbook=record(0x809, b"\0" * 16) + record(0xFC, sst) + record(0x3C, more) + record(0x0A, b""))) == "ab\n报告书\nwxyz"
    label = struct.pack("<HHHH", 0, 0, 0, 4) + "报告".encode("gb18030")
    assert office97.xls(compound(Book=record(0x42, struct.pack("<H", 936)) + record(0x204, label))) == "报告"


def test_ppt():
    atom = lambda kind, raw: struct.pack("<HHI", 0, kind, len(raw)) + raw
    inner = atom(0x0FA0, "标题\r二".encode("utf-16-le")) + atom(0x0FA8, b"body") + atom(0x1234, b"skip")
    assert office97.ppt(compound(PowerPoint_Document=struct.pack("<HHI", 0xF, 0x3E8, len(inner)) + inner)) == "标题\n二\nbody"


def test_column(spark):
    docs = [(".docx", zipped(("word/document.xml", "<p><t>text</t></p>"))), (".docx", b"not a zip"), (".rar", b"x"), (".docx", b""), (".docx", None), (None, b"x"), (".doc", word((True, b"old")))]
    df = spark.createDataFrame(docs, "ext string, data binary")
    assert [r[0] for r in df.select(columns.text_column(F.col("data"), F.col("ext"))).collect()] == ["text\n", None, None, None, None, None, "old"]
    own = {".rar": lambda b: b.decode(), ".slow": lambda b: time.sleep(5) or "never"}
    assert columns.extract(".rar", b"x", own) == "x" and columns.extract(".rar", b"  ", own) is None
    assert len(columns.extract(".rar", b"x" * (2 << 20), own)) == 1 << 20
    began = time.time()
    assert columns.extract(".slow", b"x", own, seconds=0.2) is None and time.time() - began < 2


def test_time_limit_in_tasks(spark, tmp_path):
    names = ["a.slow", "b.quick", "c.slow", "gone.quick"]
    for name in names[:3]:
        (tmp_path / name).write_text("text")
    parsers = {".slow": lambda b: time.sleep(20) or "never", ".quick": lambda b: b.decode()}
    began = time.time()
    got = columns.texts_at(spark.createDataFrame([(str(tmp_path / n),) for n in names], "path string"), parsers, seconds=0.3).collect()
    assert [(r.path, r.text) for r in got] == [(str(tmp_path / "b.quick"), "text")] and time.time() - began < 15


def pdf_file(content: bytes, packed=True, head=b""):
    body = zlib.compress(content) if packed else content
    to_unicode = b"1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0003> <6587> endbfrange 1 beginbfrange <10> <11> [<0061> <00620063>] endbfrange"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        b"<< /Length %d %s>> stream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if packed else b"", body),
        b"<< /Type /Font /Subtype /Type1 >>",
        b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>",
        b"<< /Length %d >> stream\n%s\nendstream" % (len(to_unicode), to_unicode),
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, x) for k, x in enumerate(objects)) + head


@pytest.mark.parametrize("packed", [True, False])
def test_pdf(packed):
    content = b"BT /F1 12 Tf 72 700 Td (Hello \\(one\\)) Tj 0 -14 Td [(Wor) -20 (ld) -300 (two)] TJ ET BT /F2 9 Tf 1 0 0 1 72 600 Tm <00010002> Tj T* <0003> Tj ET"
    assert pdf.text(pdf_file(content, packed)) == "Hello (one)\nWorld two\n中文\n\u6588\n"
    assert columns.extract(".pdf", pdf_file(content, packed)).startswith("Hello")


def test_damaged_pdf():
    assert columns.extract(".pdf", b"nothing") is None
    assert columns.extract(".pdf", pdf_file(b"BT (x) Tj ET", head=b"trailer << /Encrypt 9 0 R >>")) is None
    whole = pdf_file(b"BT /F1 1 Tf (kept) Tj ET")
    for cut in range(0, len(whole), 37):  # whatever is cut off, nothing but text or None comes out
        assert columns.extract(".pdf", whole[:cut]) in (None, "kept\n")
