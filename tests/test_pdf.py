"""PDFs made here: each way of cross references, filters, encodings, layout, tables, and damaged files."""

import random
import zlib
from base64 import a85encode

import pytest

from corvane.sources import files, formats, pdf, pdf_objects

HELVETICA = "<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"


def stream(data: bytes, entries: str = "") -> bytes:
    return f"<</Length {len(data)}{entries}>>\nstream\n".encode() + data + b"\nendstream"


def joined(objects: dict[int, bytes]) -> tuple[bytes, dict[int, int]]:
    out, places = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n", {}
    for number, body in objects.items():
        places[number] = len(out)
        out += f"{number} 0 obj\n".encode() + body + b"\nendobj\n"
    return out, places


def made(contents: list[bytes], font: str = HELVETICA, more: dict[int, bytes] | None = None, entries: str = "", resources: str = "", xref: bool = True) -> bytes:
    """Object 1 is the catalog, 2 the page tree, 3 the font; pages and their contents from 10 on."""
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(contents)))
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: f"<</Type/Pages/Kids[{kids}]/Count {len(contents)}/Resources<</Font<</F1 3 0 R>>{resources}>>>>".encode(), 3: font.encode()}
    for i, c in enumerate(contents):
        objects |= {10 + 2 * i: f"<</Type/Page/Parent 2 0 R/Contents {11 + 2 * i} 0 R>>".encode(), 11 + 2 * i: stream(c, entries)}
    out, places = joined(objects | (more or {}))
    if not xref:
        return out + b"trailer <</Root 1 0 R>>"
    table = b"xref\n0 1\n0000000000 65535 f \n" + b"".join(f"{n} 1\n{at:010} 00000 n \n".encode() for n, at in places.items())
    return out + table + f"trailer <</Size 99/Root 1 0 R>>\nstartxref\n{len(out)}\n%%EOF".encode()


def text(*lines: str) -> bytes:
    return b"BT /F1 10 Tf 12 TL 50 700 Td " + b" ".join(b"(" + line.encode("cp1252") + b") Tj T*" for line in lines) + b" ET"


def blocks(content: bytes) -> list[list[str]]:
    return [p.blocks for p in pdf.pages(content)]


def test_pages_in_order_however_they_are_found():
    contents = [text("One é", "two"), text("Next")]
    want = [["One é\ntwo"], ["Next"]]
    whole = made(contents)
    assert blocks(whole) == want and blocks(made(contents, xref=False)) == want
    assert blocks(whole[: whole.index(b"xref\n")]) == want  # cut off before its cross references
    assert blocks(whole.replace(b"startxref\n", b"startxref\n9")) == want
    assert blocks(b"junk" + whole) == want  # every place is off by four
    nested = made([text("A")]).replace(b"/Contents 11 0 R", b"/Contents [11 0 R 99 0 R]")
    assert blocks(nested) == [["A"]]


def test_a_later_version_of_an_object_counts():
    old = made([text("Old")])
    body = b"11 0 obj\n" + stream(text("New")) + b"\nendobj\n"
    prev = old.rindex(b"xref\n0")
    new = old + b"\n" + body + f"xref\n11 1\n{len(old) + 1:010} 00000 n \ntrailer <</Size 99/Root 1 0 R/Prev {prev}>>\nstartxref\n{len(old) + 1 + len(body)}\n%%EOF".encode()
    assert blocks(new) == [["New"]]


@pytest.mark.parametrize("searched", [False, True])
def test_objects_within_streams(searched):
    inner = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[4 0 R]/Count 1>>", 3: HELVETICA.encode(), 4: b"<</Type/Page/Contents 5 0 R/Resources<</Font<</F1 3 0 R>>>>>>"}
    offsets, at = [], 0
    for number, body in inner.items():
        offsets.append(f"{number} {at}")
        at += len(body) + 1
    head = " ".join(offsets).encode() + b" "
    packed = zlib.compress(head + b" ".join(inner.values()))
    out, places = joined({5: stream(text("Packed")), 6: stream(packed, f"/Type/ObjStm/N {len(inner)}/First {len(head)}/Filter/FlateDecode")})
    rows = {0: (0, 0, 255), **{n: (2, 6, i) for i, n in enumerate(inner)}, 5: (1, places[5], 0), 6: (1, places[6], 0), 7: (1, len(out), 0)}
    plain = [bytes([a]) + b.to_bytes(4, "big") + bytes([c]) for a, b, c in (rows[n] for n in range(8))]
    up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True)) for row, above in zip(plain, [bytes(6), *plain], strict=False))
    out += b"7 0 obj\n" + stream(zlib.compress(up), "/Type/XRef/Size 8/W[1 4 1]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 6>>") + b"\nendobj\n"
    end = f"startxref\n{out.rindex(b'7 0 obj')}\n%%EOF".encode()
    assert blocks(out + (b"" if searched else end)) == [["Packed"]]


def lzw(data: bytes) -> bytes:
    """The plain way: codes of nine bits, the table cleared before they would grow."""
    bits = "".join(f"{256:09b}" * (i % 100 == 0) + f"{b:09b}" for i, b in enumerate(data)) + f"{257:09b}"
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def runs(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + b"\x80"


@pytest.mark.parametrize(("name", "pack"), [("FlateDecode", zlib.compress), ("Fl", zlib.compress), ("ASCIIHexDecode", lambda d: d.hex().encode() + b">"), ("ASCII85Decode", lambda d: a85encode(d) + b"~>"), ("LZWDecode", lzw), ("RunLengthDecode", runs)])
def test_filters(name, pack):
    lines = [f"line {i} of (some) text".replace("(", "\\(").replace(")", "\\)") for i in range(20)]
    content = text(*lines)
    want = [["\n".join(f"line {i} of (some) text" for i in range(20))]]
    assert blocks(made([pack(content)], entries=f"/Filter/{name}")) == want
    assert blocks(made([pack(pack(content))], entries=f"/Filter[/{name}/{name}]")) == want


def test_predictors_undo_every_kind_of_row():
    rng = random.Random(5)
    width, step = 12, 3
    rows, packed, above = [bytes(rng.randrange(256) for _ in range(width)) for _ in range(25)], b"", bytes(width)
    for n, row in enumerate(rows):
        packed += bytes([n % 5])
        for i, x in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            distances = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
            paeth = (a, b, c)[distances.index(min(distances))]
            packed += bytes([(x - (0, a, b, (a + b) // 2, paeth)[n % 5]) & 255])
        above = row
    assert pdf_objects.unpredicted(packed, {"Predictor": 15, "Colors": 3, "Columns": 4}) == b"".join(rows)
    tiff = b"".join(bytes((x - (row[i - 3] if i >= 3 else 0)) & 255 for i, x in enumerate(row)) for row in rows)
    assert pdf_objects.unpredicted(tiff, {"Predictor": 2, "Colors": 3, "Columns": 4}) == b"".join(rows)


def test_strings_and_names():
    read = lambda s: pdf_objects.Reader(s).value()
    assert read(rb"(a\(b\)(c)\n\101\7z\\\q" + b"\\\r\n)") == b"a(b)(c)\nA\x07z\\q"
    assert read(b"% note\n <48 65 6> ") == b"He`" and read(b"/A#20b") == "A b" and read(b"<</K [1 -2.5 true null 3 0 R (x)]>>") == {"K": [1, -2.5, True, None, pdf_objects.Ref(3), b"x"]}
    with pytest.raises(pdf_objects.Damaged):
        read(b"[" * 1000)


def test_encodings():
    font = "<</Type/Font/Subtype/Type1/BaseFont/X/Encoding<</Differences[1/eacute/Odieresis/uni0416/afii10023/afii10097/alpha/Omega/one/fi/g.alt/nothing]>>>>"
    assert blocks(made([b"BT /F1 10 Tf <0102030405060708090a0b27> Tj ET"], font)) == [["éÖЖЁяαΩ1fig�’"]]
    table = b"1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0410> <0020> <0021> [<0058> <00590059>] endbfrange"
    wide = "<</Type/Font/Subtype/Type0/Encoding/Identity-H/DescendantFonts[<</DW 600/W[3[250] 16 18 500]>>]/ToUnicode 4 0 R>>"
    assert blocks(made([b"BT /F1 10 Tf <0010001100120003002000210099> Tj ET"], wide, {4: stream(table)})) == [["АБВ XYY�"]]
    raw = "<</Type/Font/Subtype/Type0/Encoding/UniGB-UTF16-H/DescendantFonts[<<>>]>>"
    assert blocks(made(["BT /F1 10 Tf <".encode() + "水😀".encode("utf-16-be").hex().encode() + b"> Tj ET"], raw)) == [["水😀"]]
    assert blocks(made([b"BT /F1 10 Tf <00010002> Tj ET"], raw.replace("UniGB-UTF16-H", "Identity-H"))) == [["��"]]


def test_layout():
    kerned = b"BT /F1 10 Tf 50 700 Td [(Ker)30(ned)-300(words)] TJ 0 -12 Td (next) Tj 0 -30 Td (far below) Tj ET"
    assert blocks(made([kerned])) == [["Kerned words\nnext", "far below"]]
    columns = b"BT /F1 10 Tf 50 700 Td (left one) Tj 0 -12 Td (left two) Tj 250 12 Td (right one) Tj 0 -12 Td (right two) Tj ET"
    assert blocks(made([columns])) == [["left one\nleft two", "right one\nright two"]]
    turned = b"BT /F1 10 Tf 0 1 -1 0 100 100 Tm (up) Tj ET q 1 0 0 -1 0 800 cm BT /F1 10 Tf 1 0 0 -1 50 100 Tm (flipped) Tj 1 0 0 -1 50 112 Tm (too) Tj ET Q"
    assert blocks(made([turned])) == [["up", "flipped\ntoo"]]
    quoted = b"BT /F1 10 Tf 12 TL 50 700 Td (a) Tj (b) ' 1 0 (c) \" ET BI /W 1 ID \x00\xff) EI BT /F1 10 Tf 50 500 Td (after the picture) Tj ET"
    assert blocks(made([quoted])) == [["a\nb\nc", "after the picture"]]
    form = {5: stream(b"BT /F1 10 Tf 50 600 Td (in a form) Tj ET", "/Subtype/Form/Matrix[1 0 0 1 0 9]"), 6: stream(b"/Loop Do", "/Subtype/Form")}
    page, looped = pdf.pages(made([b"/X Do", b"/Loop Do"], more=form, resources="/XObject<</X 5 0 R/Loop 6 0 R>>"))
    assert page.blocks == ["in a form"] and looped.problems == ["pdf_page_unreadable"]


def ruled(x: int, y: int, cells: list[list[str]]) -> bytes:
    """A grid with its top left corner there, cells 100 wide and 20 high."""
    rows, columns = len(cells), len(cells[0])
    out = "".join(f"{x} {y - 20 * i} m {x + 100 * columns} {y - 20 * i} l " for i in range(rows + 1)) + "".join(f"{x + 100 * j} {y} m {x + 100 * j} {y - 20 * rows} l " for j in range(columns + 1)) + "S "
    return (out + "".join(f"BT /F1 10 Tf {x + 100 * j + 5} {y - 20 * i - 14} Td ({c}) Tj ET " for i, row in enumerate(cells) for j, c in enumerate(row))).encode()


def test_ruled_tables():
    upper, lower = [["name", "size"], ["a b", "1"], ["", "2"]], [["k", "v", "u"], ["x", "y", "z"]]
    boxes = b"".join(f"{50 + 100 * j} {200 - 20 * i} 100 20 re S BT /F1 10 Tf {55 + 100 * j} {206 - 20 * i} Td (c{i}{j}) Tj ET ".encode() for i in range(2) for j in range(2))
    lone = b"300 300 50 20 re S 0 50 m 500 50 l S BT /F1 10 Tf 305 306 Td (boxed) Tj ET "
    (page,) = pdf.pages(made([ruled(50, 400, lower) + ruled(50, 700, upper) + boxes + lone]))
    assert page.tables == [upper, lower, [["c00", "c01"], ["c10", "c11"]]] and "boxed" in page.blocks
    (d,), warnings = formats.normalised("c", "a.pdf", made([text("Title"), ruled(50, 700, upper)]))
    assert d["tables"] == [{"id": d["tables"][0]["id"], "page": 2, "headers": ["name", "size"], "rows": [["a b", "1"], ["", "2"]]}] and warnings == []
    rows = [s["text"] for s in d["spans"] if s["source_type"] == "table"]
    assert d["spans"][0]["text"] == "Title" and rows == ["name | size", "a b | 1", " | 2".strip()] and d["content"].endswith(rows[-1])


def test_damaged_files_are_warnings(spark):
    whole = made([text("fine"), text("second")])
    locked = whole.replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 9 0 R")
    odd = made([text("fine"), b"not packed"], entries="").replace(b"not packed", b"(open      ")[:-1]
    rows = spark.createDataFrame([("good.pdf", whole), ("cut.pdf", whole[:40]), ("locked.pdf", locked), ("empty.pdf", b""), ("null.pdf", None), ("odd.pdf", odd), ("blank.pdf", made([b""]))], "path string, content binary")
    normal = files.normalised(rows)
    assert {r.path: r.content for r in files.documents(normal).collect()} == {"good.pdf": "fine\n\nsecond", "odd.pdf": "fine", "blank.pdf": ""}
    want = {"pdf_parse_failed:cut.pdf", "pdf_parse_failed:locked.pdf", "pdf_parse_failed:empty.pdf", "pdf_parse_failed:null.pdf", "pdf_page_unreadable:page_2", "empty_document:blank.pdf"}
    assert {r.warning for r in files.warnings(normal).collect()} == want
    bomb = made([zlib.compress(bytes(3_000_000))], entries="/Filter/FlateDecode")
    assert [p.problems for p in pdf.pages(bomb, most=1_000_000)] == [["pdf_page_unreadable"]]


def test_no_damage_escapes():
    rng = random.Random(11)
    whole = made([text("Some text"), ruled(50, 700, [["a", "b"], ["c", "d"]])], more={5: stream(zlib.compress(b"x" * 50), "/Type/ObjStm/N 3/First 5/Filter/FlateDecode")})
    for _ in range(400):
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 30)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        for content in (bytes(data), bytes(data[: rng.randrange(len(data))])):
            formats.normalised("c", "a.pdf", content)  # documents or warnings, never an error
