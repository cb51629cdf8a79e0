"""Text blocks and ruled tables of a PDF, page by page. It knows nothing of Spark.

A page's operators place runs of text and draw lines. Runs in the order in which they are drawn make lines (the same baseline) and blocks (lines
below one another); lines that cross make grids, whose cells take the runs within them. Not read: encrypted files, text in pictures, composite
fonts whose codes neither a table to Unicode nor Unicode itself explains (their characters become U+FFFD), tables without ruling."""

from __future__ import annotations

import math
import re
import struct
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

from corvane.sources.pdf_objects import DAMAGE, END, Damaged, Document, Name, Reader, Stream, Word

#: What the streams of a file may unpack to, forms that a page may draw, crossings of lines on a page.
MOST_BYTES, MOST_FORMS, MOST_CROSSINGS = 500_000_000, 10_000, 1_000_000
#: In heights of the letters: baselines that are one line, a gap that is a space, a gap that ends the line, a step down that stays in the block.
SAME_LINE, SPACE, WIDE, NEXT_LINE = 0.3, 0.2, 2.0, 1.6
#: How far ends of lines may be from what they meet, in points.
NEAR = 3.0

#: Names of characters that no rule below gives: fixed values.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "endash": "–",
    "emdash": "—", "bullet": "•", "ellipsis": "…", "degree": "°", "plusminus": "±", "multiply": "×", "divide": "÷", "mu": "µ", "section": "§",
    "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi",
    "ffl": "ffl", "guillemotleft": "«", "guillemotright": "»", "Euro": "€", "sterling": "£", "copyright": "©", "registered": "®", "trademark": "™",
    "dotlessi": "ı", "lslash": "ł", "Lslash": "Ł", "lessequal": "≤", "greaterequal": "≥", "notequal": "≠", "nbspace": "\xa0", "afii61352": "№",
}
ACCENTS = {"dieresis": "DIAERESIS", "ring": "RING ABOVE", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE"}
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


@dataclass
class Page:
    blocks: list[str] = field(default_factory=list)
    tables: list[list[list[str]]] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)


@dataclass
class Run:
    """Text along a direction: from u0 to u1 on the baseline v, letters of height h; (x, y) is its middle on the page."""

    text: str
    turn: tuple[float, float]
    u0: float
    u1: float
    v: float
    h: float
    x: float
    y: float


def pages(content: bytes, most: int = MOST_BYTES) -> Iterator[Page]:
    """The pages in order. Damaged if it can't be opened; what fails on a page is a problem of that page, which keeps what came before."""
    try:
        doc = Document(content, most)
        nodes = list(doc.pages())
    except DAMAGE as error:
        raise Damaged("pdf") from error
    if not nodes:
        raise Damaged("no pages")
    fonts: dict = {}
    for node in nodes:
        page, canvas = Page(), Canvas(doc, fonts)
        try:
            parts = doc.resolved(node.get("Contents"))
            parts = [doc.resolved(p) for p in (parts if isinstance(parts, list) else [parts])]
            canvas.draw(b"\n".join(doc.unpacked(p) for p in parts if isinstance(p, Stream)), doc.of(node, "Resources", {}), IDENTITY)
        except DAMAGE:
            page.problems.append("pdf_page_unreadable")
        page.blocks = list(blocks(canvas.runs))
        try:
            page.tables = list(tables(canvas.lines, canvas.runs))
        except DAMAGE:
            page.problems.append("pdf_table_extraction_failed")
        yield page


def glyph(name: str) -> str:
    """A character by its name: as listed, by its code, a digit, a letter with an accent, a Greek or a Cyrillic one."""
    base = name.split(".")[0]
    if base in GLYPHS or len(base) == 1:
        return GLYPHS.get(base, base)
    if m := re.fullmatch(r"(?:uni|u)([0-9A-F]{4,6})", base):
        return chr(int(m[1], 16)) if int(m[1], 16) <= 0x10FFFF else "�"
    if m := re.fullmatch(r"afii100(\d\d)", base):  # Cyrillic in the order of its alphabet, io after ie
        n, first = (int(m[1]) - 17, 0x410) if int(m[1]) < 65 else (int(m[1]) - 65, 0x430)
        if 0 <= n <= 32:
            return ("Ё" if first == 0x410 else "ё") if n == 6 else chr(first + n - (n > 6))
    size = "CAPITAL" if base[0].isupper() else "SMALL"
    tries = [f"DIGIT {base.upper()}", f"LATIN {size} LETTER {base[0].upper()} WITH {ACCENTS.get(base[1:], base[1:].upper())}", f"GREEK {size} LETTER {base.upper()}"]
    for full in tries:
        try:
            return unicodedata.lookup(full)
        except KeyError:
            continue
    return "�"


class Unicode(dict):
    """A font's own table from codes to text in UTF-16: single codes, and ranges that are looked up when a code is first met."""

    def __init__(self, data: bytes):
        self.ranges: list[tuple[int, int, bytes]] = []
        reader, held = Reader(data), []
        while (v := reader.value()) is not END:
            if not isinstance(v, Word):
                held.append(v)
                continue
            if v == b"endbfchar":
                self.update({int.from_bytes(c, "big"): t for c, t in zip(held[::2], held[1::2], strict=False) if isinstance(c, bytes) and isinstance(t, bytes)})
            elif v == b"endbfrange":
                for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                    low, high = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                    if isinstance(to, list):
                        self.update(zip(range(low, high + 1), to, strict=False))
                    elif isinstance(to, bytes):
                        self.ranges.append((low, high, to))
            held = []
        self.ranges.sort()
        self.lows = [r[0] for r in self.ranges]

    def __missing__(self, code: int) -> bytes:
        i = bisect_right(self.lows, code) - 1
        low, high, to = self.ranges[i] if i >= 0 else (0, -1, b"")
        self[code] = to[:-2] + (int.from_bytes(to[-2:], "big") + code - low & 0xFFFF).to_bytes(2, "big") if code <= high else b"\xff\xfd"
        return self[code]


class Font:
    def __init__(self, doc: Document, entries: dict):
        of = doc.of
        kids = of(entries, "DescendantFonts", [])
        self.wide = entries.get("Subtype") == "Type0"
        stream = doc.resolved(entries.get("ToUnicode"))
        self.unicode = Unicode(doc.unpacked(stream)) if isinstance(stream, Stream) else None
        self.widths: dict[int, float] = {}
        if self.wide:
            inner = doc.resolved(kids[0]) if kids else {}
            self.default = of(inner, "DW", 1000)
            self.spread([doc.resolved(v) for v in of(inner, "W", [])])
            name = str(doc.resolved(entries.get("Encoding")))
            self.raw = "UCS2" in name or "UTF16" in name  # codes that are Unicode themselves
        else:
            first, widths = of(entries, "FirstChar", 0), of(entries, "Widths", [])
            self.widths = {first + i: float(w) for i, v in enumerate(widths) if isinstance(w := doc.resolved(v), (int, float))}
            plain = 600 if "Courier" in str(entries.get("BaseFont")) else 500
            self.default = of(of(entries, "FontDescriptor", {}), "MissingWidth", 0) or plain
            self.letters = self.encoding(doc, doc.resolved(entries.get("Encoding")))
        self.scale = abs(of(entries, "FontMatrix", [0.001])[0]) or 0.001

    def spread(self, flat: list) -> None:
        """Widths of a composite font: a code and its widths, or two codes and the width of all between."""
        at = 0
        while at + 1 < len(flat):
            if isinstance(flat[at + 1], list):
                self.widths |= {flat[at] + i: w for i, w in enumerate(flat[at + 1]) if isinstance(w, (int, float))}
                at += 2
            else:
                first, last, width = flat[at : at + 3]
                self.widths |= dict.fromkeys(range(first, min(last, 0xFFFF) + 1), width)
                at += 3

    def encoding(self, doc: Document, given) -> list[str]:
        entries = given if isinstance(given, dict) else {}
        name = given if isinstance(given, Name) else doc.resolved(entries.get("BaseEncoding"))
        letters = [bytes([i]).decode("mac_roman" if name == "MacRomanEncoding" else "cp1252", "replace") for i in range(256)]
        if name not in ("WinAnsiEncoding", "MacRomanEncoding"):  # the standard encoding has curly quotes where ASCII has straight ones
            letters[0x27], letters[0x60] = "’", "‘"
        code = 0
        for v in doc.of(entries, "Differences", []):
            v = doc.resolved(v)
            if isinstance(v, Name):
                letters[code & 255] = glyph(v)
                code += 1
            elif isinstance(v, int):
                code = v
        return letters

    def read(self, s: bytes) -> tuple[str, float, int, int]:
        """The text of a string, its width in units of the letters' height, its codes and those of them that are a blank byte."""
        codes = struct.unpack(f">{len(s) // 2}H", s[: len(s) // 2 * 2]) if self.wide else s
        total = (sum(map(self.widths.get, codes, repeat(self.default))) if self.widths else len(codes) * self.default) * self.scale
        if self.unicode is not None:
            text = b"".join(map(self.unicode.__getitem__, codes)).decode("utf-16-be", "replace")
        elif self.wide:
            text = s.decode("utf-16-be", "replace") if self.raw else "�" * len(codes)
        else:
            text = "".join(map(self.letters.__getitem__, codes))
        return text, total, len(codes), 0 if self.wide else s.count(b" ")


def times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def moved(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


@dataclass
class State:
    """What q saves and Q brings back."""

    matrix: tuple
    font: Font | None = None
    size: float = 1.0
    letter_gap: float = 0.0
    word_gap: float = 0.0
    stretch: float = 1.0
    leading: float = 0.0
    rise: float = 0.0


class Canvas:
    """Carries out a page's operators: runs of text and drawn lines."""

    def __init__(self, doc: Document, fonts: dict):
        self.doc, self.fonts = doc, fonts
        self.runs: list[Run] = []
        self.lines: list[tuple[float, float, float, float]] = []
        self.forms = 0

    def font(self, resources: dict, name: str) -> Font:
        listed = self.doc.of(resources, "Font", {})
        key = listed.get(name)
        key = key if key.__hash__ else id(key)  # fonts by reference, or the very entries
        if key not in self.fonts:
            self.fonts[key] = Font(self.doc, self.doc.of(listed, name, {}))
        return self.fonts[key]

    def draw(self, data: bytes, resources: dict, matrix: tuple, depth: int = 0) -> None:
        reader, held, saved, state = Reader(data), [], [], State(matrix)
        line = place = IDENTITY  # the matrices of the text line and of the next character
        path: list[tuple[float, float, float, float]] = []
        at = start = (0.0, 0.0)

        def show(s: bytes) -> None:
            nonlocal place
            if state.font is None or not s:
                return
            text, width, n, blanks = state.font.read(s)
            along = (width * state.size + n * state.letter_gap + blanks * state.word_gap) * state.stretch
            whole = times(place, state.matrix)
            (x0, y0), (x1, y1) = moved(whole, 0, state.rise), moved(whole, along, state.rise)
            place = times((1, 0, 0, 1, along, 0), place)
            h = abs(state.size) * math.hypot(whole[2], whole[3]) or 1.0
            long = math.hypot(whole[0], whole[1]) or 1.0
            turn = (round(whole[0] / long, 2), round(whole[1] / long, 2))
            u = lambda x, y: x * turn[0] + y * turn[1]
            up = 0.3 * h
            self.runs.append(Run(text, turn, u(x0, y0), u(x1, y1), y0 * turn[0] - x0 * turn[1], h, (x0 + x1) / 2 - up * turn[1], (y0 + y1) / 2 + up * turn[0]))

        def below(x: float, y: float) -> None:
            nonlocal line, place
            line = place = times((1, 0, 0, 1, x, y), line)

        while (v := reader.value()) is not END:
            if not isinstance(v, Word):
                held.append(v)
                if len(held) > 10_000:
                    raise Damaged("operands")
                continue
            op, a, held = bytes(v), held, []
            try:
                if op == b"Tj":
                    show(a[0])
                elif op == b"TJ":
                    for part in a[0]:
                        if isinstance(part, bytes):
                            show(part)
                        elif isinstance(part, (int, float)):
                            place = times((1, 0, 0, 1, -part / 1000 * state.size * state.stretch, 0), place)
                elif op == b"T*":
                    below(0, -state.leading)
                elif op in (b"'", b'"'):
                    if op == b'"':
                        state.word_gap, state.letter_gap = a[0], a[1]
                    below(0, -state.leading)
                    show(a[-1])
                elif op in (b"Td", b"TD"):
                    if op == b"TD":
                        state.leading = -a[1]
                    below(a[0], a[1])
                elif op == b"Tm":
                    given = tuple(map(float, a[:6]))
                    line = place = given if len(given) == 6 else line
                elif op == b"BT":
                    line = place = IDENTITY
                elif op == b"Tf":
                    state.font, state.size = self.font(resources, a[0]), float(a[1])
                elif op in SETTINGS:
                    setattr(state, SETTINGS[op], float(a[0]) / (100 if op == b"Tz" else 1))
                elif op == b"q":
                    saved.append(State(**vars(state)))
                elif op == b"Q" and saved:
                    state = saved.pop()
                elif op == b"cm":
                    state.matrix = times(tuple(map(float, a[:6])), state.matrix)
                elif op == b"m":
                    at = start = moved(state.matrix, a[0], a[1])
                elif op == b"l":
                    to = moved(state.matrix, a[0], a[1])
                    path.append((*at, *to))
                    at = to
                elif op in (b"c", b"v", b"y"):
                    at = moved(state.matrix, *a[-2:])
                elif op == b"h":
                    path.append((*at, *start))
                    at = start
                elif op == b"re":
                    x, y, w, h = a[:4]
                    corners = [moved(state.matrix, *c) for c in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
                    path += [(*corners[i - 1], *corners[i]) for i in range(4)]
                    at = start = corners[0]
                elif op in PAINTED:
                    self.lines += path + ([(*at, *start)] if op in (b"s", b"b", b"b*") else [])
                    path = []
                elif op == b"n":
                    path = []
                elif op == b"Do":
                    self.form(self.doc.resolved(self.doc.of(resources, "XObject", {}).get(a[0])), resources, state.matrix, depth)
                elif op == b"ID":
                    ends = re.compile(rb"[\x00\t\n\x0c\r ]EI(?![^\x00\t\n\x0c\r ])").search(data, reader.at)
                    reader.at = ends.end() if ends else len(data)
            except (IndexError, TypeError):  # an operator without its operands is passed over
                continue

    def form(self, stream, resources: dict, matrix: tuple, depth: int) -> None:
        if not isinstance(stream, Stream) or stream.entries.get("Subtype") != "Form":
            return
        self.forms += 1
        if depth > 12 or self.forms > MOST_FORMS:
            raise Damaged("forms")
        own = tuple(float(x) for x in self.doc.of(stream.entries, "Matrix", [])) or IDENTITY
        self.draw(self.doc.unpacked(stream), self.doc.of(stream.entries, "Resources", {}) or resources, times(own, matrix), depth + 1)


#: Operators that set one number of the state, and those that paint a path: fixed values of the format.
SETTINGS = {b"Tc": "letter_gap", b"Tw": "word_gap", b"Tz": "stretch", b"TL": "leading", b"Ts": "rise"}
PAINTED = {b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"}


def blocks(runs: list[Run]) -> Iterator[str]:
    """Runs in the order of drawing as blocks: lines joined by line ends, without white space around them."""
    lines: list[list[str]] = []
    last: Run | None = None
    low = high = 0.0  # how far the block reaches along the line

    def finished() -> str:
        return "\n".join(text for parts in lines if (text := "".join(parts).strip()))

    for r in runs:
        level = last is not None and r.turn == last.turn and abs(r.v - last.v) <= SAME_LINE * max(r.h, last.h)
        gap = (r.u0 - last.u1) / max(r.h, last.h) if level else 0.0
        if not r.text.strip() and not (level and -0.5 <= gap <= WIDE):
            continue  # blanks begin nothing
        if level and -0.5 <= gap <= WIDE:
            lines[-1].append((" " if gap > SPACE else "") + r.text)
            low, high = min(low, r.u0), max(high, r.u1)
        elif level and gap > WIDE:
            lines.append([r.text])
            high = max(high, r.u1)
        else:
            h = max(r.h, last.h) if last else r.h
            if last is None or r.turn != last.turn or not 0 < last.v - r.v <= NEXT_LINE * h or r.u0 > high or r.u1 < low:
                if lines and (text := finished()):
                    yield text
                lines, low, high = [], r.u0, r.u1
            lines.append([r.text])
            low, high = min(low, r.u0), max(high, r.u1)
        last = r
    if lines and (text := finished()):
        yield text


def snapped(values: list[float]) -> list[float]:
    """Sorted values, those that are near the one before left out."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > NEAR:
            out.append(v)
    return out


def tables(lines: list[tuple[float, float, float, float]], runs: list[Run]) -> Iterator[list[list[str]]]:
    """The grids that lines across and down make where they cross, from the top of the page, as rows of cells' texts; a single box is none."""
    across = sorted({((y0 + y1) / 2, min(x0, x1), max(x0, x1)) for x0, y0, x1, y1 in lines if abs(y0 - y1) < 1 <= abs(x0 - x1)})
    down = sorted({((x0 + x1) / 2, min(y0, y1), max(y0, y1)) for x0, y0, x1, y1 in lines if abs(x0 - x1) < 1 <= abs(y0 - y1)})
    above = list(range(len(across) + len(down)))

    def group(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    tries = 0
    for j, (x, y0, y1) in enumerate(down, start=len(across)):
        first, last = bisect_left(across, (y0 - NEAR,)), bisect_right(across, (y1 + NEAR, math.inf))
        tries += last - first
        if tries > MOST_CROSSINGS:
            raise Damaged("crossings")
        for i in range(first, last):
            if across[i][1] - NEAR <= x <= across[i][2] + NEAR:
                above[group(i)] = group(j)
    grids: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    for i in range(len(above)):
        grids[group(i)][i < len(across)].append((across[i] if i < len(across) else down[i - len(across)])[0])
    found = []
    for xs, ys in grids.values():
        xs, ys = snapped(xs), snapped(ys)
        if len(xs) > 1 and len(ys) > 1 and (len(xs) - 1) * (len(ys) - 1) > 1:
            found.append((-ys[-1], xs[0], xs, ys))
    flat = sorted((r.y, i) for i, r in enumerate(runs))
    for _, _, xs, ys in sorted(found):
        cells: dict[tuple[int, int], list[Run]] = defaultdict(list)
        for _, i in sorted(flat[bisect_left(flat, (ys[0],)) : bisect_left(flat, (ys[-1],))], key=lambda f: f[1]):
            r = runs[i]
            if xs[0] <= r.x < xs[-1]:
                cells[len(ys) - 1 - bisect_right(ys, r.y), bisect_right(xs, r.x) - 1].append(r)
        yield [["\n".join(blocks(cells[row, column])) for column in range(len(xs) - 1)] for row in range(len(ys) - 1)]
