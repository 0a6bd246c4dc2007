"""Streams over the parts of .xlsx and .docx files: what is held is one row of a sheet or of a table, and a workbook's shared strings."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: What a file that can't be read raises.
BROKEN = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, ValueError, IndexError, EOFError)


def _children(stream, container: str) -> Iterator[ElementTree.Element]:
    """The children of each ``container`` element, each dropped when the next is asked for."""
    open_at, depth, holder = None, 0, None
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            depth += 1
            if open_at is None and element.tag == container:
                open_at, holder = depth, element
        else:
            if open_at is not None and depth == open_at + 1:
                yield element
                holder.clear()
            elif depth == open_at:
                open_at = None
            depth -= 1


# --- workbooks -------------------------------------------------------------------------------------------------------------


def sheets(z: zipfile.ZipFile) -> list[tuple[int, str, str]]:
    """(number from 0, name, part) of a workbook's sheets."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for no, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet")):
        target = links[sheet.get(_R)].lstrip("/")
        out.append((no, sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return out


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    with z.open("xl/sharedStrings.xml") as f:
        return ["".join(t.text or "" for t in item.iter(_S + "t")) for item in _children(f, _S + "sst")]


def cells(z: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, int, str]]:
    """(row, col, value) of a sheet's cells with a value; rows and columns count from 1."""
    last = 0
    with z.open(part) as f:
        for row in _children(f, _S + "sheetData"):
            last = int(row.get("r", last + 1))
            for c, cell in enumerate(row.iter(_S + "c"), 1):
                if m := re.match("[A-Z]+", cell.get("r") or ""):
                    c = 0
                    for ch in m[0]:
                        c = c * 26 + ord(ch) - 64
                kind, v = cell.get("t"), cell.find(_S + "v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(_S + "t"))
                else:
                    value = None if v is None else v.text
                    value = shared[int(value)] if kind == "s" and value is not None else value
                if value is not None:
                    yield last, c, value


# --- documents -------------------------------------------------------------------------------------------------------------


def _styles(z: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in z.namelist():
        return {}
    found = {}
    with z.open("word/styles.xml") as f:
        for style in _children(f, _W + "styles"):
            name = style.find(_W + "name")
            if style.tag == _W + "style" and name is not None:
                found[style.get(_W + "styleId")] = name.get(_W + "val") or ""
    return found


# What stands for a character in a run.
_MARKS = {_W + "br": "\n", _W + "cr": "\n", _W + "tab": "\t", _W + "noBreakHyphen": "-"}


def _text(p: ElementTree.Element) -> str:
    return "".join((t.text or "") if t.tag == _W + "t" else _MARKS[t.tag] for t in p.iter() if t.tag == _W + "t" or t.tag in _MARKS)


def _value(cell: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return cell.find(f"{_W}tcPr/{_W}{name}")


def paragraphs(z: zipfile.ZipFile) -> Iterator[tuple]:
    """(kind, table, row, col, paragraph, list style, text): the body's paragraphs, then the cells of all tables; everything counts from 1.

    A table inside a cell has the number of its outer table with its own behind it (2 in 1 is 12). A cell that spans columns is there
    for each, and one that goes on from the row above has that row's content.
    """
    styles = _styles(z)

    def listed(p: ElementTree.Element) -> bool:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        own = "" if style is None else style.get(_W + "val") or ""
        return "list" in styles.get(own, own).lower()

    def cell_rows(cell: ElementTree.Element, table: int, r: int, c: int) -> Iterator[tuple]:
        for k, p in enumerate(cell.findall(_W + "p"), 1):
            yield "table", table, r, c, k, listed(p), _text(p)
        for n, inner in enumerate(cell.findall(_W + "tbl"), 1):
            yield from table_rows(inner.iterfind(_W + "tr"), int(f"{table}{n}"))

    def table_rows(rows: Iterator[ElementTree.Element], table: int) -> Iterator[tuple]:
        above: dict[int, ElementTree.Element] = {}
        for r, row in enumerate(rows, 1):
            skip = row.find(f"{_W}trPr/{_W}gridBefore")
            at, c, here = 0 if skip is None else int(skip.get(_W + "val") or 0), 0, {}
            for cell in row.findall(_W + "tc"):
                merge, span = _value(cell, "vMerge"), _value(cell, "gridSpan")
                content = above.get(at, cell) if merge is not None and (merge.get(_W + "val") or "continue") == "continue" else cell
                for _ in range(1 if span is None else int(span.get(_W + "val") or 1)):
                    c, here[at] = c + 1, content
                    at += 1
                    yield from cell_rows(content, table, r, c)
            above = here

    with z.open("word/document.xml") as f:
        k = 0
        for element in _children(f, _W + "body"):
            if element.tag == _W + "p":
                k += 1
                yield "paragraph", None, None, None, k, listed(element), _text(element)
    with z.open("word/document.xml") as f:
        table = 0
        for element in _children(f, _W + "body"):
            if element.tag == _W + "tbl":
                table += 1
                yield from table_rows(element.iterfind(_W + "tr"), table)
