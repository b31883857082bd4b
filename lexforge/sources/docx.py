"""Word-processor files: reading every surface, redacting text, and writing a cleaned copy.

Files are rows of (path, content), as Spark's ``binaryFile`` source gives them; each is handled alone in an Arrow UDF.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.session import ship

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ALTERNATIVE = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
VISIBLE = ("body", "footnote", "endnote", "header", "footer")
#: Text parts of a file: kind, name pattern.
PARTS = (
    ("body", r"word/document\d*\.xml"),
    ("footnote", r"word/footnotes\.xml"),
    ("endnote", r"word/endnotes\.xml"),
    ("header", r"word/header\d*\.xml"),
    ("footer", r"word/footer\d*\.xml"),
    ("comment", r"word/comments\.xml"),
)
SPAN = "array<struct<part:string,file:string,note:int,index:int,text:string>>"
FIXED_DATE = (1980, 1, 1, 0, 0, 0)


def _members(content: bytes) -> dict[str, bytes]:
    """The readable members of a zip file; an unreadable file has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            return {i.filename: z.read(i) for i in z.infolist() if i.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)}
    except (zipfile.BadZipFile, RuntimeError):
        return {}


def _tree(raw: bytes) -> ET.Element | None:
    try:
        return ET.fromstring(raw)
    except ET.ParseError:
        return None


def _switch(properties: ET.Element | None) -> bool | None:
    """Whether run properties hide the text; None if they do not say."""
    flag = None if properties is None else properties.find(f"{W}vanish")
    return None if flag is None else flag.get(f"{W}val", "true").lower() not in ("0", "false", "off")


class Styles:
    """Which styles hide their text, by themselves or through what they are based on, and what holds without a style."""

    def __init__(self, raw: bytes):
        root = _tree(raw)
        styles = [] if root is None else list(root.iter(f"{W}style"))
        self.hides, based = {}, {}
        for style in styles:
            name, parent = style.get(f"{W}styleId", ""), style.find(f"{W}basedOn")
            said = _switch(style.find(f"{W}rPr"))
            if said is not None:
                self.hides[name] = said
            elif parent is not None:
                based[name] = parent.get(f"{W}val")
        while inherited := {name: self.hides[parent] for name, parent in based.items() if name not in self.hides and parent in self.hides}:
            self.hides |= inherited
        usual = (s.get(f"{W}styleId") for s in styles if s.get(f"{W}type") == "paragraph" and s.get(f"{W}default") in ("1", "true", "on"))
        self.paragraph = next(usual, None)
        self.default = bool(root is not None and _switch(root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr")))

    def conceals(self, run: ET.Element, paragraph: str | None) -> bool:
        """Of the run itself, its style, its paragraph's style and the file's defaults the first that says anything holds."""
        properties = run.find(f"{W}rPr")
        style = None if properties is None else properties.find(f"{W}rStyle")
        said = [_switch(properties), None if style is None else self.hides.get(style.get(f"{W}val")), self.hides.get(paragraph or self.paragraph)]
        return next((s for s in said if s is not None), self.default)


def _events(root: ET.Element) -> Iterator[tuple[bool, ET.Element]]:
    """Every element as it opens (true) and closes (false), without the fallbacks of alternative content."""
    waiting = [(True, root)]
    while waiting:
        opens, node = waiting.pop()
        yield opens, node
        if opens:
            waiting.append((False, node))
            waiting += [(True, child) for child in reversed(node) if child.tag != ALTERNATIVE]


#: What elements of a run stand for.
_MARKS = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "‑"}
#: Elements of which all text is deleted, or moved away.
_GONE = (f"{W}del", f"{W}moveFrom")


def _paragraphs(root: ET.Element, styles: Styles) -> list[dict[str, str]]:
    """For each paragraph its texts by surface; the paragraphs of a text box are paragraphs of their own."""
    out: list[dict[str, str]] = []
    inside: list[tuple[dict[str, str], str | None]] = []  # open paragraphs, each with its style
    runs: list[bool] = []  # open runs: whether they are hidden
    gone = 0
    for opens, node in _events(root):
        tag, step = node.tag, 1 if opens else -1
        if tag in _GONE:
            gone += step
        elif tag == f"{W}p":
            if opens:
                style = node.find(f"{W}pPr/{W}pStyle")
                inside.append(({}, None if style is None else style.get(f"{W}val")))
                out.append(inside[-1][0])
            else:
                inside.pop()
        elif tag == f"{W}r":
            runs.append(styles.conceals(node, inside[-1][1] if inside else None)) if opens else runs.pop()
        elif opens and inside:
            surface = "deleted" if gone or tag == f"{W}delText" else "hidden" if runs and runs[-1] else "shown"
            said = [(surface, node.text or "")] if tag in (f"{W}t", f"{W}delText") else [(surface, _MARKS[tag])] if tag in _MARKS else []
            if tag == f"{W}instrText":
                said = [("field", node.text or "")]
            elif tag.endswith("}docPr"):
                said = [("alt", node.get(name)) for name in ("descr", "title") if node.get(name)]
            for where, text in said:
                inside[-1][0][where] = inside[-1][0].get(where, "") + text
    return out


def read_parts(content: bytes, path: str = "") -> list[dict]:
    """Every text of a file: visible parts first, then comments, hidden and deleted text, fields, alternative texts,
    properties, custom parts, link targets and the file's own name; only texts with a letter or digit."""
    members = _members(content)
    styles = Styles(members.get("word/styles.xml", b""))
    visible, rest = [], []
    for kind, pattern in PARTS:
        for file in sorted(m for m in members if re.fullmatch(pattern, m)):
            root = _tree(members[file])
            if root is None:
                continue
            notes = [n for n in root if n.tag in (f"{W}footnote", f"{W}endnote", f"{W}comment")] or [root]
            index = 0
            for note in notes:
                if note.get(f"{W}type") in ("separator", "continuationSeparator"):
                    continue
                number = int(note.get(f"{W}id", "0")) if note is not root else None
                for p in _paragraphs(note, styles):
                    for surface, text in p.items():
                        row = {"part": kind if surface == "shown" else surface, "file": file, "note": number, "index": index, "text": text}
                        (visible if row["part"] in VISIBLE else rest).append(row)
                    index += 1
    for file in sorted(members):
        if file.endswith(".rels"):
            for link in _tree(members[file]) if _tree(members[file]) is not None else ():
                if link.get("TargetMode") == "External":
                    rest.append({"part": "link", "file": file, "note": None, "index": len(rest), "text": link.get("Target", "")})
        elif file.startswith("docProps/") or file.startswith("customXml/item"):
            root = _tree(members[file])
            kind = "property" if file.startswith("docProps/") else "custom"
            for i, node in enumerate(root.iter() if root is not None else ()):
                if node.text and node.text.strip():
                    rest.append({"part": kind, "file": file, "note": None, "index": i, "text": node.text})
    if path:
        rest.append({"part": "filename", "file": path.rsplit("/", 1)[-1], "note": None, "index": 0, "text": path.rsplit("/", 1)[-1]})
    return [r for r in visible + rest if re.search(r"\w", r["text"])]


def redacted(content: bytes, places: list[tuple[str, int, int, int, str]]) -> bytes:
    """A copy with (file, paragraph, start, end, label) of the shown text replaced across runs, and cleaned.

    Changes are accepted, comments, hidden runs, properties and custom parts go. Members are written in order with a
    fixed date, so the same input gives the same bytes.
    """
    members = _members(content)
    styles = Styles(members.get("word/styles.xml", b""))
    by_file: dict[str, list] = {}
    for file, paragraph, start, end, label in places:
        by_file.setdefault(file, []).append((paragraph, start, end, label))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for file, raw in members.items():
            if re.fullmatch(r"word/comments\w*\.xml|docProps/.*|customXml/.*", file):
                continue
            if any(re.fullmatch(p, file) for _, p in PARTS):
                raw = _rewrite(raw, by_file.get(file, []), styles)
            elif file.endswith(".rels") or file == "[Content_Types].xml":
                raw = re.sub(rb'<(?:Relationship|Override)\b[^>]*(?:comments\w*\.xml|docProps/|customXml/)[^>]*?/>', b"", raw)
            z.writestr(zipfile.ZipInfo(file, FIXED_DATE), raw, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _rewrite(raw: bytes, places: list[tuple[int, int, int, str]], styles: Styles) -> bytes:
    root = _tree(raw)
    if root is None:
        return raw
    for prefix, uri in re.findall(rb'xmlns:(\w+)="([^"]+)"', raw):
        ET.register_namespace(prefix.decode(), uri.decode()) if not re.fullmatch(rb"ns\d+", prefix) else None
    paragraphs = [p for p in root.iter(f"{W}p")]
    for number, p in enumerate(paragraphs):
        style = p.find(f"{W}pPr/{W}pStyle")
        style = None if style is None else style.get(f"{W}val")
        deleted = {t for gone in _GONE for d in p.iter(gone) for t in d.iter()}
        runs = [r for r in p.iter(f"{W}r") if r not in deleted and not styles.conceals(r, style)]
        texts = [t for r in runs for t in r.iter(f"{W}t")]
        for paragraph, start, end, label in sorted(places, reverse=True):
            if paragraph != number:
                continue
            at, first = 0, True
            for t in texts:
                own = t.text or ""
                a, b = max(start - at, 0), min(end - at, len(own))
                at += len(own)
                if a < b:
                    t.text = own[:a] + (label if first else "") + own[b:]
                    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                    first = False
        for r in [r for r in p.iter(f"{W}r") if styles.conceals(r, style)]:
            for t in list(r):
                if t.tag != f"{W}rPr":
                    r.remove(t)
    for parent in list(root.iter()):
        for child in list(parent):
            if child.tag in (*_GONE, f"{W}commentRangeStart", f"{W}commentRangeEnd", f"{W}commentReference"):
                parent.remove(child)
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def plain_file(texts: list[str]) -> bytes:
    """A minimal file with one paragraph for each text; characters that XML cannot hold become spaces."""
    root = ET.Element(f"{W}document")
    body = ET.SubElement(root, f"{W}body")
    for text in texts:
        run = ET.SubElement(ET.SubElement(body, f"{W}p"), f"{W}r")
        ET.SubElement(run, f"{W}t").text = re.sub("[^\t\n\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", " ", text)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("word/document.xml", FIXED_DATE), ET.tostring(root, encoding="utf-8", xml_declaration=True), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def files_of(rows: DataFrame) -> DataFrame:
    """path, content: one file for each row of (path, texts)."""
    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def build(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: plain_file([x or "" for x in t]))

    return rows.select("path", build("texts").alias("content"))


def parts(files: DataFrame) -> DataFrame:
    """path, part, file, note, index, text of every text of the files (path, content)."""
    ship(files.sparkSession)

    @F.pandas_udf(SPAN)
    def read(content: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([read_parts(c, p or "") for c, p in zip(content, path, strict=True)], dtype=object)

    return files.select("path", F.explode(read("content", "path")).alias("p")).select("path", "p.*")


def paragraphs(files: DataFrame) -> DataFrame:
    """path, part, note, index, text of the body, then the notes: the simple reader."""
    return parts(files).where(F.col("part").isin("body", "footnote", "endnote"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the word-processor files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder).select("path", "content")


def copies(files: DataFrame, places: DataFrame) -> DataFrame:
    """path, content of the redacted copies; *places* has (path, file, index, start, end, label)."""
    ship(files.sparkSession)
    listed = places.groupBy("path").agg(F.collect_list(F.struct("file", "index", "start", "end", "label")).alias("places"))

    @F.pandas_udf("binary")
    def rewrite(content: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([redacted(c, [] if p is None else [(x["file"], x["index"], x["start"], x["end"], x["label"]) for x in p]) for c, p in zip(content, found, strict=True)])

    return files.join(listed, "path", "left").select("path", rewrite("content", "places").alias("content"))
