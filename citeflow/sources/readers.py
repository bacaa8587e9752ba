"""Readers of bibliographic exports into one works table."""

from __future__ import annotations

import codecs
import csv
import io
import re
import tempfile
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from citeflow.functions import text as T

from . import scratch

TARGETS = ("Author", "Title", "Abstract", "Article References", "Times Cited", "Publication Year", "DOI", "Publisher", "Keywords")
# Header spellings that mean a target column.
ALIASES = {
    "authors": "Author", "author": "Author",
    "title": "Title", "article title": "Title",
    "abstract note": "Abstract", "abstract": "Abstract",
    "references": "Article References", "article references": "Article References", "cited references": "Article References",
    "publication year": "Publication Year", "year": "Publication Year",
    "times cited": "Times Cited", "citations": "Times Cited", "citation count": "Times Cited",
    "doi": "DOI",
    "publisher": "Publisher", "journal": "Publisher", "journal name": "Publisher",
    "keywords": "Keywords", "author keywords": "Keywords",
}
# RIS tags and BibTeX fields by target.
RIS_TAGS = {"AU": "Author", "A1": "Author", "TI": "Title", "T1": "Title", "AB": "Abstract", "N2": "Abstract", "PY": "Publication Year", "Y1": "Publication Year", "DO": "DOI", "JO": "Publisher", "JF": "Publisher", "T2": "Publisher", "PB": "Publisher", "KW": "Keywords"}


def normalize(df: DataFrame) -> DataFrame:
    """Headers to target names (others kept, title-cased), columns of one
    name coalesced left to right, missing targets added, numbers coerced."""
    names: dict[str, list] = {}
    for c in df.columns:
        if c == "row_id":
            continue
        key = re.sub(r"\s+", " ", c.strip()).lower()
        names.setdefault(ALIASES.get(key, key.title()), []).append(F.col(f"`{c}`"))
    cols = [(F.coalesce(*(x.cast("string") for x in v)) if len(v) > 1 else v[0]).alias(k) for k, v in names.items()]
    cols += [F.lit(None).cast("string").alias(t) for t in TARGETS if t not in names]
    out = df.select(*(["row_id"] if "row_id" in df.columns else []), *cols)
    return out.withColumns({c: T.number(F.col(f"`{c}`")) for c in ("Times Cited", "Publication Year")})


def _sniff(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header; the delimiter is taken from the first
    lines; UTF-8, or Latin-1 where any line isn't UTF-8.  One pass over the
    raw lines finds out, and whether a quoted field may hold a line break:
    only then a file can't be split among tasks."""
    raw = spark.read.text(path)
    quotes = F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit('"')))
    state = raw.agg(F.bool_or(~F.is_valid_utf8("value")).alias("latin"), F.bool_or(quotes % 2 == 1).alias("open")).first()
    encoding = "ISO-8859-1" if state["latin"] else "UTF-8"
    head = "\n".join(r.value for r in spark.read.option("encoding", encoding).text(path).select(F.make_valid_utf8("value").alias("value")).limit(20).collect())
    # the reader splits UTF-8 files only
    return spark.read.csv(path, header=True, sep=_sniff(head), encoding=encoding, multiLine=bool(state["open"] or state["latin"]), escape='"')


def _files(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = parse(bytes(content))
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[k : k + 10_000], columns=[c.split(" ")[0].strip("`") if not c.startswith("`") else c.split("`")[1] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


_RECORD = ", ".join(f"`{c}` string" for c in TARGETS)


def parse_ris(text: str) -> list[dict]:
    """Records of RIS lines; repeated authors join by ', ', keywords by '; '.
    A record without ER at the end counts."""
    out, now = [], {}
    for line in [*text.lstrip("\ufeff").splitlines(), "ER  - "]:
        m = re.match(r"^([A-Z][A-Z0-9])  -\s?(.*)$", line)
        if not m:
            continue
        tag, value = m[1], m[2].strip()
        if tag == "ER":
            if now:
                out.append({t: ((", " if t == "Author" else "; ").join(v) if t in ("Author", "Keywords") else v[0]) for t, v in now.items()})
            now = {}
        elif tag in RIS_TAGS and value:
            now.setdefault(RIS_TAGS[tag], []).append(value.split("/")[0] if tag in ("PY", "Y1") else value)
    return [{t: r.get(t) for t in TARGETS} for r in out]


def parse_bib(content: bytes) -> list[dict]:
    """Entries of a BibTeX file: braces balance, quotes and bare values."""
    s, out = content.decode("utf-8", "ignore"), []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]*)\s*,", s):
        if m[1].lower() in ("comment", "string", "preamble"):
            continue
        i, fields = m.end(), {}
        while True:
            f = re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(s, i)
            if not f:
                break
            i = f.end()
            if i < len(s) and s[i] == "{":
                depth, j = 0, i
                while j < len(s):
                    depth += (s[j] == "{") - (s[j] == "}")
                    j += 1
                    if depth == 0:
                        break
                value, i = s[i + 1 : j - 1], j
            elif i < len(s) and s[i] == '"':
                depth, j = 0, i + 1
                while j < len(s) and (s[j] != '"' or depth):
                    depth += (s[j] == "{") - (s[j] == "}")
                    j += 1
                value, i = s[i + 1 : j], j + 1
            else:
                v = re.compile(r"[^,}\s]*").match(s, i)
                value, i = v[0], v.end()
            fields[f[1].lower()] = re.sub(r"\s+", " ", value.replace("{", "").replace("}", "")).strip()
        row = dict.fromkeys(TARGETS)
        for k, v in fields.items():
            t = ALIASES.get(k)
            if t:
                row[t] = row[t] or (v.replace(" and ", ", ") if t == "Author" else v)
        out.append(row)
    return out


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: About so many bytes of a sheet's rows are parsed at a time.
SHEET_BYTES = 4 << 20


def _sheets(z: zipfile.ZipFile) -> list[str]:
    """The first sheet's part, then those of the sheets it goes on in."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    have = [(s.get("name") or "", rels[s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).findall(f"{_MAIN}sheets/{_MAIN}sheet")]
    own = [t for k, (name, t) in enumerate(have, 1) if k == 1 or name == f"{have[0][0][:16]} continued {k}"]
    return [t.lstrip("/") if t.startswith("/") else f"xl/{t}" for t in own]


def _shared(z: zipfile.ZipFile) -> list[str]:
    out = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{_MAIN}si":
                    out.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                    e.clear()
    return out


def _row_runs(f, size: int):
    """A sheet's XML as documents of about ``size`` bytes, each with whole
    rows under the sheet's own root."""
    if (start := f.read(2)) in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        decode = codecs.getincrementaldecoder("utf-16")()
        take = lambda: decode.decode(f.read(size)).encode()
        buf = decode.decode(start).encode()
    else:
        take, buf = lambda: f.read(size), start
    while more := take():
        buf += more
        if root := re.search(rb"<([\w.-]+:)?worksheet\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", buf):
            break
    else:
        raise ValueError("not a worksheet")
    head = buf[: root.end()]
    if start in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        head = re.sub(rb"<\?xml.*?\?>", b"", head, count=1)
    if head.endswith(b"/>"):
        return
    name = (root[1] or b"") + b"worksheet"
    opens, closes = b"<" + (root[1] or b"") + b"sheetData>", b"</" + (root[1] or b"") + b"sheetData>"
    ends = b"</" + (root[1] or b"") + b"row>"
    buf, first = buf[root.end() :], True
    while more or buf:
        # no cut inside a comment or character data
        cut = buf.rfind(ends) if more else -1
        while cut >= 0 and (buf.rfind(b"<!--", 0, cut) > buf.rfind(b"-->", 0, cut) or buf.rfind(b"<![CDATA[", 0, cut) > buf.rfind(b"]]>", 0, cut)):
            cut = buf.rfind(ends, 0, cut)
        if not more:
            yield head + (b"" if first else opens) + buf
            return
        if cut >= 0:
            cut += len(ends)
            yield head + (b"" if first else opens) + buf[:cut] + closes + b"</" + name + b">"
            buf, first = buf[cut:], False
        more = take()
        buf += more


def _cells(row, shared) -> list:
    cells, at = {}, 0  # a cell without a reference follows the one before
    for c in row.findall(f"{_MAIN}c"):
        if c.get("r"):
            letters, at = re.match(r"[A-Z]+", c.get("r"))[0], 0
            for x in letters:
                at = at * 26 + ord(x) - 64
        else:
            at += 1
        v = c.find(f"{_MAIN}v")
        if c.get("t") == "inlineStr":
            cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        elif v is not None:
            cells[at - 1] = shared[int(v.text)] if c.get("t") == "s" else v.text
    return [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def _rows(xml: bytes, shared) -> list[list]:
    return [_cells(row, shared) for row in ElementTree.fromstring(xml).iter(f"{_MAIN}row")]


def _header(xml: bytes, shared) -> list | None:
    return next((_cells(e, shared) for _, e in ElementTree.iterparse(io.BytesIO(xml)) if e.tag == f"{_MAIN}row"), None)


def _runs(z: zipfile.ZipFile, size: int, shared):
    """(run of rows, rows to leave out at its start) of the first sheet, and
    of the sheets it goes on in if their header is the same."""
    header = None
    for sheet in _sheets(z):
        with z.open(sheet) as f:
            for k, xml in enumerate(_row_runs(f, size)):
                skip = 0
                if k == 0 and header is None:
                    header = _header(xml, shared)
                elif k == 0:
                    if _header(xml, shared) != header:
                        return
                    skip = 1
                yield xml, skip


def parse_xlsx(content: bytes) -> list[list]:
    """Rows of the workbook's first sheet (and of the sheets that
    ``write_xlsx`` lets it go on in), as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = _shared(z)
        return [r for xml, skip in _runs(z, SHEET_BYTES, shared) for r in _rows(xml, shared)[skip:]]


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook; its first row holds the headers.  The
    driver unpacks the sheet piece by piece, tasks parse the pieces."""
    header = []
    with scratch.fetched(spark, path) as book, tempfile.TemporaryDirectory(prefix="citeflow-") as own, zipfile.ZipFile(book) as z:
        shared = _shared(z)
        for k, (xml, skip) in enumerate(_runs(z, SHEET_BYTES, shared)):
            if k == 0:
                header, skip = _header(xml, shared) or [], 1
            with open(f"{own}/{k:09d}-{skip}", "wb") as out:
                out.write(zlib.compress(xml, 1))
        pieces = scratch.new_path(spark)
        scratch.send(spark, own, pieces)
    names = [h or f"column_{i}" for i, h in enumerate(header)]
    strings = spark.sparkContext.broadcast(shared) if shared else None

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"], strict=True):
                rows = _rows(zlib.decompress(content.as_buffer()), strings and strings.value)[int(name[-1]) :]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], pa.string()) for i in range(len(names))], names)

    found = spark.read.format("binaryFile").load(pieces).select(F.substring_index("path", "/", -1).alias("name"), "content")
    return found.orderBy("name").mapInArrow(parse, StructType([StructField(n, StringType()) for n in names]))


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """Records of RIS files, which Spark splits at their ER lines; bytes that
    aren't UTF-8 are an error."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for text in pdf["value"] for r in parse_ris(text)], columns=list(TARGETS), dtype=object)

    return spark.read.text(path, lineSep="\nER  -").select(F.validate_utf8("value").alias("value")).mapInPandas(run, _RECORD)


def read_bib(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, parse_bib, _RECORD)


def read_pdf_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the PDF files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")


def pdf_text(files: DataFrame, parser) -> DataFrame:
    """(path, text): ``parser`` takes bytes and gives pages; errors give ''."""

    def run(batches):
        for pdf in batches:
            def one(b):
                try:
                    return "".join(parser(bytes(b)))
                except Exception:
                    return ""

            yield pd.DataFrame({"path": pdf["path"], "text": [one(b) for b in pdf["content"]]})

    return files.mapInPandas(run, "path string, text string")


READERS = {"csv": read_csv, "xlsx": read_xlsx, "ris": read_ris, "bib": read_bib}


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """The works table of a file, by its extension, with row_id in file order."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"Unsupported file format: {kind}")
    df = READERS[kind](spark, path)
    return normalize(df.withColumn("row_id", F.monotonically_increasing_id()))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, status, data) of a qualitative sheet."""
    kind = path.rsplit(".", 1)[-1].lower()
    df = (read_csv if kind == "csv" else read_xlsx)(spark, path)
    by = {c.strip().lower(): c for c in df.columns}
    return df.select(F.monotonically_increasing_id().alias("row_id"), F.col(f"`{by['status']}`").alias("status"), F.col(f"`{by['data']}`").alias("data"))
