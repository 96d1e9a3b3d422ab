"""File sources: dispatch by extension, and decoders that turn bytes into layout blocks, records or sheet cells.

Decoders are Arrow-batched and catch damaged files one by one: they give rows with an `error` instead of failing the job.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as text_functions

# Extensions by the parser that takes them.
TEXT_TYPES = ["txt", "md", "json", "jsonl", "py", "c", "cpp", "java", "js", "sh", "xml", "yaml", "html"]
IMAGE_TYPES = ["png", "jpeg", "jpg", "bmp"]
LAYOUT = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "csv": "csv", "xls": "xls", "xlsx": "xlsx"} | dict.fromkeys(TEXT_TYPES, "text") | dict.fromkeys(IMAGE_TYPES, "image")
DOM = {"pdf": "pdf", "csv": "text", "txt": "text", "md": "text", "html": "text", "xlsx": "xlsx", "xls": "xls"}
SUPPORTED = ["pptx", "pdf", "docx", "csv", "xlsx", "xls", *TEXT_TYPES, *IMAGE_TYPES]
MAX_BYTES, MAX_PAGES, LONG_BYTES, LONG_PAGES = 20_000_000, 5_000, 2_000_000, 30


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(name, bytes, content) of files below a path, by Spark's own reader."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "content")


def _parser(name, table: dict[str, str]) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return kinds[text_functions.file_type(name)]


def layout_parser(name) -> Column:
    """Which layout parser takes a file; null for none."""
    return _parser(name, LAYOUT)


def dom_parser(name) -> Column:
    """Which tree parser takes a file; null for none."""
    return _parser(name, DOM)


def is_supported(name) -> Column:
    """The name has a dot and a supported extension."""
    name = F.col(name) if isinstance(name, str) else name
    return F.contains(name, F.lit(".")) & text_functions.file_type(name).isin(SUPPORTED)


def route(name, size, pages) -> Column:
    """Where a file goes: reject, image, document, long or short."""
    kind = text_functions.file_type(name)
    size, pages = F.col(size) if isinstance(size, str) else size, F.col(pages) if isinstance(pages, str) else pages
    return (
        F.when(~is_supported(name) | (size > MAX_BYTES) | (pages > MAX_PAGES), "reject")
        .when(kind.isin(IMAGE_TYPES), "image")
        .when(kind.isin("doc", "docx"), "document")
        .when((size > LONG_BYTES) | (pages > LONG_PAGES), "long")
        .otherwise("short")
    )


def text_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, page_num, type, text, error): the whole text of UTF-8 files as one block; an error for other bytes."""
    value = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("doc_id", F.lit(0).alias("page_num"), F.lit("text").alias("type"), value.alias("text"), F.when(value.isNull(), F.lit("not UTF-8")).alias("error"))


def decoded(content: bytes, charsets: tuple[str, ...]) -> str | None:
    """The text by the first charset that takes all bytes."""
    for charset in charsets:
        try:
            return content.decode(charset)
        except UnicodeDecodeError:
            continue
    return None


def _each(files: DataFrame, schema: str, decode: Callable[[bytes], list[tuple]]) -> DataFrame:
    """decode() of each file's bytes as rows (doc_id, ..., error); the columns of schema follow the tuples."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows += [(doc, *row, None) for row in decode(bytes(content or b""))]
                except Exception as e:  # a damaged file is a row, not a failed job
                    rows.append((doc, *[None] * len(names), f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["doc_id", *names, "error"]).astype(object)

    return files.select("doc_id", "content").mapInPandas(run, f"doc_id long, {schema}, error string")


def tree_text(files: DataFrame) -> DataFrame:
    """(doc_id, layout_type, text, error): each text file as one text node, by the first of UTF-8, GBK and Latin-1 that fits."""
    return _each(files, "layout_type string, text string", lambda b: [("Text", decoded(b, ("utf-8", "gbk", "latin-1")))])


def csv_block(content: bytes) -> list[tuple]:
    """A CSV file as one block: fields joined by commas, line ends within fields as U+2028. GBK is tried before UTF-8."""
    body = decoded(content, ("gbk", "utf-8", "utf-8-sig", "latin-1")) or ""
    lines = [",".join(f.replace("\n", " ") for f in row) + "\n" for row in csv.reader(io.StringIO(body, newline=""))]
    return [(0, "text", "".join(lines))]


def csv_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, page_num, type, text, error) of CSV files."""
    return _each(files, "page_num int, type string, text string", csv_block)


def csv_records(files: DataFrame) -> DataFrame:
    """(doc_id, record_no, fields, error) of CSV files; UTF-8 is tried first."""
    def decode(content: bytes) -> list[tuple]:
        body = decoded(content, ("utf-8-sig", "gbk", "latin-1")) or ""
        return [(i, row) for i, row in enumerate(csv.reader(io.StringIO(body, newline="")))]

    return _each(files, "record_no int, fields array<string>", decode)


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _texts(element, name: str = "t") -> str:
    return "".join(e.text or "" for e in element.iter() if _tag(e) == name)


def _column(ref: str) -> tuple[int, int]:
    """0-based (row, column) of a reference such as B7."""
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", ref).groups()
    col = 0
    for c in letters:
        col = 26 * col + ord(c) - 64
    return int(digits) - 1, col - 1


def xlsx_cells(content: bytes) -> list[tuple]:
    """(sheet_no, sheet_name, row_index, col_index, value, r1, c1): cells, and merges as rows with null value and their end."""
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_texts(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = [e.attrib["name"] for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"]
        for no, name in enumerate(sheets):
            root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{no + 1}.xml"))
            for e in root.iter():
                if _tag(e) == "c":
                    raw = next((x.text for x in e if _tag(x) == "v"), None)
                    kind = e.attrib.get("t")
                    value = shared[int(raw)] if kind == "s" and raw is not None else _texts(e) if kind == "inlineStr" else raw
                    out.append((no, name, *_column(e.attrib["r"]), value, None, None))
                elif _tag(e) == "mergeCell":
                    a, _, b = e.attrib["ref"].partition(":")
                    out.append((no, name, *_column(a), None, *_column(b or a)))
    return out


def xlsx(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (doc_id, sheet_no, sheet_name, row_index, col_index, value) and merges (doc_id, sheet_no, r0, c0, r1, c1) of XLSX files."""
    rows = _each(files, "sheet_no int, sheet_name string, row_index int, col_index int, value string, r1 int, c1 int", xlsx_cells).where("error IS NULL")
    cells = rows.where("r1 IS NULL").select("doc_id", "sheet_no", "sheet_name", "row_index", "col_index", "value")
    return cells, rows.where("r1 IS NOT NULL").select("doc_id", "sheet_no", F.col("row_index").alias("r0"), F.col("col_index").alias("c0"), "r1", "c1")


def docx_blocks(content: bytes) -> list[tuple]:
    """(page_num, type, text) of a DOCX body in its order: paragraphs, pictures, and tables as cells behind bars."""
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _tag(e) == "body")
    for e in body:
        if _tag(e) == "p":
            if (t := _texts(e)).strip():
                out.append((0, "text", t))
            if any(_tag(x) == "blip" for x in e.iter()):
                out.append((0, "image", None))
        elif _tag(e) == "tbl":
            cells = [next((x.text or "" for x in c.iter() if _tag(x) == "t"), "") for c in e.iter() if _tag(c) == "tc"]
            out.append((0, "table", "".join(" | " + c for c in cells)))
    return out


def docx(files: DataFrame) -> DataFrame:
    """(doc_id, page_num, type, text, error) of DOCX files."""
    return _each(files, "page_num int, type string, text string", docx_blocks)


def pptx_blocks(content: bytes) -> list[tuple]:
    """(page_num, type, text) of a PPTX's slides: text boxes that aren't empty, pictures, tables."""
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for page, name in enumerate(slides):
            for e in ElementTree.fromstring(z.read(name)).iter():
                if _tag(e) == "sp":
                    t = "\n".join(_texts(p) for p in e.iter() if _tag(p) == "p")
                    if t.strip():
                        out.append((page, "text", t))
                elif _tag(e) == "pic":
                    out.append((page, "image", None))
                elif _tag(e) == "tbl":
                    out.append((page, "table", "".join(" | " + _texts(c) for c in e.iter() if _tag(c) == "tc")))
    return out


def pptx(files: DataFrame) -> DataFrame:
    """(doc_id, page_num, type, text, error) of PPTX files."""
    return _each(files, "page_num int, type string, text string", pptx_blocks)


def page_counts(blocks: DataFrame) -> DataFrame:
    """(doc_id, pages) of decoded blocks."""
    return blocks.groupBy("doc_id").agg((F.max("page_num") + 1).alias("pages"))


def is_mime_mail(text) -> Column:
    """The text is a multipart mail saved under another name: its version line, and a content type with a boundary."""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(r"(?m)^MIME-Version:\s*1\.0") & text.rlike(r'(?m)^Content-Type:\s*multipart/[^;]+;\s*boundary="[^"]+"')


_MARKDOWN = re.compile(r"(?P<head>#{1,6}) +(?P<title>.*)|(?P<item>\s*(?:[-*+]|\d+\.) +.*)|(?P<image>!\[.*?\]\(.*?\))")


def markdown_nodes(text: str) -> list[tuple]:
    """(ordinal, layout_type, level, text) of a Markdown text: headings, items, tables, pictures, code and paragraphs."""
    out: list[tuple] = []
    buffer: list[str] = []
    code = False

    def flush(kind: str = "Text") -> None:
        if buffer:
            out.append((len(out), kind, 0, "\n".join(buffer)))
            buffer.clear()

    for line in (text or "").split("\n"):
        if line.startswith("```"):
            flush("Code" if code else "Text")
            code = not code
        elif code:
            buffer.append(line)
        elif not line.strip():
            flush("Table" if buffer and buffer[0].startswith("|") else "Text")
        elif m := _MARKDOWN.match(line):
            flush()
            kind = "Title" if m["head"] else "List" if m["item"] else "Figure"
            out.append((len(out), kind, len(m["head"] or ""), (m["title"] if m["head"] else line).strip()))
        else:
            if buffer and buffer[0].startswith("|") != line.startswith("|"):
                flush("Table" if buffer[0].startswith("|") else "Text")
            buffer.append(line)
    flush("Code" if code else "Table" if buffer and buffer[0].startswith("|") else "Text")
    return out


def markdown(files: DataFrame) -> DataFrame:
    """(doc_id, ordinal, layout_type, level, text, error) of Markdown files."""
    return _each(files, "ordinal int, layout_type string, level int, text string", lambda b: markdown_nodes(decoded(b, ("utf-8", "gbk", "latin-1")) or ""))


# Schema of a decoded page: what a PDF decoder hands over.
RAW_PAGE = """doc_id bigint, page int, width double, height double, rotation array<double>,
 blocks array<struct<ordinal:int, type:int, bbox:array<double>, lines:array<struct<wmode:int, dir:array<double>, bbox:array<double>,
  spans:array<struct<bbox:array<double>, text:string, font:string, size:double, flags:int, color:int, pseudo_bold:boolean>>>>>>,
 shapes array<struct<ordinal:int, kind:string, bbox:array<double>, color:int, width:double, uri:string>>"""


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pages from JSON files, one object a line."""
    return spark.read.schema(RAW_PAGE).json(path)


def page_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page, ordinal, type, text) in the order (y0, x0): texts of horizontal and bottom-up lines; blank ones dropped."""
    b = pages.select("doc_id", "page", F.explode("blocks").alias("b"))
    flows = F.filter("b.lines", lambda x: ((x["dir"][0] == 1) & (x["dir"][1] == 0)) | ((x["dir"][0] == 0) & (x["dir"][1] == -1)))
    words = F.array_join(F.flatten(F.transform(flows, lambda x: F.transform(x["spans"], lambda s: s["text"]))), "")
    rows = b.select("doc_id", "page", F.when(F.col("b.type") == 1, "image").otherwise("text").alias("type"), F.when(F.col("b.type") == 1, F.lit(None)).otherwise(words).alias("text"), F.col("b.bbox").alias("bbox"), F.col("b.ordinal").alias("o"))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.col("bbox")[1], F.col("bbox")[0], "o"))
    return rows.where((F.col("type") == "image") | (F.trim("text") != "")).select("doc_id", "page", (order - 1).alias("ordinal"), "type", "text")
