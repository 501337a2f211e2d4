"""Files as parsed documents: suffix decides the parser, and a bad file is a row with an error."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements that hold no text of the document, and those that end a line.
JUNK = {"script", "style", "nav", "footer", "aside", "form", "noscript"}
BLOCKS = {"p", "div", "li", "ul", "ol", "article", "section", "table", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
SUFFIXES = ("md", "markdown", "txt", "html", "htm")


class PageParser(HTMLParser):
    """Title, author, description and visible text of a page; headings become # marks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title, self.meta, self.skipped, self.in_title, self.heading = "", {}, 0, False, ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in JUNK:
            self.skipped += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta":
            a = dict(attrs)
            if a.get("name") in ("author", "description") and a.get("content"):
                self.meta[a["name"]] = a["content"]
        elif tag in BLOCKS:
            self.parts.append("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else ""))

    def handle_endtag(self, tag: str) -> None:
        if tag in JUNK:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skipped:
            self.parts.append(data)

    def text(self) -> str:
        """Lines with single blanks; a line that repeats the one before is left out."""
        out: list[str] = []
        for line in "".join(self.parts).split("\n"):
            line = " ".join(line.split())
            if line.strip("# ") and (not out or out[-1] != line):
                out.append(line)
        return "\n".join(out)


def parse_html(html: str, name: str = "") -> dict[str, str]:
    p = PageParser()
    p.feed(html)
    p.close()
    text = p.text()
    first = re.search(r"^# (.+)$", text, re.M)
    return {"title": " ".join(p.title.split()) or (first[1] if first else "") or name, "text": text, **p.meta}


def parse_text(text: str, suffix: str, name: str) -> dict[str, str]:
    """Title of Markdown: frontmatter, first heading, file name; of plain text: its first line, 120 characters at most."""
    if suffix == "txt":
        line = next((x.strip() for x in text.split("\n") if x.strip()), "")
        return {"title": line[:120] or name, "text": text}
    front = re.match(r"---\n(.*?)\n---\n?(.*)", text, re.S)
    title = re.search(r"^title:\s*(.+)$", front[1], re.M) if front else None
    body = front[2] if front else text
    head = re.search(r"^# +(.+)$", body, re.M)
    return {"title": (title[1].strip().strip("\"'") if title else "") or (head[1].strip() if head else "") or name, "text": body}


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, suffix, title, text, bytes, error of every file; hidden files and other suffixes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    wanted = files.select("path", suffix.alias("suffix"), "content").where(F.col("suffix").isin(*SUFFIXES) & ~F.col("path").rlike(r"/\.[^/]*(/|$)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, s, c in zip(*(x.to_pylist() for x in b.columns)):
                name = re.sub(r"[-_]+", " ", p.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                try:
                    text = c.decode("utf-8")
                    d = parse_html(text, name) if s in ("html", "htm") else parse_text(text, s, name)
                    rows.append((p, s, d["title"], d["text"], len(c), None))
                except UnicodeDecodeError as e:
                    rows.append((p, s, name, None, len(c), f"not UTF-8 at byte {e.start}"))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))], ["path", "suffix", "title", "text", "bytes", "error"])

    return wanted.mapInArrow(run, "path string, suffix string, title string, text string, bytes long, error string")
