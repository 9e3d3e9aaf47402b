"""Text of Office containers (zip with XML parts), one Arrow batch at a time.

Unzipping has no relational form; what follows (entities, tags) is done by small
pure functions that the tests compare with the JVM expressions.
"""

from __future__ import annotations

import html
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES, MAX_ENTRY, MAX_FILE = 2_000, 50 * 1024 * 1024, 50 * 1024 * 1024
_ENTITY = re.compile(r"&(#x[0-9a-f]+|#\d+|amp|lt|gt|quot|apos);", re.I)


def entities(s: str) -> str:
    return _ENTITY.sub(lambda m: html.unescape(m.group(0).lower()), s)


def visible(xml: str) -> str:
    """WordprocessingML to text: entities, tabs, breaks, then tags to blanks."""
    s = entities(xml)
    # The elements of the format and the order of the steps.
    for pattern, to in ((r"<w:tab\s*/?>", "\t"), (r"<w:br\s*/?>|</w:p\s*>", "\n"), (r"<[^>]+>", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        s = re.sub(pattern, to, s, flags=re.I)
    return s.strip()


def entries(content: bytes) -> dict[str, bytes]:
    """Members of a zip within the limits; raises ValueError beyond them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        if len(infos) > MAX_ENTRIES:
            raise ValueError("too many entries")
        out = {}
        for i in infos:
            if i.file_size > MAX_ENTRY or i.compress_type not in (0, 8):
                raise ValueError(f"entry not readable: {i.filename}")
            out[i.filename] = z.read(i)
        return out


def docx_text(content: bytes) -> str:
    return visible(entries(content)["word/document.xml"].decode("utf-8", "replace"))


def xlsx_text(content: bytes) -> str:
    """``[sheetN]`` heads, tab-joined rows; sheets in name order, rows without values dropped."""
    parts = {k: v.decode("utf-8", "replace") for k, v in entries(content).items() if k.endswith(".xml")}
    shared = [visible(x) for x in re.findall(r"<si\b[^>]*>(.*?)</si>", parts.get("xl/sharedStrings.xml", ""), re.S | re.I)]
    lines = []
    for name in sorted(k for k in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", k, re.I)):
        lines.append(f"[{name[len('xl/worksheets/'):-4]}]")
        for row in re.findall(r"<row\b[^>]*>(.*?)</row>", parts[name], re.S | re.I):
            cells = []
            for attrs, body in re.findall(r"<c\b([^>]*)>(.*?)</c>", row, re.S | re.I):
                kind = (re.search(r"""\bt=["']([^"']+)""", attrs, re.I) or [None, ""])[1]
                value = (re.search(r"<v\b[^>]*>(.*?)</v>", body, re.S | re.I) or [None, ""])[1]
                inline = (re.search(r"<t\b[^>]*>(.*?)</t>", body, re.S | re.I) or [None, ""])[1]
                text = entities(inline or value)
                if kind == "s" and value.strip().isdigit() and int(value) < len(shared):
                    text = shared[int(value)]
                elif kind == "b":
                    text = "TRUE" if value == "1" else "FALSE"
                cells.append(text)
            if any(cells):
                lines.append("\t".join(cells))
    return "\n".join(lines).strip()


def pptx_text(content: bytes) -> str:
    """Text runs of the slides in numeric order, one line per slide."""
    parts = entries(content)
    slides = sorted((int(m.group(1)), k) for k in parts if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", k, re.I)))
    lines = [" ".join(" ".join(entities(t) for t in re.findall(r"<a:t\b[^>]*>(.*?)</a:t>", parts[k].decode("utf-8", "replace"), re.S | re.I)).split()) for _, k in slides]
    return "\n".join(x for x in lines if x).strip()


READERS = {"docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text}


def extract_office(files: DataFrame) -> DataFrame:
    """``path, kind, text, error`` from ``path`` and binary ``content``; damaged or oversized files give an error, not a failure.

    ``kind`` follows the ending; other files and null contents have null text.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                kind = (re.search(r"\.(doc|xls|ppt)[xm]$", path or "", re.I) or [None, ""])[1].lower()
                kind = f"{kind}x" if kind else None
                try:
                    if content is not None and len(content) > MAX_FILE:
                        raise ValueError("file too large")
                    rows.append((path, kind, READERS[kind](content) if kind and content is not None else None, None))
                except Exception as e:  # noqa: BLE001 - any damage is reported per file
                    rows.append((path, kind, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "error"])

    return files.select("path", F.col("content")).mapInPandas(run, "path string, kind string, text string, error string")
