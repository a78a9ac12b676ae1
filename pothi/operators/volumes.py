"""Cleaning the text of a scanned volume, and what was done to it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Headings no paragraph is joined across, the line that opens the back matter, signs that end a paragraph.
_MARKER = re.compile(r"\s*(?:पुष्प\s+[०-९\d]+|[०-९\d]+\s*[.)]\s*.+|अनुक्रमणिका|प्रस्तावना|परिशिष्ट.*|महत्वाच्या नोंदी|काकांची प्रवचने.*)\s*$")
_BACK, _RULE, _NUMBER = re.compile(r"\s*संपर्क\b"), re.compile(r"\s*_{3,}\s*$"), re.compile(r"\s*[०-९0-9]{1,4}\s*$")
_FINAL = tuple(".?!।॥\"')」»…")
COUNTS = ["input_lines", "output_lines", "page_nums_stripped", "paragraphs_rejoined", "backmatter_lines_dropped", "separator_lines_dropped", "trailing_ws_stripped", "blank_runs_collapsed"]


def _open(line: str) -> bool:
    """Whether a paragraph may go on after, or in, this line: it is no verse and no heading."""
    verse = len(line.strip()) <= 100 and line.strip().endswith(("!", "॥", "।।"))
    return not verse and not _MARKER.match(line)


def cleaned(text: str) -> tuple[str, dict[str, int]]:
    """Text without page numbers, rules and back matter, paragraphs that a page number parts made whole, blank lines single; and counts.

    Only a page number, with blank lines around it, is joined across, and only
    where the paragraph before has no final sign and neither side is a verse or a
    heading. A heading with nothing after it goes.
    """
    raw = text.splitlines()
    n = dict.fromkeys(COUNTS, 0) | {"input_lines": len(raw), "trailing_ws_stripped": sum(x != x.rstrip() for x in raw)}
    lines = [x.rstrip() for x in raw]
    back = next((i for i, x in enumerate(lines) if _BACK.match(x)), None)
    if back is not None:
        while back and (not lines[back - 1] or _RULE.match(lines[back - 1])):
            back -= 1
            n["separator_lines_dropped"] += bool(lines[back])
        n["backmatter_lines_dropped"] = len(lines) - back
        lines = lines[:back]
    body = [x for x in lines if not _RULE.match(x)]
    n["separator_lines_dropped"] += len(lines) - len(body)
    out: list[str] = []
    joining = False  # a page number stands between what is out and what comes
    for x in body:
        if _NUMBER.match(x):
            n["page_nums_stripped"] += 1
            joining = True
        elif not x:
            out.append(x)
        else:
            last = next((k for k in range(len(out) - 1, -1, -1) if out[k]), None)
            if joining and last is not None and not out[last].endswith(_FINAL) and _open(out[last]) and _open(x):
                out = [*out[:last], f"{out[last]} {x.lstrip()}"]
                n["paragraphs_rejoined"] += 1
            else:
                out.append(x)
            joining = False
    kept = [x for k, x in enumerate(out) if x or not k or out[k - 1]]
    n["blank_runs_collapsed"] = len(out) - len(kept)
    while kept and (not kept[-1] or _MARKER.match(kept[-1])):
        n["backmatter_lines_dropped"] += bool(kept.pop())
    while kept and not kept[0]:
        kept.pop(0)
    n["output_lines"] = len(kept)
    return "\n".join(kept), n


def clean_volumes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text and the counts: files are independent and cleaned where they stand; a null text has no row."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *(lambda t, n: (t, *(n[c] for c in COUNTS)))(*cleaned(x))) for k, x in zip(pdf["key"], pdf["text"])]
            yield pd.DataFrame(rows, columns=["key", "text", *COUNTS])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").mapInPandas(run, f"key {kind}, text string, " + ", ".join(f"{c} int" for c in COUNTS))
