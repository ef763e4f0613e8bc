"""The few Arrow functions that Spark's expressions cannot express."""

from __future__ import annotations

import difflib
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


@F.pandas_udf(T.ArrayType(T.StringType()))
def aligned(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """What each reference token became: its match, the whole replacement, or an empty string."""

    def one(a, b):
        a, b = list(a), list(b)
        out = [""] * len(a)
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            for i in range(i1, i2):
                out[i] = b[j1 + i - i1] if tag == "equal" else " ".join(b[j1:j2]) if tag == "replace" else ""
        return out

    return pd.Series([one(a, b) for a, b in zip(ref, hyp)])


# Tags whose content is dropped, and tags that begin a block.
SKIPPED = {"script", "style", "nav", "header", "footer", "aside"}
BLOCKS = {"h1", "h2", "h3", "h4", "p", "li", "pre", "blockquote", "td", "th", "dt", "dd"}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipping, self.root, self.depth = 0, None, 0
        self.open: list[tuple[str, list[str]]] = []
        self.found: dict[str | None, list[str]] = {"article": [], "main": [], "body": [], None: []}
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping += 1
        elif tag in ("article", "main", "body"):
            self.inside.append(tag)
        elif tag in BLOCKS and not self.skipping:
            self.open.append((tag, []))
        elif tag == "br" and self.open:
            self.open[-1][1].append(" ")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif tag in self.inside:
            self.inside.remove(tag)
        elif self.open and tag == self.open[-1][0]:
            self._close()

    def _close(self):
        tag, parts = self.open.pop()
        text = " ".join("".join(parts).split())
        if not text:
            return
        line = f"{'#' * int(tag[1])} {text}" if re.fullmatch("h[1-4]", tag) else f"- {text}" if tag == "li" else text
        for root in {*self.inside, None}:
            lines = self.found[root]
            if line not in lines[-3:]:
                lines.append(line)

    def handle_data(self, data):
        if self.open and not self.skipping:
            self.open[-1][1].append(data)


def html_lines(html: str | None) -> list[str]:
    parser = _Blocks()
    parser.feed(html or "")
    while parser.open:
        parser._close()
    return parser.found["article"] or parser.found["main"] or parser.found["body"] or parser.found[None]


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    """Headings, paragraphs and list items of the article, main part or body."""
    return pages.map(lambda h: "\n".join(html_lines(h)))


_BOUNDARY = re.compile(r"[.!?…]+[\"')\]”]*(?:\s+|$)")
# Abbreviations that end no sentence.
_ABBREVIATION = re.compile(r"(?:\b(?:e\.g|i\.e|vs|etc|Dr|Mr|Ms|Mrs|St|No|Fig|approx)|\b[A-Z])\.$")


def spoken_sentences(text: str, final: bool = False) -> tuple[list[str], str]:
    """(finished sentences, rest): abbreviations, initials and decimals end nothing, and neither does a
    mark at the very end unless the text is final."""

    def ends(at: int) -> bool:
        return (final or at < len(text)) and not _ABBREVIATION.search(text[:at].rstrip("\"')]” \t\n"))

    cuts = [0, *(m.end() for m in _BOUNDARY.finditer(text) if ends(m.end()))]
    if final:
        cuts.append(len(text))
    pieces = (text[a:b].strip() for a, b in zip(cuts, cuts[1:]))
    return [p for p in pieces if p], text[cuts[-1] :]


SENTENCES = T.StructType([T.StructField("sentences", T.ArrayType(T.StringType())), T.StructField("rest", T.StringType())])


@F.pandas_udf(SENTENCES)
def split_spoken(texts: pd.Series, final: pd.Series) -> pd.DataFrame:
    got = [spoken_sentences(t or "", bool(f)) for t, f in zip(texts, final)]
    return pd.DataFrame({"sentences": [g[0] for g in got], "rest": [g[1] for g in got]})
