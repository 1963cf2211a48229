"""The rules of markdown notes, line by line in Python: what the relations are held against."""

from __future__ import annotations

import re
import unicodedata
from itertools import islice

import regex

from marginalia.functions.text import BLANK, NEWLINE, SENTENCE_END, SPACE
from marginalia.schema import BLOCK_END, BLOCK_START, KEYPOINT_CHARS, KEYPOINTS

GRAPHEME = regex.compile(r"\X")
# The patterns of a note's lines and inline marks.
LINE_END = re.compile(rf"[{NEWLINE}]")
EDGES = re.compile(rf"^{SPACE}+|{SPACE}+\Z")
LINE_EDGES = re.compile(rf"^[{BLANK}]+|[{BLANK}]+\Z")
WIKI = re.compile(r"!?\[\[(.*?)(?:\|(.*?))?\]\]")
INLINE = [(re.compile(r"\[(.*?)\]\((.*?)\)"), r"\1"), (re.compile(r"`([^`]*)`"), r"\1"), (re.compile(r"[*_~#>]+"), " "), (re.compile(rf"{SPACE}+"), " ")]
ITEM = [re.compile(rf"[-*+]{SPACE}+(.*)\Z"), re.compile(rf"\d+[.)]{SPACE}+(.*)\Z")]
QUOTE = re.compile(rf">{SPACE}*(.*)\Z")
SENTENCE = re.compile(f"[^{SENTENCE_END}]*[{SENTENCE_END}]|[^{SENTENCE_END}]+\\Z")


def strip(text: str) -> str:
    return EDGES.sub("", text)


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def inline(text: str) -> str:
    text = WIKI.sub(lambda m: strip(m[2] or "") or strip(m[1]), text)
    for pattern, to in INLINE:
        text = pattern.sub(to, text)
    return strip(text)


def sentences(text: str) -> list[str]:
    text = strip(text.replace("\n", " "))
    return [s for s in map(strip, SENTENCE.findall(text)) if s]


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """(fields, body): fields only of a closed block at the very start; the last of equal keys wins."""
    text = text.replace("\r\n", "\n")
    lines = text.split("\n")
    if lines[0] != "---" or "---" not in lines[1:]:
        return {}, text
    close = lines.index("---", 1)
    pairs = [line.split(":", 1) for line in lines[1:close] if ":" in line]
    return {strip(k).lower(): strip(v) for k, v in pairs if strip(k) and strip(v)}, "\n".join(lines[close + 1 :])


def heading(line: str) -> tuple[int, str] | None:
    level = len(line) - len(line.lstrip("#"))
    if not 1 <= level <= 6 or line[level : level + 1] != " ":
        return None
    text = inline(strip(line[level:]))
    return (level, text) if text else None


def item_text(line: str) -> str | None:
    """The text of a list item, a quote or a table row, in this order; None for any other line."""
    for pattern in ITEM:
        if m := pattern.match(line):
            # The first pattern that fits decides, even if its text is blank.
            return strip(m[1]) or _other(line)
    return _other(line)


def _other(line: str) -> str | None:
    if (m := QUOTE.match(line)) and strip(m[1]):
        return strip(m[1])
    if "|" in line and not line.startswith("|-"):
        cells = [c for c in map(strip, line.split("|")) if c]
        if len(cells) >= 2:
            return " | ".join(cells)
    return None


def separator(line: str) -> bool:
    return "|" in line and not line.replace(":", "").strip("|- ")


def file_stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] and not name.endswith(".") else name


def title_of(path: str, text: str) -> str:
    fields, body = front_matter(text)
    if fields.get("title"):
        return fields["title"]
    lines = (heading(LINE_EDGES.sub("", x)) for x in LINE_END.split(body))
    return next((h[1] for h in lines if h), None) or nfc(file_stem(path))


class Keypoints:
    """Gathers the keypoints of one note."""

    def __init__(self):
        self.found: dict[str, None] = {}
        self.above: list[tuple[int, str]] = []
        self.paragraph: list[str] = []

    @property
    def full(self) -> bool:
        return len(self.found) >= KEYPOINTS

    def add(self, raw: str) -> None:
        text = inline(raw)
        if not text:
            return
        if len(text) > KEYPOINT_CHARS:  # as a reader counts: a letter with its accents is one
            text = strip("".join(islice((m[0] for m in GRAPHEME.finditer(text)), KEYPOINT_CHARS)))
        under = " / ".join(t for _, t in self.above)
        self.found.setdefault(nfc(text if not under or text.startswith(under) else f"{under}: {text}"))

    def add_sentences(self, text: str) -> None:
        for s in sentences(inline(text)):
            self.add(s)
            if self.full:
                return

    def flush(self) -> None:
        if self.paragraph:
            text, self.paragraph = " ".join(self.paragraph), []
            self.add_sentences(text)

    def enter(self, level: int, text: str) -> None:
        while self.above and self.above[-1][0] >= level:
            self.above.pop()
        self.above.append((level, text))


def keypoints(text: str, title: str) -> list[str]:
    """At most 128 distinct keypoints: list items, quotes, table rows, and sentences of paragraphs,
    each under its headings; else the whole body's sentences; else the title."""
    body = front_matter(text)[1].replace("\r\n", "\n")
    out, code = Keypoints(), False
    for raw in LINE_END.split(body):
        line = LINE_EDGES.sub("", raw)
        fence = line.startswith(("```", "~~~"))
        if code and not fence:
            continue
        if fence:
            out.flush()
            code = not code
        elif not line:
            out.flush()
        elif h := heading(line):
            out.flush()
            out.enter(*h)
        elif separator(line):
            out.flush()
        elif (point := item_text(line)) is not None:
            out.flush()
            out.add(point)
        else:
            out.paragraph.append(line)
        if out.full:
            break
    out.flush()
    if not out.found:
        out.add_sentences(body)
    if not out.found:
        out.add(title)
    return list(out.found)[:KEYPOINTS]


def without_block(text: str) -> str:
    """The text without its block of related notes; unchanged unless both marks are there in order."""
    start = text.find(BLOCK_START)
    end = text.find(BLOCK_END, start + len(BLOCK_START)) if start >= 0 else -1
    if end < 0:
        return text
    rest = (text[:start] + text[end + len(BLOCK_END) :]).replace("\r\n", "\n")
    rest = strip(re.sub(r"\n{3,}", "\n\n", rest))
    return rest + "\n" if rest and text.endswith("\n") else rest


def link_target(path: str) -> str:
    path = nfc(path)
    name = path.rsplit("/", 1)[-1]
    cut = len(path) - len(name) + len(file_stem(name)) if name else len(path)
    return path[:cut].replace("\\", "/")


def with_block(text: str, related: list[str]) -> str:
    """The text with a block that links the related notes, or without one if there are none."""
    base = strip(without_block(text))
    links = list(dict.fromkeys(map(link_target, related)))
    if not links:
        return f"{base}\n" if base else ""
    block = "\n".join([BLOCK_START, "## Related Notes", *(f"- [[{x}]]" for x in links), BLOCK_END])
    return (f"{base}\n\n" if base else "") + block + "\n"
