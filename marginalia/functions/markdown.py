"""Markdown notes as relations: front matter, title, atomic keypoints, and the managed block of related notes.

A note's lines are rows. Which lines are code follows from a running count of fences; which lines
make a paragraph from a running count of those that end one; the headings above a line are the last
ones of each level, unless one of a lower level came after. All of it is built-in functions, in one
window over a note's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOCK_END, BLOCK_START, KEYPOINT_CHARS, KEYPOINTS
from ..sources.scratch import spread
from .text import BLANKS, SPACE, file_stem, inline_normalised, is_ascii, link_target, nfc, normalised_again, once, sentences, trimmed

# The patterns of a note's lines. Order counts: the first kind that fits decides.
FENCE = r"^(?:```|~~~)"
HEADING = r"^(#{1,6}) (.*)$"
SEPARATOR = r"^[|\-: ]*$"
LINE_END = r"[\n\x0b\x0c\r\x85[\u2028-\u2029]]"  # each character of NEWLINE; Java tells Latin ones by one look
BULLET = rf"^[-*+]{SPACE}+(.*)$"
NUMBER = rf"^\p{{Nd}}+[.)]{SPACE}+(.*)$"
QUOTE = rf"^>{SPACE}*(.*)$"
LEVELS = range(1, 7)


def _full(c: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(c, F.lit(""))


def _ends_bare(line: Column) -> Column:
    """A line without white space around it; most lines have none but spaces, whose search looks at the ends alone."""
    return F.when(is_ascii(line) & ~F.contains(line, F.lit("\t")), F.trim(line)).otherwise(F.trim(line, F.lit(BLANKS)))


def without_block(text: Column) -> Column:
    """The text without its block of related notes; unchanged unless both marks are there in order."""
    start = F.locate(BLOCK_START, text)
    after = F.substr(text, start + len(BLOCK_START))
    end = F.when(start > 0, F.locate(BLOCK_END, after))
    rest = F.concat(F.substr(text, F.lit(1), start - 1), F.substr(after, end + len(BLOCK_END)))
    rest = trimmed(F.regexp_replace(F.replace(rest, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n"))
    return F.when(end > 0, F.when((rest != "") & text.endswith("\n"), F.concat(rest, F.lit("\n"))).otherwise(rest)).otherwise(text)


def with_block(text: Column, related: Column) -> Column:
    """The text with a block that links the related notes (an array of paths), or without one if there are none; a null path is none."""
    base = trimmed(without_block(F.coalesce(text, F.lit(""))))
    links = F.array_distinct(F.transform(F.filter(F.coalesce(related, F.array().cast("array<string>")), lambda p: p.isNotNull()), lambda p: F.concat(F.lit("- [["), link_target(nfc(p)), F.lit("]]"))))
    block = F.array_join(F.concat(F.array(F.lit(BLOCK_START), F.lit("## Related Notes")), links, F.array(F.lit(BLOCK_END))), "\n")
    alone = F.when(base == "", "").otherwise(F.concat(base, F.lit("\n")))
    return F.when(F.size(links) == 0, alone).otherwise(F.concat(F.when(base == "", "").otherwise(F.concat(base, F.lit("\n\n"))), block, F.lit("\n")))


def split_front_matter(text: Column) -> tuple[Column, Column]:
    """(fields' lines, body): lines only of a closed block at the very start."""
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    pattern = r"(?s)\A---\n((?:.*?\n)??)---(?:\n|\z)(.*)\z"
    closed = text.rlike(pattern)
    return F.when(closed, F.regexp_extract(text, pattern, 1)), F.when(closed, F.regexp_extract(text, pattern, 2)).otherwise(text)


def field(lines: Column, name: str) -> Column:
    """The value of a field, of the last line that has one; names are in any case."""
    value = lambda x: trimmed(F.substr(x, F.locate(":", x) + 1))
    named = lambda x: (F.locate(":", x) > 0) & (F.lower(trimmed(F.split_part(x, F.lit(":"), F.lit(1)))) == name) & (value(x) != "")
    return F.get(F.reverse(F.transform(F.filter(F.split(lines, "\n"), named), value)), F.lit(0))


def heading_text(line: Column) -> Column:
    """A heading's text; null for any other line."""
    return F.when(line.rlike(HEADING), once(once(F.regexp_extract(line, HEADING, 2), inline_normalised), _full))


def is_separator(line: Column) -> Column:
    return F.contains(line, F.lit("|")) & line.rlike(SEPARATOR)


def item_text(line: Column) -> Column:
    """The text of a list item, a quote or a table row, in this order; null for any other line."""
    cells = F.filter(F.transform(F.split(line, r"\|"), trimmed), lambda c: c != "")
    row = F.when(F.contains(line, F.lit("|")) & ~line.startswith("|-") & (F.size(cells) >= 2), F.array_join(cells, " | "))
    point = F.when(line.rlike(BULLET), F.regexp_extract(line, BULLET, 1)).when(line.rlike(NUMBER), F.regexp_extract(line, NUMBER, 1))
    return F.coalesce(_full(trimmed(point)), _full(trimmed(F.regexp_extract(line, QUOTE, 1))), row)


def _cut(text: Column) -> Column:
    """At most so many characters as a reader counts: a letter with its accents is one."""
    return F.when(F.char_length(text) > KEYPOINT_CHARS, trimmed(F.regexp_extract(text, rf"\A\X{{1,{KEYPOINT_CHARS}}}", 0))).otherwise(text)


def _under(prefix: Column, text: Column) -> Column:
    """A keypoint under its headings, which aren't repeated where it begins with them."""
    return F.when((prefix == "") | F.startswith(text, prefix), text).otherwise(F.concat(prefix, F.lit(": "), text))


def _points(pieces: Column, prefix: Column) -> Column:
    """The keypoints of an array of normalised pieces of text; blank ones are left out.

    One pass for each step: a lambda would work out again what it names twice.
    """
    whole = F.filter(pieces, lambda t: t != "")
    return F.transform(F.transform(F.transform(whole, _cut), lambda t: _under(prefix, t)), nfc)


def _said(text: Column) -> Column:
    """The sentences of a normalised text."""
    return F.transform(sentences(text, normalised=True), normalised_again)


def _one(c: Column) -> Column:
    """The only value of a group that isn't null. A list takes it in once; min_by would weigh every row."""
    return F.get(F.collect_list(c), F.lit(0))


def parsed_notes(notes: DataFrame, id_col: str = "id", path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """``notes`` (one row an id) with title, summary and keypoints, each without its managed block, instead of the text.

    Keypoints are at most 128 distinct ones: list items, quotes, table rows, and sentences of
    paragraphs, each under its headings; else the whole body's sentences; else the title. The title
    is the front matter's, else that of the first heading, else the file's name. A null text is empty.
    """
    kept = [c for c in notes.columns if c not in (id_col, text_col)]
    base = without_block(F.coalesce(F.col(text_col), F.lit("")))
    fields, body = split_front_matter(F.col("__base"))
    texts = spread(notes).select("*", base.alias("__base"))
    texts = texts.select(F.col(id_col).alias("__id"), F.struct(*kept).alias("__kept"), field(fields, "title").alias("__title"), body.alias("__body"))
    # A text stands beside its first line only.
    lines = texts.select("__id", "__kept", "__title", "__body", F.posexplode(F.split("__body", LINE_END)).alias("pos", "line"))
    first = F.col("pos") == 0
    lines = lines.select("__id", *[F.when(first, F.col(c)).alias(c) for c in ("__kept", "__title", "__body")], "pos", _ends_bare(F.col("line")).alias("line"))
    lines = lines.withColumns({"fence": F.col("line").rlike(FENCE), "heading": heading_text(F.col("line"))})

    before = Window.partitionBy("__id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("__id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("code", (F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)) % 2 == 1) & ~F.col("fence"))
    plain = ~F.col("code") & ~F.col("fence")
    lines = lines.withColumn("level", F.when(plain & F.col("heading").isNotNull(), F.length(F.regexp_extract("line", HEADING, 1))))
    point = F.when(plain & F.col("level").isNull() & ~is_separator(F.col("line")), item_text(F.col("line")))
    lines = lines.withColumn("point", point)
    prose = plain & F.col("level").isNull() & (F.col("line") != "") & ~is_separator(F.col("line")) & F.col("point").isNull()
    lines = lines.withColumn("prose", prose)
    last = {f"h{n}": F.last(F.when(F.col("level") == n, F.struct("pos", F.col("heading").alias("text"))), ignorenulls=True).over(upto) for n in LEVELS}
    # A paragraph is known by the number of lines before it that end one; code lines don't.
    lines = lines.withColumns({**last, "island": F.sum((~F.col("prose") & ~F.col("code")).cast("int")).over(upto)})
    at = lambda n: F.coalesce(F.col(f"h{n}.pos"), F.lit(-1))
    alive = [F.when(at(n) > (F.greatest(F.lit(-1), *[at(k) for k in range(1, n)]) if n > 1 else F.lit(-1)), F.col(f"h{n}.text")) for n in LEVELS]
    lines = lines.withColumn("prefix", F.concat_ws(" / ", *alive))

    # Lines of a paragraph together; all others stay alone. The note's own columns come with its first line.
    unit = F.when(F.col("prose"), F.col("island")).otherwise(-1 - F.col("pos"))
    units = lines.groupBy("__id", unit.alias("unit")).agg(
        F.min("pos").alias("pos"), F.max("prose").alias("prose"), F.max("prefix").alias("prefix"), F.max("point").alias("point"),
        F.array_sort(F.collect_list(F.when(F.col("prose"), F.struct("pos", "line")))).alias("text"), F.max_by("prefix", "pos").alias("last_prefix"),
        _one(F.when(F.col("pos") == 0, F.struct("__kept", "__title", "__body"))).alias("own"), F.min_by("heading", F.when(F.col("heading").isNotNull(), F.col("pos"))).alias("heading"))
    # Text as a column before each step that names it several times.
    units = units.withColumn("whole", F.when(F.col("prose"), F.array_join("text.line", " ")).otherwise(F.col("point")))
    units = units.withColumn("whole", inline_normalised(F.col("whole")))
    said = F.when(F.col("prose"), _said(F.col("whole"))).when(F.col("point").isNotNull(), F.array("whole"))
    units = units.withColumn("points", _points(said, F.col("prefix")))
    notes_ = units.groupBy("__id").agg(
        _one(F.col("own")).alias("own"), F.min_by("heading", F.when(F.col("heading").isNotNull(), F.col("pos"))).alias("heading"), F.max_by("last_prefix", "pos").alias("prefix"),
        F.array_sort(F.collect_list(F.when(F.size("points") > 0, F.struct("pos", "points")))).alias("p"))
    title = F.coalesce("own.__title", "heading", nfc(file_stem(F.coalesce(F.col(f"own.__kept.{path_col}"), F.lit("")))))
    out = notes_.select(
        F.col("__id").alias(id_col), "own", "prefix", title.alias("title"), F.slice(F.array_distinct(F.flatten("p.points")), 1, KEYPOINTS).alias("found"))
    rest = lambda said: F.slice(F.array_distinct(_points(said, F.col("prefix"))), 1, KEYPOINTS)
    out = out.withColumn("found", F.when(F.size("found") > 0, F.col("found")).otherwise(rest(_said(inline_normalised(F.col("own.__body"))))))
    out = out.withColumn("found", F.when(F.size("found") > 0, F.col("found")).otherwise(rest(F.array(inline_normalised(F.col("title"))))))
    summary = F.coalesce(_full(F.array_join("found", "\n")), F.col("title"))
    return out.select(id_col, *[F.col(f"own.__kept.{c}").alias(c) for c in kept], "title", summary.alias("summary"), F.col("found").alias("keypoints"))
