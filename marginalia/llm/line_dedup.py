"""Operator 4, line dedup: a log-template tree of fixed depth, in DataFrame operations only.

A line's tokens (split at white space, those with a digit generalised to ``<*>``) lead it down the
tree: the first level is the number of tokens, the next levels are the leading tokens. In a leaf,
lines that agree in at least ``similarity`` of their positions share one template; positions in
which they differ are its variable fields. A template that occurs in ``min_docs`` documents or more
recurs, and a long one, of ``long_tokens`` tokens or more, from two documents on: the document with
the smallest id keeps its lines, every other document loses them.

Only leaves that hold two or more different lines need their tokens; all else runs on hashes. A
leaf's templates are those that passes in single file would grow: the line with the most documents
that has no template yet (ties: the larger hash) founds one, and similar lines join it. They are
found many at a time, by buckets: a line's positions below the leading ones are dealt into one group
more than similar lines may differ in, so similar lines agree in all of some group, and share its
bucket. In a pass every line that outranks all others in its buckets founds a template, as no line
that it could join is left. Another line looks at the highest-ranked line of all its buckets: where
that one founds and is similar, it joins it, since nothing similar ranks higher; else it waits. Passes
end when no lines are left. Leaves of up to ``LEAF_LINES`` lines are passed over as a whole before, up to
``max_templates`` times: the same templates with less work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialise, row_keys, working_tables

#: Bits of the hash in a founder's rank, above which the number of documents stands.
HASH_BITS = 24
#: Different lines of a leaf up to which it is passed over as a whole; a pass brings a leaf together in a task.
LEAF_LINES = 256
#: Bits that tell documents whose lines' texts are needed: 8 MB, for some 20 million such documents.
ID_BITS = 1 << 26


def _shape(line: Column) -> Column:
    """The line's tokens with single spaces between them, every token that has a digit as ``<*>``.

    One search for single characters and a plain one tell most lines, which are so already.
    """
    odd = line.rlike(r"[0123456789\t\r\x0b\f]") | F.contains(line, F.lit("  "))
    general = F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "<*>")
    return F.trim(F.when(odd, F.regexp_replace(general, r"\s+", " ")).otherwise(line))


def _lines(base: DataFrame) -> DataFrame:
    """(did, tk, pos, shape): the lines of ``base`` (did, tk, body)."""
    lines = base.select("did", "tk", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    # Each step is used more than once by the next, so it has a projection of its own; a filter here
    # would be pushed below them and repeat their work.
    return lines.select("did", "tk", "pos", _shape(F.col("line")).alias("shape"))


def _holding(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``base`` whose did ``wanted`` has, and some others: a map of ``ID_BITS`` bits tells, which has the same size for any corpus."""
    bit = F.pmod(F.xxhash64("did"), F.lit(ID_BITS))
    marks = wanted.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("place"))
    marks = marks.groupBy("part").agg(F.bitmap_construct_agg("place").alias("marks"))
    rows = base.withColumns({"part": F.bitmap_bucket_number(bit), "place": F.bitmap_bit_position(bit)}).join(F.broadcast(marks), "part")
    byte = F.conv(F.hex(F.substring("marks", (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.filter(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1).select(*base.columns)


def _occurrences(text: Column, mark: str) -> Column:
    """How often a one-byte mark stands in a text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def _fits(tokens: str, model: str, similarity: float) -> Column:
    alike = F.aggregate(F.zip_with(tokens, model, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    return (alike >= similarity * F.size(tokens)) & (F.size(tokens) > 0)


def _buckets(left: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(h, rank, bucket): similar lines of a leaf share a bucket at least."""
    groups = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9).cast("int") + 1  # the lines differ in fewer positions
    sized = left.select("h", "leaf", "rank", "tokens", F.size("tokens").alias("size"))
    sized = sized.select("h", "leaf", "rank", "tokens", (F.col("size") - 1).alias("last"), groups.alias("groups"))
    # Every position is looked at once, in the group that it belongs to.
    places = lambda g: F.filter(F.sequence(g, F.col("last"), F.col("groups")), lambda i: i >= depth)
    key = lambda g: F.xxhash64("leaf", g, F.transform(places(g), lambda i: F.get("tokens", i)))
    return sized.select("h", "rank", F.explode(F.transform(F.sequence(F.lit(0), F.col("groups") - 1), key)).alias("bucket"))


def _templates(shapes: DataFrame, leaves: DataFrame, base: DataFrame, depth: int, similarity: float, max_templates: int) -> DataFrame:
    """(h, template) for lines that take another line's template."""
    crowded = materialise(
        shapes.select("h", "leaf", "n_docs", "did").join(leaves.filter("n_shapes > 1").select("leaf", "n_shapes"), "leaf"), "line-crowded"
    )
    # The crowded lines grow with the corpus, so their join is a merge at every size. A line's text
    # is that of its first document, so that a frequent line is one row here and few texts are taken apart again.
    lines = _lines(_holding(base, crowded)).select(F.xxhash64("shape").alias("h"), "did", "shape")
    text = lines.join(crowded.select("h", "did").hint("merge"), ["h", "did"], "left_semi").groupBy("h").agg(F.first("shape").alias("shape"))
    text = text.select("h", F.split("shape", " ").alias("tokens"))
    rank = F.col("n_docs") * (1 << HASH_BITS) + F.pmod("h", F.lit(1 << HASH_BITS))
    small = (F.col("n_shapes") <= LEAF_LINES).alias("small")
    texts = materialise(crowded.join(text, "h").select("h", "leaf", "tokens", rank.alias("rank"), small), "line-texts")
    whole = F.col("small") if max_templates else F.lit(False)
    left, large, found = texts.filter(whole).drop("small"), texts.filter(~whole).drop("small"), None
    for _ in range(max_templates):
        founders = left.groupBy("leaf").agg(F.max(F.struct("rank", "h")).alias("top"), F.count("*").alias("n")).filter("n > 1")
        founders = left.join(founders.select("leaf", F.col("top.h").alias("h")), ["leaf", "h"]).select("leaf", F.col("h").alias("template"), F.col("tokens").alias("model"))
        joined = left.join(founders, "leaf").withColumn("fits", _fits("tokens", "model", similarity))
        joined = materialise(joined.select("h", "leaf", "tokens", "rank", "template", "fits"), "line-pass")
        took = joined.filter((F.col("fits")) | (F.col("h") == F.col("template"))).select("h", "template")
        found = took if found is None else found.union(took)
        left = joined.filter(~F.col("fits") & (F.col("h") != F.col("template"))).select("h", "leaf", "tokens", "rank")
        if left.isEmpty():
            break
    # From here on only the lines that wait are read, so that passes get smaller with them.
    rest = materialise(large.unionByName(left), "line-rest")
    buckets, rest = materialise(_buckets(rest, depth, similarity), "line-buckets"), rest.select("h", "tokens")
    while not buckets.isEmpty():
        # Stored, so that the join reads plain shuffles and Spark can split a frequent bucket.
        top = materialise(buckets.groupBy("bucket").agg(F.max(F.struct("rank", "h")).alias("top")).select("bucket", "top.*"), "line-tops")
        top = top.select("bucket", F.struct("rank", "h").alias("top"))
        seen = buckets.select("h", "bucket").join(top, "bucket").groupBy("h").agg(F.max("top").alias("top")).select("h", F.col("top.h").alias("template"))
        seen = materialise(seen.join(rest, "h"), "line-seen")
        rest = seen.select("h", "tokens")
        founders = seen.filter("h = template").select("template", F.col("tokens").alias("model"))
        tried = seen.filter("h <> template").join(founders, "template")
        took = tried.filter(_fits("tokens", "model", similarity)).select("h", "template")
        took = materialise(took.union(founders.select("template", "template")), "line-took")
        found = took if found is None else found.union(took)
        buckets = materialise(buckets.join(took.select("h"), "h", "left_anti"), "line-buckets")
    return texts.select("h", F.col("h").alias("template")).limit(0) if found is None else found


def template_line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 3,
    similarity: float = 0.8,
    min_docs: int = 3,
    min_tokens: int = 3,
    max_templates: int = 8,
    count_col: str | None = None,
    long_tokens: int = 50,
) -> DataFrame:
    """``docs`` with recurring lines dropped, all columns kept, plus n_lines and n_dropped (int).

    Lines are split at ``\\n`` and the kept ones joined by it, so a text without recurring lines
    comes back unchanged. Lines of fewer than ``min_tokens`` tokens recur by chance and stay; ``min_docs``
    binds lines of fewer than ``long_tokens``, longer ones recur in two documents already. A null
    text stays null (0 lines); an empty text has one empty line. A text whose lines all go becomes
    empty; the row stays. Rows with the same id count as one document; exactly repeated rows get
    the same result. Rows with a null id come after all others. Columns n_lines and n_dropped of
    the input are replaced. ``max_templates`` changes the work, not the result. ``count_col`` names a column with the text's number of characters, which
    then follows the text where lines were dropped.
    """
    spare = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    text = F.col(text_col).cast("string")
    base = docs.select(*row_keys(id_col, text_col), text.alias("body"))
    lines = _lines(base)
    n_tokens = F.when(F.col("shape") == "", 0).otherwise(_occurrences(F.col("shape"), " ") + 1)
    hashed = lines.select("did", "tk", "pos", F.xxhash64("shape").alias("h"), n_tokens.alias("n_tokens"), F.xxhash64(F.substring_index("shape", " ", depth)).alias("lead"))
    with working_tables(docs.sparkSession) as keep:
        hashed = materialise(hashed, "line-hashes").filter(F.col("n_tokens") >= min_tokens)
        need = F.when(F.col("n_tokens") >= long_tokens, min(min_docs, 2)).otherwise(min_docs)  # the same in a whole leaf
        hashed = hashed.select("did", "tk", "pos", "h", F.xxhash64("n_tokens", "lead").alias("leaf"), need.alias("need"))
        shapes = hashed.groupBy("h", "leaf", "did").agg(F.max("need").alias("need")).groupBy("h", "leaf").agg(F.count("*").alias("n_docs"), F.max("need").alias("need"), F.min("did").alias("did"))
        shapes = materialise(shapes, "line-shapes")
        leaves = shapes.groupBy("leaf").agg(F.count("*").alias("n_shapes"), F.sum("n_docs").alias("n_docs"), F.max("need").alias("need"))
        # A template can only recur in a leaf with enough documents; most lines go no further than this.
        leaves = materialise(leaves.filter(F.col("n_docs") >= F.col("need")), "line-leaves")
        templates = _templates(shapes, leaves, base, depth, similarity, max_templates)
        busy = hashed.join(leaves.select("leaf"), "leaf", "left_semi")
        named = keep(materialise(busy.join(templates, "h", "left").select("did", "tk", "pos", F.coalesce("template", "h").alias("template"), "need"), "line-named"))
        recurring = named.groupBy("template", "did").agg(F.max("need").alias("need")).groupBy("template")
        recurring = recurring.agg(F.count("*").alias("n"), F.min("did").alias("owner"), F.max("need").alias("need")).filter(F.col("n") >= F.col("need"))
        # Stored, so that the join below reads two plain shuffles and Spark can split a frequent template.
        recurring = keep(materialise(recurring.select("template", "owner"), "line-recurring"))
    drops = named.join(recurring, "template").filter("did > owner")
    drops = drops.groupBy("did", "tk").agg(F.collect_set("pos").alias("drops"))

    did, tk, gone = free_names(docs, "did", "tk", "drops")
    keyed = docs.select(*[F.col(f"`{c}`") for c in spare], *[k.alias(n) for n, k in zip((did, tk), row_keys(id_col, text_col), strict=True)])
    out = keyed.join(drops.select(F.col("did").alias(did), F.col("tk").alias(tk), F.col("drops").alias(gone)), [did, tk], "left")
    n_lines = F.coalesce(_occurrences(text, "\n") + 1, F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col(gone))
    # A lambda works out anew for each line what it names, so the split text is the argument of one around it.
    joined = F.transform(F.array(F.split(text, "\n")), lambda parts: F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    cleaned = F.when(F.col(gone).isNull(), text).otherwise(F.get(joined, F.lit(0)))

    out = out.select(
        *[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in spare],
        n_lines.alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).alias("n_dropped"))
    if count_col is None:
        return out
    # In a projection of its own: Spark 4.1 evaluates a lambda wrongly when one projection holds it twice.
    size = F.when(F.col("n_dropped") == 0, F.col(f"`{count_col}`")).otherwise(F.char_length(F.col(f"`{text_col}`")))
    return out.withColumn(count_col, size.cast(docs.schema[count_col].dataType))
