"""Sections of Markdown texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed forms: a heading of level one or two, a fence, a line that is a term alone, an inline link that is no image.
HEADING = "^ {0,3}(#{1,2})[ \\t]+(.*?)([ \\t]+#+)?[ \\t]*$"
FENCE = "^ {0,3}(```|~~~)"
TERM = "^\\*\\*([^*\\n]+?)\\*\\*\\s*$"
LINK = "(?<!!)\\[([^\\]\\n]+)\\]\\(([^)\\n]+)\\)"


def anchor(heading: Column) -> Column:
    """Lower case, other than word characters, hyphens and spaces dropped, white space to hyphens."""
    kept = F.regexp_replace(F.lower(heading), "[^\\w\\- ]+", "")
    return F.regexp_replace(F.regexp_replace(kept, "\\s+", "-"), "^-+|-+$", "")


def links(body: Column) -> Column:
    """Different inline links as ``text<TAB>target``, in order."""
    found = F.regexp_extract_all(body, F.lit(LINK), 0)
    tidy = F.transform(found, lambda x: F.concat(F.trim(F.regexp_extract(x, LINK, 1)), F.lit("\t"), F.trim(F.regexp_extract(x, LINK, 2))))
    return F.array_distinct(tidy)


def sections(docs: DataFrame, id_col: str = "id", text_col: str = "text", title: Column | None = None) -> DataFrame:
    """(id, section, level, heading, anchor, line_start, line_end, body, links) of each section of each document.

    A section begins at a heading of level one or two outside fences, at line ``line_start`` (from 1), and ends before
    the next, at ``line_end`` (null for the last). What stands before the first heading belongs to none. A document
    without headings is one section with ``title`` (its id if null) as heading. A null text has no section. A document's
    lines are one task's work.
    """
    title = F.coalesce(title, F.col(id_col).cast("string")) if title is not None else F.col(id_col).cast("string")
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), title.alias("_title"), F.posexplode(F.split(text_col, "\n")).alias("_no", "_line"))
    so_far = Window.partitionBy("id").orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
    fenced = F.sum(F.col("_line").rlike(FENCE).cast("int")).over(so_far) % 2 == 1
    told = lines.withColumn("_head", ~fenced & F.col("_line").rlike(HEADING)).withColumn("section", F.sum(F.col("_head").cast("int")).over(so_far))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("_no", "_line")))), lambda x: x["_line"]), "\n")
    parts = told.groupBy("id", "section").agg(
        F.min("_title").alias("_title"), F.min(F.when(F.col("_head"), F.col("_line"))).alias("_line"), (F.min("_no") + 1).alias("line_start"), (F.max("_no") + 2).alias("_next"), body.alias("body")
    )
    whole = Window.partitionBy("id")
    parts = parts.withColumns({"_last": F.max("section").over(whole)}).where("section > 0 OR _last = 0")
    heading = F.when(F.col("section") == 0, F.col("_title")).otherwise(F.trim(F.regexp_extract("_line", HEADING, 2)))
    level = F.when(F.col("section") == 0, 1).otherwise(F.length(F.regexp_extract("_line", HEADING, 1)))
    text = F.when(F.col("section") == 0, F.col("body")).otherwise(F.regexp_replace("body", "^\\n+|\\n+$", ""))
    end = F.when(F.col("section") < F.col("_last"), F.col("_next"))
    out = parts.select("id", "section", level.alias("level"), heading.alias("heading"), "line_start", end.alias("line_end"), text.alias("body"))
    return out.select("id", "section", "level", "heading", anchor(F.col("heading")).alias("anchor"), "line_start", "line_end", "body", links(F.col("body")).alias("links"))


def glossary(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, place, term, definition): the terms of each text in their order, from 1, with what they mean.

    A term is a line in bold alone; its definition is the block of lines after it, blank lines before the block aside, up
    to a blank line or the next term, joined by spaces. Terms without a definition are left out (and leave a gap
    in the places). A null text has none. A text's lines are one task's work.
    """
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\r\n|\r|\n")).alias("_no", "_line")).withColumn("_line", F.trim(F.regexp_replace("_line", "\\s+$|^\\s+", "")))
    so_far = Window.partitionBy("id").orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
    told = lines.withColumn("_term", F.col("_line").rlike(TERM)).withColumn("place", F.sum(F.col("_term").cast("int")).over(so_far)).where("place > 0")
    mine = Window.partitionBy("id", "place")
    told = told.withColumn("_first", F.min(F.when(~F.col("_term") & (F.col("_line") != ""), F.col("_no"))).over(mine))
    told = told.withColumn("_end", F.min(F.when((F.col("_line") == "") & (F.col("_no") > F.col("_first")), F.col("_no"))).over(mine))
    inside = ~F.col("_term") & (F.col("_no") >= F.col("_first")) & (F.col("_end").isNull() | (F.col("_no") < F.col("_end")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("_no", "_line")))), lambda x: x["_line"]), " ")
    out = told.groupBy("id", "place").agg(F.max(F.when(F.col("_term"), F.trim(F.regexp_extract("_line", TERM, 1)))).alias("term"), said.alias("definition"))
    return out.where("definition <> ''").select("id", "place", "term", "definition")
