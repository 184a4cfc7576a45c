"""Parts of documents from their lines: the bibliography and the chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Headings that open and close a bibliography.
OPENS = r"(?iu)^\s*(?:\d+[. ]\s*)?(?:references|bibliography|参考文献)\s*(?=$|\[)"
CLOSES = r"(?iu)^\s*(?:(?:[A-Z]|\d+)[. ]\s*)?(?:appendix(?:\s+[A-Z])?|appendices|author biographies|acknowledg(?:e)?ments|附录)\s*$"
# Lines of publishers. A permission notice goes on until a line with a DOI's address.
NOTES = r"(?i)^(?:Corresponding author\s*:|[*∗†‡]\s*This paper (?:has been|was) accepted\b)"
PERMISSION = r"(?i)^Permission to make (?:digital or hard|digital|hard) copies\b"
PERMISSION_ENDS = r"(?i)\bdoi\.org/"
IMPRINTS = r"(?i)^(?:(?:©\s*)?\d{4}\s+Copyright\b|ACM ISBN\b|https?://doi\.org/|DAC\s*[’']?\d{2}\s*,\s*(?:June|July|August)\b)"


def without_publisher_lines(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """(doc, text): each document's lines but those of its publisher, joined by newlines and trimmed.

    A notice of permission goes from its first line to the next one with a DOI's address, both included, or to the end.
    Null lines are empty; a document without other lines has an empty text. A window holds one document."""
    text = F.coalesce(F.col(line), F.lit(""))
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    note, opens = bare.rlike(NOTES), bare.rlike(PERMISSION)
    state = F.when(note, None).when(opens, True).when(bare.rlike(PERMISSION_ENDS), False)
    before = F.last(state, ignorenulls=True).over(Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    drop = note | opens | F.coalesce(before, F.lit(False)) | bare.rlike(IMPRINTS)
    rows = lines.select(doc, pos, F.when(~drop, text).alias("__line"), drop.alias("__drop"))
    kept = F.sort_array(F.collect_list(F.when(~F.col("__drop"), F.struct(pos, "__line"))))
    joined = rows.groupBy(doc).agg(kept.alias("__rows"))
    return joined.select(doc, F.regexp_replace(F.array_join(F.transform("__rows", lambda r: r["__line"]), "\n"), r"^\s+|\s+$", "").alias("text"))


def bibliography(lines: DataFrame, doc: str, page: str, pos: str, line: str) -> DataFrame:
    """(doc, page, text): the lines of each page that belong to the bibliography, joined by newlines.

    A heading that opens it counts with the rest of its own line; one that closes it ends it, on later pages too, until
    it opens again. Pages whose lines are all blank give no row; a null line is empty. A window holds one document."""
    text = F.coalesce(F.col(line), F.lit(""))
    opens = text.rlike(OPENS)
    state = F.when(opens, True).when(text.rlike(CLOSES), False)
    inside = F.last(state, ignorenulls=True).over(Window.partitionBy(doc).orderBy(page, pos).rowsBetween(Window.unboundedPreceding, 0))
    kept = lines.select(doc, page, pos, F.when(opens, F.regexp_replace(text, OPENS, "")).otherwise(text).alias("__line"), opens.alias("__opens"), inside.alias("__in")).where("__in and not (__opens and trim(__line) = '')")
    rows = kept.groupBy(doc, page).agg(F.sort_array(F.collect_list(F.struct(pos, "__line"))).alias("__rows"))
    return rows.select(doc, page, F.array_join(F.transform("__rows", lambda r: r["__line"]), "\n").alias("text")).where(F.trim(F.regexp_replace("text", r"\s", "")) != "")


def chapters(blocks: DataFrame, doc: str, order: str, text: str, heads: Column, most: int = 6000) -> DataFrame:
    """(doc, chapter, text): blocks after each head joined by newlines and cut to ``most`` characters, the length that a
    chapter's first reading takes. Blocks before the first head and chapters without text give no row."""
    number = F.count_if(heads).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.select(doc, order, text, F.coalesce(heads, F.lit(False)).alias("__head"), number.alias("chapter")).where("chapter > 0 and not __head")
    rows = rows.groupBy(doc, "chapter").agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(text), F.lit("")).alias("__text")))).alias("__rows"))
    return rows.select(doc, "chapter", F.left(F.array_join(F.transform("__rows", lambda r: r["__text"]), "\n"), F.lit(most)).alias("text")).where(F.regexp_replace("text", r"\s", "") != "")


def anchors(blocks: DataFrame, doc: str = "doc", block: str = "block", kind: str = "kind", text: str = "text", caption: str = "caption", order: str = "ord") -> DataFrame:
    """(doc, label, kind, block, ord, text): blocks that two languages share by their label (sec1.1, fig3, tab2, ...).
    Headings are of kind section, all others captions; a block without a text is read by its caption, one without a label
    gives no row."""
    shown = F.coalesce(F.when(F.col(text) != "", F.col(text)), F.col(caption), F.lit(""))
    section = F.coalesce(F.col(kind) == "section", F.lit(False))
    label = T.anchor_label(F.when(section, "section").otherwise("caption"), shown)
    bare = F.regexp_replace(shown, r"^\s+|\s+$", "")
    rows = blocks.select(F.col(doc).alias("doc"), label.alias("label"), F.when(section, "section").otherwise("caption").alias("kind"), F.col(block).alias("block"), F.col(order).alias("ord"), bare.alias("text"))
    return rows.where("label IS NOT NULL")
