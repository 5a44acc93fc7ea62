"""Documents as blocks: routes, page classes, blocks of markup, headings with their answers, joined text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extensions by route, page rules, heading limits.
ROUTES = {"pdf": ("pdf",), "docx": ("docx",), "unsupported": ("doc",), "image": ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")}
PAGE_CHARS, TEXT_SHARE, SCAN_SHARE, PAGE_WORDS = 50, 0.80, 1.0 - 0.80, 20
HEADING, AHEAD = 120, 4
BLOCK_TAGS = "h[1-6]|p|li|ul|ol|dl|dt|dd|div|table|thead|tbody|tfoot|tr|td|th|caption|pre|blockquote|hr|figure|figcaption|section|article|aside|header|footer|main|nav|form|fieldset|address|details|summary|body|html|script|style"


def route(path: Column) -> Column:
    """How a source is read: by extension, text for others, folder for a path that ends in a slash."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./?#]+)(?:[?#].*)?$", 1))
    out = F.lit("text")
    for name, kinds in ROUTES.items():
        out = F.when(ext.isin(*kinds), name).otherwise(out)
    return F.when(path.endswith("/"), "folder").otherwise(out)


def plain_blocks(docs: DataFrame) -> DataFrame:
    """Lines with text, trimmed, as paragraph blocks in order."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).alias("pos"), F.lit("paragraph").alias("kind"), F.col("line").alias("text"))


def page_class(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, share, kind): text from 0.80 of pages with text, scan up to a fifth (in binary arithmetic, so exactly a fifth is mixed)."""
    has = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \n\t]", "")) >= PAGE_CHARS
    by = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.avg(has.cast("int")).alias("share"))
    return by.select("doc_id", "n_pages", F.round("share", 6).alias("share"), F.when(F.col("share") >= TEXT_SHARE, "text").when(F.col("share") <= SCAN_SHARE, "scan").otherwise("mixed").alias("kind"))


def page_words(pages: DataFrame) -> DataFrame:
    """(doc_id, page, n_words, reader): pages with 20 words are read as text, others as scans."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return pages.select("doc_id", "page", n.alias("n_words"), F.when(n >= PAGE_WORDS, "text").otherwise("scan").alias("reader"))


def markup_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, level, text) of the headings, paragraphs and list items of simple markup. A block's
    text goes to its end tag or the next block tag, without inline tags; a line break is a space."""
    found = F.regexp_extract_all("html", F.lit(rf"(?s)<(?:h[1-6]|p|li)(?:\s[^>]*)?>.*?(?=(?i:</?(?:{BLOCK_TAGS})(?=[\s/>]))|\z)"), 0)
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("pos", "raw"))
    tag = F.regexp_extract("raw", r"^<(h[1-6]|p|li)", 1)
    text = F.regexp_replace(F.regexp_replace("raw", r"(?i)<br(?=[\s/>])[^>]*>", " "), r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>", "")
    kind = F.when(tag.startswith("h"), "heading").when(tag == "li", "list_item").otherwise("paragraph")
    return rows.select("doc_id", "pos", kind.alias("kind"), F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int")).otherwise(0).alias("level"), F.trim(text).alias("text"))


def answer_of(ahead: Column) -> Column:
    """The text of the first paragraph or list item of the blocks ahead, if no heading comes before it and it is not empty."""
    first = F.get(F.filter(ahead, lambda b: b["kind"].isin("heading", "paragraph", "list_item")), F.lit(0))
    return F.when((first["kind"] != "heading") & (first["text"] != ""), first["text"])


def heading_answers(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, heading, answer): the first paragraph or list item within four blocks of a heading and before the next one; long headings are left out."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, AHEAD)
    rows = blocks.withColumn("ahead", F.collect_list(F.struct("kind", "text")).over(w)).where((F.col("kind") == "heading") & (F.length("text") <= HEADING) & (F.col("text") != ""))
    return rows.select("doc_id", "pos", F.col("text").alias("heading"), answer_of(F.col("ahead")).alias("answer")).where("answer IS NOT NULL")


def document_text(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_words, text): pages in order, a blank line between."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    by = pages.withColumn("_w", words).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("_w").alias("n_words"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return by.select("doc_id", "n_pages", "n_words", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def to_markdown(kind: Column, level: Column, text: Column) -> Column:
    return F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(level, F.lit(1))), F.lit(" "), text)).when(kind == "list_item", F.concat(F.lit("- "), text)).otherwise(text)


def lines_of_words(words: DataFrame, near: float = 5.0) -> DataFrame:
    """(page, line, text, font): words (page, ord, top, font, text) broken into lines where the top moves by more than ``near`` from the word before."""
    w = Window.partitionBy("page").orderBy("ord")
    rows = words.withColumn("_new", F.coalesce(F.abs(F.col("top") - F.lag("top").over(w)) > near, F.lit(False)).cast("int")).withColumn("line", F.sum("_new").over(w))
    by = rows.groupBy("page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"), F.avg("font").alias("font"))
    return by.withColumn("level", F.when(F.col("font") >= 22, 1).when(F.col("font") >= 18, 2).when(F.col("font") >= 14, 3).otherwise(0))
