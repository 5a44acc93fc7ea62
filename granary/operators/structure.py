"""Structure of texts: lines and their kinds, gaps, trees by indent, alphabets and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as tx

# Fixed value: the alphabet.
ALPHABET = "abcdefghijklmnñopqrstuvwxyz"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line), all lines of a text."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


def blocks(docs: DataFrame) -> DataFrame:
    """Lines that are not blank with kind, text, heading level, number, indent level and whether a blank line stands before."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines(docs).withColumn("kind", tx.line_kind(F.col("line"))).withColumn("gap_section", F.coalesce(F.lag(F.col("kind") == "blank").over(w), F.lit(False)))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", r"^[ \t]*(#{1,3})", 1))).otherwise(1)
    marker = F.when(F.col("kind") == "numbered", F.regexp_extract("line", r"^[ \t]*([0-9]+)", 1)).otherwise("")
    width = F.floor(tx.indent(F.col("line"), 2) / 2).cast("int")  # two spaces, or one tab, are a level
    return rows.where("kind <> 'blank'").select("doc_id", "pos", "kind", tx.line_text(F.col("line")).alias("text"), level.alias("level"), marker.alias("marker"), width.alias("indent_level"), "gap_section")


def is_structured(docs: DataFrame) -> DataFrame:
    """Whether any line of a document is marked as a heading, number or bullet."""
    return lines(docs).groupBy("doc_id").agg(F.bool_or(tx.line_kind(F.col("line")).isin("heading", "numbered", "bullet")).alias("structured"))


def rebuilt(docs: DataFrame) -> DataFrame:
    """The texts of the blocks one after the other, without their marks."""
    found = blocks(docs).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("rebuilt"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("rebuilt", F.lit("")).alias("rebuilt"))


def paragraph_first(docs: DataFrame) -> DataFrame:
    """Lines with text, and whether each is the first of its paragraph."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    blank = F.col("line").rlike(r"^[ \t]*$")
    rows = lines(docs).withColumn("first", F.coalesce(F.lag(blank).over(w), F.lit(True)))
    return rows.where(~blank).select("doc_id", "pos", "first")


def indent_tree(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, label, width, parent): the parent is the nearest earlier line of a smaller indent.

    The stack of open lines is folded over a document's lines; it never holds more than the depth.
    """
    rows = lines(docs).where(~F.col("line").rlike(r"^[ \t]*$")).select("doc_id", "pos", F.regexp_replace(F.trim(F.regexp_replace("line", "\t", " ")), r"^[-*•][ ]+", "").alias("label"), tx.indent(F.col("line"), 4).alias("width"))
    by_doc = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "width", "label"))).alias("rows"))
    kind = "struct<stack:array<struct<pos:int,width:int>>,out:array<int>>"
    start = F.struct(F.array().cast("array<struct<pos:int,width:int>>").alias("stack"), F.array().cast("array<int>").alias("out")).cast(kind)

    def step(acc: Column, row: Column) -> Column:
        open_ = F.filter(acc["stack"], lambda s: s["width"] < row["width"])
        return F.struct(F.concat(open_, F.array(F.struct(row["pos"].alias("pos"), row["width"].alias("width")))).alias("stack"), F.concat(acc["out"], F.array(F.try_element_at(open_, F.lit(-1))["pos"])).alias("out")).cast(kind)

    folded = by_doc.withColumn("parents", F.aggregate("rows", start, step)["out"])
    each = folded.select("doc_id", F.explode(F.arrays_zip("rows", "parents")).alias("x"))
    return each.select("doc_id", F.col("x.rows.pos").alias("pos"), F.col("x.rows.label").alias("label"), F.col("x.rows.width").alias("width"), F.col("x.parents").alias("parent"))


def characters(docs: DataFrame) -> DataFrame:
    """(doc_id, char): the distinct characters of each text."""
    return docs.select("doc_id", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), ""))).alias("char")).where("char <> ''")


def alphabet_missing(docs: DataFrame, alphabet: str = ALPHABET) -> DataFrame:
    """Letters of the alphabet that a text lacks, in its order, and the share it has; case does not count for a lower-case alphabet."""
    letters = F.array(*[F.lit(c) for c in dict.fromkeys(alphabet)])
    text = F.coalesce("text", F.lit(""))
    own = F.array_distinct(F.split(F.lower(text) if alphabet == alphabet.lower() else text, ""))
    missing = F.array_except(letters, own)
    return docs.select("doc_id", F.array_join(missing, "").alias("missing"), F.round((F.size(letters) - F.size(missing)) / F.size(letters), 4).alias("coverage"))


def text_coverage(docs: DataFrame, have: str) -> DataFrame:
    """How a store of characters covers each text: exactly, by the other case, or not; and the covered share (1 for an empty text)."""
    own = F.array(*[F.lit(c) for c in dict.fromkeys(have)])
    chars = F.filter(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "")), lambda c: ~c.rlike(r"^\s*$"))
    rows = docs.select("doc_id", chars.alias("chars"))
    exact = F.array_intersect("chars", own)
    other = F.filter(F.array_except("chars", own), lambda c: F.array_contains(own, F.lower(c)) | F.array_contains(own, F.upper(c)))
    rows = rows.select("doc_id", F.size("chars").alias("n_chars"), F.size(exact).alias("n_covered"), F.size(other).alias("n_downgraded"))
    missing = F.col("n_chars") - F.col("n_covered") - F.col("n_downgraded")
    return rows.select("doc_id", "n_covered", "n_downgraded", missing.alias("n_missing"), F.when(F.col("n_chars") == 0, 1.0).otherwise(F.round((F.col("n_chars") - missing) / F.col("n_chars"), 4)).alias("ratio"))


def char_order(chars: DataFrame, alphabet: str = ALPHABET) -> DataFrame:
    """Distinct characters in domain order: letters of the alphabet (lower before upper), digits, the rest by code."""
    c = F.col("char")
    place = F.instr(F.lit(alphabet), F.lower(c))
    kind = F.when(place > 0, 0).when(c.rlike("^[0-9]$"), 1).otherwise(2)
    rows = chars.select("char").distinct().select("char", kind.alias("kind"), F.when(kind == 0, place).otherwise(0).alias("place"), F.when(kind == 0, (c != F.lower(c)).cast("int")).otherwise(0).alias("upper"), F.ascii("char").alias("code"))
    return rows.orderBy("kind", "place", "upper", "code")
