"""Lines of pages: texts, fonts, repeated margin lines, headings and sections, pages that need recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as T

PAGE = ["doc_id", "page_number"]
MARGIN, REPEAT_SHARE, MIN_PAGES, MAX_CANDIDATES = 72.0, 0.5, 3, 20


def distinct_lines(lines: DataFrame) -> DataFrame:
    return lines.dropDuplicates([*PAGE, "line_no"])


def page_texts(lines: DataFrame) -> DataFrame:
    """``(doc_id, page_number, text, chars)``: lines joined by line breaks; bytes of the lines alone."""
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("text"), F.sum(F.octet_length("text")).alias("chars"))


def document_texts(lines: DataFrame) -> DataFrame:
    p = page_texts(lines)
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda s: s["text"]), "\n\n").alias("text"))


def median_font(lines: DataFrame, by: list[str]) -> DataFrame:
    """The median of the font sizes; the mean of the middle two for an even number, 12 without any."""
    return lines.groupBy(*by).agg(F.coalesce(F.expr("percentile(font_size, 0.5)"), F.lit(12.0)).alias("median_font"))


def _zone() -> Column:
    return F.when(F.col("page_height") - F.col("y") <= MARGIN, "header").when(F.col("y") <= MARGIN, "footer")


def margin_lines(lines: DataFrame, share: float = REPEAT_SHARE) -> DataFrame:
    """``(doc_id, zone, norm, n)``: margin lines found on at least that share of the pages of a document with at least 3, at most 20 a zone."""
    norm = T.collapse("text")
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page_number").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    c = lines.withColumn("zone", _zone()).where("zone IS NOT NULL").groupBy("doc_id", "zone", norm.alias("norm")).agg(F.count(F.lit(1)).alias("n")).where("norm <> ''")
    w = Window.partitionBy("doc_id", "zone").orderBy(F.desc("n"), F.asc("norm"))
    return c.join(pages, "doc_id").where(F.col("n") >= F.ceil(F.col("pages") * share)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= MAX_CANDIDATES).select("doc_id", "zone", "norm", "n")


def without_margins(lines: DataFrame, share: float = REPEAT_SHARE) -> DataFrame:
    """The lines but for repeated margin lines, compared with blanks collapsed."""
    gone = margin_lines(lines, share).select("doc_id", F.col("norm").alias("__n")).distinct()
    return lines.withColumn("__n", T.collapse("text")).join(gone, ["doc_id", "__n"], "left_anti").drop("__n")


def margin_stats(lines: DataFrame) -> DataFrame:
    """``(doc_id, headers, footers, removed)``."""
    m = margin_lines(lines)
    per = m.groupBy("doc_id").agg(F.count_if(F.col("zone") == "header").alias("headers"), F.count_if(F.col("zone") == "footer").alias("footers"))
    gone = lines.withColumn("norm", T.collapse("text")).join(m.select("doc_id", "norm").distinct(), ["doc_id", "norm"], "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("removed"))
    return per.join(gone, "doc_id", "left")


def is_heading(median: Column, ratio: float = 1.2, smallest: float = 10.0) -> Column:
    """Set larger than the text, 3 to 200 bytes long, and in capitals, without a final dot, or short."""
    n, t = F.octet_length("text"), F.trim("text")
    letters = F.regexp_replace("text", r"[^\p{L}]", "")
    dot = F.endswith(t, F.lit("."))
    form = ((letters == F.upper(letters)) & ~dot) | ~dot | (n < 50)
    return (F.col("font_size") >= smallest) & (F.col("font_size") > median * ratio) & n.between(3, 200) & form


def headings(lines: DataFrame, ratio: float = 1.2, smallest: float = 10.0) -> DataFrame:
    """``(doc_id, page_number, line_no, heading, font_size, level)``: levels by font size from the largest, 5 at most.

    Sizes are ranked among a document's distinct heading sizes, which are few.
    """
    m = median_font(lines, ["doc_id"])
    h = lines.join(m, "doc_id").where(is_heading(F.col("median_font"), ratio, smallest)).select(*PAGE, "line_no", F.trim("text").alias("heading"), F.col("font_size").cast("double").alias("font_size"))
    sizes = h.select("doc_id", "font_size").distinct().withColumn("level", F.least(F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("font_size"))), F.lit(5)))
    return h.join(sizes, ["doc_id", "font_size"])


def sections(lines: DataFrame, ratio: float = 1.2, smallest: float = 10.0) -> DataFrame:
    """``(doc_id, heading, level, start_page, end_page)``: a section ends before the page of the next heading of its level or above.

    The next such heading is the nearest among the next ones of each of the five levels: one window per level
    over the document's headings, instead of a join of all with all.
    """
    h = headings(lines, ratio, smallest)
    last = lines.groupBy("doc_id").agg(F.max("page_number").alias("last_page"))
    w = Window.partitionBy("doc_id").orderBy("page_number", "line_no").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("level") <= 1, F.col("page_number")), ignorenulls=True).over(w)
    ends = F.when(F.col("level") == 1, nxt)
    for l in range(2, 6):
        ends = F.when(F.col("level") == l, F.first(F.when(F.col("level") <= l, F.col("page_number")), ignorenulls=True).over(w)).otherwise(ends)
    s = h.withColumn("next_page", ends).join(last, "doc_id")
    return s.select("doc_id", "heading", "level", F.col("page_number").alias("start_page"), "line_no", F.when(F.col("next_page").isNull(), F.col("last_page")).otherwise(F.greatest(F.col("next_page") - 1, F.col("page_number"))).alias("end_page"))


def section_contents(lines: DataFrame, secs: DataFrame) -> DataFrame:
    """``(doc_id, start_page, line_no, content)``: all lines of each section's pages. Joined by page, after the page texts are made."""
    pages = page_texts(lines).select("doc_id", F.col("page_number").alias("p"), "text")
    s = secs.select("doc_id", "start_page", "line_no", F.explode(F.sequence("start_page", "end_page")).alias("p"))
    return s.join(pages, ["doc_id", "p"]).groupBy("doc_id", "start_page", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]), "\n").alias("content"))


def ocr_stats(lines: DataFrame, least: int = 50) -> DataFrame:
    """``(doc_id, pages, needing, having)``: pages with too little text, and pages with recognised lines."""
    p = lines.groupBy(*PAGE).agg(F.sum(F.octet_length("text")).alias("n"), F.bool_or(F.coalesce("is_ocr", F.lit(False))).alias("o"))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("n") < least).alias("needing"), F.count_if("o").alias("having"))


def overlapping(boxes: DataFrame, group: list[str], key: str) -> DataFrame:
    """``(group, a, b)``: pairs of boxes (x, y, width, height) of one group that overlap.

    Boxes go into the horizontal bands they touch and are compared within a band only; a pair is given by the
    first band both touch. Bands are as high as the group's mean box.
    """
    band = boxes.groupBy(*group).agg(F.greatest(F.avg("height"), F.lit(1e-6)).alias("bh"))
    b = boxes.join(band, group).withColumn("lo", F.floor(F.col("y") / F.col("bh"))).withColumn("band", F.explode(F.sequence(F.floor(F.col("y") / F.col("bh")), F.floor((F.col("y") + F.col("height")) / F.col("bh")))))
    l, r = b.alias("l"), b.alias("r")
    on = [F.col(f"l.{g}") == F.col(f"r.{g}") for g in group] + [F.col("l.band") == F.col("r.band"), F.col(f"l.{key}") < F.col(f"r.{key}"), F.greatest("l.lo", "r.lo") == F.col("l.band"),
        F.col("l.x") < F.col("r.x") + F.col("r.width"), F.col("r.x") < F.col("l.x") + F.col("l.width"), F.col("l.y") < F.col("r.y") + F.col("r.height"), F.col("r.y") < F.col("l.y") + F.col("l.height")]
    return l.join(r, on).select(*[F.col(f"l.{g}").alias(g) for g in group], F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"))


def simple_heading(font: str | Column, median: str | Column, ratio: float = 1.2) -> Column:
    """Whether a font is larger than the page's median by the ratio."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return c(font).cast("double") > c(median).cast("double") * ratio
