"""Noise in text from scanned pages: running headers, page numbers, broken and misread words; and its repair.

Furniture: a line among the first or last of its page is a page number if its number and those at the other pages'
edges rise with the pages, and a running header or footer if its wording repeats on other pages. Lines are compared
fuzzily: by a skeleton in which characters that scanners confuse are one and digits are one, and within a few edits of
any skeleton that repeats more. Only where a line stands by itself does its place decide.

Words broken at line ends are judged by the corpus's own vocabulary, counted over all lines: the two parts
go together if the joined word is known, and stay a compound if that is what the corpus writes. Misread words
are those with characters no word has, and unknown words whose skeleton is that of a known one.

Lines are shuffled once, by page; windows never span more than a page, and a word broken at a page's end meets the
next page's first line by a join of pages. Frequent words (of which there is a bounded number) are judged where the
text is, so that only rare ones are shuffled.

Defined results: repeated lines count once; lines with null text, key or flag are no cases; empty lines are
body without words; documents without scanned lines give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import cut

KEY = ["doc_id", "page_number", "line_no"]
EDGE_TOP, EDGE_BOTTOM = 3, 2
#: Of the page's width, how far from the text's left edge a line is set apart.
APART = 0.06
#: How much more frequent than the doubtful word its likely original must be.
RATIO = 8
#: Single characters that scanners confuse, each with what stands for all of its kind; then pairs of those.
SINGLE_READ, SINGLE_KIND = "ei1!05g9t@(6b", "clllosqqfachh"
PAIRS = (("rn", "m"), ("ll", "u"), ("cl", "d"), ("rl", "n"), ("vv", "w"))
NOISE = "~|·^"
HYPHENS = "-­‐‑¬"
_HY = f"[{HYPHENS}]"
ENDS = f"\\p{{L}}[{NOISE}]?{_HY}$"
#: Characters that an edge line compared with edits must have, and how many edits to a character it may differ by.
LONG, EDITS = 10, 0.2
#: So many repeated edge lines of a document's zone are compared with all others there; where there are more, lines meet by pieces.
FEW = 64
#: Words of at most ``SHORT`` characters that are one in ``FREQUENT`` tokens or more are judged where the text is.
FREQUENT, SHORT = 1 << 17, 32


def skeleton(word: str | Column) -> Column:
    """The word with all characters that scanners confuse made one."""
    c = F.lower(F.col(word) if isinstance(word, str) else word)
    c = F.regexp_replace(c, f"[{NOISE}]", "")
    c = F.translate(c, SINGLE_READ, SINGLE_KIND)
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), PAIRS, c)


PAGE = ["doc_id", "page_number"]
#: Characters that scanners read for digits, each with its digit.
DIGIT_READ, DIGIT = "lIi|!oOQsSzZB", "1111100055228"


def _lines(lines: DataFrame) -> DataFrame:
    """The distinct lines with their place from the page's top and bottom; of unlike rows with one key the greatest holds."""
    keep = lines.where(" AND ".join(f"{k} IS NOT NULL" for k in KEY) + " AND text IS NOT NULL")
    row = F.struct("text", F.coalesce("is_ocr", F.lit(False)).alias("is_ocr"), "x", "y", "page_width")
    down, up = (Window.partitionBy(*PAGE).orderBy(o) for o in (F.asc("line_no"), F.desc("line_no")))
    return keep.repartition(*PAGE).groupBy(*KEY).agg(F.max(row).alias("r")).select(*KEY, "r.*").withColumns({"top": F.row_number().over(down), "bottom": F.row_number().over(up)})


def _numberish(c: Column) -> Column:
    """Whether a line only counts pages, as read by a scanner."""
    t = F.lower(F.regexp_replace(c, f"[{NOISE}\\s]", ""))
    return t.rlike(r"^(?:page|seite|p\.?|pág\.?)?[\[(<{|\-–]*[0-9ilvxcdmo|!]{1,9}(?:(?:of|von|de|sur|/)[0-9ilo|!]{1,6})?[\])>}|\-–.]*$")


def _number(c: Column) -> Column:
    """The number that an edge line begins or ends with, misread digits mended; null where it has none."""
    t = F.regexp_replace(c, f"[~·^{{}}()<>\\[\\]\\-–.]", " ")
    t = F.regexp_replace(t, r"(?i)^\s*(?:page|seite|p|pág)\s|\s(?:of|von|de|sur|/)\s.*$", " ")
    d = F.translate(F.trim(t), DIGIT_READ, DIGIT)
    return F.coalesce(*[F.nullif(F.regexp_extract(d, p, 1), F.lit("")) for p in (r"^(\d{1,5})(?=\s|$)", r"(?:\s|^)(\d{1,5})$")]).cast("int")


def judged_edges(l: DataFrame) -> DataFrame:
    """``(d, page_number, line_no, why)`` of the furniture at page edges, ``d`` the document's hash; why is ``sequence``, ``repeated`` or ``alone``.

    A number line is furniture if its number goes up with the pages: at least two pages of the document have the same
    difference of number and page there; or if other pages' numbers do and only its own can't be read. Wording is
    furniture if it repeats on other pages: the same skeleton but for numbers, or one within a few edits of a
    skeleton that more pages have, whichever of the zone that is. Only a document too short for either is judged by
    the set-apart place of the line alone.
    """
    edge = l.where((F.col("top") <= EDGE_TOP) | (F.col("bottom") <= EDGE_BOTTOM))
    zone = F.when(F.col("bottom") <= EDGE_BOTTOM, F.when(F.col("top") <= EDGE_BOTTOM, F.when(F.col("y") > 300, "t").otherwise("b")).otherwise("b")).otherwise("t")
    bare = F.regexp_replace(F.regexp_replace("text", r"^\s*[\dIl|!]{1,4}\s*\|\s*|\s{2,}[\dIl|!]{1,5}\s*$", ""), r"\s+", " ")
    k = F.regexp_replace(F.translate(skeleton(F.trim(bare)), "0123456789", "##########"), "#+", "#")
    title = ~F.trim("text").rlike(r"[.;,]$") & (F.length("text") < 60)
    # Rows carry hashes of document and skeleton: joins move them several times.
    e = cut(edge.select(F.xxhash64("doc_id").alias("d"), "page_number", "line_no", zone.alias("zone"), k.alias("k"), _numberish("text").alias("numberish"), title.alias("title"), (_number("text") - F.col("page_number")).alias("step"), F.col("x").cast("float").alias("x"), F.col("page_width").cast("float").alias("page_width")).withColumn("kh", F.xxhash64("k")))
    doc = l.groupBy(F.xxhash64("doc_id").alias("d")).agg(F.percentile_approx("x", 0.5).alias("left"), F.count_distinct("page_number").alias("pages"))
    at = ["d", "zone"]
    keys = e.groupBy(*at, "kh").agg(F.max("k").alias("k"), F.count_distinct("page_number").alias("on_pages"))
    # A skeleton meets all repeated ones of its zone; where these are many, those that hold one of its pieces: of one
    # piece more than it may have edits, one stands unchanged in the other. Pieces are 3 or 4 characters by its length.
    long = keys.where(F.length("k") >= LONG)
    long = long.join(long.where("on_pages >= 2").groupBy(*at).agg(F.count(F.lit(1)).alias("others")), at)
    edits = F.floor(F.length("k") * EDITS).cast("int")
    q = F.floor(F.length("k") / (edits + 1)).cast("int")
    every = F.array(F.lit(""))
    pieces = F.transform(F.sequence(F.lit(0), edits), lambda i: F.col("k").substr(i * q + 1, q))
    within = F.concat(*[F.transform(F.sequence(F.lit(1), F.length("k") - n + 1), lambda i, n=n: F.col("k").substr(i, F.lit(n))) for n in (3, 4)])
    by = lambda c: F.explode(F.when(F.col("others") <= FEW, every).otherwise(F.array_distinct(c))).alias("piece")
    more = long.where("on_pages >= 2").select(*at, by(within), F.col("k").alias("m"), F.col("on_pages").alias("like_pages"))
    near = (F.abs(F.length("m") - F.length("k")) <= edits) & (F.col("m") != F.col("k")) & (F.col("like_pages") >= F.col("on_pages"))
    like = long.select(*at, "kh", "k", "on_pages", by(pieces)).join(more, [*at, "piece"]).where(near).where(F.levenshtein("k", "m") <= edits).groupBy(*at, "kh").agg(F.max("like_pages").alias("like_pages"))
    size = F.length("k").alias("size")
    keys = keys.select(*at, "kh", size, "on_pages").join(like, [*at, "kh"], "left").select(*at, "kh", "size", F.greatest("on_pages", F.coalesce(F.col("like_pages") + 1, F.lit(0))).alias("on_pages"))
    steps = e.where("step IS NOT NULL").groupBy(*at, "step").agg(F.count_distinct("page_number").alias("in_step")).where("in_step >= 2")
    zones = steps.groupBy(*at).agg(F.max("in_step").alias("longest"))
    apart = (F.col("x") - F.col("left")) > F.col("page_width") * APART
    j = e.drop("k").join(doc, "d").join(keys, [*at, "kh"]).join(steps, [*at, "step"], "left").join(zones, at, "left")
    sequence = F.col("numberish") & (F.col("in_step").isNotNull() | (F.col("longest").isNotNull() & apart))
    repeated = (apart & (F.col("on_pages") >= 2)) | (~apart & (F.col("on_pages") >= F.greatest(F.lit(3), F.col("pages") * 0.5)) & (F.col("size") >= 6) & F.col("title"))
    alone = apart & (F.col("numberish") | F.col("title"))
    return j.select("d", "page_number", "line_no", F.when(sequence, "sequence").when(repeated, "repeated").when(alone, "alone").alias("why")).where("why IS NOT NULL")


def _core(c: Column) -> Column:
    """A token without the punctuation around it."""
    return F.rtrim(F.ltrim(c, F.lit("\"'«»“”[")), F.lit("\"'«»“”].,;:?)"))


def _word(c: Column) -> Column:
    return F.lower(_core(F.when(F.startswith(c, F.lit("(")) & F.contains(c, F.lit(")")), F.substring(c, 2, 1 << 30)).otherwise(c)))


def marked(lines: DataFrame, geometry: bool = False) -> DataFrame:
    """The distinct lines with ``furniture``; for each body line, the body line after it (``next_page``, ``next_line``) with its first word, and whether the one before ends in a hyphen; and the line's ``words``, bare and in lower case."""
    l = cut(_lines(lines))
    out = cut(judged_edges(l).groupBy("d", "page_number").agg(F.collect_set("line_no").alias("out")))
    place = ["x", "page_width"] if geometry else []
    first = F.regexp_extract("text", r"^\s*(\S+)", 1)
    hyphen = F.rtrim("text").rlike(ENDS)
    here = ["d", "page_number"]
    judged = lambda *c: l.select(F.xxhash64("doc_id").alias("d"), "page_number", "line_no", *c).join(out, here, "left").withColumn("furniture", F.coalesce(F.array_contains("out", F.col("line_no")), F.lit(False))).drop("out")
    m = judged("doc_id", "text", *place, "is_ocr")
    w = Window.partitionBy(*here, "furniture").orderBy("line_no")
    edges = cut(judged(first.alias("w"), hyphen.alias("h")).where("NOT furniture").groupBy(*here).agg(F.min(F.struct("line_no", "w")).alias("f"), F.max(F.struct("line_no", "h")).alias("l")))
    over = edges.select("d", (F.col("page_number") - 1).alias("page_number"), F.struct(F.col("page_number").alias("p"), F.col("f.line_no").alias("n"), F.col("f.w").alias("w")).alias("over"), F.lit(None).cast("boolean").alias("under"))
    under = edges.select("d", (F.col("page_number") + 1).alias("page_number"), F.lit(None).cast("struct<p:int,n:int,w:string>").alias("over"), F.col("l.h").alias("under"))
    turn = over.unionByName(under).groupBy(*here).agg(F.max("over").alias("over"), F.max("under").alias("under"))
    nxt = F.struct(F.col("page_number").alias("p"), F.lead("line_no").over(w).alias("n"), F.lead(first).over(w).alias("w"))
    b = m.join(turn, here, "left").withColumn("nxt", nxt).withColumn("before", F.lag(hyphen).over(w))
    to = F.when(F.col("nxt.n").isNotNull(), F.col("nxt")).otherwise(F.col("over"))
    words = F.transform(F.split(F.trim("text"), r"\s+"), _word)
    return b.select(*KEY, "text", *place, "is_ocr", "furniture", words.alias("words"), to["p"].alias("next_page"), to["n"].alias("next_line"), to["w"].alias("next_word"), F.coalesce("before", "under", F.lit(False)).alias("goes_on"))


def breaks(m: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``KEY, next_page, next_line, tail, head, left, right, joined, is_break`` of each scanned body line that ends in a hyphen and goes on."""
    clean = lambda c: F.lower(F.regexp_replace(c, f"[{NOISE}]", ""))
    ends = m.where("is_ocr AND NOT furniture AND next_word IS NOT NULL").where(F.rtrim("text").rlike(ENDS)).withColumn("tail", F.regexp_extract("text", r"(\S+)\s*$", 1))
    h = ends.select(*KEY, "next_page", "next_line", "tail", F.col("next_word").alias("head"), clean(F.regexp_replace(F.regexp_replace("tail", f"{_HY}$", ""), r"^[\"'«»“”\[(]+(?=\p{L}{2})", "")).alias("left"), clean(F.regexp_extract("next_word", r"^([^.,;:?)\]]+)", 1)).alias("right"), F.col("tail").rlike("-$").alias("plain"))
    h = h.withColumn("joined", F.concat("left", "right")).withColumn("compound", F.concat_ws("-", "left", "right"))
    best = vocabulary.groupBy("sk").agg(F.max("n").alias("n"))
    out = h.withColumn("js", skeleton("joined")).withColumn("cs", skeleton("compound"))
    out = out.join(best.select(F.col("sk").alias("js"), F.col("n").alias("jn")), "js", "left").join(best.select(F.col("sk").alias("cs"), F.col("n").alias("cn")), "cs", "left")
    jn, cn = F.coalesce("jn", F.lit(0)), F.coalesce("cn", F.lit(0))
    return out.select(*KEY, "next_page", "next_line", "tail", "head", "left", "right", "joined", ((~F.col("plain") & (cn <= jn)) | (jn > cn) | ((jn == 0) & (cn == 0))).alias("is_break"))


def vocabulary(m: DataFrame) -> DataFrame:
    """``(word, n, digital, sk)``: how often each word stands within a line, and how often in born-digital text."""
    whole = F.size("words") - F.rtrim("text").rlike(f"{_HY}$").cast("int")
    w = m.where("NOT furniture").select(F.explode(F.slice("words", 1, F.greatest(whole, F.lit(0)))).alias("word"), (~F.col("is_ocr")).cast("int").alias("d")).where(F.col("word").rlike(r"^[\p{L}][\p{L}'’-]*$"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("digital")).withColumn("sk", skeleton("word"))


def doubtful(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``counts`` (word, c) of distinct words with ``bad`` and ``original``, which is null where none is known."""
    known = vocab.where("digital >= 2").select("word")
    best = vocab.groupBy("sk").agg(F.max_by("word", F.struct("n", "word")).alias("original"), F.max("n").alias("best"))
    marks = F.col("word").rlike(f"[{NOISE}@]") | F.col("word").rlike(r"\p{L}[!(]\p{L}|^[!]\p{L}")
    mixed = F.col("word").rlike(r"\p{L}\d|\d\p{L}") & ~F.col("word").rlike(r"^\d+(?:st|nd|rd|th|er|e|a|o)$")
    j = counts.withColumn("sk", skeleton("word")).join(best, "sk", "left").join(known.withColumn("known", F.lit(True)), "word", "left")
    like = F.col("original").isNotNull() & (F.col("original") != F.col("word")) & F.col("known").isNull() & (F.col("best") >= F.col("c") * RATIO) & (F.length("word") >= 2)
    return j.select("word", "c", F.coalesce((marks & F.col("word").rlike(r"[\p{L}\d]")) | mixed | like, F.lit(False)).alias("bad"), F.when(F.col("original") != F.col("word"), F.col("original")).alias("original"))


def _open(c: Column) -> Column:
    return F.when(F.right(c, F.lit(1)).isin(*HYPHENS), F.regexp_replace(c, f"(?<=\\p{{L}}){_HY}$", "")).otherwise(c)


def noise(lines: DataFrame) -> DataFrame:
    """``KEY, kind``: furniture, hyphen and misread lines among the scanned ones."""
    m = cut(marked(lines))
    vocab = cut(vocabulary(m))
    br = cut(breaks(m, vocab))
    furniture = m.where("is_ocr AND furniture").select(*KEY, F.lit("furniture").alias("kind"))
    hyphen = br.where("is_break").select(*KEY, F.lit("hyphen").alias("kind"))
    # The two words at a line's hyphen are judged with their break: as one if it is one, else each by itself.
    hangs = F.rtrim("text").rlike(ENDS) & F.col("next_word").isNotNull()
    inner = F.slice("words", F.when(F.col("goes_on"), 2).otherwise(1), F.greatest(F.lit(0), F.size("words") - F.col("goes_on").cast("int") - hangs.cast("int")))
    plain = m.where("is_ocr AND NOT furniture").select(*KEY, F.explode(inner).alias("t")).select(*KEY, _open(F.col("t")).alias("word"))
    here, there = [F.col(k) for k in KEY], [F.col("doc_id"), F.col("next_page").alias("page_number"), F.col("next_line").alias("line_no")]
    apart = br.where("NOT is_break")
    apart = apart.select(*here, _open(_word(F.col("tail"))).alias("word")).unionByName(apart.select(*there, _open(_word(F.col("head"))).alias("word")))
    words = plain.unionByName(apart).where("word <> ''")
    joined = br.where("is_break").select(*KEY, "next_page", "next_line", "left", "right", F.col("joined").alias("word"))
    counts = words.select("word").unionByName(joined.select("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    judged = cut(doubtful(counts, vocab))
    total = judged.agg(F.sum("c").alias("total"))
    frequent = judged.where(F.length("word") <= SHORT).join(F.broadcast(total), F.col("c") * FREQUENT >= F.col("total")).select("word", "bad")
    settled = words.join(F.broadcast(frequent), "word", "left")
    bad = judged.where("bad").select("word", "original")
    in_line = settled.where("bad").select(*KEY).unionByName(settled.where("bad IS NULL").select(*KEY, "word").join(bad.select("word"), "word", "left_semi").select(*KEY))
    strange = lambda c: _word(F.col(c)).rlike(f"[{NOISE}@]|\\p{{L}}\\d|\\d\\p{{L}}|\\p{{L}}[!(]\\p{{L}}|^[!(]\\p{{L}}")
    parts = br.where("is_break")
    odd = parts.where(strange("tail")).select(*here).unionByName(parts.where(strange("head")).select(*there))
    # Of a misread broken word, the part that differs from the original.
    jb = joined.join(bad.where("original IS NOT NULL"), "word")
    at_left, at_right = ~F.startswith("original", "left"), F.startswith("original", "left") & ~F.endswith("original", "right")
    differing = jb.where(at_left).select(*here).unionByName(jb.where(at_right).select(*there))
    misread = in_line.unionByName(odd).unionByName(differing).distinct().withColumn("kind", F.lit("misread"))
    return furniture.unionByName(hyphen).unionByName(misread)


def repaired(lines: DataFrame) -> DataFrame:
    """``(doc_id, content)``: each document's scanned text as paragraphs, without furniture, with broken words joined and misread words replaced where their original is known."""
    m = cut(marked(lines, geometry=True))
    vocab = cut(vocabulary(m))
    br = breaks(m, vocab).where("is_break").select(*KEY, F.lit(True).alias("brk"))
    body = m.where("is_ocr AND NOT furniture")
    left = body.groupBy("doc_id", "page_number").agg(F.percentile_approx("x", 0.4).alias("left"))
    toks = body.join(left, ["doc_id", "page_number"]).select(*KEY, ((F.col("x") - F.col("left")) > F.col("page_width") * 0.01).alias("starts"), F.posexplode(F.split(F.trim("text"), r"\s+")).alias("i", "t"))
    toks = toks.withColumn("word", F.lower(_core(F.col("t"))))
    bad = doubtful(toks.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("c")), vocab).where("bad AND original IS NOT NULL").select("word", "original")
    case = lambda o: F.when(F.col("t").rlike(r"^\P{L}*\p{Lu}"), F.initcap(o)).otherwise(o)
    fixed = toks.join(bad, "word", "left").withColumn("t", F.when(F.col("original").isNotNull(), F.concat(F.regexp_extract("t", r"^([\"'«“\[]*)", 1), case(F.col("original")), F.regexp_extract("t", r"([\"'»”\].,;:?)]*)$", 1))).otherwise(F.col("t")))
    text = fixed.groupBy(*KEY, "starts").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]), " ").alias("t"))
    piece = text.join(br, KEY, "left").select(*KEY, F.concat(F.when(F.col("starts"), F.lit("\n\n")).otherwise(F.lit("")), F.when(F.col("brk"), F.regexp_replace("t", f"{_HY}\\s*$", "")).otherwise(F.concat("t", F.lit(" ")))).alias("t"))
    page = piece.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "t"))), lambda s: s["t"]), "").alias("t"))
    doc = page.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "t"))), lambda s: s["t"]), "").alias("c"))
    return doc.select("doc_id", F.regexp_replace(F.trim("c"), r" *\n\n", "\n\n").alias("content"))
