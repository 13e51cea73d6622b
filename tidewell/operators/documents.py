"""Document structure by windows over lines: boilerplate, wrapped lines, headings, key-value areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.chunking import merge_udf, pack_udf
from tidewell.functions.text import caption_or_placeholder, normalize_text, strip
from tidewell.operators.bullets import bullet_summary

# What bullets, plain headings, ends of sentences and fences look like.
BULLET = r"^\s*(?:[-*+•·]|[0-9]+[.)、]|[（(][0-9]+[)）])\s+"
PLAIN_HEADING = r"^\s*(?:第\s*[0-9一二三四五六七八九十百千]+\s*[章节条篇部分]|[0-9]+(?:\.[0-9]+){1,3}(?=[\s、．.]|$)|[一二三四五六七八九十]+\s*[、．.])"
STOPS = "。！？!?；;：:”」』）)"
FENCE = r"^\s*(`{3,}|~{3,})"


def lines_of(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line), line ends of any kind."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n|\r", "\n"), "\n")
    return documents.select("doc_id", F.posexplode(lines).alias("line_no", "line"))


def page_boilerplate(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines without running heads and feet, (doc_id, boilerplate)). Lines: (doc_id, page, line_no, line).

    The first two lines of a page, and the last two where it has more than four, are compared over pages
    without blanks and with digits as '#'; what stands on enough pages goes, at page edges only."""
    rows = lines.withColumn("line", strip("line")).filter(F.col("line") != "")
    page = Window.partitionBy("doc_id", "page")
    rows = rows.withColumn("n", F.row_number().over(page.orderBy("line_no")) - 1).withColumn("size", F.count("*").over(page))
    norm = F.regexp_replace(F.regexp_replace("line", r"(?U)\s+", ""), r"(?U)\d+", "#")
    rows = rows.withColumn("norm", norm)
    edge = (F.col("n") < 2) | (F.col("n") >= F.col("size") - 2)
    asked = (F.col("n") < 2) | ((F.col("size") > 4) & (F.col("n") >= F.col("size") - 2))
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    need = F.when(F.col("pages") <= 2, 2).otherwise(F.greatest(F.lit(3), F.floor((F.col("pages") * 3 + 4) / 5)))
    seen = rows.filter(asked & F.col("norm").isNotNull() & (F.length("norm") <= 60)).groupBy("doc_id", "norm").agg(F.countDistinct("page").alias("times"))
    boiler = seen.join(pages, "doc_id").filter(F.col("times") >= need).select("doc_id", "norm")
    kept = rows.join(boiler.withColumn("gone", F.lit(True)), ["doc_id", "norm"], "left").filter(F.col("gone").isNull() | ~edge)
    return kept.select("doc_id", "page", "line_no", "line"), boiler


def _is_cjk(c: Column) -> Column:
    return c.rlike("^[一-鿿　-〿]$")


def join_wrapped_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, line) with lines joined that were broken by the page's width.

    A line joins the one before if that is not ended by a stop mark and this is no bullet or heading, and
    the text so far reaches 85 % of the widest line. That length test is a running one, but once a joined
    text is long enough it stays so: a run of joinable lines joins from the first long line on."""
    page = Window.partitionBy("doc_id", "page")
    order = page.orderBy("line_no")
    rows = lines.withColumn("limit", F.floor(F.max(F.length("line")).over(page) * 0.85))
    before = F.lag("line").over(order)
    ok = before.isNotNull() & (before != "") & (F.col("line") != "") & ~F.substring(before, -1, 1).isin(*STOPS) & ~F.col("line").rlike(BULLET) & ~F.col("line").rlike(PLAIN_HEADING)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("before", before)
    rows = rows.withColumn("run", F.sum((~F.col("ok")).cast("int")).over(order))
    long_before = F.max((F.length("before") >= F.col("limit")) & F.col("ok")).over(Window.partitionBy("doc_id", "page", "run").orderBy("line_no"))
    rows = rows.withColumn("joins", F.col("ok") & F.coalesce(long_before, F.lit(False)))
    rows = rows.withColumn("text_no", F.sum((~F.col("joins")).cast("int")).over(order))
    close = _is_cjk(F.substring("before", -1, 1)) | _is_cjk(F.substring("line", 1, 1))
    part = F.when(F.col("joins"), F.concat(F.when(close, "").otherwise(" "), F.col("line"))).otherwise(F.col("line"))
    parts = rows.withColumn("part", part).groupBy("doc_id", "page", "text_no").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "part"))).alias("parts"))
    return parts.select("doc_id", "page", "line_no", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("line"))


def _plain_level(line: Column) -> Column:
    dots = F.regexp_extract(line, r"^\s*([0-9]+(?:\.[0-9]+)*)", 1)
    head = F.substring(line, 1, 6)
    depth = (
        F.when(dots != "", F.least(F.lit(4), F.length(dots) - F.length(F.replace(dots, F.lit("."), F.lit(""))) + 1))
        .when(line.startswith("第") & head.rlike("[章篇]"), 1)
        .when(line.startswith("第") & head.rlike("[节条]"), 2)
        .otherwise(3)
    )
    rest = strip(F.regexp_replace(line, PLAIN_HEADING, ""))
    good = (line != "") & (F.length(line) <= 40) & ~F.substring(line, -1, 1).isin(*STOPS) & line.rlike(PLAIN_HEADING) & ((rest != "") | (F.length(line) <= 12))
    return F.when(good, depth)


def heading_levels(lines: DataFrame, markdown: bool = True) -> DataFrame:
    """Lines with ``level`` and ``title`` where they are headings (Markdown '#', underlined by the very next
    line, or plain numbered ones), ``fenced`` inside code, ``under`` for an underline itself."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    text = strip("line")
    if not markdown:
        return lines.withColumns({"level": _plain_level(text), "title": F.when(_plain_level(text).isNotNull(), text), "fenced": F.lit(False), "under": F.lit(False)})
    fence = F.col("line").rlike(FENCE)
    rows = lines.withColumn("fences", F.sum(fence.cast("int")).over(order)).withColumn("fenced", fence | (F.col("fences") % 2 == 1))
    after = F.lead("line").over(order)
    marks = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    atx = ~F.col("fenced") & (marks != "")
    plain = ~F.col("fenced") & (text != "") & ~atx & ~F.col("line").rlike(r"^\s*\||" + BULLET)
    under = F.when(plain & after.rlike(r"^=+\s*$"), 1).when(plain & after.rlike(r"^-{2,}\s*$"), 2)
    rows = rows.withColumn("level", F.when(atx, F.length(marks)).otherwise(under))
    title = F.when(atx, F.regexp_replace(F.regexp_replace("line", r"^#{1,6}\s+", ""), r"\s*#*\s*$", "")).when(under.isNotNull(), text)
    rows = rows.withColumn("title", title)
    was = F.lag(F.col("level").isNotNull() & ~F.col("line").startswith("#")).over(order)
    return rows.withColumn("under", F.coalesce(was & F.col("line").rlike(r"^(=+|-{2,})\s*$"), F.lit(False))).drop("fences")


def heading_paths(rows: DataFrame, levels: int = 6) -> DataFrame:
    """``rows`` (with level, title) with ``path``: the headings open at each line, outermost first. For each
    level the last heading counts if it stands after the last heading above it: a window per level over one
    sort, no stack."""
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    above = F.lit(-1)
    for k in range(1, levels + 1):
        own = F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(upto)
        parts.append(F.when(own["line_no"] > above, own["title"]))
        above = F.greatest(above, F.coalesce(own["line_no"], F.lit(-1)))
    return rows.withColumn("path", F.array_compact(F.array(*parts)))


def structure_blocks(documents: DataFrame, markdown: bool = True) -> DataFrame:
    """(doc_id, block_no, path, title, body, atomic): body lines under their headings; code fences, images
    and table rows stand alone."""
    rows = heading_paths(heading_levels(lines_of(documents), markdown))
    image = F.regexp_extract("line", r"^!\[([^\]]*)\]\([^)]*\)", 1)
    is_image = ~F.col("fenced") & F.col("line").rlike(r"^!\[[^\]]*\]\([^)]*\)")
    is_row = ~F.col("fenced") & F.col("line").rlike(r"^\s*\|.*\|\s*$")
    if not markdown:
        is_image, is_row = F.lit(False), F.lit(False)
    kind = F.when(F.col("level").isNotNull() | F.col("under"), "heading").when(F.col("fenced"), "code").when(is_image, "image").when(is_row, "table").when(strip("line") == "", "blank").otherwise("text")
    rows = rows.withColumn("kind", kind).withColumn("line", F.when(F.col("kind") == "image", caption_or_placeholder(image)).otherwise(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    opens = (F.col("kind") != F.lag("kind", 1, "").over(order)) | F.col("kind").isin("image", "table", "heading")
    rows = rows.withColumn("block_no", F.sum(opens.cast("int")).over(order)).filter(~F.col("kind").isin("blank", "heading"))
    blocks = rows.groupBy("doc_id", "block_no").agg(F.min("kind").alias("kind"), F.first("path").alias("path"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return blocks.select("doc_id", "block_no", "path", F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("")).alias("title"), body.alias("body"), (F.col("kind") != "text").alias("atomic"))


def render_blocks(blocks: DataFrame, max_chars: int = 600, min_merge: int = 120, depth: int = 4) -> DataFrame:
    """(doc_id, seq, text): blocks of each document merged and put under their path."""
    own = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "path", "title", "body", "atomic"))).alias("blocks"))  # one document
    return own.select("doc_id", F.posexplode(merge_udf(max_chars, min_merge, depth)("blocks")).alias("seq", "text"))


#: Letters of a key (fixed value).
KEY_CHARS = r"^[一-鿿A-Za-z0-9（）()\-－/／·～~．.]+$"


def _key_ok(key: Column) -> Column:
    return F.length(key).between(2, 14) & key.rlike(KEY_CHARS) & ~key.rlike(r"^\d+$") & (key.rlike("[一-鿿]") | (F.length(key) >= 3))


def kv_pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, key, value) of 'key value' lines; a key broken over two lines is put together."""
    bare = F.regexp_replace(strip("line"), r"^[•·\-–—*]\s*", "")
    rows = lines.withColumn("bare", bare)
    key, value = F.regexp_extract("bare", r"(?U)^(\S+)\s+(.+)$", 1), strip(F.regexp_extract("bare", r"(?U)^(\S+)\s+(.+)$", 2))
    good = _key_ok(key) & (value != "") & (F.length(value) <= 40) & ~value.rlike("[。！？；，、：:]")
    rows = rows.withColumns({"key": F.when(good, key), "value": F.when(good, value)})
    order = Window.partitionBy("doc_id").orderBy("line_no")
    whole = F.concat("bare", F.lead("key").over(order))
    broken = F.col("key").isNull() & _key_ok(F.col("bare")) & F.lead("key").over(order).isNotNull() & (F.length(whole) <= 16) & F.regexp_replace(whole, KEY_CHARS, "").eqNullSafe("")
    rows = rows.withColumn("broken", F.coalesce(broken, F.lit(False)))
    rows = rows.withColumns({"k": F.when(F.col("broken"), whole).otherwise(F.col("key")), "v": F.when(F.col("broken"), F.lead("value").over(order)).otherwise(F.col("value")), "taken": F.coalesce(F.lag("broken").over(order), F.lit(False))})
    return rows.filter(F.col("k").isNotNull() & ~F.col("taken")).select("doc_id", "line_no", F.col("k").alias("key"), F.col("v").alias("value"))


def kv_dense_segments(lines: DataFrame, near: int = 5, least: int = 2, gap: int = 3) -> DataFrame:
    """Key-value lines with at least ``least`` others within ``near`` lines, numbered by segment; more than
    ``gap`` lines between neighbours open a new one."""
    around = Window.partitionBy("doc_id").orderBy("line_no").rangeBetween(-near, near)
    order = Window.partitionBy("doc_id").orderBy("line_no")
    kept = kv_pairs(lines).withColumn("near", F.count("*").over(around) - 1).filter(F.col("near") >= least).drop("near")
    opens = F.coalesce(F.col("line_no") - F.lag("line_no").over(order) > gap, F.lit(True))
    return kept.withColumn("segment", F.sum(opens.cast("int")).over(order))


def kv_param_summary(documents: DataFrame, size: int = 600, least: int = 5) -> DataFrame:
    """(doc_id, segment, text) '【参数对照】' blocks of segments with at least ``least`` new keys; keys of
    earlier segments are not new, also of too short ones."""
    rows = kv_dense_segments(lines_of(documents))
    rows = rows.withColumn("first", F.min("segment").over(Window.partitionBy("doc_id", "key"))).filter(F.col("segment") == F.col("first"))
    own = rows.groupBy("doc_id", "segment").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line_no", F.concat("key", F.lit("："), "value", F.lit("；")).alias("item")))).alias("items"))
    own = own.filter(F.col("n") >= least).join(documents.select("doc_id", "filename"), "doc_id")
    header = F.concat(F.lit("【参数对照】《"), "filename", F.lit("》"))
    return own.select("doc_id", "segment", F.explode(pack_udf(size)(header, F.transform("items", lambda x: x["item"]))).alias("text"))


#: A hotline with its label, a website, words and limits of first use.
HOTLINE = r"((?:售后|服务|客服)(?:服务)?(?:热线|电话|中心))[：:]?\s*(4\d{2}[-\s]?\d{3}[-\s]?\d{4}|\d{3,4}[-\s]?\d{7,8})"
WEBSITE = r"(www\.[A-Za-z0-9.\-]+)"
FIRST_USE = r"首次使用|使用前|防护栏|流苏边|收纳好|整理出[^。]*清扫空间"
FIRST_USE_TRIM = r"使用前|首次使用|收纳好|整理出"


def _blocks(documents: DataFrame) -> DataFrame:
    """Documents are blocks (doc_id, seq, text) of one name; without ``seq`` each is one block."""
    return documents if "seq" in documents.columns else documents.withColumn("seq", F.lit(0))


def service_summary(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the first hotline (with its label), website (on a line that says so) and line about the
    online service of each document (doc_id, filename, text, perhaps seq) as one block."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n|\r", "\n"), "\n")
    rows = _blocks(documents).select("doc_id", "seq", F.posexplode(lines).alias("line_no", "line")).withColumn("line", strip("line"))
    label, number = F.regexp_extract("line", HOTLINE, 1), F.regexp_replace(F.regexp_extract("line", HOTLINE, 2), r"\s+", "")
    phone = F.when(number != "", F.concat(label, F.lit("："), number))
    site = F.when(F.col("line").contains("官网"), F.regexp_replace(F.regexp_extract("line", WEBSITE, 1), r"\.+$", ""))
    chat = F.when(F.col("line").contains("微信") & F.col("line").contains("在线客服"), F.col("line"))
    first = lambda c: F.min(F.when(c != "", F.struct("seq", "line_no", c.alias("t"))))["t"]
    found = rows.groupBy("doc_id").agg(first(phone).alias("phone"), first(site).alias("site"), first(chat).alias("chat"))
    found = found.filter(F.coalesce("phone", "site", "chat").isNotNull()).join(documents.select("doc_id", "filename").distinct(), "doc_id")
    parts = F.concat_ws("；", F.col("phone"), F.concat(F.lit("官网："), "site"), F.col("chat"))
    return found.select("doc_id", F.concat(F.lit("【售后服务】《"), "filename", F.lit("》"), parts).alias("text"))


def first_use_summary(documents: DataFrame, least: int = 2, limit: int = 8) -> DataFrame:
    """(doc_id, text): sentences about first use, of 12 to 120 characters without blanks, from the word on that
    says so, the first eight; summary blocks are skipped, all repeats dropped."""
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), "(?<=[。；])")
    rows = _blocks(documents).filter(~F.col("text").startswith("【")).select("doc_id", "filename", "seq", F.posexplode(parts).alias("n", "sentence"))
    rows = rows.withColumn("sentence", F.regexp_replace("sentence", r"(?U)\s+", ""))
    rows = rows.filter(F.length("sentence").between(12, 120) & F.col("sentence").rlike(FIRST_USE))
    trimmed = F.regexp_extract("sentence", f"((?:{FIRST_USE_TRIM}).*)$", 1)
    rows = rows.withColumn("sentence", F.when(trimmed != "", trimmed).otherwise(F.col("sentence"))).filter(F.length("sentence") >= 12)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "sentence").orderBy("seq", "n"))).filter("k = 1")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "n"))).filter(F.col("k") <= limit)
    own = rows.groupBy("doc_id", "filename").agg(F.array_sort(F.collect_list(F.struct("k", "sentence"))).alias("s")).filter(F.size("s") >= least)
    return own.select("doc_id", F.concat(F.lit("【首次使用要点】《"), "filename", F.lit("》"), F.array_join(F.transform("s", lambda x: x["sentence"]), "；")).alias("text"))


def prepare_document(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, text): derived blocks (overview and quick scan, attributes, parameters, bullets, service, first use)
    before the document's own blocks (doc_id, seq, text), all normalised."""
    from tidewell.operators.sheets import attribute_blocks, overview_blocks

    names = documents.select("doc_id", "filename")
    blocks = blocks.withColumn("text", normalize_text("text")).filter(F.col("text") != "")
    named = blocks.join(documents.select("doc_id", "filename"), "doc_id")
    whole = named.groupBy("doc_id", "filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    order = Window.partitionBy("doc_id").orderBy("pos", "piece")
    attributes = attribute_blocks(blocks, names).withColumn("at", F.row_number().over(order))
    parts = [(overview_blocks(blocks, names), "n", 0), (attributes, "at", 1), (kv_param_summary(whole), "segment", 2), (bullet_summary(named), "run", 3), (service_summary(named), None, 4), (first_use_summary(named), None, 5)]
    rows = blocks.select("doc_id", F.lit(9).alias("part"), F.col("seq").cast("long").alias("at"), "text")
    for frame, at, part in parts:
        rows = rows.union(frame.select("doc_id", F.lit(part), (F.col(at) if at else F.lit(0)).cast("long"), "text"))
    order = Window.partitionBy("doc_id").orderBy("part", "at", "text")
    return rows.filter(F.col("text") != "").select("doc_id", (F.row_number().over(order) - 1).alias("seq"), "text")


def apply_descriptions(texts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(doc_id, text): image placeholders replaced in order by the descriptions (doc_id, seq, page,
    description) where there are as many; else the descriptions are appended with page and number."""
    mark = "【图】文档此处有一张图片，图中内容无法提取"
    own = descriptions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "page", "description"))).alias("d"))
    rows = texts.join(own, "doc_id", "left")
    pieces = F.split(F.col("text"), mark)
    count = F.size(pieces) - 1
    filled = F.array_join(F.zip_with(pieces, F.col("d"), lambda p, d: F.concat(p, F.coalesce(F.concat(F.lit("【图】"), d["description"]), F.lit("")))), "")
    extra = F.array_join(F.transform("d", lambda d: F.format_string("【图】(page %d, no. %d) %s", d["page"].cast("int"), d["seq"].cast("int"), d["description"])), "\n")
    return rows.select("doc_id", F.when(F.col("d").isNull(), F.col("text")).when(count == F.size("d"), filled).otherwise(F.concat_ws("\n", "text", extra)).alias("text"))


def dedupe_images(images: DataFrame, least_bytes: int = 2048, least_side: int = 64) -> DataFrame:
    """Images (doc_id, seq, content, width, height) without repeats, small files and small sides, numbered
    anew per document; an unknown side doesn't count against an image."""
    digest = F.sha1("content")
    rows = images.withColumn("digest", digest).filter((F.octet_length("content") >= least_bytes) & (F.coalesce(F.least("width", "height"), F.lit(least_side)) >= least_side))
    first = Window.partitionBy("doc_id", "digest").orderBy("seq")
    rows = rows.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")))


def reindex_document(chunks: DataFrame, size: int = 600, overlap: int = 100) -> DataFrame:
    """Chunks of each document in order, as atomic blocks again."""
    from tidewell.functions.chunking import chunk_blocks_udf

    own = chunks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("blocks"))
    return own.select("doc_id", F.posexplode(chunk_blocks_udf(size, overlap)("blocks")).alias("seq", "text"))
