"""Sheets as cell tables (sheet_id, row_no, col_no, value): grids, fill-down, layout, records, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.chunking import pack_udf
from tidewell.functions.text import cell_type, field_alias, is_blank, parse_record_block, strip
from tidewell.sources.shared import stored

#: Words of field names and the look of entity names (fixed values).
FIELD_WORDS = (
    "model", "型号", "chipset", "芯片", "flash", "ram", "内存", "存储", "weight", "重量", "毛重", "净重", "size", "尺寸", "长度", "宽度", "高度", "price", "价格", "单价", "金额",
    "总价", "成本", "ports", "端口", "frequency", "频率", "power", "功率", "poe", "电压", "rate", "速率", "distance", "距离", "antenna", "天线", "packing", "包装",
    "accessory", "配件", "ctn", "net", "gross", "display", "led", "switch", "材质", "颜色", "品牌", "日期", "时间", "状态", "备注", "说明", "名称", "编号", "货号", "订单",
    "类型", "简介", "数量", "库存", "单位", "规格", "适用范围", "参数", "地址", "电话", "客户", "城市", "区域", "省份", "负责人", "sku", "ean", "barcode", "stock", "qty", "unit",
    "color", "brand", "type", "name", "date", "status", "remark", "note", "desc",
)
MODEL = r"^[A-Za-z]{1,8}[-_ ]?\d{1,}[A-Za-z0-9]*$"


def ffill_first_col(cells: DataFrame, rate: float = 0.3) -> DataFrame:
    """First columns with at least ``rate`` blank cells are filled down with the last value above."""
    first, blank = F.col("col_no") == 0, is_blank("value")
    share = F.avg(F.when(first, blank.cast("double"))).over(Window.partitionBy("sheet_id"))
    upto = Window.partitionBy("sheet_id").orderBy("row_no", "col_no").rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(first & ~blank, F.col("value")), ignorenulls=True).over(upto)
    rows = cells.withColumns({"share": share, "above": above})
    value = F.when(first & blank & (F.col("share") >= rate), F.coalesce("above", "value")).otherwise(F.col("value"))
    return rows.withColumn("value", value).select(*cells.columns)


def split_grids(cells: DataFrame, least_rows: int = 2, least_cols: int = 2, least_cells: int = 2) -> DataFrame:
    """Cells with ``grid_no``: a sheet is cut at blank rows, each band at blank columns; rows of fewer than
    ``least_cells`` cells and grids that are too small go."""
    full = cells.filter(~is_blank("value"))
    bands = full.select("sheet_id", "row_no").distinct()
    by_row = Window.partitionBy("sheet_id").orderBy("row_no")
    bands = bands.withColumn("band", F.sum(F.coalesce(F.col("row_no") - F.lag("row_no").over(by_row) > 1, F.lit(True)).cast("int")).over(by_row))
    rows = full.join(bands, ["sheet_id", "row_no"])
    cols = rows.select("sheet_id", "band", "col_no").distinct()
    by_col = Window.partitionBy("sheet_id", "band").orderBy("col_no")
    cols = cols.withColumn("part", F.sum(F.coalesce(F.col("col_no") - F.lag("col_no").over(by_col) > 1, F.lit(True)).cast("int")).over(by_col))
    rows = rows.join(cols, ["sheet_id", "band", "col_no"])
    rows = rows.withColumn("cells", F.count("*").over(Window.partitionBy("sheet_id", "band", "part", "row_no"))).filter(F.col("cells") >= least_cells)
    grid = Window.partitionBy("sheet_id", "band", "part")
    rows = rows.withColumns({"r": F.size(F.collect_set("row_no").over(grid)), "c": F.size(F.collect_set("col_no").over(grid))}).filter((F.col("r") >= least_rows) & (F.col("c") >= least_cols))
    return rows.withColumn("grid_no", F.dense_rank().over(Window.partitionBy("sheet_id").orderBy("band", "part"))).select("sheet_id", "grid_no", "row_no", "col_no", "value")


def _purity(cells: DataFrame, *keys: str) -> DataFrame:
    """Share of the commonest type among the cells of a row or column (0 where all are blank)."""
    counted = cells.groupBy(*keys, "type").agg(F.count("*").alias("n"))
    typed = F.col("type").isNotNull()
    return counted.groupBy(*keys).agg(F.coalesce(F.max(F.when(typed, F.col("n"))) / F.sum(F.when(typed, F.col("n"))), F.lit(0.0)).alias("purity"))


def _fieldness(values: DataFrame) -> DataFrame:
    """(sheet_id, f): how much a set of values looks like field names, 0 to 1."""
    v = strip("value")
    words = F.exists(F.array(*map(F.lit, FIELD_WORDS)), lambda w: F.contains(F.lower(v), w))
    rows = values.filter(~is_blank("value")).groupBy("sheet_id").agg(
        F.avg(words.cast("double")).alias("kw"), F.avg((F.length(v) <= 10).cast("double")).alias("short"), (F.countDistinct(v) / F.count("*")).alias("uniq"), F.avg(v.rlike(MODEL).cast("double")).alias("model")
    )
    raw = 1.2 * F.col("kw") + 0.5 * F.col("short") + 0.3 * F.col("uniq") - 0.8 * F.col("model")
    return rows.select("sheet_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("f"))


def header_rows(cells: DataFrame, ratio: float = 0.8, scan: int = 4) -> DataFrame:
    """(sheet_id, header_row): the first of the top rows that is nearly as full as the fullest."""
    fills = cells.groupBy("sheet_id", "row_no").agg(F.count_if(~is_blank("value")).alias("fill"))
    sheet = Window.partitionBy("sheet_id")
    rows = fills.withColumns({"most": F.max("fill").over(sheet), "nth": F.row_number().over(sheet.orderBy("row_no"))})
    good = (F.col("nth") <= scan) & (F.col("fill") >= ratio * F.col("most"))
    return rows.groupBy("sheet_id").agg(F.coalesce(F.min(F.when(good, F.col("row_no"))), F.min("row_no")).alias("header_row"))


def table_profile(cells: DataFrame) -> DataFrame:
    """(sheet_id, row_h, col_h, f_header, f_col0, score, kind): type purity of rows and columns, and which of
    header row and first column looks more like field names. Sheets under 2 x 2 are flat."""
    head = header_rows(cells)
    typed = cells.withColumn("type", cell_type("value")).join(head, "sheet_id")
    data = typed.filter(F.col("row_no") > F.col("header_row"))
    body = data.filter("col_no > 0")
    row_h = _purity(body, "sheet_id", "row_no").groupBy("sheet_id").agg(F.avg("purity").alias("row_h"))
    col_h = _purity(body, "sheet_id", "col_no").groupBy("sheet_id").agg(F.avg("purity").alias("col_h"))
    f_header = _fieldness(typed.filter((F.col("row_no") == F.col("header_row")) & (F.col("col_no") > 0))).withColumnRenamed("f", "f_header")
    f_col0 = _fieldness(data.filter("col_no = 0")).withColumnRenamed("f", "f_col0")
    size = cells.groupBy("sheet_id").agg(F.countDistinct("row_no").alias("rows"), F.countDistinct("col_no").alias("cols"))
    out = size
    for part in (row_h, col_h, f_header, f_col0):
        out = out.join(part, "sheet_id", "left")
    out = out.na.fill(0.0, ["row_h", "col_h", "f_header", "f_col0"])
    delta = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("row_h") - F.col("col_h")) / 0.4))
    out = out.withColumn("score", 1.5 * (F.col("f_col0") - F.col("f_header")) + 0.4 * delta)
    kind = F.when((F.col("rows") < 2) | (F.col("cols") < 2), "flat").when(F.col("score") >= 0.5, "transposed").when(F.col("score") <= -0.5, "row_wise").otherwise("unknown")
    return out.select("sheet_id", *[F.round(c, 3).alias(c) for c in ("row_h", "col_h", "f_header", "f_col0", "score")], kind.alias("kind"))


def header_template_columns(cells: DataFrame, first: int | str | Column, last: int | str | Column) -> DataFrame:
    """(sheet_id, col_no, name): rows ``first`` to ``last`` of each column joined by ' > ', repeats once; a
    blank name is the column's number. The bounds are numbers, or columns where each sheet has its own."""
    rows = cells.filter(F.col("row_no").between(first, last))
    parts = F.array_sort(F.collect_list(F.when(~is_blank("value"), F.struct("row_no", strip("value").alias("t")))))
    named = rows.groupBy("sheet_id", "col_no").agg(F.array_join(F.array_distinct(F.transform(parts, lambda x: x["t"])), " > ").alias("name"))
    return named.withColumn("name", F.when(F.col("name") == "", F.concat(F.lit("列"), F.col("col_no") + 1)).otherwise(F.col("name")))


def dense_cells(cells: DataFrame) -> DataFrame:
    """Cells whose rows and columns are numbered from 0 without gaps: those without any value go. One shuffle by sheet."""
    rows = cells.select("sheet_id", "row_no", "col_no", "value").repartition("sheet_id")
    for at in ("row_no", "col_no"):
        told = F.max(~is_blank("value")).over(Window.partitionBy("sheet_id", at))
        rows = rows.withColumn("told", told).filter("told").withColumn(at, F.dense_rank().over(Window.partitionBy("sheet_id").orderBy(at)) - 1)
    return rows.drop("told")


#: Rows that may name the entities of a transposed sheet, the share of different values under which the row above
#: them groups them, and the mean length of names (fixed values).
ENTITY_ROWS, GROUP_SHARE, NAME_LENGTH = 3, 0.6, 12


def sheet_layouts(cells: DataFrame) -> DataFrame:
    """(sheet_id, kind, first_row, last_row, repeats) of dense cells: the kind of ``table_profile``, the rows that
    name fields (of a transposed sheet: entities), and the share of repeated names in the last of them.

    A row-wise sheet's names stand in its header row, with the row above it as their groups where that has values.
    A transposed sheet's stand in the first of its top rows that looks most like names of models; the row above
    groups them where its values repeat. Data begin after ``last_row`` in either case."""
    v = strip("value")
    told = ~is_blank("value") & (F.col("col_no") > 0)
    n = F.count_if(told)
    share = F.count_if(told & v.rlike(MODEL)) / n
    differ = F.countDistinct(F.when(told, v)) / n
    short = (F.avg(F.when(told, F.length(v))) <= NAME_LENGTH).cast("double")
    rows = cells.groupBy("sheet_id", "row_no").agg(
        F.count_if(~is_blank("value")).alias("fill"), F.when(n > 0, differ).alias("differ"), F.when(n > 0, share + 0.3 * differ + 0.3 * short).otherwise(0.0).alias("like")
    )
    by_row = Window.partitionBy("sheet_id").orderBy("row_no")
    rows = rows.withColumns({"fill_above": F.lag("fill", 1, 0).over(by_row), "differ_above": F.lag("differ").over(by_row)})
    rows = rows.join(table_profile(cells).select("sheet_id", "kind"), "sheet_id").join(header_rows(cells), "sheet_id")
    across = F.col("kind") == "transposed"
    chosen = F.when(across, F.col("row_no") < ENTITY_ROWS).otherwise(F.col("row_no") == F.col("header_row"))
    grouped = F.when(across, F.coalesce(F.col("differ_above") < GROUP_SHARE, F.lit(False))).otherwise(F.col("fill_above") > 0)
    picked = F.max_by(F.struct("row_no", grouped.alias("grouped"), "differ"), F.struct("like", -F.col("row_no")))
    out = rows.filter(chosen).groupBy("sheet_id", "kind").agg(picked.alias("r"))
    return out.select("sheet_id", "kind", (F.col("r.row_no") - F.col("r.grouped").cast("int")).alias("first_row"), F.col("r.row_no").alias("last_row"), F.round(1 - F.coalesce("r.differ", F.lit(1.0)), 3).alias("repeats"))


def layout_records(cells: DataFrame) -> DataFrame:
    """(sheet_id, record_no, title, fields) of sheets of all kinds in one table, each read by its own layout: merged
    first columns are filled down, names may span rows, records are rows or, of transposed sheets, columns. Sheets
    of unknown kind are read by rows; flat ones (under two rows or columns) are text and give no records. Filled
    cells and layouts are written once, as many steps read them."""
    filled = stored(ffill_first_col(dense_cells(cells)), "cells")
    sheets = filled.join(stored(sheet_layouts(filled).filter("kind <> 'flat'"), "layouts"), "sheet_id")
    names = header_template_columns(sheets, F.col("first_row"), F.col("last_row"))
    across = F.col("kind") == "transposed"
    return sheet_records(sheets.filter(~across), names, F.col("last_row")).union(sheet_records(sheets.filter(across), names, F.col("last_row"), True))


_FIELDS = "array<struct<k:string,v:string>>"


def sheet_records(cells: DataFrame, names: DataFrame, header_row: int | Column = 0, transposed: bool = False) -> DataFrame:
    """(sheet_id, record_no, title, fields): a record per row, titled by its first value; or per column of a
    transposed sheet, fields of one name joined by '；'."""
    data = cells.filter((F.col("row_no") > header_row) & ~is_blank("value")).withColumn("value", strip("value"))
    ordered = lambda at: F.array_sort(F.collect_list(F.struct(F.col(at), F.col("k"), F.col("v"))))
    fields = lambda c: F.transform(c, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))
    if not transposed:
        rows = data.join(names, ["sheet_id", "col_no"]).select("sheet_id", "row_no", "col_no", F.col("name").alias("k"), F.col("value").alias("v"))
        own = rows.groupBy("sheet_id", "row_no").agg(ordered("col_no").alias("f"))
        return own.select("sheet_id", F.col("row_no").alias("record_no"), F.element_at("f", 1)["v"].alias("title"), fields("f").alias("fields"))
    keys = data.filter("col_no = 0").select("sheet_id", "row_no", F.col("value").alias("k"))
    rows = data.filter("col_no > 0").join(keys, ["sheet_id", "row_no"])
    once = rows.groupBy("sheet_id", "col_no", "k").agg(F.min("row_no").alias("row_no"), F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "value"))), lambda x: x["value"])), "；").alias("v"))
    own = once.groupBy("sheet_id", "col_no").agg(ordered("row_no").alias("f")).join(names, ["sheet_id", "col_no"], "left")
    return own.select("sheet_id", F.col("col_no").alias("record_no"), F.coalesce("name", F.concat(F.lit("第"), "col_no", F.lit("列"))).alias("title"), fields("f").alias("fields"))


def render_records(records: DataFrame, max_chars: int = 600, key_fields: int = 2) -> DataFrame:
    """(sheet_id, record_no, text) '【sheet】title：k: v；…'; a long record gives several pieces that repeat
    its first fields. No field is lost, also where one alone is too long."""
    head = F.concat(F.lit("【"), F.col("sheet_id").cast("string"), F.lit("】"), F.col("title"), F.lit("："))
    items = F.transform("fields", lambda x: F.concat(x["k"], F.lit(": "), x["v"], F.lit("；")))
    whole = F.concat(head, F.array_join(items, ""))
    keys = F.array_join(F.slice(items, 1, key_fields), "")
    rest = F.slice(items, key_fields + 1, F.greatest(F.size(items), F.lit(1)))
    long = (F.length(whole) > max_chars + 1) & (F.size(items) > key_fields)
    one = F.array(F.regexp_replace(whole, "；$", ""))
    many = pack_udf(max_chars)(F.concat(head, keys), rest)
    return records.select("sheet_id", "record_no", F.posexplode(F.when(long, many).otherwise(one)).alias("piece", "text"))


def leading_title(cells: DataFrame, most: int = 3, limit: int = 300) -> DataFrame:
    """(sheet_id, title): the one-cell rows before the data, at most three."""
    rows = cells.filter(~is_blank("value")).groupBy("sheet_id", "row_no").agg(F.count("*").alias("n"), F.min(strip("value")).alias("t"))
    start = rows.filter("n > 1").groupBy("sheet_id").agg(F.min("row_no").alias("start"))
    top = rows.join(start, "sheet_id").filter((F.col("n") == 1) & (F.col("row_no") < F.col("start")))
    own = top.groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "t"))).alias("t"))
    return own.select("sheet_id", F.substring(F.array_join(F.transform(F.slice("t", 1, most), lambda x: x["t"]), " "), 1, limit).alias("title"))


def document_overview(records: DataFrame, least: int = 5, limit: int = 500) -> DataFrame:
    """(doc_id, n_titles, names): the record titles of a document, distinct without regard to case in order of
    appearance; fewer than ``least`` give none. Records: (doc_id, pos, title)."""
    first = Window.partitionBy("doc_id", F.lower("title")).orderBy("pos")
    rows = records.withColumn("k", F.row_number().over(first)).filter("k = 1")
    own = rows.groupBy("doc_id").agg(F.count("*").alias("n_titles"), F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("t")).filter(F.col("n_titles") >= least)
    names = F.array_join(F.transform("t", lambda x: x["title"]), "、")
    return own.select("doc_id", "n_titles", F.when(F.length(names) > limit, F.concat(F.substring(names, 1, limit), F.lit("…"))).otherwise(names).alias("names"))


def attribute_gates(pairs: DataFrame, least: int = 5, average: float = 40.0) -> DataFrame:
    """(doc_id, field, n_titles, mean_length, n_values) of fields worth a summary: enough titles, short values
    that differ. Pairs: (doc_id, field, title, pos, value); of a title's repeated values the last counts."""
    last = pairs.groupBy("doc_id", "field", "title").agg(F.max_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    own = last.groupBy("doc_id", "field").agg(F.count("*").alias("n_titles"), F.avg(F.length("value")).alias("mean_length"), F.countDistinct("value").alias("n_values"))
    return own.filter((F.col("n_titles") >= least) & (F.col("mean_length") <= average) & (F.col("n_values") > 1))


def attribute_summary(pairs: DataFrame, filenames: DataFrame, size: int = 600) -> DataFrame:
    """(doc_id, field, pos, piece, text) '【属性对照】' blocks: every title's value of a field, in pieces with one header;
    ``pos`` is the field's first place."""
    last = pairs.groupBy("doc_id", "field", "title").agg(F.max_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    good = attribute_gates(pairs).select("doc_id", "field")
    own = last.join(good, ["doc_id", "field"]).groupBy("doc_id", "field").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", F.concat("title", F.lit(": "), "value", F.lit("；")).alias("item")))).alias("items")).join(filenames, "doc_id")
    alias = field_alias("field")
    label = F.when((alias != "") & (alias != F.col("field")), F.concat("field", F.lit("（"), alias, F.lit("）"))).otherwise(F.col("field"))
    header: Column = F.concat(F.lit("【属性对照】《"), "filename", F.lit("》"), label, F.lit("："))
    return own.select("doc_id", "field", "pos", F.posexplode(pack_udf(size)(header, F.transform("items", lambda x: x["item"]))).alias("piece", "text"))


#: Kinds of fields that tell records apart, and limits of the quick scan (fixed values).
TELLING = ("频率", "距离", "速率", "天线", "重量", "价格")
QUICK_VALUES, QUICK_LENGTH, QUICK_NAMES, LEAST_NAMES, NAMES_LENGTH = 3, 20, 40, 5, 500


def record_rows(blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, sheet, title, fields) of the blocks (doc_id, seq, text) that are records."""
    rows = blocks.select("doc_id", "seq", parse_record_block("text").alias("r"))
    return rows.filter(F.col("r").isNotNull()).select("doc_id", "seq", "r.*")


def _quick_values(fields: Column) -> Column:
    """The first three short values of fields that tell records apart, one for each alias."""

    def step(state: Column, f: Column) -> Column:
        alias = field_alias(f["k"])
        telling = F.exists(F.array(*map(F.lit, TELLING)), lambda t: F.contains(alias, t) | F.contains(t, alias))
        take = (F.size(state["values"]) < QUICK_VALUES) & (F.length(f["v"]) <= QUICK_LENGTH) & (alias != "") & ~F.array_contains(state["used"], alias) & telling
        return F.when(take, F.struct(F.concat(state["used"], F.array(alias)).alias("used"), F.concat(state["values"], F.array(f["v"])).alias("values"))).otherwise(state)

    none = F.array().cast("array<string>")
    return F.aggregate(fields, F.struct(none.alias("used"), none.alias("values")), step, lambda state: state["values"])


def overview_blocks(blocks: DataFrame, filenames: DataFrame) -> DataFrame:
    """(doc_id, n, text): '【文档概览】' (n 0) with the names of a document's records, first spellings in order, and for up to
    40 names '【条目速览】' (n 1) with up to three telling values of each. Fewer than five names give neither."""
    rows = record_rows(blocks)
    sheets = rows.groupBy("doc_id").agg(F.countDistinct("sheet").alias("n_sheets"), F.min("sheet").alias("sheet"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", F.lower("title")).orderBy("seq"))).filter("k = 1")
    entry = F.struct("seq", "title", _quick_values(F.col("fields")).alias("values"))
    own = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("e")).filter(F.size("e") >= LEAST_NAMES).join(sheets, "doc_id").join(filenames, "doc_id")
    names = F.array_join(F.transform("e", lambda x: x["title"]), "、")
    names = F.when(F.length(names) > NAMES_LENGTH, F.concat(F.substring(names, 1, NAMES_LENGTH), F.lit("…"))).otherwise(names)
    note = F.when(F.col("n_sheets") == 1, F.concat(F.lit("（工作表「"), "sheet", F.lit("」）"))).otherwise("")
    quick = F.array_join(F.transform(F.filter("e", lambda x: F.size(x["values"]) > 0), lambda x: F.concat(x["title"], F.lit(": "), F.array_join(x["values"], "/"))), "；")
    texts = F.array(
        F.concat(F.lit("【文档概览】《"), "filename", F.lit("》"), note, F.lit("共包含 "), F.size("e"), F.lit(" 个条目："), names),
        F.when((F.size("e") <= QUICK_NAMES) & (quick != ""), F.concat(F.lit("【条目速览】《"), "filename", F.lit("》各条目关键参数："), quick)),
    )
    return own.select("doc_id", F.posexplode(texts).alias("n", "text")).filter(F.col("text").isNotNull())


def attribute_blocks(blocks: DataFrame, filenames: DataFrame, size: int = 600) -> DataFrame:
    """``attribute_summary`` of the records among a document's blocks; blank values don't count."""
    pairs = record_rows(blocks).select("doc_id", "seq", "title", F.posexplode("fields").alias("at", "f"))
    pairs = pairs.select("doc_id", F.col("f.k").alias("field"), "title", (F.col("seq").cast("long") * (1 << 20) + F.col("at")).alias("pos"), F.col("f.v").alias("value"))
    return attribute_summary(pairs.filter("value <> ''"), filenames, size)
