"""Text functions as column expressions: everything stays inside generated code.

Patterns carry ``(?U)`` where Unicode classes are meant, since Java's default ones are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column | str) -> Column:
    """One kind of line end, runs of blanks to one space, at most one empty line in a row, stripped."""
    out = F.regexp_replace(F.coalesce(_c(c), F.lit("")), "\r\n|\r", "\n")
    out = F.regexp_replace(out, "[ \t　]{2,}", " ")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def normalize_ws(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.coalesce(_c(c), F.lit("")), "[ \t　]+", " "))


def strip_control_chars(c: Column | str) -> Column:
    """Without invisible control characters; tab and line ends stay."""
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def truncate(c: Column | str, limit: int, suffix: str = "…") -> Column:
    """At most ``limit`` characters, the suffix included."""
    text = F.coalesce(_c(c), F.lit(""))
    if limit <= 0:
        return text
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, max(0, limit - len(suffix))), F.lit(suffix)))


def slugify(c: Column | str) -> Column:
    """Lower-case letters, digits and CJK joined by '-'; where nothing is left, eight hex digits of a hash."""
    text = F.coalesce(_c(c), F.lit(""))
    slug = F.regexp_replace(F.regexp_replace(F.lower(strip(text)), "[^a-zA-Z0-9一-鿿]+", "-"), "^-+|-+$", "")
    return F.when(slug != "", slug).otherwise(F.substring(F.md5(text.cast("binary")), 1, 8))


def mask_secret(c: Column | str, keep: int = 4) -> Column:
    text = F.coalesce(_c(c), F.lit(""))
    masked = F.concat(F.substring(text, 1, keep), F.lit("*" * 8), F.expr("''") if keep == 0 else F.substring(text, -keep, keep))
    return F.when(F.length(text) <= 2 * keep, F.repeat(F.lit("*"), F.length(text))).otherwise(masked)


def count_chars(c: Column | str) -> Column:
    return F.length(F.coalesce(_c(c), F.lit("")))


def strip_meta(c: Column | str) -> Column:
    """Without leading 【…】 and 《…》 marks; a text that is nothing else stays."""
    text = F.coalesce(_c(c), F.lit(""))
    bare = F.regexp_replace(text, r"(?U)^(?:【[^】]{0,80}】|《[^》]{0,160}》|\s)+", "")
    return F.when(bare == "", text).otherwise(bare)


def split_sub_intents(c: Column | str, limit: int = 4) -> Column:
    """Distinct parts of at least two characters, split at sentence marks and connectives; the whole text
    where none is left."""
    text = F.coalesce(_c(c), F.lit(""))
    parts = F.filter(F.transform(F.split(text, "[。！？!?；;\n]+|(?:另外|还有|以及|然后|顺便)"), strip), lambda x: F.length(x) >= 2)
    found = F.array_distinct(parts)
    whole = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(strip(text)))
    return F.slice(F.when(F.size(found) > 0, found).otherwise(whole), 1, limit)


#: Ranges of scripts (fixed values).
SCRIPTS = {"cjk": "一-鿿", "kana": "぀-ヿ", "hangul": "가-힯", "cyrillic": "Ѐ-ӿ", "thai": "฀-๿", "latin": "a-zA-Z"}


def detect_language(c: Column | str) -> Column:
    text = F.coalesce(_c(c), F.lit(""))
    n = {k: F.regexp_count(text, F.lit(f"[{v}]")) for k, v in SCRIPTS.items()}
    total = reduce(lambda a, b: a + b, n.values())
    return (
        F.when(total == 0, "")
        .when(n["kana"] > 0, "ja")
        .when(n["hangul"] > 0, "ko")
        .when(n["thai"] > 0, "th")
        .when(n["cyrillic"] / total > 0.4, "ru")
        .when(n["cjk"] / total > 0.3, "zh-CN")
        .when(n["latin"] / total > 0.5, "en")
        .otherwise("")
    )


def confidence(score: Column | str) -> Column:
    """Similarity as 0..99: halves go to the even side."""
    s = _c(score)
    return F.when(s <= 0, 0).when(s >= 0.95, 99).otherwise(F.least(F.lit(99), F.greatest(F.lit(0), F.bround(s * 100, 0).cast("int")))).cast("int")


#: Wordings by which a reply says that it can't answer (fixed values).
REFUSALS = (
    r"查不(到|了|出来)",
    r"没(有)?查到",
    r"无法查询|查询不了|无法查(询|证|找|到)",
    r"没有(相关|对应|这部分|这块)?(资料|文档|信息|内容|记录)",
    r"未找到|没有找到",
    r"不在(我)?(这边|这里|这边范围|服务范围|职责范围|业务范围)",
    r"(超出|不在)我(的)?(服务|职责|业务|负责)?范围",
    r"无法(回答|作答|提供|确认|确定|判断)",
    r"不太(方便|清楚|能)(回答|作答|提供|确认)?",
    r"不清楚|不知道|没法(回答|确认|提供)",
    r"没有(依据|资料|信息)(可以|能)?(回答|确认|提供)",
    r"帮(不上|不了)(您|你)?(这个)?忙",
    r"建议您(咨询|联系)(人工|客服|工作人员)",
)


def is_refusal(c: Column | str) -> Column:
    text = F.coalesce(_c(c), F.lit(""))
    return (text == "") | text.rlike("|".join(f"(?:{p})" for p in REFUSALS))


def is_real_answer(c: Column | str) -> Column:
    text = strip(F.coalesce(_c(c), F.lit("")))
    return ~text.isin("", "NO_ANSWER") & ~is_refusal(text)


def embed_tokens(c: Column | str) -> Column:
    """Single CJK characters and runs of ASCII letters and digits, lower case; after a CJK character that
    is followed by another also the pair."""
    # Each character that another follows is written out as itself and its pair, apart: one pattern finds all.
    apart = F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), "([一-鿿])(?=([一-鿿]))", "$1 $1$2 ")
    return F.regexp_extract_all(apart, F.lit("([一-鿿]{1,2}|[a-z0-9]+)"), F.lit(1))


def estimate_tokens(c: Column | str) -> Column:
    text = F.coalesce(_c(c), F.lit(""))
    cjk = F.regexp_count(text, F.lit("[一-鿿]"))
    return F.when(text == "", 0).otherwise(cjk + F.greatest(F.lit(1), F.floor((F.length(text) - cjk) / 4).cast("int"))).cast("int")


# The variables of a template and how one is written.
VARIABLES = ("tenant.name", "visitor.id", "visitor.language", "channel", "now", "employee.name")
_VARIABLE = r"\{\{\s*([a-zA-Z0-9_\.]+)\s*\}\}"


def extract_variables(c: Column | str) -> Column:
    """Distinct variable names of a template, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(_VARIABLE), F.lit(1))))


def unknown_variables(c: Column | str) -> Column:
    return F.array_except(extract_variables(c), F.array(*map(F.lit, VARIABLES)))


def render_persona(c: Column | str, values: dict[str, Column], limit: int = 200) -> Column:
    """The template with known variables filled in (each cut to ``limit``), unknown ones as they are."""
    out = F.coalesce(_c(c), F.lit(""))
    for name, value in values.items():
        shown = F.regexp_replace(truncate(value, limit), r"([\\$])", r"\\$1")
        out = F.regexp_replace(out, F.lit(r"\{\{\s*" + name.replace(".", r"\.") + r"\s*\}\}"), shown)
    return out


def split_reply(c: Column | str, max_segments: int, least: int = 80) -> Column:
    """A long reply as several messages: by paragraphs, else by sentences in even groups; what exceeds the
    number of segments is joined to the last."""
    n = max(2, min(8, int(max_segments or 2)))
    kept = lambda parts: F.filter(F.transform(parts, strip), lambda x: x != "")

    def even(sentences: Column) -> Column:
        count = F.size(sentences)
        groups = F.greatest(F.lit(2), F.least(F.when(count <= 2 * n, F.least(F.lit(n), count - 1)).otherwise(n), count))
        base, extra = F.floor(count / groups).cast("int"), (count % groups).cast("int")
        return F.transform(
            F.sequence(F.lit(0), groups - 1),
            lambda g: strip(F.array_join(F.slice(sentences, g * base + F.least(g, extra) + 1, base + F.when(g < extra, 1).otherwise(0)), "")),
        )

    def parts(text: Column) -> Column:
        by_sentence = _let(kept(F.regexp_extract_all(text, F.lit("([^。！？!?；;\n]+[。！？!?；;]?)"), F.lit(1))), lambda s: F.when(F.size(s) < 2, F.array(text)).otherwise(even(s)))
        return _let(kept(F.split(text, r"\n\s*\n")), lambda p: F.when(F.size(p) >= 2, p).otherwise(by_sentence))

    def at_most(parts: Column) -> Column:
        joined = F.concat(F.slice(parts, 1, n - 1), F.array(F.array_join(F.slice(parts, n, F.greatest(F.size(parts), F.lit(1))), "\n")))
        return F.when(F.size(parts) <= n, parts).otherwise(joined)

    def reply(text: Column) -> Column:
        short = F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= least, F.array(text))
        return short.otherwise(_let(parts(text), at_most))

    return _let(strip(F.coalesce(_c(c), F.lit(""))), reply)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def split_turns(c: Column | str) -> Column:
    """Turns of a many-turn question; a question without turn marks is one."""
    text = _c(c)
    parts = F.filter(F.transform(F.split(text, "[｜|]"), lambda p: strip(F.regexp_replace(strip(p), "^第[一二三四五]轮[：:]", ""))), lambda p: p != "")
    whole = F.array(strip(text))
    return F.when(~text.contains("第一轮"), whole).when(F.size(parts) > 0, parts).otherwise(whole)


def parse_verdict(c: Column | str) -> Column:
    """struct(verdict, diff, reason) of the first JSON object in a judge's text; unreadable is a fail."""
    text = F.coalesce(_c(c), F.lit(""))
    found = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "verdict string, diff string, reason string")
    bad = F.struct(F.lit("fail").alias("verdict"), F.lit("unreadable").alias("diff"), F.substring(text, 1, 200).alias("reason"))
    return F.when(found["verdict"].isNotNull(), found).otherwise(bad)


def clean_transcript(c: Column | str) -> Column:
    """Text read from an image without code fences and a leading 'this picture shows'."""
    text = strip(F.replace(F.replace(F.coalesce(_c(c), F.lit("")), F.lit("```markdown"), F.lit("")), F.lit("```"), F.lit("")))
    return strip(F.regexp_replace(text, "^(这张图|该图|图片|图中)\\s*(展示|显示|呈现)?了?[：:，,]?", ""))


def caption_or_placeholder(c: Column | str) -> Column:
    text = strip(F.coalesce(_c(c), F.lit("")))
    return F.when(text != "", F.concat(F.lit("【图】"), text)).otherwise(F.lit("【图】文档此处有一张图片，图中内容无法提取"))


#: Long numbers behind a label: rows that match every question a little (fixed value).
ID_ROW = r"(?:订单编号|运单号|物流单号|货号|商品编号|SKU\s*ID|Offer\s*ID|单号)\s*[：:]\s*\d{6,}"


def is_identifier_row(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit("")).rlike(ID_ROW)


#: Warnings that only inform (fixed values).
INFORMING = (
    r"^已剥离 .+页眉/页脚行$", r"标识符片段的向量化", r"图片已识别为文字并入库", r"图片来自已转写的扫描页，整页文字已入库，不再重复识别",
    r"图片(过小或重复，已作为装饰元素跳过|已作为装饰元素跳过)", r"合并单元格，已向下填充", r"分组表头.*已按多行表头合并", r"已保守按行切分",
    r"已按逗号处理", r"已按纯段落处理",
)


def document_status(warnings: Column | str) -> Column:
    """'partial' if some warning is not known to be only informing, else 'success'."""
    informs = "|".join(f"(?:{p})" for p in INFORMING)
    return F.when(F.exists(F.coalesce(_c(warnings), F.array().cast("array<string>")), lambda w: ~w.rlike(informs)), "partial").otherwise("success")


#: Cell values that stand for nothing (fixed values).
BLANKS = ("", "-", "--", "/", "\\", "N/A", "NA", "—", "－", "无")


def is_blank(c: Column | str) -> Column:
    return strip(F.coalesce(_c(c).cast("string"), F.lit(""))).isin(*BLANKS)


def cell_type(c: Column | str) -> Column:
    """date, num, measure, code or text (patterns and limits are fixed values); null for a blank cell."""
    s = strip(_c(c).cast("string"))
    number = F.replace(F.regexp_replace(s, "^[¥￥$€£]+", ""), F.lit(","), F.lit(""))
    return (
        F.when(is_blank(c), None)
        .when(s.rlike(r"^(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})$"), "date")
        .when(number.rlike(r"^[+-]?\d+(\.\d+)?%?$"), "num")
        .when(s.rlike(r"(?U)^\d"), "measure")
        .when((F.length(s) <= 24) & (F.regexp_count(s, F.lit(" ")) <= 3) & ~s.contains("，") & ~s.contains("。"), "code")
        .otherwise("text")
    )


def parse_record_block(c: Column | str) -> Column:
    """struct(sheet, title, fields array<struct<k,v>>) of '【sheet】title：k: v；k: v', with either colon after title and keys,
    both of 40 characters at most; a piece without a key is glued to the field before it, a repeated key's last value
    counts. Null for a text that doesn't begin like that."""
    text = F.coalesce(_c(c), F.lit(""))
    head = "^【([^】]+)】([^：:]{1,40})[：:]"
    sheet, title = strip(F.regexp_extract(text, head, 1)), strip(F.regexp_extract(text, head, 2))
    pieces = F.filter(F.transform(F.split(F.regexp_replace(text, head, ""), "；"), lambda p: strip(p)), lambda p: p != "")
    pair = r"(?s)^([^：:]{1,40})[：:](?U:\s*)(.*)$"
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<struct<k:string,v:string>>").alias("fields"))

    def put(state: Column, key: Column, value: Column) -> Column:
        field = F.struct(key.alias("k"), value.alias("v"))
        there = F.exists(state["fields"], lambda f: f["k"] == key)
        fields = F.when(there, F.transform(state["fields"], lambda f: F.when(f["k"] == key, field).otherwise(f))).otherwise(F.concat(state["fields"], F.array(field)))
        return F.struct(key.alias("last"), fields.alias("fields"))

    def step(state: Column, piece: Column) -> Column:
        key, value = strip(F.regexp_extract(piece, pair, 1)), strip(F.regexp_extract(piece, pair, 2))
        before = F.get(F.filter(state["fields"], lambda f: f["k"] == state["last"]), F.lit(0))["v"]
        glued = put(state, state["last"], F.concat(before, F.lit("；"), piece))
        return F.when(key != "", put(state, key, value)).when(state["last"] != "", glued).otherwise(state)

    fields = F.aggregate(pieces, start, step, lambda state: state["fields"])
    return F.when(title != "", F.struct(sheet.alias("sheet"), title.alias("title"), fields.alias("fields")))


#: Field words and their aliases, longer ones before what they contain (fixed values).
FIELD_ALIASES = (
    ("ctn weight", "整箱重量"), ("gross weight", "毛重"), ("net weight", "净重"), ("weight", "重量"), ("wireless data rate", "无线速率"),
    ("data rate", "速率"), ("transmission distance", "传输距离"), ("ptp distance", "传输距离"), ("distance", "距离"), ("frequency", "频率"),
    ("antenna", "天线"), ("chipset", "芯片"), ("flash/ram", "内存"), ("lan ports", "网口"), ("poe ports", "POE口"), ("ports", "端口"),
    ("poe power", "供电"), ("power", "功率"), ("ctn size", "整箱尺寸"), ("packing", "装箱"), ("package", "包装"), ("accessory", "配件"),
    ("warranty", "保修"), ("price", "价格"), ("moq", "最小起订量"), ("color", "颜色"), ("material", "材质"), ("model", "型号"),
)


def field_alias(c: Column | str) -> Column:
    """The alias of a field name: that of the first word it contains; a short CJK name is its own."""
    low = F.lower(strip(F.coalesce(_c(c), F.lit(""))))
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(a).alias("a")) for w, a in FIELD_ALIASES])
    found = F.get(F.filter(words, lambda x: F.contains(low, x["w"])), F.lit(0))["a"]
    return F.coalesce(found, F.when(low.rlike("[一-鿿]") & (F.length(low) <= 8), low), F.lit(""))
