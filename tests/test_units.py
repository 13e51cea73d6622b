"""Small fixtures for rules that the tables can't show."""

import json
import pickle
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tidewell.functions import chunking, intent, pages, text
from tidewell.operators import bullets, documents, lifecycle, retrieval, scope, sessions, sheets, usage, vectors
from tidewell.sources import files
from tidewell.streaming import jobs


def one(spark, column, *values, schema="a string"):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], schema).select(column.alias("x")).collect()]


# --- text


def test_whitespace_of_all_scripts(spark):
    assert one(spark, text.strip("a"), "　 x　") == ["x"]
    assert one(spark, text.normalize_text("a"), "a\r\nb　　c\n\n\n\nd ", None) == ["a\nb c\n\nd", ""]
    assert one(spark, text.truncate("a", 4), "abcd", "abcde", None) == ["abcd", "abc…", ""]
    assert one(spark, text.mask_secret("a"), "12345678", "123456789", "") == ["********", "1234********6789", ""]
    assert one(spark, text.slugify("a"), " Ab c! ", "产品 A")[0] == "ab-c"
    assert one(spark, text.count_chars("a"), "😀é") == [2]


def test_meta_prefix(spark):
    assert one(spark, text.strip_meta("a"), "【要点】《x.pdf》 body", "【only】", None) == ["body", "【only】", ""]


def test_language(spark):
    assert one(spark, text.detect_language("a"), "こんにちは", "안녕", "สวัสดี", "привет мир", "你好吗", "hello", "123", None) == ["ja", "ko", "th", "ru", "zh-CN", "en", "", ""]


def test_sub_intents(spark):
    assert one(spark, text.split_sub_intents("a"), "价格多少？另外怎么退货！价格多少？x", "a", "") == [["价格多少", "怎么退货"], ["a"], []]


def test_intents(spark):
    got = one(spark, intent.detect_intent("a"), "I want to speak to a HUMAN", "你们是骗子，我要投诉", "refund now, terrible", "refund please", "you idiot", "在吗", "add my wechat")
    assert [(g.handoff, g.reason) for g in got[:4]] == [(True, "asked for a person"), (True, "risk: 投诉"), (True, "refund with anger: refund"), (False, "")]
    assert got[4].abuse and got[5].meaningless and got[6].ad


def test_confidence_halves_go_even(spark):
    assert one(spark, text.confidence("a"), 0.025, 0.035, -1.0, 0.95, 0.005, schema="a double") == [2, 4, 0, 99, 0]


def test_refusals(spark):
    assert one(spark, text.is_refusal("a"), "抱歉，查不到相关资料", "净重 420g。", "", "人为损坏不在保修范围内") == [True, False, True, False]
    assert one(spark, text.is_real_answer("a"), " NO_ANSWER ", "净重 420g。") == [False, True]


def test_tokens(spark):
    assert one(spark, text.embed_tokens("a"), "保修X1期", "") == [["保", "保修", "修", "x1", "期"], []]
    assert one(spark, text.estimate_tokens("a"), "你好abcd", "", "ab") == [3, 0, 1]


def test_split_reply(spark):
    s = "这是一个比较长的句子用来测试拆分功能是否正常工作呢。"
    got = one(spark, text.split_reply("a", 3), s * 5, "short", "p1 " * 20 + "\n\n" + "p2 " * 20 + "\n\n" + "p3\n\np4", "")
    assert ["".join(got[0]), len(got[0])] == [s * 5, 3] and got[1] == ["short"] and len(got[2]) == 3 and got[2][2] == "p3\np4" and got[3] == []


def test_turns_and_verdicts(spark):
    assert one(spark, text.split_turns("a"), "第一轮：你好｜第二轮：再见", " one ") == [["你好", "再见"], ["one"]]
    got = one(spark, text.parse_verdict("a"), 'text {"verdict": "pass", "diff": "", "reason": "r"} end', "nothing")
    assert (got[0].verdict, got[0].reason, got[1].verdict) == ("pass", "r", "fail")
    assert one(spark, text.clean_transcript("a"), "```markdown\n这张图展示了：价格表\n```") == ["价格表"]


def test_document_status(spark):
    assert one(spark, text.document_status("a"), ["已剥离 3 个跨页重复的页眉/页脚行"], ["something new"], [], None, schema="a array<string>") == ["success", "partial", "success", "success"]


def test_cells(spark):
    assert one(spark, text.cell_type("a"), "2024-01-02", "¥1,200", "15.5KG", "WB730", "—", "a long text，with marks", None) == ["date", "num", "measure", "code", None, "text", None]


def test_record_block(spark):
    got = one(spark, text.parse_record_block("a"), "【表】WB730：重量: 15KG；价格: 10；20；距离: 5KM")[0]
    assert (got.sheet, got.title, [(f.k, f.v) for f in got.fields]) == ("表", "WB730", [("重量", "15KG"), ("价格", "10；20"), ("距离", "5KM")])


def test_record_block_with_either_colon(spark):
    got = one(spark, text.parse_record_block("a"), "【s】M1：size：10；weight: 5", "【s】M1: a: 1；b:2；rest；a: 3；more", "【s】" + "t" * 41 + "：a: 1", "plain：a: 1", "【s】M1：；x", None)
    assert [g and (g.title, [(f.k, f.v) for f in g.fields]) for g in got] == [("M1", [("size", "10"), ("weight", "5")]), ("M1", [("a", "3；more"), ("b", "2；rest")]), None, None, ("M1", []), None]


def test_overview_and_quick_scan(spark):
    def block(k, fields, name="M"):
        return (1, k, f"【桥】{name}{k}：{fields}")

    rows = [block(k, f"重量: {k}KG；Frequency：{k}GHz；频率: 其他；Distance: {k}KM；Weight: {'长' * 21}；Data rate: 9M；price: 5") for k in range(5)] + [block(4, "重量: 9KG", "m")]
    names = spark.createDataFrame([(1, "a.xlsx"), (2, "b.xlsx")], "doc_id long, filename string")
    few = [(2, k, f"【桥】M{k}：重量: {k}KG") for k in range(4)]
    got = [r.text for r in sheets.overview_blocks(spark.createDataFrame(rows + few, "doc_id long, seq int, text string"), names).orderBy("n").collect()]
    assert got == ["【文档概览】《a.xlsx》（工作表「桥」）共包含 5 个条目：M0、M1、M2、M3、M4", "【条目速览】《a.xlsx》各条目关键参数：" + "；".join(f"M{k}: {k}KG/{k}GHz/{k}KM" for k in range(5))]
    more = spark.createDataFrame([(1, k, f"【{k % 2}】M{k}：x: 1") for k in range(41)], "doc_id long, seq int, text string")
    got = [r.text for r in sheets.overview_blocks(more, names).collect()]
    assert len(got) == 1 and got[0].startswith("【文档概览】《a.xlsx》共包含 41 个条目：M0、M1")


def test_prepared_records(spark):
    rows = [(1, k, f"【桥】M{k}：重量: {k}KG；Ports：2；备注: {'很长的说明文字' * 7}{k}") for k in range(6)] + [(1, 6, "售后热线：400-886-8888"), (1, 7, "  ")]
    docs = spark.createDataFrame([(1, "a.xlsx")], "doc_id long, filename string")
    got = [r.text for r in documents.prepare_document(docs, spark.createDataFrame(rows, "doc_id long, seq int, text string")).orderBy("seq").collect()]
    assert [t[:6] for t in got[:4]] == ["【文档概览】", "【条目速览】", "【属性对照】", "【售后服务】"] and got[4:] == [r[2] for r in rows[:7]]
    assert got[2] == "【属性对照】《a.xlsx》重量：" + "；".join(f"M{k}: {k}KG" for k in range(6))  # ports don't differ, remarks are long


def test_round_even(spark):
    import random

    from tidewell.functions.numbers import round_even

    own = random.Random(1)
    values = [6.25, 18.75, 9.075, 0.15, 2.675, 0.25, 0.35, 1e-9, 0.0, 99.95, 12345.678, -6.25, -0.05, 0.05, 5e-324] + [100.0 * own.randrange(4000) / own.randrange(1, 4000) for _ in range(3000)] + [own.randrange(2000) / 20 for _ in range(500)] + [own.randrange(10**7) / 2000 for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 6):
        got = [r[0] for r in rows.select(round_even(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]
    assert rows.select(round_even(F.lit(None).cast("double"), 1)).first()[0] is None


def test_pages_ignore_titles_inside_unread_elements():
    assert pages.page_text("<title>A</title><p>x</p><svg><title>icon</title><desc>d</desc></svg><p>y</p>") == ("A", "x\ny", False)
    assert pages.page_text('<meta name="description" content="a   b"><p>a b</p>') == ("", "a b", False)
    assert pages.page_text('<meta name=Description content="one"><meta name=description content="two"><noscript><meta name=description content="three"></noscript>z') == ("", "two\nz", False)
    assert pages.page_text("<p>" + "x" * 50, 0) == ("", "x" * 50, False)


def test_caps_of_two_tenants_with_one_id(spark):
    rows = [(1, 1, "k", "a.pdf", 60, "x"), (1, 2, "k", "b.pdf", 60, "y"), (2, 1, "k", "c.pdf", 60, "z")]
    uploads = spark.createDataFrame([(*r, f"2024-01-0{k + 1}") for k, r in enumerate(rows)], "doc_id long, tenant_id long, kb_id string, filename string, size_bytes long, extra string, created_at string")
    got = sorted((r.tenant_id, r.doc_id, r.extra, r.reason) for r in scope.admit_with_caps(uploads, max_kb_bytes=100).collect())
    assert got == [(1, 1, "x", None), (1, 2, "z", "bytes"), (2, 1, "y", None)]


def test_identifier_rows(spark):
    assert one(spark, text.is_identifier_row("a"), "SKU ID：1234567", "货号: 12345") == [True, False]


# --- chunking


def test_chunks():
    topics = [f"topic {i} " + "words about it " * 3 for i in range(8)]
    out = chunking.chunk_text("\n\n".join(topics), 600)
    assert 1 < len(out) <= 8 and all(len(c) <= 701 for c in out) and all(t.strip() in "".join(out) for t in topics)
    assert len(chunking.chunk_text("\n\n".join(topics), 600, overlap=0, min_fill=0)) == 8
    assert all(len(c) <= 300 for c in chunking.chunk_text("一句话。" * 200, 300))
    assert chunking.chunk_text("") == chunking.chunk_text(None) == chunking.chunk_text(" \n ") == []
    assert chunking.cut_windows("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]
    long = "【a > b】\n" + "字" * 700
    assert all(p.startswith("【a > b】\n") for p in chunking.chunk_blocks([long, "short", None]) if p != "short")


def test_pack_and_merge():
    assert chunking.pack_items("H:", ["aaa；", "bbb；", "ccc；"], 10) == ["H:aaa；bbb", "H:ccc"]
    blocks = [(["A"], "A", "x", False), (["A", "B"], "B", "y", False), (["A", "C"], "C", "z", False), (["A"], "", "code", True), ([], "", "p", False), ([], "", "q", False)]
    assert chunking.merge_blocks(blocks) == ["【A】\nx", "【A】\nB\ny\n\nC\nz", "【A】\ncode", "p\n\nq"]


# --- structure


def lines(spark, body, doc_id=1):
    return documents.lines_of(spark.createDataFrame([(doc_id, body)], "doc_id long, text string"))


def test_markdown_blocks(spark):
    body = "intro\n# One\nfirst\n## Two\n| a | b |\n| 1 | 2 |\n```\n# no heading\n```\n![net](x.png)\ntext\nThree\n===\nend"
    rows = documents.structure_blocks(spark.createDataFrame([(1, body)], "doc_id long, text string")).orderBy("block_no").collect()
    assert [(r.path, r.body, r.atomic) for r in rows] == [
        ([], "intro", False), (["One"], "first", False), (["One", "Two"], "| a | b |", True), (["One", "Two"], "| 1 | 2 |", True),
        (["One", "Two"], "```\n# no heading\n```", True), (["One", "Two"], "【图】net", True), (["One", "Two"], "text", False), (["Three"], "end", False),
    ]


def test_plain_headings(spark):
    rows = documents.structure_blocks(spark.createDataFrame([(1, "第一章 总则\n正文一\n1.2 范围\n正文二\n1. 列表项\n一、说明。")], "doc_id long, text string"), markdown=False)
    got = {r.body: r.path for r in rows.collect()}
    assert got == {"正文一": ["第一章 总则"], "正文二\n1. 列表项\n一、说明。": ["第一章 总则", "1.2 范围"]}


def naive_join(own):
    out, limit = [], int(max(map(len, own)) * 0.85)
    for line in own:
        prev = out[-1] if out else ""
        if out and prev[-1] not in documents.STOPS and not line.startswith("- ") and len(prev) >= limit:
            out[-1] = f"{prev} {line}"
        else:
            out.append(line)
    return out


def test_wrapped_lines_equal_a_fold(spark):
    import random

    random.seed(5)
    docs = [[random.choice(["", "- "]) + "w" * random.randint(1, 12) + random.choice(["", "", "."  , "。"]) for _ in range(random.randint(1, 9))] for _ in range(120)]
    rows = [(i, 0, k, line) for i, own in enumerate(docs) for k, line in enumerate(own)]
    got = documents.join_wrapped_lines(spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string")).orderBy("doc_id", "line_no").collect()
    for i, own in enumerate(docs):
        assert [r.line for r in got if r.doc_id == i] == naive_join(own)


def test_boilerplate(spark):
    rows = [(1, p, k, line) for p in range(4) for k, line in enumerate([f"Page {p}", f"body {chr(97 + p)}", "tail"])]
    kept, boiler = documents.page_boilerplate(spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string"))
    assert {r.norm for r in boiler.collect()} == {"Page#"}
    assert kept.filter("line LIKE 'Page%'").count() == 0


def test_key_values(spark):
    body = "产品型号 DDX19\n额定电压 220V\n额定输入电流（充电状\n态） 0.5A\n尘盒容量 300ml\n水箱容量 200ml\n重量 3kg\n这是一个正文句子，不是参数。\n" + "散文句子在这里。\n" * 9 + "孤立 值"
    docs = spark.createDataFrame([(1, "m.pdf", body)], "doc_id long, filename string, text string")
    pairs = {r.key: r.value for r in documents.kv_dense_segments(documents.lines_of(docs)).collect()}
    assert pairs == {"产品型号": "DDX19", "额定电压": "220V", "额定输入电流（充电状态）": "0.5A", "尘盒容量": "300ml", "水箱容量": "200ml", "重量": "3kg"}
    assert documents.kv_param_summary(docs).first().text.startswith("【参数对照】《m.pdf》产品型号：DDX19；")


MANUAL = """1. 连接电源线
*语音为高配标配
5 获取完整版使用指南
微信扫描机身二维码，获取完整版使用指南。
• 基站附近若有镜子、 反光的踢脚线等物体， 需遮挡其底部 14cm 的部分。
• 请勿将基站放在阳光直射的地方。
• 建议放置在信号强的位置，以便获得更好的使用体验。
2. 寻找合适的位置放置基站
基站靠墙放置在平坦的硬质地面，左右0.1m和前方0.8m范围内不要
放置物品。
≥0.1m (0.33')
3. 使用水箱"""


def test_bullets(spark):
    def texts(blocks):
        rows = spark.createDataFrame([(1, k, b) for k, b in enumerate(blocks)], "doc_id long, seq int, text string")
        return [r.body for r in bullets.bullet_bodies(rows).orderBy("run").collect()]

    out = texts([MANUAL])
    assert out == ["基站附近若有镜子、 反光的踢脚线等物体， 需遮挡其底部 14cm 的部分。；请勿将基站放在阳光直射的地方。；建议放置在信号强的位置，以便获得更好的使用体验。；寻找合适的位置放置基站基站靠墙放置在平坦的硬质地面，左右0.1m和前方0.8m范围内不要放置物品。"]
    assert texts(["正文一句话。\n• 孤立的一条要求请不要忽视它。\n正文一句话。\n正文一句话。"]) == []
    care = "• 主机长时间不用时请先充满电，\n每 3 个月补充电一次。\n5. 返回基站后主机待机约5小时进入深度休眠。\n• 短句"
    assert texts([care]) == ["主机长时间不用时请先充满电，每 3 个月补充电一次。；返回基站后主机待机约5小时进入深度休眠。", "返回基站后主机待机约5小时进入深度休眠。"]
    assert texts([MANUAL, MANUAL]) == out and texts(["", "\n"]) == []


def test_summaries(spark):
    body = "• 第一条要求内容请务必遵守到底。\n• 第二条要求内容请\n务必遵守到底。\n\n\n\n售后服务中心： 400-886-8888，谢谢。\n更多详情请至官网： www.example.com.\n请用微信扫描，联系在线客服。\n首次使用前请先充满电再开机使用；首次使用时请撕掉 保护膜后再放置。"
    docs = spark.createDataFrame([(1, "m.pdf", body), (2, "n.pdf", "产品型号 DDX19\n400-886-8888 www.example.com 微信"), (3, "o.pdf", None)], "doc_id long, filename string, text string")
    assert [r.text for r in documents.bullet_summary(docs).collect()] == ["【要点清单】《m.pdf》第一条要求内容请务必遵守到底。；第二条要求内容请务必遵守到底。"]
    assert [r.text for r in documents.service_summary(docs).collect()] == ["【售后服务】《m.pdf》售后服务中心：400-886-8888；官网：www.example.com；请用微信扫描，联系在线客服。"]
    assert [r.text for r in documents.first_use_summary(docs).collect()] == ["【首次使用要点】《m.pdf》首次使用前请先充满电再开机使用；；首次使用时请撕掉保护膜后再放置。"]
    blocks = spark.createDataFrame([(1, 0, body)], "doc_id long, seq int, text string")
    got = [r.text[:6] for r in documents.prepare_document(docs.select("doc_id", "filename"), blocks).orderBy("seq").collect()]
    assert got == ["【要点清单】", "【售后服务】", "【首次使用要", "• 第一条要"]


def test_images(spark):
    texts = spark.createDataFrame([(1, "a【图】文档此处有一张图片，图中内容无法提取b"), (2, "x")], "doc_id long, text string")
    shown = spark.createDataFrame([(1, 1, 3, "a router"), (2, 1, 4, "a cable")], "doc_id long, seq int, page int, description string")
    assert {r.doc_id: r.text for r in documents.apply_descriptions(texts, shown).collect()} == {1: "a【图】a routerb", 2: "x\n【图】(page 4, no. 1) a cable"}
    images = spark.createDataFrame([(1, 1, b"a" * 3000, 100, 100), (1, 2, b"a" * 3000, 100, 100), (1, 3, b"b" * 10, 100, 100), (1, 4, b"c" * 3000, 20, 100), (1, 5, b"d" * 3000, None, None)], "doc_id long, seq int, content binary, width int, height int")
    assert [r.seq for r in documents.dedupe_images(images).collect()] == [1, 2]


# --- sheets


def sheet(spark, grid):
    return spark.createDataFrame([(1, i, j, v) for i, r in enumerate(grid) for j, v in enumerate(r)], "sheet_id long, row_no int, col_no int, value string")


def test_layouts(spark):
    across = sheet(spark, [["", "WB730", "WB620", "WB510"], ["重量", "15KG", "13KG", "12KG"], ["距离", "5KM", "4KM", "3KM"], ["价格", "100", "90", "80"], ["配件", "With", "With", "With"]])
    assert sheets.table_profile(across).first().kind == "transposed"
    down = sheet(spark, [["订单编号", "日期", "金额", "状态"], ["A001", "2024-01-01", "10", "done"], ["A002", "2024-01-02", "20", "open"], ["A003", "2024-01-03", "30", "done"]])
    assert sheets.table_profile(down).first().kind == "row_wise"
    names = sheets.header_template_columns(across, 0, 0)
    got = {r.title: [(f.k, f.v) for f in r.fields] for r in sheets.sheet_records(across, names, transposed=True).collect()}
    assert got["WB730"][:2] == [("重量", "15KG"), ("距离", "5KM")]


def test_each_sheet_is_read_by_its_own_layout(spark):
    grids = {
        1: [["", "Outdoor Series", "Outdoor Series", "Outdoor Series"], ["型号", "WB730", "WB620", "WB510"], ["重量", "15.5KG", "13KG", "12KG"], ["传输距离", "5KM", "4KM", "3KM"], ["价格", "￥165", "￥120", "￥90"]],
        2: [["订单号", "日期", "金额", "状态"], ["A001", "2026-03-01", "¥120", "已发货"], ["A002", "2026-03-02", "¥80", "待发货"], ["A003", "2026-03-03", "¥240", "已发货"]],
        3: [["参数", "X1", "X2"], ["重量", "1KG", "2KG"], [None, "5KM", "10KM"], ["价格", "￥10", "￥20"]],
        4: [["", "", "", ""], ["", "商品信息", "", "特性"], ["", "名称", "品牌", "颜色"], ["", "cold widget", "B1", "red"], ["", "small bolt", "B2", "blue"]],
        5: [["only a line"]],
    }
    cells = spark.createDataFrame([(s, i, j, v) for s, g in grids.items() for i, r in enumerate(g) for j, v in enumerate(r)], "sheet_id long, row_no int, col_no int, value string")
    layouts = {r.sheet_id: (r.kind, r.first_row, r.last_row) for r in sheets.sheet_layouts(sheets.ffill_first_col(sheets.dense_cells(cells))).collect()}
    assert layouts == {1: ("transposed", 0, 1), 2: ("row_wise", 0, 0), 3: ("transposed", 0, 0), 4: ("row_wise", 0, 1), 5: ("flat", 0, 0)}
    got = {(r.sheet_id, r.title): {f.k: f.v for f in r.fields} for r in sheets.layout_records(cells).collect()}
    assert got[1, "Outdoor Series > WB730"] == {"重量": "15.5KG", "传输距离": "5KM", "价格": "￥165"}
    assert got[2, "A001"] == {"订单号": "A001", "日期": "2026-03-01", "金额": "¥120", "状态": "已发货"}
    assert got[3, "X1"] == {"重量": "1KG", "价格": "￥10"}  # one blank of four is under the rate for filling down
    assert got[4, "small bolt"] == {"商品信息 > 名称": "small bolt", "品牌": "B2", "特性 > 颜色": "blue"}
    assert sorted(k[0] for k in got) == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    assert sheets.layout_records(cells.limit(0)).count() == 0


def test_fill_and_grids(spark):
    grid = sheet(spark, [["a", "1"], [None, "2"], ["-", "3"], ["b", "4"]])
    assert [r.value for r in sheets.ffill_first_col(grid).filter("col_no = 0").orderBy("row_no").collect()] == ["a", "a", "a", "b"]
    two = sheet(spark, [["a", "b"], ["1", "2"], ["", ""], ["c", "d"], ["3", "4"]])
    assert sheets.split_grids(two).select("grid_no").distinct().count() == 2


def test_long_records_lose_nothing(spark):
    fields = [("k%d" % i, "v" * 50 + str(i)) for i in range(30)]
    rows = spark.createDataFrame([(1, 1, "T", fields)], "sheet_id long, record_no int, title string, fields array<struct<k:string,v:string>>")
    out = [r.text for r in sheets.render_records(rows).collect()]
    assert len(out) > 1 and all(v in "".join(out) for _, v in fields) and all(t.startswith("【1】T：k0: ") for t in out)


# --- retrieval

HITS = "query_id long, chunk_id string, kb_id string, doc_id string, score double, text string"


def test_floor_and_rerank(spark):
    hits = spark.createDataFrame([(1, c, k, "d", s, "t") for c, k, s in (("a1", "A", 0.91), ("a2", "A", 0.88), ("a3", "A", 0.61), ("b1", "B", 0.62))], HITS)
    assert [r.chunk_id for r in retrieval.per_kb_floor(hits, 8).orderBy("place").collect()] == ["a1", "a2", "b1", "a3"]
    coarse = spark.createDataFrame([(1, "c1", "A", "d", 0.9, "t", 1), (1, "c2", "A", "d", 0.5, "t", 2), (1, "c3", "A", "d", 0.6, "t", 3)], HITS + ", place int")
    scores = spark.createDataFrame([(1, "c1", 0.2), (1, "c2", 0.95), (1, "c3", 0.3)], "query_id long, chunk_id string, rerank double")
    assert [r.chunk_id for r in retrieval.apply_rerank(coarse, scores, 3, 0.05, 0.0).orderBy("place").collect()] == ["c2", "c3", "c1"]
    assert [r.chunk_id for r in retrieval.apply_rerank(coarse, None, 3, 0.05, 0.75).collect()] == ["c1"]


def test_fusion(spark):
    a = spark.createDataFrame([(1, "n1", 0.9), (1, "n2", 0.5)], "query_id long, chunk_id string, score double")
    b = spark.createDataFrame([(1, "n2", 0.8), (1, "n3", 0.4)], "query_id long, chunk_id string, score double")
    assert [r.chunk_id for r in retrieval.rrf_fuse([a, b], 5).orderBy("place").collect()][0] == "n2"


def test_service_block_and_overview(spark):
    chunks = spark.createDataFrame([("s1", 1, "k", "d", 0, "【售后服务】《m》热线 400", True), ("o1", 1, "k", "d", 1, "【文档概览】《m》", True), ("o2", 1, "k", "d", 1, "【条目速览】《m》", True), ("x", 1, "k", "d", 2, "text", True)], "chunk_id string, tenant_id long, kb_id string, doc_id string, seq int, text string, enabled boolean")
    queries = spark.createDataFrame([(1, "机器坏了怎么办"), (2, "重量多少")], "query_id long, text string")
    where = spark.createDataFrame([(1, 1, "k"), (2, 1, "k")], "query_id long, tenant_id long, kb_id string")
    none = spark.createDataFrame([], HITS + ", place int")
    got = retrieval.service_supplement(none, queries, where, chunks).collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in got] == [(1, "s1", 0.0)]
    near = spark.createDataFrame([(2, "x", 0.1)], "query_id long, chunk_id string, score double")
    over = retrieval.overview_fallback_hits(none, where, chunks, near).filter("query_id = 2").orderBy("place").collect()
    assert [r.chunk_id for r in over] == ["o1", "o2", "x"]


def test_no_row_crosses_tenants(spark, sf_dir):
    from tidewell.plans.retrieval import _vectors

    queries, chunks = _vectors(spark, sf_dir)
    hits = vectors.block_similarity_join(queries, chunks, 5, -1.0)
    crossed = hits.join(queries.select("query_id", "tenant_id").distinct(), "query_id").join(chunks.select("chunk_id", F.col("tenant_id").alias("t")), "chunk_id").filter("t <> tenant_id")
    assert crossed.count() == 0
    again = vectors.block_similarity_join(queries, chunks, 5, -1.0, chunk_block=7, query_block=1)
    key = lambda df: sorted((r.query_id, r.chunk_id, r.place) for r in df.collect())
    assert key(hits) == key(again) == key(vectors.similarity_join(queries, chunks, 5, -1.0))


# --- scope and lifecycle


def test_scope_fails_closed(spark):
    with pytest.raises(ValueError):
        scope.tenant_scope(spark.range(1), "")
    with pytest.raises(ValueError):
        scope.assert_same_tenant(spark.range(1), None)


def test_publish_checks(spark):
    people = spark.createDataFrame([(1, "hi {{bad.name}}"), (2, ""), (3, "ok")], "employee_id long, persona string")
    kb = spark.createDataFrame([(3, "k")], "employee_id long, kb_id string")
    doc = spark.createDataFrame([], "employee_id long, doc_id string")
    docs = spark.createDataFrame([("d", "k", True)], "doc_id string, kb_id string, enabled boolean")
    got = {r.employee_id: (r.blocked, r.confirm) for r in scope.publish_checks(people, kb, doc, docs, text.unknown_variables("persona")).collect()}
    assert got == {1: (["unknown variables: bad.name"], ["nothing is bound"]), 2: (["persona is blank"], ["nothing is bound"]), 3: ([], [])}


def test_images_of_messages(spark):
    messages = spark.createDataFrame([(1, 7, 1, 5, ["i1", "i2", "i1", "i3", "i4"], "hello", json.dumps({"images": [{"id": "i2"}, {"id": "i1"}]}))], "message_id long, session_id long, tenant_id long, visitor_id long, image_ids array<string>, content string, meta string")
    images = spark.createDataFrame([("i1", 1, 5, "one"), ("i2", 1, 6, "two"), ("i4", 1, 5, "four")], "image_id string, tenant_id long, visitor_id long, ocr_text string")
    assert [r.image_id for r in scope.claim_images(messages, images).collect()] == ["i1"]
    assert scope.messages_with_image_text(messages, images).first().content == "hello\ntwo\none"


def test_caps_skip_refused_files(spark):
    rows = [(i, 1, "k", f"f{i}.txt", size, f"2024-01-0{i} 00:00:00") for i, size in ((1, 50), (2, 60), (3, 40), (4, 10))]
    uploads = spark.createDataFrame(rows, "doc_id long, tenant_id long, kb_id string, filename string, size_bytes long, created_at string")
    got = {r.doc_id: r.reason for r in scope.admit_with_caps(uploads, max_kb_bytes=100, max_docs=3).collect()}
    assert got == {1: None, 2: "bytes", 3: None, 4: None}


@pytest.mark.parametrize(
    "kind, raw, value",
    [("boolean", "1", True), ("boolean", "no", False), ("boolean", "2", None), ("integer", " 42 ", 42), ("integer", "3.0", 3), ("integer", "3.5", None), ("integer", "", None), ("text", "5", "5"), ("datetime", "", None)],
)
def test_conversion(spark, kind, raw, value):
    row = lifecycle.convert_column(spark.createDataFrame([(raw,), (None,)], "a string"), "a", kind, "t").collect()
    assert row[0].value == value and (row[0].error is None) == (value is not None) and row[1].error is None


def test_datetime_with_offset(spark):
    row = lifecycle.convert_column(spark.createDataFrame([("2024-01-01T08:00:00+08:00",)], "a string"), "a", "datetime", "t").first()
    assert str(row.value) == "2024-01-01 00:00:00"


def test_reconcile_equal(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, 3)], "id long, a string, b long")
    assert lifecycle.reconcile_tables(a, a, ["id"]).first().ok
    assert not lifecycle.reconcile_tables(a, a.filter("id = 1"), ["id"]).first().ok
    swapped = spark.createDataFrame([(1, None, None), (2, None, 3)], "id long, a string, b long")
    assert lifecycle.reconcile_tables(a, swapped, ["id"]).first().different == 1


def test_versions_follow(spark):
    current = spark.createDataFrame([(1, 4)], "employee_id long, version_no long")
    saves = spark.createDataFrame([(1, 10, "2024-01-02"), (1, 9, "2024-01-01"), (2, 8, "2024-01-01")], "employee_id long, save_id long, saved_at string")
    assert {r.save_id: r.version_no for r in lifecycle.next_versions(current, saves).collect()} == {9: 5, 10: 6, 8: 1}


def test_snapshot_legacy(spark):
    rows = spark.createDataFrame([(1, 0, 0)], "employee_id long, reply_delay_min int, reply_delay_max int")
    old = spark.createDataFrame([(1, '{"reply_delay": 7}')], "employee_id long, snapshot string")
    got = lifecycle.apply_snapshot(rows, old, "reply_delay int, reply_delay_min int, reply_delay_max int").first()
    assert (got.reply_delay_min, got.reply_delay_max) == (7, 7)


# --- sessions and rates

MESSAGES = "tenant_id long, session_id long, seq long, role string, content string, created_at timestamp"


def say(spark, *roles):
    from datetime import datetime, timedelta

    return spark.createDataFrame([(1, 1, i, r, "低置信" if r == "system" else "x", datetime(2024, 1, 1) + timedelta(seconds=10 * i)) for i, r in enumerate(roles)], MESSAGES)


def test_cycles_re_arm(spark):
    rows = say(spark, "ai", "visitor", "visitor", "ai", "ai", "visitor", "system", "agent", "visitor")
    assert sorted(r.wait_s for r in sessions.response_cycles(rows).collect()) == [20, 20]


def test_stop_groups(spark):
    rows = say(spark, "visitor", "ai", "visitor", "ai", "visitor", "ai", "visitor")
    both = sessions.stop_trigger(rows, [[("ai_rounds", 2), ("visitor_messages", 3)]]).first()
    assert (both.fired_at, both.silent_after) == (4, 1)
    assert sessions.stop_trigger(rows, [[("unknown", 0)]]).count() == 0
    assert sessions.stop_trigger(rows, [], legacy_rounds=1).first().fired_at == 2


def test_streak_resets(spark):
    rows = say(spark, "system", "system", "ai", "system")
    assert [(r.streak, r.escalate) for r in sessions.no_answer_streak(rows, 2).orderBy("seq").collect()] == [(1, False), (2, True), (1, False)]


def test_session_state(spark, tmp_path):
    rows = say(spark, "visitor", "system", "system", "takeover", "ai", "release", "ai", "close", "ai")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = jobs.run_once(jobs.session_state_stream(stream), "state-test").orderBy("seq").collect()
    assert [r.status for r in got] == ["ai", "ai", "queued", "human", "human", "ai", "ai", "closed", "closed"]
    assert (got[-1].ai, got[-1].visitor, got[2].streak, got[5].streak) == (1, 1, 2, 0)


def test_quota_share_is_that_of_the_double(spark):
    used = spark.createDataFrame([(1, "2024-01-18", 3630), (2, "2024-01-18", 1)], "tenant_id long, created_at string, total_tokens long")
    tenants = spark.createDataFrame([(1, 40000), (2, 0)], "tenant_id long, daily_token_quota long")
    assert {r.tenant_id: r.used_percent for r in usage.quota_status(used, tenants).collect()} == {1: round(3630 * 100.0 / 40000, 2), 2: None}


def test_memory_counts_empty_notes(spark):
    notes = spark.createDataFrame([(1, 1, i, "" if i in (11, 12) else f"n{i}", f"2024-01-{i:02}") for i in range(1, 13)], "tenant_id long, visitor_id long, note_id long, content string, updated_at string")
    assert sorted(r.note_id for r in sessions.visitor_memory(notes).collect()) == list(range(3, 11))


def test_ids_inside_longer_runs(spark):
    chunks = spark.createDataFrame([(1, 1, 1, 1, "see AB-1234567890-x and AB-1234567890", True), (2, 1, 1, 1, "no12345678yes", True), (3, 1, 1, 1, "1234567", True), (4, 2, 1, 1, "12345678", True)], "chunk_id long, tenant_id long, kb_id long, doc_id long, text string, enabled boolean")
    queries = spark.createDataFrame([(1, "where is AB-1234567890"), (2, "and 12345678?"), (3, "nothing")], "query_id long, text string")
    where = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 3)], "query_id long, tenant_id long, kb_id long")
    got = {(r.query_id, r.chunk_id) for r in retrieval.pin_exact_ids(queries, where, chunks).collect()}
    assert got == {(1, 1), (2, 1), (2, 2)}


def test_rate_limit_edges(spark):
    from datetime import datetime, timedelta

    at = [0, 1, 60, 61, 62]
    hits = spark.createDataFrame([(1, i, datetime(2024, 1, 1) + timedelta(seconds=s)) for i, s in enumerate(at)], "tenant_id long, usage_id long, created_at timestamp")
    got = [r.accepted for r in usage.rate_limit_decisions(hits, rpm=1, window_s=60.0).orderBy("usage_id").collect()]
    assert got == [True, False, False, True, False]


def test_stop_window_rules(spark):
    from datetime import datetime

    rules = "array(named_struct('days', array(0), 'start', '22:00', 'end', '06:00'), named_struct('days', array(1), 'start', '09:30', 'end', '09:30'), named_struct('days', array(2), 'start', 'bad', 'end', '10:00'))"
    times = [datetime(2024, 1, 1, 23), datetime(2024, 1, 1, 5, 59), datetime(2024, 1, 1, 12), datetime(2024, 1, 2, 9, 30, 59), datetime(2024, 1, 2, 9, 31), datetime(2024, 1, 3, 9)]
    rows = spark.createDataFrame([(t,) for t in times], "at timestamp")
    got = [r.x for r in rows.select(intent.in_stop_window(F.col("at"), F.lit("UTC"), F.expr(rules)).alias("x")).collect()]
    assert got == [True, True, False, True, False, False]


# --- pages


def test_urls(spark):
    got = one(spark, pages.extract_urls("a"), "看 https://a.example/x，还有（http://b.example/y）和 [t](https://a.example/x). www.c.example", None)
    assert got == [["https://a.example/x", "http://b.example/y"], []]


def test_html():
    html = "<html><head><title>T &amp; t</title><meta name='description' content='about'><style>s</style></head><nav>menu<nav>deep</nav></nav><h1>H</h1><p>one <b>two</b><script>x</script></p><div>three"
    assert pages.page_text(html) == ("T & t", "about\nH\none two\nthree", False)
    assert pages.page_text("<p>" + "x" * 50, 10) == ("", "x" * 10, True)


def test_hash_embed_by_hand(spark):
    """Each token's bucket and sign from its digest, counted one by one."""
    import hashlib
    import math

    inputs = ["Hello hello 42", "你好吗 ok", "...", None, "a b c d e f g h i j a b c a"]
    tokens = [["hello", "hello", "42"], ["你", "你好", "好", "好吗", "吗", "ok"], [], [], list("abcdefghij") + list("abca")]
    rows = spark.createDataFrame(list(enumerate(inputs)), "k int, text string")
    for dim in (7, 256):
        got = {r.k: r.embedding for r in vectors.hash_embed(rows, "text", dim).collect()}
        for k, own in enumerate(tokens):
            want = [0.0] * dim
            for t in own:
                digest = hashlib.blake2b(t.encode(), digest_size=8).digest()
                want[int.from_bytes(digest, "big") % dim] += 1.0 if digest[0] >= 128 else -1.0
            length = math.sqrt(sum(v * v for v in want)) or 1.0
            assert got[k] == pytest.approx([v / length for v in want], abs=1e-6)


# --- files


def test_text_files(spark, tmp_path):
    for name, raw in {"a": "你好".encode("gb18030"), "b": "﻿héllo".encode(), "c": b"", "d": b"\xff\xfe\xff\x81"}.items():
        (tmp_path / f"{name}.txt").write_bytes(raw)
    got = {r.path[-5]: r for r in files.read_text_files(spark, str(tmp_path)).collect()}
    assert got["a"].text == "你好" and got["b"].text == "héllo" and got["c"].status == "failed" and got["d"].status == "success"


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2,5\n")
    (tmp_path / "b.csv").write_text("only,header\n")
    got = files.read_csv_sniffed(spark, str(tmp_path)).collect()
    assert {(r.row_no, r.col_no, r.value) for r in got if r.path.endswith("a.csv")} == {(0, 0, "x"), (0, 1, "y"), (1, 0, "1"), (1, 1, "2,5")}
    assert [r.status for r in got if r.path.endswith("b.csv")] == ["failed"]


def test_folders_of_files(spark, tmp_path):
    """The same rows as Spark's own reader's, in folders of values too; hidden names, odd names, empty files."""
    from tidewell.sources import folders

    raws = {"a": "你好".encode("gb18030"), "b b": "\ufeffhéllo".encode(), "c": b"", "d": b"\xff\xfe\xff\x81", "_e": b"hidden", ".f": b"hidden", "g%20": b" ", "n": b"x" * 300_000}
    for where in ("k=1", "k=2"):
        (tmp_path / where).mkdir()
        for name, raw in raws.items():
            (tmp_path / where / f"{name}.txt").write_bytes(raw)
    folders.register(spark)
    plain = lambda rows: sorted((unquote(r.path.rpartition("/")[2]), *r[1:]) for r in rows.collect())
    for where in ("k=*", "k=1"):
        want = plain(files.read_text_files(spark, f"{tmp_path}/{where}"))
        for slices in (1, 5):
            got = spark.read.format("tidewell_text").option("slices", slices).load(f"{tmp_path}/{where}")
            assert got.rdd.getNumPartitions() == slices and plain(got) == want
    assert len(plain(spark.read.format("tidewell_text").load(str(tmp_path)))) == 12
    assert spark.read.format("tidewell_text").load(f"file://{tmp_path}/k=1/n.txt").first().size_bytes == 300_000
    (tmp_path / "none").mkdir()
    assert spark.read.format("tidewell_text").load(f"{tmp_path}/none").count() == 0


def test_csv_folder(spark, tmp_path):
    from tidewell.sources import folders

    (tmp_path / "a.csv").write_text("x;y\n1;2,5\n\n;\n" + "3;4\n" * 9_000)
    (tmp_path / "b.csv").write_text("only,header\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text('"q\nr"\ns\n')
    folders.register(spark)
    rows = lambda df: sorted(df.collect(), key=lambda r: (r.path, r.row_no, r.col_no))
    assert rows(spark.read.format("tidewell_csv").option("slices", 3).load(str(tmp_path))) == rows(files.read_csv_sniffed(spark, str(tmp_path)))


def test_planning_lists_no_names(spark, tmp_path):
    """The driver plans as many slices, of the same size, for many files as for none."""
    from tidewell.sources import folders

    reader = folders.TextFolder({"path": str(tmp_path), "slices": "4"}).reader(None)
    before = pickle.dumps((reader, reader.partitions()))
    for i in range(3_000):
        (tmp_path / f"{i}").touch()
    assert pickle.dumps((reader, reader.partitions())) == before
    got = spark.read.format("tidewell_text").option("slices", 4).load(str(tmp_path))
    assert got.filter("status = 'failed'").count() == 3_000


def test_eval_files(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"id": "1", "category": "c", "input": "q"}, {"id": "2"}]}))
    cases = files.read_eval_cases(spark, str(tmp_path / "cases.json"))
    assert cases.count() == 2 and len(cases.columns) == 8
    files.write_eval_results(cases, str(tmp_path / "out"), "2024-01-01")
    assert spark.read.json(str(tmp_path / "out")).first().total == 2


def test_timing_log(spark, tmp_path):
    (tmp_path / "log").write_text("INFO turn path=normal tokens=12 degraded=false intent=1.5ms search=20ms(x2) total=30.0ms\nINFO turn path=ad tokens=0 degraded=1\nother\n")
    got = files.read_timing_log(spark, str(tmp_path / "log")).collect()
    assert [(r.path_name, r.tokens, r.degraded) for r in got] == [("normal", 12, False), ("ad", 0, True)]
    assert got[0].stages == {"intent": 1.5, "search": 20.0, "total": 30.0} and got[0].calls == {"intent": 1, "search": 2, "total": 1} and got[1].stages == {}


def test_chunk_and_vector_tables(spark, tmp_path, sf_dir):
    from tidewell.sources.derived import frame

    chunks = frame(spark, sf_dir, "chunk_vectors").withColumn("text", F.lit("x"))
    files.write_chunks(chunks, str(tmp_path / "c"), salts=2)
    files.write_vectors(chunks, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == chunks.count()
    assert spark.read.parquet(str(tmp_path / "v")).count() == chunks.filter("enabled").count()


def test_mixed_dimensions_raise(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, vector array<double>")
    with pytest.raises(Exception, match="different length"):
        vectors.assert_one_dimension(rows).collect()


# --- streams


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docs = [(1, 1, "k", "a.txt", "one\n\ntwo"), (2, 1, "k", "b.txt", "")]
    spark.createDataFrame(docs, "doc_id long, tenant_id long, kb_id string, filename string, text string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    status = {r.doc_id: r.status for r in spark.read.parquet(str(tmp_path / "out/status")).collect()}
    assert status == {1: "success", 2: "failed"} and spark.read.parquet(str(tmp_path / "out/chunks")).count() == 1
    vectors = jobs.ingested(spark, str(tmp_path / "out"), "vectors").collect()
    assert [(r.doc_id, len(r.embedding)) for r in vectors] == [(1, 64)]


def test_late_rows_are_counted(spark, tmp_path):
    kept = []
    for n, times in enumerate((["2024-01-01 00:10:00", "2024-01-01 00:01:00"], ["2024-01-01 00:09:30", "2024-01-01 00:08:00"])):
        rows = spark.createDataFrame([(x,) for x in times], "created_at string").coalesce(1)
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        jobs.count_late(stream, str(tmp_path / "counts"), str(tmp_path / "state"), 60, lambda df, n: kept.append(df.count()))  # a restart each
    assert tuple(jobs.late_counts(spark, str(tmp_path / "counts")).first()) == (4, 1) and kept == [2, 1]


def test_stream_equals_batch(spark, sf_dir):
    from tidewell.plans.streams import QUERIES
    from tidewell.plans.usage import QUERIES as BATCH

    rows = lambda df: sorted((r.tenant_id, r.usage_id, r.accepted) for r in df.collect())
    assert rows(QUERIES["rate_limit_stream"](spark, sf_dir)) == rows(BATCH["rate_limit_decisions"](spark, sf_dir))
