"""Rules that triage a visitor's message, as column expressions over fixed word lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import detect_language, split_sub_intents, strip

# The phrases that the rules match, in the order in which the first match is the reason.
HANDOFF = (
    "转人工", "人工客服", "找人工", "要人工", "接人工", "真人", "人工服务", "客服人工", "转接人工", "人工坐席", "转客服", "找客服", "human agent", "human support", "real person",
    "speak to a human", "talk to a human", "transfer me", "live agent", "customer service agent", "get a human", "human operator", "attendant humain",
    "parler à un humain", "agente humano", "hablar con un humano", "atender humano", "menschen sprechen", "mitarbeiter verbinden", "оператор",
    "живой человек", "соедините с", "переведите на", "担当者につないで", "人間の担当", "オペレーター", "상담원 연결",
)
RISK = (
    "投诉", "举报", "曝光", "起诉", "律师", "消协", "12315", "工商局", "媒体", "赔偿", "纠纷", "仲裁", "欺诈", "骗子", "起诉你们", "能不能便宜", "便宜点", "少点钱", "打个折", "优惠点", "最低多少",
    "给个底价", "议价", "complaint", "complain about", "report you", "expose you", "sue", "lawyer", "attorney", "fraud", "scam", "rip off",
    "consumer protection", "arbitration", "compensation", "жалоба", "жаловаться", "суд", "адвокат", "мошенник", "обман", "queja", "demanda",
    "abogado", "estafa", "fraude", "escroquerie", "betrug", "anwalt", "詐欺", "訴える", "弁護士", "クレーム", "give me a discount", "any discount",
    "can you do a discount", "cheaper price", "lower the price", "best price", "final price", "bottom price", "negotiate", "make it cheaper",
    "скидку", "дешевле", "descuento", "rabatt", "値下げ", "安くして",
)
REFUND = (
    "退款", "退货", "退钱", "换货", "差价", "refund", "money back", "return the", "exchange the", "price difference",
)
NEGATIVE = (
    "不满意", "太差", "差评", "垃圾", "坑", "被骗", "离谱", "什么意思", "你们怎么回事", "必须给个说法", "太过分", "unacceptable", "terrible", "awful", "useless", "disappointed",
    "angry", "ridiculous", "what the hell", "are you kidding", "worst",
)
ABUSE = (
    "傻逼", "滚", "白痴", "废物", "去死", "妈的", "操你", "idiot", "stupid", "moron", "shut up", "fuck", "shit", "damn", "screw you",
)
ADS = (
    "加微信", "加v", "加V", "代购", "刷单", "兼职", "引流", "互赞", "推广", "add my wechat", "add wechat", "promotion service", "dropship", "drop ship",
    "brush orders", "buy followers", "collaborate with us", "advertise here",
)
MEANINGLESS = (
    "在?", "在？", "在吗", "在么", "1", "。", ".", "?", "？", "hi", "hello", "你好", "有人吗", "test", "11", "hey", "hey?", "yo", "ok", "hi?",
)


def first_hit(text: Column, phrases: tuple[str, ...]) -> Column:
    """The first phrase of the list (in list order) that the lower-cased text contains, or null."""
    return F.when(any_hit(text, phrases), F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(p.lower())), p) for p in phrases]))


def any_hit(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains one of the phrases: a single pattern."""
    return F.lower(text).rlike("|".join(re.escape(p.lower()) for p in phrases))


def is_meaningless(text: Column) -> Column:
    bare = strip(F.coalesce(text, F.lit("")))
    return F.lower(bare).isin(*MEANINGLESS) | (F.length(bare) <= 1)


def detect_intent(text: Column | str) -> Column:
    """struct(handoff, reason, abuse, ad, meaningless, sub_intents, language). A wish for a person comes
    before a risk word, a risk word before refund with anger."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    risk, refund = first_hit(t, RISK), first_hit(t, REFUND)
    reason = (
        F.when(any_hit(t, HANDOFF), "asked for a person")
        .when(risk.isNotNull(), F.concat(F.lit("risk: "), risk))
        .when(refund.isNotNull() & any_hit(t, NEGATIVE), F.concat(F.lit("refund with anger: "), refund))
        .otherwise("")
    )
    return F.struct(
        (reason != "").alias("handoff"), reason.alias("reason"), any_hit(t, ABUSE).alias("abuse"), any_hit(t, ADS).alias("ad"),
        is_meaningless(t).alias("meaningless"), split_sub_intents(t).alias("sub_intents"), detect_language(t).alias("language"),
    )


def turn_route(
    intent: Column, channel_on: Column, status: Column, in_stop_window: Column, stop_fired: Column, low_confidence: Column, has_hits: Column,
    clarify_count: Column, clarify_rounds: Column, policy: Column, has_page: Column, context_answer: Column, overview_answer: Column, model_up: Column,
) -> Column:
    """The path of a turn: the first rule that applies. A message with page content is never of low
    confidence; the answers that a model gave from context or overview are columns."""
    low = low_confidence & ~has_page
    return (
        F.when(~channel_on, "channel_off")
        .when(status == "stopped", "session_stopped")
        .when(in_stop_window, "stop_window")
        .when(stop_fired, "stop_condition")
        .when(intent["handoff"], "handoff_forced")
        .when(intent["abuse"], "abuse")
        .when(intent["ad"], "ad")
        .when(intent["meaningless"], "meaningless")
        .when(low & ~has_hits & context_answer, "ctx_fallback")
        .when(low & ~has_hits & overview_answer, "overview_fallback")
        .when(low & (policy == "clarify") & (clarify_count < clarify_rounds), "lowconf_clarify")
        .when(low & (policy == "fallback") & has_hits, "lowconf_fallback")
        .when(low, "handoff_lowconf")
        .when(~model_up, "llm_unavailable")
        .otherwise("normal")
    )


def in_stop_window(at: Column, zone: Column, rules: Column) -> Column:
    """Whether a local time falls into a rule (days with 0 = Monday, start, end 'HH:MM', both inclusive; an
    end before the start passes midnight; the day is the message's own). Bad rules never match."""
    zones = F.when(zone.rlike(r"^[A-Za-z_]+/[A-Za-z_/]+$|^UTC$"), zone).otherwise(F.lit("UTC"))
    local = F.from_utc_timestamp(at, zones)
    minute = F.hour(local) * 60 + F.minute(local)
    day = F.weekday(local)

    def of(clock: Column) -> Column:
        good = clock.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$")
        return F.when(good, F.substring_index(clock, ":", 1).try_cast("int") * 60 + F.substring_index(clock, ":", -1).try_cast("int"))

    def holds(rule: Column) -> Column:
        start, end = of(rule["start"]), of(rule["end"])
        inside = F.when(start <= end, minute.between(start, end)).otherwise((minute >= start) | (minute <= end))
        return F.coalesce(F.array_contains(rule["days"], day) & start.isNotNull() & end.isNotNull() & inside, F.lit(False))

    return F.exists(rules, holds)
