"""Transparent rule tables over text: weak labels, audit features, priorities.

A rule is (label, pattern, weight, reason).  The table is compiled into column expressions,
so all rules run inside one projection, without a Python function and without a join.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import match_form


class Rule(NamedTuple):
    label: str
    pattern: str
    weight: int
    reason: str


#: The support lexicon; patterns are matched on lower-case normalised text.
SUPPORT_LEXICON = (
    Rule("software_update", r"\b(ios\s*11|high\s*sierra|macos|ios\s*update|new\s*update|latest\s*update|software\s*update|system\s*update)\b", 2, "os_update_version_mention"),
    Rule("software_update", r"\b(question\s*mark|question\s*marks|letter\s*i\b)", 2, "ios11_autocorrect_bug"),
    Rule("software_update", r"\b(after\s*the\s*update|since\s*the\s*update|updated\s*my\s*phone|update\s*glitch|update\s*bug)\b", 2, "post_update_malfunction"),
    Rule("software_update", r"\b(update|updated|upgrade|upgraded|patch)\b", 1, "update_keyword"),
    Rule("battery_power", r"\b(battery\s*drain|battery\s*draining|battery\s*life|battery\s*percentage|battery\s*dies|battery\s*dropping)\b", 2, "battery_drain_phrase"),
    Rule("battery_power", r"\b(overheating|phone\s*gets\s*hot|phone\s*hot|charging\s*cable|charger\s*cable|won't\s*charge|not\s*charging)\b", 2, "power_charging_overheat"),
    Rule("battery_power", r"\b(battery|charger|charging|recharge|power\s*bank)\b", 1, "battery_keyword"),
    Rule("device_hardware", r"\b(cracked\s*screen|broken\s*screen|shattered\s*screen|screen\s*cracked|display\s*cracked)\b", 2, "screen_damage_phrase"),
    Rule("device_hardware", r"\b(touch\s*screen\s*not\s*working|screen\s*unresponsive|touch\s*unresponsive|unresponsive\s*screen)\b", 2, "touch_screen_failure"),
    Rule("device_hardware", r"\b(camera\s*black|camera\s*not\s*working|front\s*camera|speaker\s*crackling|microphone\s*not\s*working|home\s*button\s*broken|power\s*button\s*stuck|water\s*damage)\b", 2, "hardware_component_defect"),
    Rule("device_hardware", r"\b(hardware|screen|display|speaker|camera|mic|microphone)\b", 1, "hardware_keyword"),
    Rule("account_access", r"\b(apple\s*id|icloud|itunes\s*account|verification\s*code|two\s*factor|2fa|security\s*questions?)\b", 2, "account_security_phrase"),
    Rule("account_access", r"\b(account\s*(locked|disabled|suspended)|forgot\s*password|reset\s*password|can't\s*log\s*in|can't\s*sign\s*in)\b", 2, "account_access_failure"),
    Rule("account_access", r"\b(account|login|log\s*in|sign\s*in|passcode|password)\b", 1, "login_keyword"),
    Rule("connectivity_network", r"\b(wi-?fi|bluetooth|cellular\s*data|mobile\s*data|no\s*service|sim\s*card|airpods\s*disconnect|dropped\s*calls?)\b", 2, "network_connectivity_phrase"),
    Rule("connectivity_network", r"\b(disconnecting\s*from\s*wifi|won't\s*connect\s*to\s*wifi|can't\s*connect\s*to\s*wifi|bluetooth\s*won't\s*pair)\b", 2, "connection_pairing_issue"),
    Rule("connectivity_network", r"\b(wifi|bluetooth|lte|4g|sim|carrier|signal|hotspot)\b", 1, "connectivity_keyword"),
    Rule("billing_payment", r"\b(unexpected\s*charge|charged\s*twice|apple\s*pay|refund\s*request|request\s*a\s*refund|unauthorized\s*charge|subscription\s*renewal)\b", 2, "billing_dispute_phrase"),
    Rule("billing_payment", r"\b(billed|charged|receipt|subscription|refund|in-?app\s*purchase|credit\s*card|debit\s*card)\b", 1, "billing_keyword"),
    Rule("order_shipping", r"\b(tracking\s*number|package\s*delivered|shipment\s*status|preparing\s*for\s*shipment|store\s*pickup|online\s*order)\b", 2, "order_tracking_phrase"),
    Rule("order_shipping", r"\b(fedex|ups|shipped|shipping|delivery|dispatch|dispatched)\b", 1, "shipping_keyword"),
    Rule("app_or_service_issue", r"\b(apple\s*music|imessage|facetime|app\s*store|safari|apple\s*maps|carplay|airdrop|siri|apple\s*podcasts)\b", 2, "native_app_service_name"),
    Rule("app_or_service_issue", r"\b(app\s*crashes|app\s*crashing|app\s*keeps\s*closing|app\s*freezing|can't\s*download\s*apps?)\b", 2, "app_malfunction_phrase"),
    Rule("feature_how_to", r"\b(how\s*do\s*i|how\s*can\s*i|is\s*there\s*a\s*way\s*to|can\s*you\s*tell\s*me\s*how|how\s*to)\b", 2, "how_to_inquiry_starter"),
    Rule("feature_how_to", r"\b(where\s*is\s*the\s*setting|how\s*does\s*one)\b", 1, "configuration_inquiry"),
    Rule("complaint_feedback", r"\b(fix\s*your\s*shit|fix\s*this\s*shit|worst\s*phone|hate\s*apple|terrible\s*customer\s*service|worst\s*company|horrible\s*update)\b", 2, "strong_complaint_phrase"),
    Rule("complaint_feedback", r"\b(ridiculous|unacceptable|disappointed|waste\s*of\s*money|garbage)\b", 1, "negative_sentiment_keyword"),
)

FALLBACK, REVIEW = "unknown_other", "needs_review"


def label_order(rules: tuple[Rule, ...]) -> list[str]:
    return list(dict.fromkeys(r.label for r in rules))


def scores(text: Column, rules: tuple[Rule, ...]) -> Column:
    """``array<struct<neg, ord, label, why>>`` of the labels above zero, best first, ties in the order of the table."""
    parts = []
    for i, label in enumerate(label_order(rules)):
        total = reduce(lambda a, b: a + b, [F.when(text.rlike("(?U)" + r.pattern), r.weight).otherwise(0) for r in rules if r.label == label])
        why = F.array_compact(F.array(*[F.when(text.rlike("(?U)" + r.pattern), F.lit(r.reason)) for r in rules if r.label == label]))
        parts.append(F.struct((-total).alias("neg"), F.lit(i).alias("ord"), F.lit(label).alias("label"), why.alias("why")))
    return F.array_sort(F.filter(F.array(*parts), lambda x: x["neg"] < 0))


def weak_labels(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = SUPPORT_LEXICON) -> DataFrame:
    """``df`` with ``label, label_source, label_reason, label_confidence, matched`` (struct ``rule_``).

    Texts of less than eight characters or two words, and texts without a match, get the
    fallback.  The best two labels equal, or both of two and more, ask for review.  A winner of
    two and more is ``high``, else ``medium``.  Null texts count as empty."""
    norm = df.withColumn("__n", match_form(text_col))
    s = norm.withColumn("__s", scores(F.col("__n"), rules))
    top, second = F.try_element_at("__s", F.lit(1)), F.try_element_at("__s", F.lit(2))
    short = (F.length("__n") < 8) | (F.size(F.split("__n", " ")) <= 1)
    clash = second.isNotNull() & ((top["neg"] == second["neg"]) | ((top["neg"] <= -2) & (second["neg"] <= -2)))
    rivals = F.array_join(F.transform(F.filter("__s", lambda x: x["neg"] <= second["neg"]), lambda x: F.concat(F.lit("'"), x["label"], F.lit("'"))), ", ")
    def verdict(label, source, reason, confidence):
        return F.struct(label.alias("label"), F.lit(source).alias("source"), reason.alias("reason"), confidence.alias("confidence"))

    fallback, low = F.lit(FALLBACK), F.lit("low")
    pick = (
        F.when(short, verdict(fallback, "fallback", F.lit("too_short_or_conversational"), low))
        .when(F.size("__s") == 0, verdict(fallback, "fallback", F.lit("no_matching_rules_found"), low))
        .when(clash, verdict(F.lit(REVIEW), REVIEW, F.concat(F.lit("conflicting_rules_matched: ["), rivals, F.lit("]")), low))
        .otherwise(verdict(top["label"], "rule", F.concat(F.lit("matched: "), F.array_join(top["why"], ", ")), F.when(top["neg"] <= -2, "high").otherwise("medium")))
    )
    matched = F.array_join(F.array_sort(F.transform("__s", lambda x: x["label"])), "|")
    return s.withColumn("__p", pick).select(
        *df.columns, F.col("__p.label").alias("rule_label"), F.col("__p.source").alias("rule_source"), F.col("__p.reason").alias("rule_reason"),
        F.col("__p.confidence").alias("rule_confidence"), matched.alias("rule_matched"), F.size("__s").alias("rule_match_count"),
    )


def review_priority(df: DataFrame) -> DataFrame:
    """``priority`` of labelled rows: overlaps first, then unsure labels, then low confidence."""
    p = (
        F.when(F.col("rule_match_count") > 1, "critical")
        .when(F.col("rule_label").isin("software_update", FALLBACK, REVIEW), "high")
        .when(F.col("rule_confidence").isin("low", "medium"), "medium")
        .otherwise("normal")
    )
    return df.withColumn("priority", p)
