"""Intent tagging of messages by ordered pattern rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenmart.functions.text import any_of, folded

# Intents in order of precedence with their patterns.
INTENT_RULES: Mapping[str, Sequence[str]] = {
    "HELP": (r"\bhelp\b", r"\baiuto\b", r"cosa puoi fare"),
    "SYSTEM_STATUS": (r"system status", r"stato (?:del )?(?:radar|connettori)", r"radar funziona"),
    "COMPARE_PRODUCTS": (r"\bcompare\b", r"\bconfronta\b", r"differenze tra"),
    "NEW_VS_USED": (r"new or used", r"nuov[oa] o usat[oa]", r"meglio nuov", r"conviene il nuovo"),
    "EXPLAIN_RECOMMENDATION": (r"why (?:buy|recommend)", r"perch[eé].*(?:consiglia|raccomanda)", r"spiegami il punteggio"),
    "EXPLAIN_WARNING": (r"explain.*warning", r"spiega.*avvis", r"perch[eé].*warning"),
    "MARKET_SUMMARY": (r"market price", r"quanto vale", r"prezzo medio", r"andamento mercato"),
    "LISTING_SUMMARY": (r"listing summary", r"riassumi.*annuncio", r"questo annuncio"),
    "WISHLIST_STATUS": (r"wishlist", r"cosa sto monitorando"),
    "INVENTORY_STATUS": (r"inventory", r"inventario", r"cosa possiedo"),
    "PRODUCT_OVERVIEW": (r"tell me about", r"parlami", r"\bscheda\b"),
}
# The same shape of table for text in an invented language.
SAMPLE_RULES: Mapping[str, Sequence[str]] = {
    "HELP": ("that for ", "de la "),
    "COMPARE_PRODUCTS": (" und ", "que des "),
    "MARKET_SUMMARY": ("of the ", "ción"),
    "LISTING_SUMMARY": (" the ",),
    "PRODUCT_OVERVIEW": (" le ", " die "),
}


def intent(message: Column, rules: Mapping[str, Sequence[str]] = INTENT_RULES) -> Column:
    """struct(intent, confidence): first matching rule, surer when it is the only one."""
    text = folded(message)
    hits = {name: any_of(text, patterns) for name, patterns in rules.items()}
    name = F.lit("UNSUPPORTED")
    for label in reversed(list(rules)):
        name = F.when(hits[label], label).otherwise(name)
    count = sum((flag.cast("int") for flag in hits.values()), F.lit(0))
    confidence = F.when(count == 0, 25).when(count == 1, 95).otherwise(85)
    return F.struct(name.alias("intent"), confidence.alias("confidence"))


def volume(messages: DataFrame, text: Column, keys: Sequence[str], rules: Mapping[str, Sequence[str]] = INTENT_RULES) -> DataFrame:
    """Messages per intent and confidence."""
    tagged = messages.select(*keys, intent(text, rules).alias("tag"))
    return tagged.groupBy(*keys, F.col("tag.intent").alias("intent"), F.col("tag.confidence").alias("confidence")).agg(
        F.count(F.lit(1)).alias("messages"))
