"""Column functions over metric sentences: values, natures, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.text import conflict_text

#: The literals of a metric sentence in French and English, without accents.
NUMBER = r"[-+]?\d+(?:(?:[ . ]\d{3})+|(?:[.,]\d+))?"
SCALE = r"(?:k|thousand|thousands|millier(?:s)?|million(?:s)?|milliard(?:s)?|billion|billions|bn)"
SUB_ANNUAL = (
    r"\b(?:q[1-4]|t[1-4]|h[12]|s[12]|quarters?|trimestres?|semesters?|semestres?|first[ -]half|second[ -]half|half[ -]year|year[ -]to[ -]date|ytd|ttm|ltm"
    r"|trailing[ -]twelve[ -]months?|last[ -]twelve[ -]months?|rolling(?:[ -]year)?|premier[ -]semestre|second[ -]semestre|months?|mois|janvier|fevrier|mars"
    r"|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre|january|february|march|april|may|june|july|august|september|october|november|december)\b"
)
FISCAL = r"\b(?:fy|fiscal(?:[ -]year)?|financial(?:[ -]year)?|exercice|annee fiscale)\b"
CALENDAR = r"\b(?:calendar(?:[ -]year)?|annee (?:civile|calendaire))\b"
PAST = r"(?:publi(?:e|ee|es|ees)|declar(?:e|ee|es|ees)|declared|reported|audited|estim(?:e|ee|es|ees|ated)|verifi(?:e|ee|es|ees)|verified)"
#: The same without `declared`, as the second pattern of denial has it.
PAST_NE = PAST.replace("|declared", "")
DENIED = [
    r"\b(?:non(?:\s+encore)?|pas(?:\s+encore)?|jamais|not(?:\s+yet)?|never)\b(?:[\s-]+\p{L}+){0,3}[\s-]+" + PAST + r"\b",
    r"\b(?:ne|n)\b.{0,24}\b(?:pas|jamais)\b.{0,24}\b" + PAST_NE + r"\b",
    r"\b(?:unpublished|undeclared|unaudited|unreported|unverified)\b",
    r"\b(?:contest(?:e|ee|es|ees)|disputed|incertain(?:e|es|s)?|uncertain)\b",
]
PUBLISHED = r"\b(?:publi(?:e|ee|es|ees)|declar(?:e|ee|es|ees)|declared|reported|audited)\b"
ESTIMATED = (
    r"\b(?:estim(?:e|ee|es|ees|ated)|forecast(?:ed)?|prevision(?:nel(?:le)?)?|expected|projected|target(?:ed)?|guidance|budgeted|preliminary|provisional"
    r"|attendu(?:e|es|s)?|projete(?:e|es|s)?|objectif|budgete(?:e|es|s)?|preliminaire|provisoire)\b"
)
CURRENCIES = {
    "EUR": r"(?:€|\beur\b|\beuros?\b)", "USD": r"\busd\b|\bus dollars?\b|\bdollars? americains?\b",
    "GBP": r"(?:£|\bgbp\b|\bpounds? sterling\b|\blivres? sterling\b)", "CHF": r"\bchf\b|\bfrancs? suisses?\b",
    "CAD": r"\bcad\b|\bcanadian dollars?\b|\bdollars? canadiens?\b", "AUD": r"\baud\b|\baustralian dollars?\b|\bdollars? australiens?\b",
    "JPY": r"\bjpy\b|\byens?\b", "CNY": r"\bcny\b|\byuans?\b|\brenminbi\b",
}


def literal_value(raw: Column) -> Column:
    """A written number: the last of comma and dot is decimal; one kind alone groups thousands if all groups are of three."""
    x = F.regexp_replace(raw, r"[  ]", "")
    both_comma = F.regexp_replace(F.regexp_replace(x, r"\.", ""), ",", ".")
    both_dot = F.regexp_replace(x, ",", "")
    grouped = x.rlike(r"^[-+]?\d+(?:[.,]\d{3})+$")
    canonical = (
        F.when(x.contains(",") & x.contains("."), F.when(x.rlike(r"\..*,"), both_comma).otherwise(both_dot))
        .when(grouped, F.regexp_replace(x, "[.,]", ""))
        .otherwise(F.regexp_replace(x, ",", "."))
    )
    return canonical.try_cast("double")


def scale_factor(word: Column) -> Column:
    w = F.lower(F.coalesce(word, F.lit("")))
    return (
        F.when(w == "", F.lit(1.0)).when(w.rlike("^(k|thousands?|milliers?)$"), 1e3).when(w.rlike("^millions?$"), 1e6).when(w.rlike("^(milliards?|billions?|bn)$"), 1e9)
    )


def metric_value(text: Column) -> Column:
    """The one distinct number of a sentence, years of 1900 to 2100 left out; null if there is none or more."""
    # the first test is cheap, and fails at nearly every character of a long text
    pattern = r"(?i)(?=[-+\d])(?<![\p{L}\d])(" + NUMBER + r")(?:\s*(" + SCALE + "))?"

    def one(found: Column) -> Column:
        raw, word = F.regexp_extract(found, pattern, 1), F.regexp_extract(found, pattern, 2)
        value = literal_value(raw) * scale_factor(word)
        year = (word == "") & raw.rlike(r"^\d{4}$") & (literal_value(raw) >= 1900) & (literal_value(raw) <= 2100)
        unclear = (word != "") & raw.rlike(r"^[-+]?\d+[.,]\d{3}$")
        return F.when(~year & ~unclear, value)

    values = F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)))
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def period_key(text: Column, normal: bool = False) -> Column:
    """year|fiscal or year|calendar of a sentence with exactly one year and one basis and no part of a year.

    normal: the text is in conflict form already."""
    t = text if normal else conflict_text(text)
    years = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)))
    fiscal, calendar = t.rlike(FISCAL), t.rlike(CALENDAR)
    ok = ~t.rlike(SUB_ANNUAL) & (F.size(years) == 1) & (fiscal != calendar)
    return F.when(ok, F.concat(F.element_at(years, 1), F.lit("|"), F.when(fiscal, "fiscal").otherwise("calendar")))


def value_nature(text: Column, normal: bool = False) -> Column:
    """published, estimated or unknown; denied, disputed, both and neither are unknown."""
    t = text if normal else conflict_text(text)
    denied = F.lit(False)
    for pattern in DENIED:
        denied = denied | t.rlike(pattern)
    published, estimated = t.rlike(PUBLISHED), t.rlike(ESTIMATED)
    return F.when(denied | (published == estimated), "unknown").when(published, "published").otherwise("estimated")


def currency(text: Column) -> Column:
    """Currencies named in a sentence, as a list."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), c) for c, p in CURRENCIES.items()]))
