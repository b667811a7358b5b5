"""Column functions over text: normal forms, tokens, profiles.

Unicode normal forms are not in Spark SQL: they are Arrow UDFs, sent only texts that are not ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the mechanical form: characters read as the one they are set against.
QUOTES = {"«»“”„‟": '"', "ʼ‘’‚‛‹›": "'", "‐‑‒–—―": "-"}
ZERO_WIDTH = "​‌‍⁠﻿"
SPACE = r"[\s\u0085   -     　]"
SECRETS = r"(?i)(secret|token|api[_-]?key|authorization|password|credential|signature|bearer|sk-[a-z0-9_-]+)"
NAVIGATION = r"(?i)\b(accueil|about|contact|home|menu|navigation|privacy|mentions légales)\b"


def _form(name: str, strip_marks: bool):
    @F.pandas_udf(T.StringType())
    def normal(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            x = unicodedata.normalize(name, x)
            return "".join(c for c in x if not unicodedata.category(c).startswith("M")) if strip_marks else x

        return s.map(one, na_action="ignore")

    return normal


_NFKC = _form("NFKC", False)


def _bare_letters(form: str) -> tuple[str, str]:
    """Characters that decompose to one character and marks, and what is left of them: a rule, for translate()."""
    source, target = [], []
    for code in [*range(0x80, 0x2100), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.category(x).startswith("M"))
        if len(bare) == 1 and bare != c:
            source.append(c)
            target.append(bare)
    return "".join(source), "".join(target)


_BARE = {form: _bare_letters(form) for form in ("NFKD", "NFD")}
#: Compatibility characters that stand for several letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "...", "™": "TM"}


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _unless_ascii(c: Column, f) -> Column:
    # a Python function is evaluated for every row whatever stands around it: ASCII texts go to it as null
    plain = _ascii(c)
    return F.when(plain, c).otherwise(f(F.when(~plain, c)))


def nfkc(c: Column) -> Column:
    return _unless_ascii(c, _NFKC)


def without_marks(c: Column, form: str = "NFKD") -> Column:
    """Decomposed text without combining marks, in JVM functions only."""
    x = F.translate(c, *_BARE[form])
    if form == "NFKD":
        for k, v in LIGATURES.items():
            x = F.replace(x, F.lit(k), F.lit(v))
    return F.regexp_replace(x, r"\p{M}+", "")


# What follows is asked for whole documents: a pattern tries each character, a search for one that is rarely there costs a hundredth of that.


def _steps(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """The steps one after the other. Each reads the one before as a lambda variable, which is computed once however often it is named."""
    return F.element_at(reduce(F.transform, steps, F.array(c)), 1)


def _any(v: Column, characters: str) -> Column:
    return reduce(Column.__or__, [v.contains(k) for k in characters])


def _single_spaces(v: Column) -> Column:
    return F.when(v.contains("  "), F.regexp_replace(v, " {2,}", " ")).otherwise(v)


BREAKS = "\r\u0085\u2028\u2029"
WIDE_SPACES = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Spaces but " " and line breaks, as NFKC leaves them.
NARROW = "\t\x0b\f" + "".join(k for k in WIDE_SPACES if k not in BREAKS and unicodedata.normalize("NFKC", k) == k)


def visible_text(c: Column) -> Column:
    """NFKC; line breaks as LF, other space runs as one space, lines trimmed, empty ones dropped."""
    return _steps(
        nfkc(c),
        lambda v: F.when(_any(v, BREAKS), F.regexp_replace(v, f"\r\n|[{BREAKS}]", "\n")).otherwise(v),
        lambda v: F.when(_any(v, NARROW), F.regexp_replace(v, f"[{NARROW}]", " ")).otherwise(v),
        lambda v: F.array_join(F.filter(F.transform(F.split(v, "\n"), lambda x: F.trim(_single_spaces(x))), lambda x: x != ""), "\n"),
    )


def mechanical_form(visible: Column) -> Column:
    """Mechanical form of a visible text: lower case, one space for any run, plain quotes and dashes, no soft hyphens, no
    zero-width characters beside space or punctuation."""
    narrow, spaces = "\t\x0b\f\r", "\n\t\x0b\f\r" + WIDE_SPACES
    # soft hyphens stand last: what has no counterpart is dropped
    source = spaces + "".join(QUOTES) + "\u00ad"
    target = " " * len(spaces) + "".join(v * len(k) for k, v in QUOTES.items())
    return _steps(
        visible,
        lambda v: F.when(_any(v, ZERO_WIDTH), F.regexp_replace(v, f"(?<=^|[\\s\\p{{P}}])[{ZERO_WIDTH}]+|[{ZERO_WIDTH}]+(?=$|[\\s\\p{{P}}])", "")).otherwise(v),
        lambda v: F.when(_ascii(v) & ~_any(v, narrow), F.replace(v, F.lit("\n"), F.lit(" "))).otherwise(F.replace(F.translate(v, source, target), F.lit("\u2026"), F.lit("..."))),
        lambda v: F.trim(F.lower(_single_spaces(v))),
    )


def mechanical_key(c: Column) -> Column:
    """Comparison key: the mechanical form without a final period."""
    return F.rtrim(F.regexp_replace(mechanical_form(visible_text(c)), r"\.$", ""))


def conflict_text(c: Column) -> Column:
    """NFKD without marks, one space for any run, trimmed, lower case; empty for null."""
    return F.lower(F.trim(F.regexp_replace(without_marks(F.coalesce(c, F.lit(""))), f"{SPACE}+", " ")))


def plain_key(c: Column) -> Column:
    """Lower case, one space for any run, trimmed; empty for null."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " ")))


def halves(c: Column) -> tuple[Column, Column]:
    """128 bits of hash of a text in two numbers of fixed width; null for null."""
    return F.when(c.isNotNull(), F.xxhash64(c)), F.when(c.isNotNull(), F.xxhash64(F.lit(1), c))


def several(a: Column, b: Column) -> Column:
    """Aggregate over halves(): true if two texts differ. Unlike a distinct count it has one group a key and combines before the shuffle."""
    return F.coalesce((F.min(a) != F.max(a)) | (F.min(b) != F.max(b)), F.lit(False))


def context_tokens(c: Column) -> Column:
    """Words of letters and digits, lower case, marks dropped."""
    return F.regexp_extract_all(F.lower(without_marks(visible_text(c), "NFD")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sequence_starts(hay: Column, needle: Column) -> Column:
    """0-based starts of one token list inside another; none for an empty one."""
    # bound once as lambda variables: what stands inside a lambda is computed for each element. Words are compared one by one, as slice() copies
    # the whole list for each start

    def starts(p: Column) -> Column:
        h, w = p["h"], p["w"]
        last = F.size(h) - F.size(w)
        all_ = F.when((last >= 0) & (F.size(w) > 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        same = lambda i, k: F.get(h, i + k).eqNullSafe(F.get(w, k))
        return F.filter(all_, lambda i: same(i, F.lit(0)) & F.forall(F.sequence(F.lit(0), F.size(w) - 1), lambda k: same(i, k)))

    return F.element_at(F.transform(F.array(F.struct(hay.alias("h"), needle.alias("w"))), starts), 1)


def masked(c: Column) -> Column:
    """Empty if the text looks like it holds a secret."""
    return F.when(c.rlike(SECRETS), "").otherwise(c)


def profile(c: Column) -> dict[str, Column]:
    """Shape of an excerpt, as the quality rules test it."""
    t = visible_text(c)
    n = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    return {
        "code_points": F.length(t).cast("long"),
        "words": n(r"[\p{L}\p{N}]+"),
        "letters": n(r"\p{L}"),
        "separators": n(r"[|/•·:;+_-]"),
        "navigation": n(NAVIGATION),
        "sentences": F.size(F.filter(F.split(t, r"(?<=[.!?])\s+(?=[\p{Lu}\d])"), lambda x: F.trim(x) != "")).cast("long"),
        "clauses": F.size(F.filter(F.split(t, r"\s*[;•]\s*"), lambda x: F.regexp_count(x, F.lit(r"[\p{L}\p{N}]+")) >= 4)).cast("long"),
        "question": t.rlike(r"[?？]\s*$"),
    }


def weak(p: dict[str, Column]) -> Column:
    return (p["code_points"] < 24) | (p["words"] < 4) | (p["letters"] < 12) | (p["separators"] >= 2) | (p["navigation"] >= 2)


def compound(p: dict[str, Column]) -> Column:
    return (p["sentences"] > 1) | (p["clauses"] > 1)
