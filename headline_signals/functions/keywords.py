"""Keyword categories and matching (K1, K4).

``match="substring"`` (the reference's rule) tests ``word in text``: "ai" counts in
"said". ``match="word"`` needs the word bounded by non-alphanumerics; single words are
looked up in the text's token array (one split per text, then a hash intersection),
multi-word phrases by a bounded regex. ``mention_counts`` finds the same for many lists
at once, on batches of texts (``word_match``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .word_match import counter, plain

# The eight keyword categories and their words, in the reference's order.
KEYWORDS: dict[str, list[str]] = {
    "bullish": ["surge", "soar", "rally", "gain", "rise", "up", "high", "record", "breakthrough"],
    "bearish": ["fall", "drop", "decline", "down", "low", "crash", "plunge", "threat", "risk"],
    "fed_monetary": ["fed", "federal reserve", "interest rate", "monetary policy", "powell",
                     "rate cut", "rate hike"],
    "earnings": ["earnings", "revenue", "profit", "guidance", "beat", "miss", "forecast"],
    "trade_tariffs": ["tariff", "trade war", "trade", "china", "trump", "trade deal"],
    "tech_ai": ["ai", "artificial intelligence", "technology", "semiconductor", "tech",
                "nvidia", "tesla"],
    "geopolitical": ["war", "conflict", "sanctions", "russia", "ukraine", "military", "threat"],
    "economic": ["gdp", "inflation", "unemployment", "economic", "recession", "growth",
                 "recovery"],
}

TOKEN_SPLIT = "[^a-z0-9]+"


def tokens(lowered: Column) -> Column:
    """Alphanumeric tokens of lower-cased text."""
    return F.split(lowered, TOKEN_SPLIT)


def _phrase_hit(lowered: Column, phrase: str) -> Column:
    return lowered.rlike(r"(^|[^a-z0-9])" + phrase + r"([^a-z0-9]|$)")


def _check(match: str) -> None:
    if match not in ("substring", "word"):
        raise ValueError(f"match must be 'substring' or 'word', not {match!r}")


def mention_count(lowered: Column, words: list[str], match: str = "substring",
                  toks: Column | None = None) -> Column:
    """How many distinct category words occur in the (lower-cased) text (K1).

    Null text counts 0. ``toks`` may pass a precomputed ``tokens(lowered)``.
    """
    _check(match)
    if match == "substring":
        total = F.lit(0)
        for w in words:
            total = total + F.coalesce(lowered.contains(w).cast("int"), F.lit(0))
        return total
    singles = [w for w in words if " " not in w]
    phrases = [w for w in words if " " in w]
    toks = tokens(lowered) if toks is None else toks
    # explicit null test: size(null) is -1, not null, when ANSI mode is off
    total = (F.when(lowered.isNull(), F.lit(0))
             .otherwise(F.size(F.array_intersect(toks, F.array(*[F.lit(w) for w in singles]))))
             if singles else F.lit(0))
    for p in phrases:
        total = total + F.coalesce(_phrase_hit(lowered, p).cast("int"), F.lit(0))
    return total


#: From so many words on, the lists are matched in one pass over the text (``word_match``).
MANY_WORDS = 1


def mention_counts(lowered: Column, lists: list[list[str]], match: str = "substring", many: int = MANY_WORDS) -> Column:
    """``mention_count`` of every list as one array column. From ``many`` words on, texts are matched by
    batches, each read once whatever the number of words; whole words that are not plain ones
    (``word_match.plain``) are left to ``mention_count``."""
    _check(match)
    words = [w for ws in lists for w in ws]
    if len(words) < many or (match == "word" and not plain(words)):
        toks = tokens(lowered) if match == "word" else None
        return F.array(*[mention_count(lowered, ws, match, toks).cast("int") for ws in lists])
    return F.arrow_udf(counter(lists, match == "word"), "array<int>")(lowered)


def hit_columns(keywords: dict[str, list[str]]) -> list[str]:
    """Names of the per-text match columns added by ``keyword_hits``."""
    return [c for cat in keywords for c in (f"_kw_{cat}_n", f"_kw_{cat}_hit")]


def keyword_hits(df, text_col: str = "Headline", keywords: dict[str, list[str]] | None = None,
                 match: str = "substring", many: int = MANY_WORDS):
    """Add per-text match columns (``_kw_<cat>_n`` int, ``_kw_<cat>_hit`` boolean), all categories in one pass
    over the text (``mention_counts``).

    Run it on a table of distinct texts and join the result, so that each text is
    matched once however many rows refer to it.
    """
    keywords = KEYWORDS if keywords is None else keywords
    if not keywords:
        return df
    found = mention_counts(F.lower(F.col(text_col)), list(keywords.values()), match, many)
    df = df.withColumn("_kw_counts", found)
    cols = {}
    for i, cat in enumerate(keywords):
        n = F.col("_kw_counts")[i]
        cols[f"_kw_{cat}_n"] = n
        cols[f"_kw_{cat}_hit"] = n > 0
    return df.withColumns(cols).drop("_kw_counts")
