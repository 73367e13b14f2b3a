"""Column-level text helpers (all JVM-side expressions, no UDFs).

Each helper returns a ``Column``; the matching DuckDB spelling used by the
oracle SQL lives next to it as ``*_SQL`` so both sides read the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour (kept verbatim).
# ---------------------------------------------------------------------------
# URL detector used by the cleaning filters.
URL_PATTERN = r"https?://[^\s/$.?#].[^\s]*"
# Anchored "text is only a URL" test used by the masker.
URL_ONLY_PATTERN = r"^\s*https?://[^\s]+\s*$"
# Mask token.
MASK_TOKEN = "[MASKED]"
# High-priority opinion words that are always masked.
HIGH_PRIORITY_LEXICON = [
    "stupid", "idiot", "moron", "clown", "liar", "scumbag", "traitor", "criminal",
    "disgraceful", "shameful", "lunatic", "awful", "terrible", "horrible", "worst",
    "pos", "warrior", "hero", "villain", "disgusting", "pathetic", "failed", "conned",
]
# Artifacts that halve the format-compliance score of a post prediction.
FORMAT_ARTIFACTS = ["Post:", "Completed Tweet:", "**", "flexed!"]
# Prefixes removed from a prediction before comparison.
PREDICTION_PREFIXES = ["Post:", "Completed Tweet:"]

# Emoji code-point ranges (Java 17 has no \p{IsEmoji}); pictographs, symbols,
# dingbats, flags, variation selector and joiner are treated as emoji.
EMOJI_CLASS = (
    "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2300}-\\x{23FF}\\x{2B00}-\\x{2BFF}"
    "\\x{1F1E6}-\\x{1F1FF}\\x{FE0F}\\x{200D}\\x{3030}\\x{303D}\\x{3297}\\x{3299}"
    "\\x{00A9}\\x{00AE}\\x{203C}\\x{2049}\\x{2122}\\x{2139}\\x{2194}-\\x{21AA}]"
)


def is_blank(c: Column) -> Column:
    """Null, empty or whitespace-only text."""
    return F.coalesce(c.rlike(r"^\s*$"), F.lit(True))


def blank_to_null(c: Column) -> Column:
    """P1: '', 'nan', 'None', 'NaN', '"NaN"' and NULL all mean "missing"."""
    return F.when(~F.trim(c).isin("", "nan", "None", "NaN", '"NaN"', "null"), c)


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words (null text -> 0)."""
    return F.coalesce(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")), F.lit(0))


def contains_url(c: Column) -> Column:
    """P5: text contains a URL (null -> false)."""
    return F.coalesce(c.rlike(URL_PATTERN), F.lit(False))


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL_PATTERN, "")


def is_only_url(c: Column) -> Column:
    """Text is non-blank and consists of URLs and whitespace only."""
    return ~is_blank(c) & is_blank(strip_urls(c))


def url_without_context(c: Column, min_words: int = 5) -> Column:
    """Text has a URL but fewer than ``min_words`` words longer than 2 chars."""
    rest = F.split(strip_urls(c), r"\s+")
    meaningful = F.size(F.filter(rest, lambda w: F.length(w) > 2))
    return F.coalesce(contains_url(c) & (meaningful < min_words), F.lit(False))


def is_only_emoji(c: Column) -> Column:
    """Non-blank text made only of emoji code points and whitespace."""
    return ~is_blank(c) & is_blank(F.regexp_replace(c, EMOJI_CLASS, ""))


def strip_html(c: Column) -> Column:
    """Page adapter: drop tags, collapse whitespace."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


# ---------------------------------------------------------------------------
# Tokenisers
# ---------------------------------------------------------------------------

def rouge_tokens(c: Column) -> Column:
    """ROUGE tokeniser without stemming: lower-case, runs of [a-z0-9]."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


ROUGE_TOKENS_SQL = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"

# mteval-13a punctuation rules, fixed values:
#   1. split off  { - ~ , [ - ` , space - & , ( - + , : - @ , /
#   2. period/comma not preceded by a digit
#   3. period/comma not followed by a digit
#   4. dash preceded by a digit
BLEU_RULES = [
    (r"([{-~\[-` -&(-+:-@/])", " {1} "),
    (r"([^0-9])([\.,])", "{1} {2} "),
    (r"([\.,])([^0-9])", " {1} {2}"),
    (r"([0-9])(-)", "{1} {2} "),
]
BLEU_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def bleu_tokens(c: Column) -> Column:
    """BLEU (13a) tokeniser as a native expression chain."""
    s = F.coalesce(c, F.lit(""))
    s = F.replace(s, F.lit("<skipped>"), F.lit(""))
    s = F.replace(s, F.lit("-\n"), F.lit(""))
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    for a, b in BLEU_ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pat, rep in BLEU_RULES:
        s = F.regexp_replace(s, pat, rep.replace("{1}", "$1").replace("{2}", "$2"))
    return F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")


def bleu_tokens_sql(c: str) -> str:
    s = f"coalesce({c}, '')"
    s = f"replace({s}, '<skipped>', '')"
    s = f"replace({s}, '-' || chr(10), '')"
    s = f"replace({s}, chr(10), ' ')"
    for a, b in BLEU_ENTITIES:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"(' ' || {s} || ' ')"
    for pat, rep in BLEU_RULES:
        s = f"regexp_replace({s}, '{pat}', '{rep.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')}', 'g')"
    return f"list_filter(string_split_regex(trim({s}), '\\s+'), lambda w: w <> '')"


def ngrams(tokens: Column, n: int) -> Column:
    """Array of space-joined n-grams (tokens never contain whitespace).

    One regular-expression pass over the space-joined tokens: a zero-width
    match at every token start captures the next n tokens.  Native and
    code-generated, unlike a per-element lambda.
    """
    if n == 1:
        return tokens
    pattern = r"(?<=^| )(?=(\S+(?: \S+){%d})(?: |$))" % (n - 1)
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit(pattern), 1)


def truncate(c: Column, n: int) -> Column:
    """left-truncate with ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def slug(c: Column) -> Column:
    """space and ':' -> '_', then keep only [a-zA-Z0-9_.-]."""
    return F.regexp_replace(F.regexp_replace(c, "[ :]", "_"), "[^a-zA-Z0-9_.-]", "")
