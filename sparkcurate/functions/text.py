"""General text Columns: trimming, tagged blocks, language test, slugs, keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when trimming.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_SPACES = "".join(f"\\x{{{ord(c):X}}}" for c in WHITESPACE)

# Scripts that speak against English text.
NON_LATIN_CLASS = (
    r"[\x{0400}-\x{04FF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}"
    r"\x{AC00}-\x{D7AF}\x{0600}-\x{06FF}\x{0900}-\x{097F}]"
)

# Function words, one of which any English text should contain.
ENGLISH_WORDS = (
    "the", "of", "and", "in", "for", "is", "to", "a", "an",
    "with", "from", "by", "on", "are", "was", "that", "this",
)

# Words that never become keywords of a paper.
KEYWORD_STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "it", "as", "be", "was", "are",
    "were", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "shall", "can",
    "this", "that", "these", "those", "not", "no", "its", "we", "our",
    "their", "using", "based", "via", "into", "over", "about", "between",
    "through", "during", "before", "after", "above", "below", "up", "down",
    "than", "other", "such", "only", "also", "more", "most", "very",
    "each", "every", "all", "both", "few", "many", "some", "any",
    "new", "first", "two", "one", "which", "when", "how", "what",
)

# Words dropped from a question before it becomes a search query.
QUERY_STOP_WORDS = (
    "what", "which", "how", "why", "when", "where", "who", "whom",
    "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "the", "a", "an", "and", "or", "but", "in",
    "on", "at", "to", "for", "of", "with", "by", "from", "as",
    "into", "through", "during", "this", "that", "these", "those",
    "it", "its", "can", "may", "might", "explain", "describe",
    "define", "discuss", "compare", "contrast", "give", "provide",
    "list", "name", "identify", "answer", "question", "following",
    "example", "examples", "please", "briefly", "detail", "given",
    "assume", "using", "use", "find", "denotes", "all", "pairs",
    "sum", "sigma", "beta", "left", "right", "frac", "text",
)


def strip(c: Column) -> Column:
    """Trim all Unicode white space from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def with_spaces(pattern: str) -> str:
    r"""The pattern with ``\s`` as every character of WHITESPACE, in a class or alone.

    By itself the engine means six ASCII characters only.
    """
    out, inside, i = [], False, 0
    while i < len(pattern):
        part = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if part == r"\s":
            part = _SPACES if inside else f"[{_SPACES}]"
            i += 2
        else:
            inside = part == "[" or inside and part != "]"
            i += len(part)
        out.append(part)
    return "".join(out)


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def block(c: Column, tag: str, ignore_case: bool = True) -> Column:
    """Content of the first ``<tag>...</tag>``, or null when there is none.

    An empty block gives ``''``, which is why this is not a bare ``regexp_extract``.
    """
    flags = "(?is)" if ignore_case else "(?s)"
    whole = F.regexp_substr(c, F.lit(f"{flags}<{tag}>.*?</{tag}>"))
    opening = len(tag) + 2
    return F.substring(whole, F.lit(opening + 1), F.length(whole) - (2 * opening + 1))


def truncated(c: Column, size: int, mark: str = "...") -> Column:
    """The first ``size`` characters, marked when something was cut."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit(mark))).otherwise(c)


def is_english(c: Column) -> Column:
    """Short texts pass; else at most 5 % non-Latin script and one English function word."""
    foreign = F.regexp_count(c, F.lit(NON_LATIN_CLASS))
    words = "|".join(ENGLISH_WORDS)
    has_word = c.rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])")
    size = F.length(c)
    return F.when(F.coalesce(size, F.lit(0)) < 20, F.lit(True)).otherwise(
        (foreign <= size * F.lit(0.05)) & has_word
    )


def last_sentences(c: Column, n: int = 2) -> Column:
    """The last ``n`` sentences; the whole trimmed text when it has no more than that."""
    text = strip(c)
    parts = F.split(text, with_spaces(r"(?<=[.!?])\s+(?=[A-Z])"))
    return F.when(F.size(parts) <= n, text).otherwise(
        F.array_join(F.slice(parts, F.lit(-n), F.lit(n)), " ")
    )


def slug(c: Column, size: int = 50) -> Column:
    """A file-name-safe form: anything but letters, digits, ``_`` and ``-`` becomes ``_``."""
    return F.substring(F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_"), 1, size)


def display_name(c: Column, size: int = 80) -> Column:
    """Like :func:`slug`, but keeps blanks and drops everything else."""
    return F.substring(F.regexp_replace(c, "[^a-zA-Z0-9_ -]", ""), 1, size)


def keyword_tokens(c: Column) -> Column:
    """Runs of three or more ASCII letters of the lower-cased text, stop words removed."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    # Words shorter than three letters cannot match the pattern and need no test.
    stop = [w for w in KEYWORD_STOP_WORDS if len(w) >= 3]
    return F.filter(words, lambda w: ~w.isin(*stop))


def query_keywords(c: Column, k: int = 5) -> Column:
    """Array of the ``k`` longest distinct words of a question, earlier words first on ties.

    Math, commands and braces are blanked out before the text is cut into words.
    """
    text = F.regexp_replace(c, r"\$[^$]+\$", " ")
    text = F.regexp_replace(text, r"(?s)\\\[.*?\\\]", " ")
    text = F.regexp_replace(text, r"\\[a-zA-Z]+\{[^}]*\}", " ")
    text = F.regexp_replace(text, r"\\[a-zA-Z]+", " ")
    # Whatever is left between runs of letters separates words.
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    stop = [w for w in QUERY_STOP_WORDS if len(w) > 2]
    distinct = F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop)))
    # Sorting by (-length, position) is the stable "longest first".
    ranked = F.sort_array(
        F.transform(
            distinct,
            lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")),
        )
    )
    return F.slice(F.transform(ranked, lambda s: s["w"]), 1, k)
