"""Text column helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not count as content.
STOPWORDS = (
    "the", "a", "an", "is", "are", "of", "to", "and", "or", "in", "on", "for",
    "by", "with", "this", "that", "be", "will", "shall", "at", "as", "it",
    "not", "no", "any", "may", "can", "does", "do", "who", "what", "which",
    "under", "from", "such", "if", "would", "than", "then",
)
# The shorter list used when matching expected answers to chunks.
CASE_STOPWORDS = (
    "the", "a", "an", "is", "are", "of", "to", "and", "or", "in", "on", "for",
    "by", "with", "this", "that", "be", "will", "shall", "at", "as", "it",
    "not", "no", "any", "may", "can", "does", "do", "who", "what", "which",
)

# Number words and unit lengths in days.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
UNIT_DAYS = {"day": 1, "days": 1, "week": 7, "weeks": 7, "month": 30, "months": 30, "year": 365, "years": 365}
DURATION_PATTERN = (
    r"(?i)\b(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s*[-\s]?\s*(day|days|week|weeks|month|months|year|years)\b"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression."""
    return F.transform(F.array(value), body)[0]


#: ASCII white space, as trimmed by ``strip``.
WHITE_SPACE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.trim(text, F.lit(WHITE_SPACE))


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize(text: Column) -> Column:
    return collapse(F.lower(text))


def first_words(text: Column, n: int) -> Column:
    """At least the first ``n`` words of the collapsed text, as an array; the text beyond them is not read."""
    return F.split(collapse(F.regexp_extract(text, rf"^(?:\s*+\S++){{0,{n}}}", 0)), " ")


def content_words(text: Column, stopwords: Sequence[str] = STOPWORDS, longer_than: int = 1) -> Column:
    """Lower-case ASCII words and digits, without stopwords and short words; order and repeats kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(words, lambda w: (F.length(w) > longer_than) & ~F.array_contains(stop, w))


def distinct_content_words(text: Column, stopwords: Sequence[str] = STOPWORDS, longer_than: int = 1) -> Column:
    """The set of content words of a text."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(F.array_except(words, F.array(*[F.lit(w) for w in stopwords])), lambda w: F.length(w) > longer_than)


def overlap_ratio(quote_words: Column, words: Column) -> Column:
    """Share of ``quote_words`` (repeats count) found in ``words``; 0 for no words."""
    hit = F.size(F.filter(quote_words, lambda w: F.array_contains(words, w)))
    return F.when(F.size(quote_words) > 0, hit / F.size(quote_words)).otherwise(F.lit(0.0))


def duration_days(text: Column) -> Column:
    """First duration in the text, in days; null when there is none."""
    number = F.lower(F.regexp_extract(text, DURATION_PATTERN, 1))
    unit = F.lower(F.regexp_extract(text, DURATION_PATTERN, 2))
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    units = F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv])
    value = F.coalesce(F.try_element_at(words, number), number.try_cast("int"))
    return F.when(number != "", value * F.try_element_at(units, unit))


def keyword_category(text: Column, rules: Sequence[tuple[str, str]], default: str = "general") -> Column:
    """First rule whose keyword occurs in the lower-cased text."""
    low, out = F.lower(text), None
    for keyword, category in rules:
        hit = F.contains(low, F.lit(keyword))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return F.lit(default) if out is None else out.otherwise(default)


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed, basic entities decoded."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)
