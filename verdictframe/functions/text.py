"""Text columns: normalisers, extraction, rule-based tagging."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictframe.functions import rules


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]  # F.get would name the whole once more, for its size


def strip(c: Column | str) -> Column:
    """Trim white space of any kind; null becomes an empty string."""
    return F.coalesce(F.regexp_replace(col(c), r"(?U)^\s+|\s+$", ""), F.lit(""))


def strip_lower(c: Column | str) -> Column:
    return F.lower(strip(c))


NORMALIZERS = {"strip": strip, "strip_lower": strip_lower}


def normalize_prompt(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), r"(?U)\s+", " "))


def instruction_header(c: Column | str) -> Column:
    """Text before the embedded input, or the whole text; marks are tried in order, not by position."""
    prompt = col(c)
    tries = [
        F.when(F.instr(prompt, mark) > 0, F.substring(prompt, F.lit(1), F.instr(prompt, mark) - 1))
        for mark in rules.HEADER_MARKS
    ]
    return strip(F.coalesce(*tries, prompt))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def extract_email(c: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(col(c), rules.EMAIL_PATTERN, 0), F.lit(""))


def extract_name(c: Column | str) -> Column:
    name = F.coalesce(F.regexp_extract(col(c), "(?U)" + rules.NAME_PATTERN, 1), F.lit(""))
    return F.concat(F.upper(F.left(name, F.lit(1))), F.lower(F.substr(name, F.lit(2))))


def first_match(text: Column, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(v)) for p, v in patterns], F.lit(default))


#: Patterns of words, gaps and groups of alternatives, one after the other; and the parts that a match need not have.
_PLAIN = re.compile(r"(?:\\b|\\s[*+]?|[a-z]\??|-\??|\(\?:[a-z|]+\))+")
_LOOSE = re.compile(r"\([^)]*\)|\\b|\\s[*+]?|.\?|-")


def needed_word(pattern: str) -> str:
    """The longest run of letters that every match of ``pattern`` holds; empty for patterns that are not plain."""
    return max(_LOOSE.sub(" ", pattern).split(), key=len, default="") if _PLAIN.fullmatch(pattern) else ""


def rule_tags(
    c: Column | str,
    keywords: Mapping[str, Sequence[str]] = rules.TAG_KEYWORDS,
    patterns: Sequence[tuple[str, Sequence[str]]] = rules.TAG_PATTERNS,
) -> Column:
    """Tags of all matching rules, in rule order, each once.

    The text is lower-cased once, and a pattern runs only over texts that hold the word it cannot match without.
    """

    def matches(text: Column, pattern: str) -> Column:
        return text.contains(word) & text.rlike(pattern) if (word := needed_word(pattern)) else text.rlike(pattern)

    def found(text: Column) -> Column:
        hits = [F.when(text.contains(k), F.array(*map(F.lit, tags))) for k, tags in keywords.items()]
        hits += [F.when(matches(text, p), F.array(*map(F.lit, tags))) for p, tags in patterns]
        return F.array_distinct(F.flatten(F.array_compact(F.array(*hits))))

    return bound(F.lower(col(c)), found)


def objective(c: Column | str) -> Column:
    return first_match(F.lower(col(c)), rules.OBJECTIVE_PATTERNS, "balanced")


def grounding(c: Column | str) -> Column:
    return first_match(F.lower(col(c)), rules.GROUNDING_PATTERNS, "synthetic")


def difficulty_mix(c: Column | str) -> Column:
    """Name of the mix: hard (medium .3, hard .7), easy (easy .7, medium .3) or even (.4, .4, .2)."""
    return F.when(col(c).rlike(rules.HARD_PATTERN), "hard").when(col(c).rlike(rules.EASY_PATTERN), "easy").otherwise("even")


def batch_size(c: Column | str, default: int = 12, top: int | None = None) -> Column:
    """The first number that the text names, at least 1 and at most ``top`` if that is given."""
    number = F.regexp_extract(col(c), rules.BATCH_PATTERN, 1).try_cast("bigint")
    wanted = F.greatest(F.lit(1), F.coalesce(number, F.lit(default)))
    return (wanted if top is None else F.least(F.lit(top), wanted)).cast("bigint")


def iso_to_millis(c: Column | str) -> Column:
    """Epoch milliseconds of an ISO-8601 text, null when it is not one."""
    return F.unix_millis(F.try_to_timestamp(col(c)))


def plain_text(html: Column | str) -> Column:
    """Whole text of a page without scripts, styles and tags, runs of white space as one space."""
    bare = col(html)
    for gone in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]*>", "[ \\t\\r\\n]+"):
        bare = F.regexp_replace(bare, gone, " ")
    return F.trim(bare)
