"""Text functions as column expressions, which run inside the JVM, and `read` for what Python reads of a text in one go."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no content, and what a token is.
STOPWORDS = (
    "about", "after", "also", "and", "are", "because", "before", "between", "from", "have", "into", "that", "the", "their", "them", "then", "there", "this", "these", "those", "when", "where", "which", "while", "with",
    "would", "could", "should", "does", "did", "how", "why", "what", "were", "was", "for", "not", "but", "can", "has", "had",
)
TOKEN = "[a-z][a-z0-9-]{2,}"
#: Fixed value: queries with one of these are out of scope.
OUT_OF_SCOPE = ["buy", "forecast", "investment", "portfolio", "stock", "tomorrow", "weather"]
#: Fixed value: what the withheld answer says.
WITHHELD = "I could not find enough source-backed evidence to answer this query."


def words_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def all_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def marked_tokens(text: Column) -> Column:
    """Lower-case tokens in order and with repetitions; every stopword is an empty string."""
    return F.transform(all_tokens(text), lambda t: F.when(t.isin(*STOPWORDS), "").otherwise(t))


def tokens(text: Column) -> Column:
    """Content tokens in order, with repetitions. A null text has null tokens."""
    return F.filter(all_tokens(text), lambda t: ~t.isin(*STOPWORDS))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def overlap_terms(left: Column, right: Column) -> Column:
    return F.sort_array(F.array_intersect(left, right))


def normalize(text: Column) -> Column:
    """NUL and every run of white space become one space; ends are stripped."""
    return F.trim(F.regexp_replace(F.translate(text, "\0", " "), r"(?U)[\s\x1c-\x1f]+", " "))


def markdown_to_text(text: Column) -> Column:
    """Without fenced code, images and heading marks; inline code and links give their text."""
    steps = (("(?s)```.*?```", " "), ("`([^`]*)`", "$1"), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^\s{0,3}#{1,6}\s*", ""))
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def sentences(text: Column) -> Column:
    """Pieces between white space that follows . ! or ?, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def _windows(run: Column) -> Column:
    """The phrases of a run of L content tokens: four tokens from every third one, then a tail of two or three."""
    size = F.size(run)
    k = F.floor((size - 1) / 3).cast("int")
    whole = F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.array_join(F.slice(run, j * 3 + 1, 4), " "))).otherwise(F.array().cast("array<string>"))
    tail = F.when(size - 3 * k >= 2, F.array(F.array_join(F.slice(run, 3 * k + 1, 4), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(whole, tail)


def noun_phrases(text: Column, limit: int = 8) -> Column:
    """The first different phrases of a text: per sentence, runs of content tokens cut into windows."""
    marked = lambda s: F.array_join(F.transform(marked_tokens(s), lambda t: F.when(t == "", "|").otherwise(t)), " ")
    runs = lambda s: F.filter(F.transform(F.split(marked(s), r"\|"), lambda r: F.filter(F.split(r, " "), lambda t: t != "")), lambda r: F.size(r) > 1)
    found = F.flatten(F.transform(sentences(text), lambda s: F.flatten(F.transform(runs(s), _windows))))
    return F.slice(F.array_distinct(found), 1, limit)


def important_terms(text: Column, limit: int = 8) -> Column:
    """The most frequent content tokens, ties by the token."""
    count = lambda found, t: F.size(F.filter(found, lambda x: x == t))
    ranked = lambda found: F.sort_array(F.transform(F.array_distinct(found), lambda t: F.struct((-count(found, t)).alias("n"), t.alias("t"))))
    # inside transform the tokens have a name, so they are found once and not for each of them
    terms = F.transform(F.array(tokens(text)), lambda found: F.slice(F.transform(ranked(found), lambda x: x["t"]), 1, limit))
    return F.get(terms, F.lit(0))


_TOKEN, _SENTENCE_END, _STOP = re.compile(TOKEN), re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+"), frozenset(STOPWORDS)


def read(text: str, limit: int) -> tuple[list[str], list[str], list[str]]:
    """The `important_terms`, `noun_phrases` and `token_set` of a text, whose tokens are found once for all of them."""
    content: list[str] = []
    phrases: dict[str, None] = {}
    for sentence in _SENTENCE_END.split(text.strip(" ")):
        run: list[str] = []
        for token in [*_TOKEN.findall(sentence.lower()), ""]:
            if token and token not in _STOP:
                run.append(token)
                continue
            content += run
            if len(run) > 1 and len(phrases) < limit:
                for at in range(0, len(run) - 1, 3):
                    phrases[" ".join(run[at : at + 4])] = None
            run = []
    counts = Counter(content)
    return sorted(counts, key=lambda t: (-counts[t], t))[:limit], list(phrases)[:limit], list(counts)


def title(text: Column, fallback: Column, width: int = 96) -> Column:
    """The first sentence or line that is not blank, cut to `width` characters."""
    lines = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, width), fallback)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_label(text: Column, width: int = 96) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, width)


def estimate_tokens(text: Column) -> Column:
    """1.35 tokens for each word between white space, rounded up."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.ceil(words * 1.35).cast("long")


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(F.concat_ws("::", *parts)), 1, 12))


def canonical_uri(uri: Column) -> Column:
    """A URI without its fragment and without slashes at the end."""
    return F.regexp_replace(F.regexp_replace(uri, "(?s)#.*$", ""), "/+$", "")


def url_authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def is_url(value: Column) -> Column:
    return F.lower(value).rlike("^https?://[^/?#]+")


def domain_of_path(path: Column) -> Column:
    """The name of the folder that a file is in."""
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(-2)), F.lit("workspace"))
