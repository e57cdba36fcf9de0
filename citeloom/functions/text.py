"""Text expressions: cleaning, tokens, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOP_WORDS = tuple("""
a about above after again against all also am an and any are as at be because been before being below between both but by can cannot
could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in
into is it its itself me more most my myself no nor not of off on once only or other ought our ours ourselves out over own same she
should so some such than that the their theirs them themselves then there these they this those through to too under until up very was
we were what when where which while who whom why with would you your yours yourself yourselves
""".split())


def clean_text(text: Column) -> Column:
    """Lower-cased, everything but a-z and white space deleted (not replaced: hyphenated words fuse); null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\s]", "")


def words(text: Column) -> Column:
    """The cleaned text split at white space, in order and with repetition; may hold empty and one-letter pieces."""
    return F.split(clean_text(text), r"\s+")


def is_token(word: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Whether a word has two letters or more and is no stop word."""
    return (F.length(word) >= 2) & ~word.isin(list(stop_words)) if stop_words else F.length(word) >= 2


def title_and_abstract(title: Column, abstract: Column) -> Column:
    """Title, a space and abstract; a null part is empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def labelled_text(title: Column, abstract: Column) -> Column:
    """The two parts under their labels, a line each."""
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nAbstract: "), F.coalesce(abstract, F.lit("")))


def strip_marker(text: Column, marker: str = "Abstract") -> Column:
    """Without the first occurrence of marker, then trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, rf"(?s)^(.*?){marker}", "$1"))


def truncate(text: Column, limit: int = 2000) -> Column:
    """The first `limit` characters; the feature is a prompt's bound."""
    return F.substring(text, 1, limit)


def keyword_form(text: Column) -> Column:
    return F.lower(F.trim(text))


def shortened_list(names: Column, n: int = 3) -> Column:
    """The first n names, comma-separated, with "..." if there are more; null and empty lists give null."""
    head = F.array_join(F.slice(names, 1, n), ", ")
    return F.when(F.size(names) > n, F.concat(head, F.lit("..."))).when(F.size(names) > 0, head)


def topic_prompt(title: Column, abstract: Column, categories: Column, context: Column) -> Column:
    """A classification request: the categories (one text), the paper and, if not null, its citation context."""
    extra = F.when(context.isNotNull(), F.concat(F.lit("\nCitation context: "), context)).otherwise(F.lit(""))
    return F.concat(F.lit("Choose the best categories for the paper.\nCategories:\n"), categories, F.lit("\n"), labelled_text(title, abstract), extra)


KEYWORD_REQUEST = "Name the paper's domains, tasks and methods as a JSON object of three lists, domain, task and method."
CHAT_REQUEST = "Give seven to ten keywords of this interest as a JSON object with one list, keywords."


def keyword_prompt(title: Column, abstract: Column) -> Column:
    """A request for a paper's keywords; null parts are empty."""
    return F.concat(F.lit(KEYWORD_REQUEST + "\n"), labelled_text(title, abstract))


def chat_prompt(text: Column) -> Column:
    """A request for the keywords of what a person wrote; a null text is empty."""
    return F.concat(F.lit(CHAT_REQUEST + "\n"), F.coalesce(text, F.lit("")))


def prompt_words(text: Column) -> Column:
    """Words of letters only, lower-cased, split at white space; others are dropped."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^\p{L}+$")), lambda w: F.lower(w))
