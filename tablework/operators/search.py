"""Document search by author, title and phrases."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _containing(phrase: str) -> Callable[[Column], Column]:
    return lambda paragraph: F.contains(paragraph, F.lit(phrase))


def search_docs(df: DataFrame, authors: Sequence[str] = (), titles: Sequence[str] = (),
                phrases: Sequence[str] = (), predicate: Column | None = None,
                author: str = "author", title: str = "title",
                paragraphs: str = "paragraphs") -> DataFrame:
    """Documents by one of the authors, with one of the titles, holding every phrase.

    An empty list does not restrict. Documents without author or paragraphs
    are never found; a missing title passes the title filter. Each phrase
    must occur inside some paragraph. ``predicate`` is the caller's own test.
    """
    found = F.col(author).isNotNull() & F.col(paragraphs).isNotNull()
    if authors:
        found &= F.col(author).isin(*authors)
    if titles:
        found &= F.col(title).isNull() | F.col(title).isin(*titles)
    if predicate is not None:
        found &= predicate
    for phrase in phrases:  # last, as the costly part of the test
        found &= F.exists(paragraphs, _containing(phrase))
    return df.where(found)
