"""The search box's language: terms that must all occur, a quoted phrase, prefix*, field:value, days:n; compiled to one predicate."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that searches pass over.
STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


@dataclass(frozen=True)
class Clause:
    """kind: term, prefix, phrase, category or days; field: None for any."""

    kind: str
    value: str
    field: str | None = None


def parse(query: str, fields: frozenset[str] = frozenset({"title", "abstract", "authors", "article", "comments"})) -> list[Clause]:
    """The clauses of a query, lower case but for categories; repeated ones and stop words are dropped, an unknown field is part of its word.

    A query that is wholly in quotes is one phrase. What follows the first * of a word is ignored.
    """
    query = query.strip()
    if len(query) > 1 and query[0] == query[-1] == '"':
        words = [w for w in re.split(r"[^\w]+", query.lower()) if w]
        return [Clause("phrase", " ".join(words))] if words else []
    out: list[Clause] = []
    for word in re.split(r"[^\w:.*-]+", query):
        field, _, rest = word.partition(":")
        if rest and field.lower() == "category":
            out.append(Clause("category", rest))
            continue
        if rest and field.lower() == "days" and rest.isdigit():
            out.append(Clause("days", rest))
            continue
        known = field.lower() if rest and field.lower() in fields else None
        value = (rest if known else word).lower()
        if "*" in value:
            value = value[: value.index("*")]
            if value:
                out.append(Clause("prefix", value, known))
        elif value and value not in STOP:
            out.append(Clause("term", value, known))
    return list(dict.fromkeys(out))


def _any_starts(words: Column, prefix: str) -> Column:
    return F.exists(words, lambda x: x.startswith(prefix))


def predicate(clauses: list[Clause], text: dict[str, Column], category: Column, day: Column | None = None, today: Column | None = None) -> Column:
    """Whether a row meets all clauses; no clause is met by none. text: the fields that are searched, words parted by anything but a-z, 0-9."""
    words = {f: F.split(F.lower(c), r"[^\p{L}\p{Nd}]+") for f, c in text.items()}
    out = F.lit(bool(clauses))
    for c in clauses:
        where = [words[c.field]] if c.field in words else list(words.values())
        if c.kind == "category":
            # a category also stands for those below it
            met = category.startswith(c.value)
        elif c.kind == "days":
            met = F.lit(False) if day is None else F.datediff(today, day) <= int(c.value)
        elif c.kind == "phrase":
            met = F.lit(False)
            for w in where:
                met |= F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).contains(f" {c.value} ")
        else:
            met = F.lit(False)
            for w in where:
                met |= F.array_contains(w, c.value) if c.kind == "term" else _any_starts(w, c.value)
        out &= F.coalesce(met, F.lit(False))
    return out
