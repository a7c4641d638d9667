"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Base places: starts of a fixed phrase's words standing consecutively. Beside them, blocks of BLOCK words, one from every
word on, are joined with the token sets of TEMPLATES: a block matches when it holds CONTAINMENT percent or more of a
template's tokens. Template tokens are ordered by the number of documents of the whole corpus that hold them, fewest first.

* Prefix filter: a matching block holds one of a template's first ``size - need + 1`` tokens. These make an inverted index
  (token, template, rank), which documents are joined with by the tokens they hold; it is as large as the templates are and
  is broadcast. A block is looked at from the rarest template token it holds, so from the index rows of one rank.
* Positional filter: from a token of rank r at a place, only tokens of later ranks count, so one and the distinct later
  ones within a block's reach of the place must make ``need``; other places go.
* Length filter: of the blocks that hold the place, those go whose template words, repeats counted, are fewer than ``need``.

What is left is counted in full, and the largest share is the template's. A matching block gives the template's label.

Null and empty texts have no words: zero counts, null places, empty label strings, score 0. Texts of any length are taken
whole. Template tokens in equally many documents are ordered by the token; equal shares make one score. Repeated rows of
one doc_id are one document. An empty table gives an empty table.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

# Phrases and labels of the base places.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Well-known wordings of licenses.
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "apache-2.0-text": "licensed under the apache license version 2 0 you may not use this file except in compliance",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms",
    "cc-text": "this work is licensed under a creative commons attribution license",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "gpl-3-notice": "this work is licensed under the gnu general public license version 3",
    "mit-notice": "released under the mit license",
}
BLOCK, CONTAINMENT = 32, 80
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(docs: DataFrame) -> DataFrame:
    """The runs of WORD in the text with A-Z lowered, found by one translation and a split at spaces."""
    other = "".join(x for x in map(chr, range(128)) if x != " " and not x.isalnum())
    spaced = F.translate(F.coalesce("text", F.lit("")), ascii_uppercase + other, ascii_lowercase + " " * len(other))
    return docs.select("doc_id", F.array_remove(F.split(spaced, " "), "").alias("w"))


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(xs) -> str:
    return f"array({', '.join(map(text, xs))})"


def ordered_templates(worded: DataFrame) -> dict[str, list[str]]:
    """Each template's tokens, those in the fewest documents first."""
    tokens = sorted({x for s in TEMPLATES.values() for x in s.split()})
    seen = worded.select(F.explode(F.expr(f"array_intersect(w, {strings(tokens)})")).alias("token")).groupBy("token").count().collect()
    many = {r["token"]: r["count"] for r in seen}
    return {k: sorted(set(s.split()), key=lambda x: (many.get(x, 0), x)) for k, s in TEMPLATES.items()}


def phrase_places(phrase: str) -> str:
    first, *rest = phrase.split()
    last = " and ".join(f"get(w, i + {k + 1}) = {text(x)}" for k, x in enumerate(rest))
    return f"if(array_contains(w, {text(first)}), filter(sequence(0, size(w) - 1), i -> get(w, i) = {text(first)} and {last}), cast(array() as array<int>))"


def needed(size: int) -> int:
    return -(-CONTAINMENT * size // 100)


def prefix_index(spark, templates: dict[str, list[str]]) -> DataFrame:
    """(token, template, tokens, rank, need): the first tokens of each template; as many rows as the templates allow."""
    rows = [
        f"struct({text(token)} as token, {text(name)} as template, {strings(tokens)} as tokens, {rank} as rank, {needed(len(tokens))} as need)"
        for name, tokens in templates.items()
        for rank, token in enumerate(tokens[: len(tokens) - needed(len(tokens)) + 1])
    ]
    return spark.range(1).selectExpr(f"inline(array({', '.join(rows)}))")


#: The words within a block's reach of place p, and the template's tokens of later ranks.
REACH = f"slice(w, greatest(p - {BLOCK - 1}, 0) + 1, least(p, {BLOCK - 1}) + {BLOCK})"
LATER = "slice(tokens, rank + 2, size(tokens))"
#: Places of the token that the positional filter leaves.
PLACES = f"filter(sequence(0, size(w) - 1), p -> get(w, p) = token and 1 + size(array_intersect({REACH}, {LATER})) >= need)"
#: The blocks that hold place p, moved on to their first template token (which loses none), that the length filter leaves.
BLOCKS = f"filter(transform(filter(sequence(greatest(p - {BLOCK - 1}, 0), p), q -> array_contains(tokens, get(w, q))), q -> slice(w, q + 1, {BLOCK})), b -> size(filter(b, x -> array_contains(tokens, x))) >= need)"
#: The largest number of the template's tokens in any of these blocks.
BEST = f"coalesce(array_max(flatten(transform({PLACES}, p -> transform({BLOCKS}, b -> size(array_intersect(b, tokens)))))), 0)"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (1 for a base place, else the best containment)."""
    worded = words(c.documents(docs))
    index = prefix_index(docs.sparkSession, templates := ordered_templates(worded))
    prefixes = sorted({x for v in templates.values() for x in v[: len(v) - needed(len(v)) + 1]})
    x = worded.select("doc_id", "w", *(F.expr(phrase_places(p)).alias(f"p{i}") for i, p in enumerate(PHRASES)))
    every = ", ".join(f"p{i}" for i in range(len(PHRASES)))
    base = ", ".join(f"if(size(p{i}) > 0, {text(v)}, null)" for i, v in enumerate(PHRASES.values()))
    x = x.selectExpr(
        "doc_id", "w", "cast(size(w) as long) n_words", f"cast(size(concat({every})) as long) n_base",
        f"cast(array_min(concat({every})) as long) first_word", f"cast(array_max(concat({every})) as long) last_word",
        f"array_compact(array({base})) base", f"explode_outer(array_intersect(w, {strings(prefixes)})) token",
    )
    found = x.join(F.broadcast(index), "token", "left").withColumn("best", F.expr(f"if(template is null, 0, {BEST})"))
    own = ("n_words", "n_base", "first_word", "last_word", "base")
    by_doc = found.selectExpr("doc_id", *own, "if(best >= need, template, null) label", "if(best >= need, best / cast(size(tokens) as double), 0D) share")
    merged = by_doc.groupBy("doc_id").agg(*(F.first(k).alias(k) for k in own), F.collect_set("label").alias("more"), F.max("share").alias("share"))
    out = merged.selectExpr(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        "concat_ws(',', array_sort(array_distinct(base))) base_labels", "concat_ws(',', array_sort(array_distinct(concat(base, more)))) labels",
        "if(n_base > 0, 1D, share) score",
    )
    return c.own_id(out)
