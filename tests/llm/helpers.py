"""Awkward documents, and words as the contracts define them."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, h string, `a.b` string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def rows() -> list[tuple]:
    texts = [
        (1, "the cat sat on the mat and ran away from the dog.\nIt was a fine day for all.\nLine three here.\nLine four here.", "en"),
        (2, "the cat sat on the mat and ran away from the dog.\nIt was a fine day for all.\nLine three here.\nLine four here.", "en"),
        (2, "the cat sat on the mat and ran away from the dog.\nIt was a fine day for all.\nLine three here.\nLine four here.", "en"),
        (3, None, None), (4, "", "en"), (5, " \n\t \n", "de"), (6, "one two three", "en"), (7, "one two three", None), (None, "one two three four five six", "en"), (None, None, None),
        (8, LONG, "fr"), (9, "12 34 ### !!!", "es"), (10, "mail bob@site.org or 10.0.0.1 now, card 4111 1111 1111 1111, +1 (212) 555-0100 ok", "en"),
        (11, "intro words here " + PASSAGE + " tail one", "en"), (12, PASSAGE + " other tail", "en"), (13, "x " * 80, "en"),
        (14, "Das ist ein kurzer Satz über schöne Dinge.\nIt was a fine day for all.\nLine three here.\nLine four here.", "de"), (15, "a  b \n c <|endoftext|> d", "en"),
        (16, "Licensed under the Apache License, Version 2.0.", "en"), (17, "some prose. Released under the MIT License.", "en"), (8, "same id as the long text", "fr"),
    ]
    return [(i, t, lang, "s/x" if i is None else f"s{i % 2}", None if t is None else len(t), "clash", None, "dot") for i, t, lang in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "n_chars")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lowered(text: str | None) -> list[str]:
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in split(text)]
