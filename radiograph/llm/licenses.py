"""License scan with a positional index of rare words.

A license notice is recognised by a template. The two words of each template's mandatory key phrase with the highest
inverse document frequency (over all files) are its postings. A file's words that have postings are looked up, which
selects templates and the places where they would begin; where both words agree on such a place, the whole key phrase
must stand there. A file with a key phrase has its two rarest words, and these are the file's rarest of that template, so
no notice is lost, however many a file holds. All of that happens within a file's
row, in DataFrame functions; only the document frequencies of the key phrases' few words are aggregated.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. Null and empty texts have no words and no
labels. Rows are scanned one by one, so repeated rows repeat their result and null ids keep theirs; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import LOWER, UPPER

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, notice, mandatory key phrase in it).
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "agreed to in writing software"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "in the hope that it will be useful"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "including commercial applications"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to the public domain", "related and neighboring rights"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
)
#: Rare words of each key phrase that are looked up; two of them have to agree on a place.
RARE_WORDS = 2
#: Share of a notice's words that have to stand at their places.
LEAST_SHARE = 0.75
VOCABULARY = tuple(sorted({w for _, _, key in TEMPLATES for w in key.split()}))


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def document_frequencies(documents: DataFrame) -> dict[str, int]:
    """In how many rows each word of the key phrases stands: at most one number for each of them."""
    own = F.explode(F.array_intersect(words(F.col("text")), F.array(*[F.lit(w) for w in VOCABULARY])))
    return {r["w"]: r["n"] for r in documents.select(own.alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def _phrase_places(phrase: list[str]) -> Column:
    """The places of w where the phrase's words stand consecutively."""
    def here(i: Column) -> Column:
        return F.forall(F.array(*[F.get("w", i + k) == F.lit(p) for k, p in enumerate(phrase)]), lambda x: x)

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - len(phrase), F.lit(0))), here)


def _key_at(notice: str, key: str) -> int:
    """The place of the key phrase in its notice."""
    of, need = notice.split(), key.split()
    return next(i for i in range(len(of)) if of[i : i + len(need)] == need)


def _notices() -> Column:
    """The templates as one literal array of (label, words, key words, the key's place)."""
    rows = []
    for label, notice, key in TEMPLATES:
        of, need = notice.split(), key.split()
        rows.append(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, of)).alias("words"), F.array(*map(F.lit, need)).alias("key"), F.lit(_key_at(notice, key)).alias("key_at")))
    return F.array(*rows)


def _postings(frequency: dict[str, int]) -> Column:
    """word -> (template, place of the word in it) for the rarest words of each key phrase, as one literal map."""
    return F.create_map(*[x for word, places in _rare_places(frequency).items() for x in (F.lit(word), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(at).alias("at")) for t, at in places]))])


def _rare_places(frequency: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    held: dict[str, list[tuple[int, int]]] = {}
    for t, (_, notice, key) in enumerate(TEMPLATES):
        need, begin = key.split(), _key_at(notice, key)
        for i in sorted(range(len(need)), key=lambda i: (frequency.get(need[i], 0), need[i]))[:RARE_WORDS]:
            held.setdefault(need[i], []).append((t, begin + i))
    return held


def scan_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of documents(doc_id, text)."""
    frequency = document_frequencies(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    rows = rows.withColumn("line", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))

    places, labels = [], []
    for phrase, label in PHRASES:
        stands = F.contains("line", F.lit(f" {phrase} "))
        places.append(F.when(stands, _phrase_places(phrase.split())).otherwise(F.array().cast("array<int>")))
        labels.append(F.when(stands, F.lit(label)))
    rows = rows.withColumn("places", F.concat(*places)).withColumn("base", F.array_compact(F.array(*labels)))

    # The index selects: the places of rare words, and where each of their templates would begin by them.
    postings, nothing = _postings(frequency), F.array().cast("array<struct<t:int,shift:int>>")
    rows = rows.withColumn("rare", F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(*sorted(_rare_places(frequency))), i))))

    def begins(i: Column) -> Column:
        return F.transform(F.try_element_at(postings, F.get("w", i)), lambda p: F.struct(p["t"].alias("t"), (i - p["at"]).alias("shift")))

    rows = rows.withColumn("hits", F.when(F.size("rare") >= RARE_WORDS, F.sort_array(F.flatten(F.transform("rare", begins)))).otherwise(nothing))
    # Sorted, beginnings on which two words agree are neighbours.
    following = F.slice("hits", 2, F.greatest(F.size("hits") - 1, F.lit(0)))
    rows = rows.withColumn("agreed", F.array_distinct(F.array_compact(F.zip_with("hits", following, lambda a, b: F.when(a == b, a)))))
    notices = _notices()

    def found(h: Column) -> Column:
        notice, shift = F.element_at(notices, h["t"] + 1), h["shift"]
        key_begin = shift + notice["key_at"]
        key_stands = (key_begin >= 0) & (F.slice("w", F.greatest(key_begin, F.lit(0)) + 1, F.size(notice["key"])) == notice["key"])
        same = F.filter(notice["words"], lambda x, k: (shift + k >= 0) & (F.get("w", F.greatest(shift + k, F.lit(0))) == x))
        return F.struct(notice["label"].alias("label"), F.when(key_stands, F.size(same) / F.size(notice["words"])).otherwise(F.lit(0.0)).alias("share"))

    rows = rows.withColumn("found", F.transform("agreed", found))
    method = F.transform(F.filter("found", lambda f: f["share"] >= LEAST_SHARE), lambda f: f["label"])
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))
    return rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        joined("base").alias("base_labels"), joined(F.concat("base", method)).alias("labels"), F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
