"""License scans: an exact set-similarity join of text windows with license templates.

A block is a window of consecutive words of a text, as long as the template divided by ``CONTAINMENT``, on one line or over several. A block
matches a template when it contains at least ``CONTAINMENT`` of the template's distinct words, among them all the words that
name the license, and none that would make it another one (``lesser`` in a GPL notice). The join finds every such pair: words are put in one global order, rarest
first, by their counts over the whole corpus; a template with o words to find has its first |T| - o + 1 words
as prefix, a block's words of the template vocabulary likewise, and a matching pair shares a prefix word
(prefix filter), has at least o vocabulary words (length filter), and at the shared word's positions
still enough words behind it in both (positional filter). What passes is verified by intersecting the sets.

Windows are joined as runs of words: runs overlap so that each window lies in one, a run has the words of its windows,
so no filter loses a window, and what passes is verified window by window. Only runs with a prefix word leave the scan; the template side is a fixed table of a few
hundred rows, so its broadcast does not grow with the data and a notice that a third of all texts share joins where it is read.
Places of the base phrases are found in the text's own row.

Defined results: a null text is empty: no words, no places, null first and last word, empty labels, score 0.
A text shorter than a template's window is one block. Case is folded for A-Z only. Repeated rows get the same results each; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, settle, sized, table

#: What separates words after A-Z is folded, and the same before folding.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Base phrases and their labels (fixed values).
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

CONTAINMENT = 0.8
_BY = "sharealike share sa noncommercial non nc noderivatives noderivs nd"
#: Notices and namings of well-known licenses (fixed values): label, words, words that must be there, words that must not.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license", ""),
    ("mit", "licensed under the mit license", "mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted charge obtaining software", ""),
    ("apache-2", "licensed under the apache license version 2 0", "apache license 2", ""),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute gnu general public license", "lesser library affero"),
    ("gpl-2", "gnu general public license version 2", "gnu general license version 2", "lesser library affero"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license", "gnu general either version 2", "lesser library affero"),
    ("gpl-3", "gnu general public license version 3", "gnu general license version 3", "lesser library affero"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license", "gnu general either version 3", "lesser library affero"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser license", ""),
    ("lgpl", "gnu lesser general public license version", "gnu lesser license", ""),
    ("agpl-3", "gnu affero general public license version 3", "gnu affero license 3", ""),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero either version 3", ""),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license 2", ""),
    ("bsd", "released under the bsd license", "bsd license", ""),
    ("bsd", "licensed under the bsd license", "bsd license", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution source binary forms conditions", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission distribute purpose fee granted", ""),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution", _BY),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike", "noncommercial nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial", "sharealike noderivatives noderivs"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "licensed cc by nc", "sa nd"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software public domain", ""),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", ""),
]


def fold(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def license_words(folded: Column) -> Column:
    return F.array_remove(F.split(folded, GAP), "")


def _needed(n: int, containment: float) -> int:
    return math.ceil(containment * n - 1e-9)


def reach(template: str, containment: float) -> int:
    """Words of a template's windows."""
    return math.ceil(len(template.split()) / containment - 1e-9)


def word_order(df: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each template word by its count over all texts, rarest first; ties by the word."""
    ws = F.array_remove(F.split(F.col(text), RAW_GAP), "")
    found = df.select(F.explode(F.filter(F.transform(ws, lambda w: F.lower(w)), lambda w: w.isin(vocabulary))).alias("w")).groupBy("w").count()
    counts = dict(found.collect())  # at most one row a template word
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _prefixes(rank: dict[str, int], templates, containment: float) -> list[tuple]:
    """One row for each template and prefix word."""
    index = []
    for i, (label, t, must, never) in enumerate(templates):
        s = sorted(set(t.split()), key=rank.__getitem__)
        o = _needed(len(s), containment)
        index += [(i, label, w, pos, o, len(s), s, reach(t, containment), must.split(), never.split()) for pos, w in enumerate(s[: len(s) - o + 1])]
    return index


def _has_prefix(index: list[tuple]) -> str:
    any_word = "|".join(sorted({row[2] for row in index}))
    return rf"(?i)(?<![0-9A-Za-z\x{{80}}-\x{{10FFFF}}])(?:{any_word})(?![0-9A-Za-z\x{{80}}-\x{{10FFFF}}])"


def _pairs(blocks: DataFrame, words: Column, rank: dict[str, int], index: list[tuple]) -> DataFrame:
    """``blocks`` beside each template of which their ``words`` hold enough, with the overlap; a pair for each prefix word shared."""
    prefix = F.broadcast(blocks.sparkSession.createDataFrame(index, "template int, label string, w string, pos int, o int, size int, words array<string>, reach int, must array<string>, never array<string>"))
    ranks = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    known = F.array_distinct(F.filter(words, lambda w: w.isin(list(rank))))
    ordered = F.transform(F.sort_array(F.transform(known, lambda w: F.struct(F.element_at(ranks, w).alias("r"), w.alias("w")))), lambda x: x["w"])
    at = blocks.withColumn("bw", ordered).select("*", F.size("bw").alias("n"), F.posexplode("bw").alias("j", "w"))
    pairs = at.join(prefix, "w").where("n >= o AND j <= n - o AND 1 + least(size - pos - 1, n - j - 1) >= o")
    return pairs.withColumn("overlap", F.size(F.array_intersect("bw", "words"))).where("overlap >= o AND size(array_except(must, bw)) = 0")


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, t, must, _ in templates for w in (t + " " + must).split()})


def license_windows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=None, containment: float = CONTAINMENT, rank: dict[str, int] | None = None) -> DataFrame:
    """Rows for each template that a window of a text matches: doc_id, text_hash, label, template, score (the best of a run)."""
    templates = templates or TEMPLATES
    rank = rank or word_order(df, text, _vocabulary(templates))
    index = _prefixes(rank, templates, containment)
    step, firsts = max(row[7] for row in index), sorted({row[2] for row in index})

    def runs(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws), F.lit(step))
        return F.filter(F.transform(starts, lambda i: F.slice(ws, i + 1, 2 * step - 1)), lambda run: F.exists(run, lambda w: w.isin(firsts)))

    docs = df.where(F.col(text).rlike(_has_prefix(index)))
    blocks = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.explode(let(license_words(fold(F.col(text))), runs)).alias("run"))
    found = _pairs(blocks, F.col("run"), rank, index).dropDuplicates(["doc_id", "text_hash", "run", "template"])
    starts = F.sequence(F.lit(1), F.greatest(F.size("run") - F.col("reach") + 1, F.lit(1)))

    def holds(window: Column) -> Column:
        named = (F.size(F.array_except("must", window)) == 0) & ~F.arrays_overlap("never", window)
        return F.when(named, F.size(F.array_intersect(window, "words"))).otherwise(0)

    best = F.array_max(F.transform(starts, lambda i: holds(F.slice("run", i, F.col("reach")))))
    return found.withColumn("best", best).where("best >= o").select("doc_id", "text_hash", "label", "template", (F.col("best") / F.col("size")).alias("score"))


def phrase_places(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words and places array<struct<at, label>> (word positions of the base phrases)."""
    src = F.coalesce(F.col(text), F.lit(""))
    maybe = "(?i)" + "|".join(p.replace(" ", RAW_GAP) for p, _ in PHRASES)

    def starts(ws: Column) -> Column:
        def at(phrase: str, label: str) -> Column:
            parts = phrase.split()
            fits = lambda i: F.forall(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(parts)]), lambda p: F.coalesce(F.get(ws, i + p["k"]) == p["w"], F.lit(False)))
            return F.transform(F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (F.get(ws, i) == parts[0]) & fits(i)), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

        return F.concat(*[at(p, label) for p, label in PHRASES])

    empty = F.array().cast("array<struct<at:int,label:string>>")
    return df.withColumns(
        {
            "n_words": F.size(F.array_remove(F.split(src, RAW_GAP), "")).cast("long"),
            "places": F.when(src.rlike(maybe), let(license_words(fold(src)), starts)).otherwise(empty),
        }
    )


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def license_scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row a document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rank = word_order(df, text, _vocabulary(TEMPLATES))
    hits = license_windows(df, doc_id, text, containment=containment, rank=rank)
    best = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    best = sized(settle(best.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_hash", "hit_hash")))
    docs = phrase_places(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).withColumn("text_hash", F.xxhash64("text")).drop("text")
    both = docs.join(best, docs["doc_id"].eqNullSafe(best["hit_id"]) & (docs["text_hash"] == best["hit_hash"]), "left")
    labels, at = F.transform("places", lambda x: x["label"]), F.transform("places", lambda x: x["at"])
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        _joined(labels).alias("base_labels"),
        _joined(F.concat(labels, F.coalesce("more", none))).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def licenses_sql() -> str:
    """DuckDB: every window of every text that has a template's required words, without other filters."""
    words = lambda t: f"CAST(string_split('{t}', ' ') AS VARCHAR[])" if t else "CAST([] AS VARCHAR[])"
    rows = ", ".join(f"('{label}', list_distinct({words(t)}), {words(must)}, {words(never)}, {reach(t, CONTAINMENT)})" for label, t, must, never in TEMPLATES)
    phrases = ", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in PHRASES)
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
WITH t(label, ts, need, bans, reach) AS (VALUES {rows}), p(label, ps) AS (VALUES {phrases}),
d AS (SELECT doc_id, row_number() OVER () AS rid, {low} AS low, regexp_extract_all({low}, '{word}') AS ws FROM documents),
c AS (SELECT rid, label, ts, need, bans, unnest(list_transform(range(1, greatest(len(ws) - reach + 1, 1) + 1), lambda i: ws[i:i + reach - 1])) AS w FROM d, t WHERE len(list_intersect(need, ws)) = len(need)),
m AS (SELECT rid, label, len(list_intersect(list_distinct(w), ts)) / len(ts) AS score FROM c
      WHERE len(list_intersect(need, w)) = len(need) AND len(list_intersect(bans, w)) = 0 AND len(list_intersect(list_distinct(w), ts)) >= ceil({CONTAINMENT} * len(ts) - 1e-9)),
h AS (SELECT rid, list(DISTINCT label) AS more, max(score) AS best FROM m GROUP BY rid),
i AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) > 0),
a AS (SELECT rid, label, i - 1 AS pos FROM i, p WHERE ws[i] = ps[1] AND ws[i:i + len(ps) - 1] = ps),
g AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM a GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
       greatest(coalesce(best, 0.0::DOUBLE), CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM d LEFT JOIN h USING (rid) LEFT JOIN g USING (rid)"""


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLES = {"op6_license_scan": licenses_sql()}
