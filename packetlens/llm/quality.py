"""Quality rules: a threshold table compiled into one projection of built-in functions.

Each rule is a ratio of two counters of a text with an allowed interval. ``quality_features`` turns a
text into the counters, ``verdict`` folds the table into one Boolean expression; nothing shuffles and
no user function runs, so the operator is a narrow scan-project at any size.

Defined results: a null or empty text has no words, all counters 0, ``base_failed`` true and ``kept``
false. Repeated rows are judged one by one; every column of the input stays (a column named like one
of the results is replaced). An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, SPACE, let, words

#: Words that running text of these languages hardly does without (fixed values).
STOP_WORDS = {
    "en": ["a", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"],
    "fr": ["au", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une"],
    "de": ["auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "es": ["como", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"],
}
ALL_STOP_WORDS = sorted({w for ws in STOP_WORDS.values() for w in ws})

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


class Rule(NamedTuple):
    name: str
    over: str
    under: str
    least: float | None
    most: float | None


#: The production thresholds: least <= over / under <= most.
RULES = [
    Rule("mean_word_chars", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("exclaims_per_word", "n_exclaims", "n_words", None, 0.2),
    Rule("stop_words_per_word", "n_stop", "n_words", 0.02, None),
    Rule("duplicate_lines_per_line", "n_dup_lines", "n_lines", None, 0.5),
]


def repeated_words(ws: Column) -> Column:
    """How many words lie in a window of 8 words that occurs twice or more.

    Window hashes are built by doubling (1, 2, 4, 8 words, 64 bits). Texts without an equal pair, almost
    all, stop after ``array_distinct``; for the others the windows are sorted by hash and the marked
    intervals are summed, in O(n log n).
    """

    def joined(h: Column, step: int) -> Column:
        left = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), left), F.slice(h, F.lit(step + 1), left), lambda a, b: F.xxhash64(a, b))

    def covered(h8: Column) -> Column:
        marked = let(
            F.sort_array(F.transform(h8, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )
        return F.aggregate(
            marked,
            F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).cast("long").alias("t")),
            lambda a, p: F.struct(p.alias("p"), (a["t"] + F.least(F.lit(WINDOW), p - a["p"])).alias("t")),
            lambda a: a["t"],
        )

    return let(
        F.transform(ws, lambda w: F.xxhash64(w)),
        lambda h1: let(
            joined(h1, 1),
            lambda h2: let(
                joined(h2, 2),
                lambda h4: let(joined(h4, 4), lambda h8: F.when(F.size(F.array_distinct(h8)) == F.size(h8), F.lit(0).cast("long")).otherwise(covered(h8))),
            ),
        ),
    )


def quality_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counters of each whole text."""
    src, ws = F.coalesce(F.col(text), F.lit("")), F.col(OWN + "words")
    lines = F.col(OWN + "lines")
    staged = df.withColumns({OWN + "words": words(F.col(text)), OWN + "lines": F.filter(F.split(src, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    return staged.withColumns(
        {
            "n_words": F.size(ws).cast("long"),
            "word_chars": F.length(F.array_join(ws, "")).cast("long"),
            "n_symbols": F.regexp_count(src, F.lit("[" + SYMBOLS + "]")).cast("long"),
            "n_exclaims": F.regexp_count(src, F.lit("!")).cast("long"),
            "n_stop": F.size(F.filter(ws, lambda w: F.lower(w).isin(ALL_STOP_WORDS))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeated_words(ws),
        }
    ).drop(OWN + "words", OWN + "lines")


def verdict(rules: list[Rule] = RULES) -> Column:
    """The table as one expression over the counters; a ratio without a denominator passes."""

    def passes(r: Rule) -> Column:
        ratio = F.try_divide(F.col(r.over).cast("double"), F.col(r.under))
        tests = ([ratio >= r.least] if r.least is not None else []) + ([ratio <= r.most] if r.most is not None else [])
        return (F.col(r.under) == 0) | reduce(lambda a, b: a & b, tests)

    return reduce(lambda a, b: a & b, map(passes, rules), F.lit(True))


def quality_rules(df: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``df`` with counters, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return quality_features(df, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *RESULT)


def _sql_rules(rules: list[Rule]) -> str:
    out = []
    for r in rules:
        ratio = f"CAST({r.over} AS DOUBLE) / {r.under}"
        tests = ([f"{ratio} >= {r.least}"] if r.least is not None else []) + ([f"{ratio} <= {r.most}"] if r.most is not None else [])
        out.append(f"({r.under} = 0 OR ({' AND '.join(tests)}))")
    return " AND ".join(out)


def quality_sql(source: str = "documents", keep: str = "doc_id") -> str:
    """DuckDB query with one row for each row of ``source``: its columns ``keep`` and the results."""
    stop = ", ".join(f"'{w}'" for w in ALL_STOP_WORDS)
    return f"""
WITH r AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS body FROM {source}),
w AS (SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM r),
g AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
m AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM m, range({WINDOW}) t(k) GROUP BY rid),
f AS (SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(body) - length(translate(body, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(length(body) - length(replace(body, '!', '')) AS BIGINT) AS n_exclaims,
             CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT {keep}, {', '.join(RESULT[:-1])}, NOT base_failed AND {_sql_rules(RULES)} AS kept FROM b"""


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {"op4_quality_rules": quality_sql()}
