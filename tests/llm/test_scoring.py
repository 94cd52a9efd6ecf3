"""LM scores against a plain model with dictionaries and a word-by-word walk through the automaton."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from packetlens.llm import scoring
from packetlens.llm.scoring import ALPHA, lm_scores, pieces_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def plainly(docs, order, mu):
    """Rows by dictionaries: states are tuples of words, arcs the seen n-grams, failure arcs drop the first word."""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in docs]
    counts = Counter()
    for (_, text), out in zip(docs, held, strict=True):
        if not out:
            w = words_of(text)
            counts.update(tuple(w[i - n : i]) for n in range(1, order + 1) for i in range(n, len(w) + 1))
    total, kinds = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + ALPHA) / (total + ALPHA * (kinds + 1))
        return (counts[gram] + mu * p(gram[1:])) / (counts[gram[:-1]] + mu)

    out = []
    for (doc, text), held_out in zip(docs, held, strict=True):
        w, state, score = words_of(text), (), 0.0
        for x in w:
            while state and not counts[(*state, x)]:
                score += math.log10(mu / (counts[state] + mu))
                state = state[1:]
            score += math.log10(p((*state, x)))
            state = (*state, x)
            while state and (len(state) >= order or not counts[state]):
                state = state[1:]
        base = sum(math.log10((counts[(x,)] + ALPHA) / (total + ALPHA * (kinds + 1))) for x in w)
        out.append((doc, held_out, len(w), sum(counts[(x,)] > 0 for x in w), total, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, *map(repr, r[1:5]), round(r[5], 6), round(r[6], 6))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(5)
    words = ["the", "The", "a", "of", "é", "漢", "x\u00a0y", "\x1cq", "Z", "zz"] + [f"w{i}" for i in range(40)]
    weights = 1 / np.arange(1, len(words) + 1)
    out = []
    for i in range(150):
        said = rng.choice(words, int(rng.integers(0, 60)), p=weights / weights.sum())
        out.append((i, "".join(str(w) + str(rng.choice([" ", "\n", "\t ", "  "])) for w in said)))
    out += [(200, None), (201, ""), (202, " \n"), (203, "the " * 300), (204, " lead and trail "), (None, "the a of"), (None, None), (7, "of the"), (7, "of the")]
    return out


@pytest.mark.parametrize(("order", "group", "piece", "grams"), [(3, 1 << 20, 1 << 20, 1 << 20), (3, 500, 20, 50), (2, 300, 7, 10), (1, 1000, 30, 100), (4, 2000, 1, 300)])
def test_equals_brute_force_in_groups_and_pieces_of_any_size(spark, docs, order, group, piece, grams):
    df = spark.createDataFrame([(*d, "x", 1, True) for d in docs], "doc_id long, text string, own string, part int, train boolean")
    out = lm_scores(df, order=order, mu=2.5, group_bytes=group, piece=piece, bucket_grams=grams)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(out.collect(), plainly(docs, order, 2.5))


def test_query_equals_brute_force(spark, tmp_path, docs):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    same(scoring.QUERIES["op11_lm_scoring"](spark, str(tmp_path)).collect(), plainly(docs, scoring.ORDER, scoring.MU))


def test_held_out_texts_are_likelier_than_by_single_words(spark, sf):
    out = scoring.QUERIES["op11_lm_scoring"](spark, sf).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert out[0] > out[1]


def test_probabilities_of_all_words_sum_to_one():
    """After any history the seen words and one unseen one share the whole probability."""
    counts = [np.array([4, 3, 2, 1, 0], np.int64), np.array([2, 0, 1, 0, 0], np.int64)]
    p1 = (counts[0] + ALPHA) / (10 + ALPHA * 5)
    assert p1.sum() == pytest.approx(1)
    p2 = (counts[1] + 2.0 * p1) / (3 + 2.0)
    assert p2.sum() == pytest.approx(1)


def test_pieces_join_to_the_text():
    rng = np.random.default_rng(6)
    for _ in range(200):
        text = "".join(rng.choice(list("ab \n漢"), int(rng.integers(0, 60))))
        for size in (1, 4, 100):
            got = list(pieces_of(text, size, 2))
            assert "".join(p for p, _ in got) == text
            read = []
            for piece, before in got:
                assert before.encode().split() == read[-2:]
                read += piece.encode().split()


def test_numbers_survive_packing():
    rng = np.random.default_rng(7)
    for values in ([], [0], [255, 0], [256], [2**32 - 1, 5], [2**33], [2**64 - 1, 0, 7], rng.integers(0, 2**44, 1000), rng.integers(0, 3, 1000)):
        values = np.array(values, np.uint64)
        assert (scoring.from_planes(scoring.planes(values)) == values).all()


def test_nothing(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_are_shuffled_once(spark, sf):
    out = scoring.QUERIES["op11_lm_scoring"](spark, sf)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange [g#" in plan and "ReusedExchange [bucket#" in plan
