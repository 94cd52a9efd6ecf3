"""Fill-in-middle against SQL and a plain brute force, short and chunked documents alike."""

import hashlib
import re

import numpy as np
import pytest
from conftest import rows

from packetlens.llm import infill
from packetlens.llm.infill import CONTROLS, FOUND, TOKENS, Automaton, codes_of, infill_digests

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def plainly(doc, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    d = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc, "plain", None, n, sha(text), None, sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc, form, len(m), n, sha(out), len(p), sha(text))


def test_query_equals_sql(spark, sf, oracle):
    assert rows(infill.QUERIES["op13_fill_in_middle"](spark, sf)) == oracle(infill.ORACLES["op13_fill_in_middle"])


def test_scan_equals_stepping():
    rng = np.random.default_rng(4)
    steps, ticks = [(1, 2, 0), (2, 2, 1), (0, 1, 2)], [(0, 1, 0), (1, 0, 2), (0, 0, 0)]
    own = Automaton({"a": 1, "b": 2}, steps, ticks)
    for automaton, given in ((own, steps), (TOKENS, [(1, 1), (0, 0)])):
        lengths = rng.integers(0, 90, 60)
        classes = rng.integers(0, len(given), int(lengths.sum())).astype(np.uint8)
        f, n = automaton.scan(classes, lengths)
        at = 0
        for i, size in enumerate(lengths):
            for start in range(automaton.states):
                state, count = start, 0
                for c in classes[at : at + size]:
                    count += automaton.ticks[c][state]
                    state = given[c][state]
                assert (automaton.after[f[i], start], n[i, start]) == (state, count)
            at += size
    f, n = own.scan(np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert f.tolist() == [0, 0, 0] and not n.any()


def test_control_strings_are_found_wherever_chunks_begin():
    for text in ("<<P>", "<S", "<P >", "a<M>b", "<<", "P>", "<S><", "<p>"):
        for cut in range(len(text) + 1):
            state = 0
            for part in (text[:cut], text[cut:]):
                g, _ = CONTROLS.scan(CONTROLS.classes(codes_of(part)), np.array([len(part)]))
                state = CONTROLS.after[g[0], state]
            assert (state == FOUND) == any(m in text for m in ("<P>", "<S>", "<M>"))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    alphabet = list("ab cé漢🙂 \t\n<>PSM") + [" the", "\r\n", " ", "\x1c"]
    out = [(i, "".join(rng.choice(alphabet, rng.integers(0, 300)))) for i in range(150)]
    out += [(1000 + i, "".join(rng.choice(["word", " ", "  ", "x"], rng.integers(0, 400)))) for i in range(150)]
    out += [(2000, None), (2001, ""), (2002, " "), (2003, " " * 100), (2004, "x" * 100), (2005, "a <P"), (2006, "a <P> b"), (2007, "x <S"), (None, "some words here"), (None, "other words of no id " * 9)]
    return out + out[:3] + out[150:153]


@pytest.mark.parametrize(("chunk", "fan"), [(1 << 16, 128), (7, 3), (64, 128)])
def test_equals_brute_force_in_chunks_of_any_size(spark, texts, chunk, fan, monkeypatch):
    monkeypatch.setattr(infill, "FAN", fan)
    df = spark.createDataFrame([(*t, 1, "x", 5) for t in texts], "doc_id long, text string, part long, own_row string, n int")
    got = rows(infill_digests(*infill.infill_parts(df, chunk=chunk)))
    assert got == sorted((plainly(*t) for t in texts), key=repr)


def test_pieces_are_the_output(spark, texts):
    df = spark.createDataFrame(texts[:60], "doc_id long, text string")
    made = {}
    for r in sorted(infill.infill(df, chunk=16).collect(), key=lambda r: (r["doc_id"], r["ord"], r["at"])):
        made.setdefault(r["doc_id"], ["", r["form"]])[0] += r["output"]
    for doc, text in texts[:60]:
        output, form = made[doc]
        assert infill.restore(output, form) == text and sha(output) == plainly(doc, text)[4]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert infill_digests(*infill.infill_parts(empty)).count() == 0
