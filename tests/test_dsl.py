import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packetlens.plans import dsl
from packetlens.schema import PACKET_SCHEMA

CANONICAL = [
    ("", "()"),
    ("udp", "(proto == 17)"),
    ("ip.addr == 88.221.154.110", "(ip.addr == 88.221.154.110)"),
    ("ip.addr != 10.0.0.1 && udp", "((ip.addr != 10.0.0.1 and proto == 17))"),
    ("udp && frame.len < 60 || icmp", "((proto == 17 and (length < 60 or proto == 1)))"),
    ("icmp || udp && frame.len < 60", "((proto == 1 or (proto == 17 and length < 60)))"),
    ("frame.time < Jan 15, 2024 00:00:00", "(frame.time: < 1705276800 0)"),
    ("ip.addr != 10.0.0.1 && udp ||tcp", "((ip.addr != 10.0.0.1 and (proto == 17 or proto == 6)))"),
]


@pytest.mark.parametrize(("text", "canonical"), CANONICAL)
def test_canonical_text(text, canonical):
    assert dsl.parse(text).canonical() == canonical


@pytest.mark.parametrize(
    "text",
    ["ip.src =~ 1.2.3.4", "ip.foo == 1", "port ==", "udp &&", "udp tcp", "frame.time > JUN 15, 2021 12:00:00", "ip.src == 1.2.3", "proto == x", "frame.time > Jan 99, 2021 12:00:00", "udp & tcp", "frame.time > Jan 1,"],
)
def test_errors_name_a_position(text):
    with pytest.raises(dsl.FilterSyntaxError) as e:
        dsl.parse(text)
    assert 0 <= e.value.position <= len(text)


def test_errors_list_choices():
    with pytest.raises(dsl.FilterSyntaxError) as e:
        dsl.parse("ip.foo == 1")
    assert "ip.addr" in e.value.choices


def test_field_names_are_case_sensitive_shortcuts_are_not():
    assert dsl.parse("ICMP").canonical() == "(proto == 1)"
    with pytest.raises(dsl.FilterSyntaxError):
        dsl.parse("IP.SRC == 1.2.3.4")


def test_zone():
    assert dsl.parse("frame.time == Jan 15, 2024 00:00:00", "Europe/Berlin").parts[0].value == 1705276800000000 - 3_600_000_000


BASE = 1705276800000000
ROWS = [
    (167772161 + i % 5, 3232235521 + i % 7, [0, 80, 443, 1024][i % 4], [443, 0, 53, 65535][i % 4], [6, 17, 1][i % 3], 40 + i * 7 % 1400, BASE + (i - 30) * 500_000)
    for i in range(60)
] + [(167772161, 167772161, 0, 0, 1, 70_000, BASE)]


def _value(field, draw):
    kind = dsl.FIELDS[field][1]
    return {"ip": lambda: draw(st.sampled_from([167772161, 167772163, 3232235521, 3232235527])), "time": lambda: BASE + draw(st.integers(-10, 10)) * 1_000_000, "int": lambda: draw(st.sampled_from([0, 1, 6, 17, 53, 60, 443, 1024, 99999999]))}[kind]()


@st.composite
def trees(draw, depth=3):
    if depth == 0 or draw(st.booleans()):
        field = draw(st.sampled_from(list(dsl.FIELDS)))
        return dsl.Term(field, draw(st.sampled_from(dsl.COMPARATORS)), _value(field, draw))
    kind = draw(st.sampled_from([dsl.And, dsl.Or]))
    return kind((draw(trees(depth=0)), draw(trees(depth=depth - 1))))


OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def evaluate(node, row) -> bool:
    if isinstance(node, dsl.And):
        return all(evaluate(p, row) for p in node.parts)
    if isinstance(node, dsl.Or):
        return any(evaluate(p, row) for p in node.parts)
    names = PACKET_SCHEMA.fieldNames()
    return any(OPS[node.op](row[names.index(c)], node.value) for c in dsl.FIELDS[node.field][0])


@pytest.fixture(scope="module")
def frame(spark):
    at = lambda us: datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)
    return spark.createDataFrame([(*r[:6], at(r[6])) for r in ROWS], PACKET_SCHEMA).cache()


@settings(max_examples=25, deadline=None, derandomize=True)
@given(tree=trees())
def test_compiled_filters_equal_row_by_row_evaluation(frame, tree):
    got = frame.where(dsl.compile_filter(dsl.And((tree,)))).count()
    assert got == sum(evaluate(tree, r) for r in ROWS)


@settings(max_examples=200, deadline=None, derandomize=True)
@given(tree=trees())
def test_time_range_is_sound(tree):
    r = dsl.time_range(tree)
    for row in ROWS:
        if evaluate(tree, row):
            assert r is not None
            assert (r[0] is None or r[0] <= row[6]) and (r[1] is None or row[6] <= r[1])


def test_compat_mode(frame):
    count = lambda text, compat: frame.where(dsl.compile_filter(dsl.parse(text), compat)).count()
    boundary = sum(r[6] == BASE for r in ROWS)
    assert count("frame.time > Jan 15, 2024 00:00:00", True) == count("frame.time > Jan 15, 2024 00:00:00", False) + boundary
    inside = sum(BASE < r[6] < BASE + 1_000_000 for r in ROWS)
    assert inside and count("frame.time <= Jan 15, 2024 00:00:00", True) == count("frame.time <= Jan 15, 2024 00:00:00", False) + inside
    assert count("frame.len <= 99999999", False) == len(ROWS) and count("frame.len <= 99999999", True) == sum(r[5] <= 99999999 % 65536 for r in ROWS)
    swap = lambda v: int.from_bytes(v.to_bytes(4, "big"), "little")
    assert count("ip.src < 10.0.0.3", True) == sum(swap(r[0]) < swap(167772163) for r in ROWS)


def test_random_texts_parse_or_raise():
    random.seed(3)
    words = ["udp", "&&", "||", "ip.src", "==", "10.0.0.1", "frame.time", "<", "Jan", "5,", "2024", "00:00:00", "port", "99"]
    for _ in range(500):
        try:
            dsl.parse(" ".join(random.choices(words, k=random.randrange(8))))
        except dsl.FilterSyntaxError:
            pass


@pytest.mark.parametrize("text", ["port == 99999999999999999999999", "proto == 1 || frame.len < 1000000000000000000"])
def test_numbers_out_of_range_are_syntax_errors(text):
    with pytest.raises(dsl.FilterSyntaxError, match="18 digits"):
        dsl.parse(text)


def decide(terms, kinds, row):
    """Right-nested, from the last term back."""
    out = terms[-1](row)
    for term, kind in zip(reversed(terms[:-1]), reversed(kinds), strict=True):
        out = (term(row) and out) if kind == "&&" else (term(row) or out)
    return out


@pytest.mark.parametrize("kinds", [["||"] * 600, ["&&", "||"] * 100, (["&&"] * 5 + ["||"] * 3) * 20])
def test_long_filters(spark, kinds):
    rng = random.Random(4)
    lengths = [rng.randrange(40, 1500) for _ in range(len(kinds) + 1)]
    ops = [rng.choice(["==", "!=", "<"]) for _ in lengths]
    text = " ".join(f"frame.len {o} {n} {k}" for o, n, k in zip(ops, lengths, [*kinds, ""], strict=True))
    tree = dsl.parse(text)
    assert tree.canonical().count("(") == len(kinds) + 1 and dsl.date_predicate(tree) is None
    test = {"==": lambda n: lambda x: x == n, "!=": lambda n: lambda x: x != n, "<": lambda n: lambda x: x < n}
    terms = [test[o](n) for o, n in zip(ops, lengths, strict=True)]
    got = {r.length for r in spark.range(40, 1500, 7).withColumnRenamed("id", "length").where(dsl.compile_filter(tree)).collect()}
    assert got == {n for n in range(40, 1500, 7) if decide(terms, kinds, n)}
