import pytest

from packetlens.plans.capture_filter import compile_capture_filter
from packetlens.plans.dsl import FilterSyntaxError

SCHEMA = "src_ip long, dst_ip long, src_port int, dst_port int, proto int, length int"
A, B, C = 167772161, 167772418, 3232235527  # 10.0.0.1, 10.0.1.2, 192.168.0.7
ROWS = [(A, C, 1024, 80, 6, 40), (C, A, 80, 1024, 6, 1500), (B, C, 5353, 53, 17, 60), (A, B, 0, 0, 1, 84), (A, A, 80, 80, 17, 100), (C, B, 443, 443, 6, 61)]

CASES = {
    "": lambda s, d, p, q, x, n: True,
    "ip": lambda s, d, p, q, x, n: True,
    "tcp": lambda s, d, p, q, x, n: x == 6,
    "not tcp": lambda s, d, p, q, x, n: x != 6,
    "! ! udp": lambda s, d, p, q, x, n: x == 17,
    "src 10.0.0.1": lambda s, d, p, q, x, n: s == A,
    "src and dst host 10.0.0.1": lambda s, d, p, q, x, n: s == d == A,
    "host 10.0.0.1 && dst host 192.168.0.7": lambda s, d, p, q, x, n: A in (s, d) and d == C,
    "net 10.0.0.0 mask 255.255.255.0": lambda s, d, p, q, x, n: A in (s, d),
    "dst net 10.0": lambda s, d, p, q, x, n: d in (A, B),
    "port 0": lambda s, d, p, q, x, n: False,
    "udp src port 80": lambda s, d, p, q, x, n: x == 17 and p == 80,
    "src or dst portrange 50-100": lambda s, d, p, q, x, n: x != 1 and (50 <= p <= 100 or 50 <= q <= 100),
    "dst port 80 or 53": lambda s, d, p, q, x, n: q in (80, 53),
    "ip proto 1 || proto udp": lambda s, d, p, q, x, n: x in (1, 17),
    "icmp or tcp and less 61": lambda s, d, p, q, x, n: x in (1, 6) and n <= 61,
    "icmp or (tcp and greater 1500)": lambda s, d, p, q, x, n: x == 1 or x == 6 and n >= 1500,
}


def test_cases(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for text, want in CASES.items():
        got = [tuple(r) for r in df.where(compile_capture_filter(text)).collect()]
        assert got == [r for r in ROWS if want(*r)], text


@pytest.mark.parametrize(
    "text", ["tcp port", "port x", "port 65536", "80", "(tcp", "tcp)", "tcp udp", "net 10.0.0.1/8", "net 10.0.0.0 mask 255.0.255.0", "portrange 9-3", "host 1.2.3", "not", "and", "ip proto x", "src", "less -1"]
)
def test_errors_name_a_position(spark, text):
    with pytest.raises(FilterSyntaxError) as e:
        compile_capture_filter(text)
    assert 0 <= e.value.position <= len(text)
