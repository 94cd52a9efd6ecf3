import pytest
from conftest import rows

from packetlens import queries as q
from packetlens.operators.engine import OPERATORS, PacketFrame, aggregate_column
from packetlens.testdata import packets

SLOW = {"stream_ingest", "stream_agg", "pcap_roundtrip", "store_roundtrip", "filter_ip_or_proto_store", "filter_time_disjoint_store", "filter_time_range_store"}


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_against_sql(spark, sf, oracle, name):
    assert rows(q.queries()[name](spark, sf)) == oracle(q.oracle_sql()[name])


#: filter -> rows and bytes at sf0.001
EXPECTED = {
    "": (1000, 89552), "ip.addr == 192.168.0.7": (4, 393), "ip.addr != 10.0.0.1": (1000, 89552), "ip.addr != 10.0.0.1 && udp": (268, 23602), "ip.src != 10.0.0.1 && udp": (253, 22364),
    "port == 443 && frame.len < 60": (86, 4246), "tcp && frame.len > 100 || icmp": (168, 25081), "icmp || udp && frame.len < 60": (289, 21728), "udp && frame.len < 60 || icmp": (88, 4360),
    "port.src >= 1024 && port.dst < 100": (424, 38350), "frame.time > Jan 15, 2024 00:00:00": (506, 44884), "frame.time < Jan 15, 2024 00:00:00": (494, 44668), "proto != 6": (469, 40970),
    "frame.len <= 99999999": (1000, 89552), "ip.src == 10.0.0.1 || udp": (302, 27037),
}


@pytest.mark.parametrize("text", EXPECTED)
def test_known_results(spark, sf, text):
    got = PacketFrame(packets(spark, sf)).filter(text).df.selectExpr("count(*)", "sum(length)").first()
    assert tuple(got) == EXPECTED[text]


def test_daily_aggregates(spark, sf):
    f = PacketFrame(packets(spark, sf))
    for op, want in {"sum": 3203, "mean": 97, "min": 40, "max": 329, "count": 33}.items():
        out = f.aggregate(op, "length", q.DAY).collect()
        assert len(out) == 30 and tuple(out[0]) == (1704067200000000, want)
    assert f.aggregate("count_dist", "v4Src", q.DAY).first()[1] == 18


def test_aggregate_options(spark, sf):
    f = PacketFrame(packets(spark, sf))
    exact = f.aggregate("mean", "length", q.DAY, exact_mean=True).first()[1]
    assert exact == pytest.approx(3203 / 33)
    gaps = f.filter("ip.addr == 192.168.0.7").aggregate("count", "length", q.DAY, fill_gaps=True).collect()
    assert len(gaps) > 4 and sum(r[1] or 0 for r in gaps) == 4
    assert PacketFrame(f.df, compat=True).aggregate("sum", "v4Dst", 10**15).first()[1] < 2**32
    for bad in (("median", "length"), ("sum", "payload")):
        with pytest.raises(ValueError, match="one of"):
            aggregate_column(*bad)
    assert len(OPERATORS) == 6


def test_plan_has_partial_aggregation_and_pruned_columns(spark, sf):
    plan = q.flagship(spark, sf)._jdf.queryExecution().toString()
    assert "partial_sum" in plan and "props" not in plan.split("== Physical Plan ==")[1]
