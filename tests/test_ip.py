import pytest
from pyspark.sql import functions as F

from packetlens.functions.ip import format_ipv4, ip_to_long, long_to_ip, parse_ipv4, swap32, swap32_col


def test_literals():
    assert parse_ipv4("192.168.0.1") == 3232235521 and format_ipv4(3232235521) == "192.168.0.1"
    assert swap32(0x01020304) == 0x04030201
    for bad in ("1.2.3", "1.2.3.256", "a.b.c.d", "1.2.3.4.5", ""):
        with pytest.raises(ValueError, match="not an IPv4"):
            parse_ipv4(bad)


def test_columns(spark):
    df = spark.createDataFrame([(0,), (1,), (2**32 - 1,), (3232235521,)], "v long")
    for r in df.select("v", long_to_ip(F.col("v")).alias("t"), ip_to_long(long_to_ip(F.col("v"))).alias("back"), swap32_col(F.col("v")).alias("s")).collect():
        assert r.t == format_ipv4(r.v) and r.back == r.v and r.s == swap32(r.v)
    bad = spark.createDataFrame([("1.2.3",), ("x",), (None,), ("1.2.3.999",)], "t string").select(ip_to_long(F.col("t")).alias("v")).collect()
    assert all(r.v is None for r in bad)
