import math

import pytest
from pyspark.sql import functions as F

from torvane.config import Arguments, EngineConfig
from torvane.functions import bits, share
from torvane.functions import ring as rg
from torvane.functions.ring import ring
from torvane.functions.share import Dealer

WRAP = 1 << 64
EDGES = [0, 1, -1, 2, -2, 1023, 1024, -1024, (1 << 63) - 1, -(1 << 63), 1 << 40, -(1 << 40) + 7]


def signed(x: int) -> int:
    x %= WRAP
    return x - WRAP if x >= WRAP // 2 else x


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, x, EDGES[(3 * i + 1) % len(EDGES)]) for i, x in enumerate(EDGES)]
    return spark.createDataFrame(rows, "i long, x long, y long")


D = Dealer(("i",))


def run(spark, df, **columns):
    with ring(spark):
        out = df.select("x", "y", *(c.alias(k) for k, c in columns.items()))
    return out.collect()


def test_ring_wraps_and_shares_open(spark, pairs):
    X, Y = F.col("x"), F.col("y")  # noqa: N806
    rows = run(
        spark, pairs, s=X + Y, p=X * Y,
        so=share.open_sum(share.add(D.share(X, "x"), D.share(Y, "y"))),
        po=share.open_sum(D.multiply(D.share(X, "x"), D.share(Y, "y"))),
        bo=share.open_xor(D.multiply_bits(D.share_bits(X, "x"), D.share_bits(Y, "y"))),
    )
    for r in rows:
        assert r.s == r.so == signed(r.x + r.y)
        assert r.p == r.po == signed(r.x * r.y)
        assert r.bo == signed(r.x & r.y)


def test_ansi_mode_is_restored(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    with pytest.raises(RuntimeError), ring(spark):
        raise RuntimeError
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_shared_bits_and_comparison(spark, pairs):
    X, Y = F.col("x"), F.col("y")  # noqa: N806
    small = pairs.filter("x between -2047 and 2047 and y between -2047 and 2047")
    with ring(spark):
        at = share.Held(small)
        found = D.bits(at, D.share(X, "x"), (0, 7, 31, 63))
        g, e = D.geq(at, D.share(X, "x"), D.share(Y, "y"), 26), D.equal_bits(at, D.share_bits(X, "x"), D.share_bits(Y, "y"), 11)
        opened = {f"b{p}": share.open_xor(b) for p, b in zip((0, 7, 31, 63), found, strict=True)}
        rows = at.done(**opened, g=share.open_xor(g), e=share.open_xor(e), plain=bits.geq(X, Y, 26)).collect()
    assert len(rows) > 2
    for r in rows:
        assert [r.b0, r.b7, r.b31, r.b63] == [(r.x >> p) & 1 for p in (0, 7, 31, 63)]
        assert r.g == r.plain == int(r.x >= r.y)
        assert r.e == int(r.x % 2048 == r.y % 2048)


def test_bit_words(spark, pairs):
    X, Y = F.col("x"), F.col("y")  # noqa: N806
    rows = run(spark, pairs, h=bits.hex128(X, Y), back=bits.parse_hex128(F.concat(F.lit("0x"), F.upper(bits.hex128(X, Y)))), low=bits.to_bits(X, 70), none=bits.to_bits(X, 0), every=bits.and_all(X, 64), pairs=bits.pairwise_and(X))
    for r in rows:
        assert r.h == f"{r.x % WRAP:016x}{r.y % WRAP:016x}"
        assert (r.back.hi, r.back.lo) == (r.x, r.y)
        assert r.low == [(r.x >> i) & 1 if i < 64 else 0 for i in range(70)] and r.none == []
        assert r.every == int(r.x == -1)
        assert r.pairs == signed((r.x & (r.x << 1)) & 0xAAAAAAAAAAAAAAAA)


def test_unsigned_text(spark):
    df = spark.createDataFrame([("0",), (" 18446744073709551615",), ("9223372036854775808",), ("7 ",)], "t string")
    with ring(spark):
        assert [r[0] for r in df.select(bits.unsigned(F.col("t"))).collect()] == [0, -1, -(1 << 63), 7]


def test_truncation_of_shares_is_exact_or_one_more(spark):
    X, Y = F.col("x"), F.col("y")  # noqa: N806
    df = spark.range(20000).select(F.col("id").alias("i"), ((F.col("id") * 7919) % 2000001 - 1000000).alias("x"))
    with ring(spark):
        got = df.select((share.open_sum(share.truncate_local(D.share(X), 10)) - rg.truncate(X, 10)).alias("e")).groupBy("e").count().collect()
    counts = {r["e"]: r["count"] for r in got}
    assert counts.keys() == {0, 1} and min(counts.values()) > 5000


def test_encode_decode_and_functions_of_one_value(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.5, -1.5, 0.0009, -0.0009, 123.4567)], "v double")
    with ring(spark):
        rows = df.select("v", rg.encode(F.col("v"), 10).alias("e"), rg.encode_floor(F.col("v"), 10).alias("f"), rg.decode(rg.encode(F.col("v"), 10), 10).alias("d"), rg.clipped_relu(rg.encode(F.col("v"), 10), 10).alias("c"), rg.inverse_sqrt(rg.encode(F.col("v"), 10), 10).alias("r")).collect()
    for r in rows:
        assert r.e == r.f == math.trunc(r.v * 1024) and abs(r.d - r.v) < 1 / 1024
        assert r.c == min(max(r.e + 512, 0), 1024)
        assert r.r == (math.trunc(1024 / math.sqrt(r.e / 1024)) if r.e > 0 else None)


def test_gcd_and_lcm(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (12, 18), (7919, 7907), (1 << 40, 1 << 20), (12200160415121876738, 1)][:5], "a long, b long")
    with ring(spark):
        rows = df.select("a", "b", rg.gcd(F.col("a"), F.col("b")).alias("g"), rg.lcm(F.col("a"), F.col("b")).alias("l")).collect()
    for r in rows:
        assert r.g == math.gcd(r.a, r.b) and r.l == math.lcm(r.a, r.b)


def test_config():
    assert EngineConfig().compare_bit == 26 and EngineConfig.parse(f="8", i="20").one == 256
    for bad in ({"f": 40, "i": 30}, {"f": 0}, {"truncation": "no"}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    with pytest.raises(ValueError):
        EngineConfig.parse(color="red")


def test_settings_from_files_and_words(tmp_path):
    path = tmp_path / "engine.toml"
    path.write_text("[engine]\nf = 8\ni = 20\n")
    assert EngineConfig.load(str(path), {}) == EngineConfig(8, 20)
    assert EngineConfig.load(str(path), {"APP_I": "30", "OTHER": "x"}) == EngineConfig(8, 30)
    with pytest.raises(ValueError):
        EngineConfig.load(str(path), {"APP_F": "60"})
    assert Arguments.parse([f"cfg={path}", "ti=true"]) == Arguments(str(path), True) and not Arguments.parse([f"cfg={path}"]).ti
    for bad in ([], ["ti=true"], [f"cfg={path}", "x=1"], [f"cfg={path}", "ti=yes"], ["cfg=/nowhere/at/all"], [f"cfg={path}", f"cfg={path}"], ["word"]):
        with pytest.raises(ValueError):
            Arguments.parse(bad)
    path.write_text("[engine")
    with pytest.raises(ValueError):
        EngineConfig.load(str(path), {})
