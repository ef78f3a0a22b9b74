import datetime as dt
import hashlib
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import calendar as C
from ledgerlens.functions import ledger as L
from ledgerlens.functions import stats as S
from ledgerlens.functions import tiers as T


def one(spark, expression, **columns):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return frame.select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "text,expected",
    [
        ("0x0", 0),
        ("0xff", 255),
        ("0xFFFFFFFFFFFFFFFFFF", 2**72 - 1),
        (hex(10**30), 10**30),
        (hex(10**38 - 1), 10**38 - 1),
        ("0x" + "0" * 40 + "10", 16),
        (hex(10**38), None),
        (hex(2**255), None),
        ("1000000000000000000000", 10**21),
        ("0", 0),
        ("", 0),
        (None, 0),
        ("0xzz", None),
        ("abc", None),
        ("9" * 39, None),
    ],
)
def test_parse_amount(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "v string")
    value = frame.select(L.parse_amount(F.col("v")).alias("x")).first().x
    assert value == (None if expected is None else Decimal(expected))


def test_parse_amount_random(spark):
    rng = np.random.default_rng(1)
    numbers = [int(rng.integers(0, 2**62)) * int(rng.integers(0, 2**62)) for _ in range(200)]
    frame = spark.createDataFrame([(hex(n), str(n)) for n in numbers], "h string, d string")
    rows = frame.select(L.parse_amount(F.col("h")).alias("h"), L.parse_amount(F.col("d")).alias("d")).collect()
    assert [int(r.h) for r in rows] == numbers == [int(r.d) for r in rows]


def test_addresses(spark):
    frame = spark.createDataFrame([(" 0XAb ",), ("",), (None,)], "a string")
    rows = frame.select(L.normalize_address(F.col("a")).alias("n"), L.address_or_null(F.col("a")).alias("o")).collect()
    assert [r.n for r in rows] == ["0xab", "", ""]
    assert [r.o for r in rows] == ["0xab", None, None]


def test_record_hash(spark):
    frame = spark.createDataFrame([("a", None, 5)], "x string, y string, z int")
    value = frame.select(L.record_hash(F.col("x"), F.col("y"), F.col("z")).alias("h")).first().h
    assert value == hashlib.sha256(b"a|None|5").hexdigest()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(day=st.dates(dt.date(1996, 1, 1), dt.date(2032, 12, 31)), other=st.dates(dt.date(1996, 1, 1), dt.date(2032, 12, 31)))
def test_calendar(spark, day, other):
    d, o = F.lit(day), F.lit(other)
    row = spark.range(1).select(
        C.week_start(d).alias("start"),
        C.week_of_year(d).alias("week"),
        C.months_between_dates(d, o).alias("months"),
        C.weeks_between_dates(d, o).alias("weeks"),
        C.quarter_end(d).alias("quarter_end"),
    ).first()

    def sunday(x):
        return x - dt.timedelta(days=(x.weekday() + 1) % 7)

    assert row.start == sunday(day)
    assert row.week == int(day.strftime("%U"))
    assert row.months == (day.year - other.year) * 12 + day.month - other.month
    assert row.weeks == (sunday(day) - sunday(other)).days // 7
    month = (day.month - 1) // 3 * 3 + 3
    following = dt.date(day.year + month // 12, month % 12 + 1, 1)
    assert row.quarter_end == following - dt.timedelta(days=1)


def test_tiers_cover_every_value(spark):
    values = [None, 0.0, 0.0005, 0.001, 0.1, 1.0, 10.0, 100.0, 5e9]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    rows = [r.t for r in frame.select(T.value_tier(F.col("v")).alias("t")).collect()]
    assert rows == ["zero", "zero", "micro", "small", "medium", "large", "very_large", "whale", "whale"]
    risk = spark.createDataFrame([(0.39,), (0.4,), (0.7,), (0.9,)], "v double")
    assert [r.t for r in risk.select(T.risk_category(F.col("v")).alias("t")).collect()] == [
        "low", "medium", "high", "critical",
    ]


@pytest.mark.parametrize("bins", [4, 16, 1024])
def test_exact_quantiles_match_numpy(spark, bins):
    """Few bins take many rounds; a third of the rows share one value, others lie 600 decades apart."""
    rng = np.random.default_rng(3)
    a = np.where(rng.random(5000) < 0.33, 7.0, rng.normal(size=5000) * 100)
    b = np.arange(5000.0)
    c = 10.0 ** rng.uniform(-300, 300, 5000) * rng.choice([-1, 0, 1], 5000)
    frame = spark.createDataFrame([tuple(map(float, x)) for x in zip(a, b, c)], "a double, b double, c double").repartition(5)
    probabilities = [0.0, 0.001, 0.25, 0.5, 0.75, 0.99, 1.0]
    rows = S.exact_quantiles(frame, ["a", "b", "c"], probabilities, bins=bins).collect()
    found = {(r.feature, r.probability): r.quantile for r in rows}
    for p in probabilities:
        for name, x in (("a", a), ("b", b), ("c", c)):
            assert found[name, p] == pytest.approx(np.quantile(x, p), rel=1e-12)


def test_ranks_do_not_depend_on_the_sketch(spark):
    """A sketch of no use at all costs rounds, never the result."""
    rng = np.random.default_rng(4)
    x = np.r_[rng.lognormal(0, 8, 3000), [np.inf, -np.inf, np.inf, 0.0]]
    values = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)], "g int, value double")
    wanted = {f"r{k}": (0.99, lambda n, k=k: F.least(F.lit(k), n - 1)) for k in (0, 1, 700, 5000)}
    got = {(r.g, r.name): r.value for r in S.select_ranks(values, ["g"], wanted, accuracy=2, bins=8).collect()}
    for g in (0, 1):
        own = np.sort(x[np.arange(len(x)) % 2 == g])
        assert {k: got[g, f"r{k}"] for k in (0, 1, 700, 5000)} == {k: own[min(k, len(own) - 1)] for k in (0, 1, 700, 5000)}


def test_discrete_quantiles_by_group(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", None), (None, 5.0), (None, 4.0), ("b", None), ("c", float("nan"))]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.m, r.top) for r in S.discrete_quantiles(frame, ["g"], F.col("v"), {"m": 0.5, "top": 1.0}).collect()}
    assert got == {"a": (2.0, 3.0), None: (4.0, 5.0)}
    assert S.discrete_quantiles(frame.filter("false"), [], F.col("v"), {"m": 0.5}).count() == 0
    whole = S.discrete_quantiles(frame, [], F.col("v"), {"m": 0.5}).collect()
    assert [tuple(r) for r in whole] == [(3.0,)]


def test_median_of_a_day_with_over_a_million_rows(spark):
    day = spark.range(1_200_000).select(F.when(F.col("id") < 1_199_990, F.to_date(F.lit("2024-10-01"))).otherwise(F.to_date(F.lit("2024-10-02"))).alias("d"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7).alias("v"))
    got = {str(r.d): r.m for r in S.discrete_quantiles(day, ["d"], F.col("v"), {"m": 0.5}).collect()}
    values = day.toPandas()
    for d, v in values.groupby(values.d.astype(str)).v:
        assert got[d] == np.sort(v.to_numpy())[(len(v) + 1) // 2 - 1]


def test_quantiles_ignore_missing(spark):
    frame = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "a double")
    assert S.exact_quantiles(frame, ["a"], [0.5]).first().quantile == 2.0


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    values = rng.random(1000)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = {r.bin: r["count"] for r in S.histogram(frame, "v", 20).collect()}
    expected, _ = np.histogram(values, bins=20)
    assert [rows.get(i, 0) for i in range(20)] == expected.tolist()


def test_hexadecimal_of_any_length(spark):
    from ledgerlens.functions import ledger

    cases = {
        "0x" + "0" * 60 + "ffff1234": 4294906420,
        "0x" + "0" * 78 + "10": 16,
        "0x" + "f" * 31: 16**31 - 1,
        "0x" + "f" * 65: None,
        "1" + "0" * 38: None,
        "0x": None,
        "": 0,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", ledger.parse_amount(F.col("t")).alias("n"))
    assert {r.t: None if r.n is None else int(r.n) for r in df.collect()} == cases


def test_page_bounds():
    from ledgerlens.operators import risk

    for wrong in ({"min_score": 1.2}, {"page": 0}, {"page_size": 1001}, {"min_tx_count": -1}):
        with pytest.raises(ValueError):
            risk.risk_wallet_page(None, None, **wrong)
