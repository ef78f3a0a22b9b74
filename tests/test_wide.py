"""Amounts of up to 256 bits against Python's whole numbers."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.functions import wide as W
from ledgerlens.sources import landing

EDGES = [0, 1, 10**26 - 1, 10**26, 10**38 - 1, 10**38, 10**52 - 1, 10**52, 2**255, 2**256 - 1]


def numbers(n: int, seed: int) -> list[int]:
    rng = random.Random(seed)
    return EDGES + [rng.getrandbits(rng.randrange(1, 257)) for _ in range(n)]


def texts_of(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return frame.withColumn("w", W.parse_wide(F.col("t")))


@pytest.mark.parametrize("write", [str, hex, lambda n: f" 0X{n:064X} ", lambda n: f"+00{n}"])
def test_parsing_and_printing(spark, write):
    values = numbers(300, 1)
    rows = texts_of(spark, [write(n) for n in values]).select("i", W.wide_text(F.col("w")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: str(n) for i, n in enumerate(values)}


def test_missing_and_broken_text(spark):
    cases = {None: "0", "": "0", "  ": "0", "0x": None, "0xzz": None, "-5": None, "1.5": None, "1e5": None, "abc": None,
             str(2**256): None, hex(2**256): None, "0x" + "0" * 70 + "f": "15", "0" * 90 + "7": "7", "1 2": None}
    rows = texts_of(spark, list(cases)).orderBy("i").select(W.wide_text(F.col("w")).alias("x")).collect()
    assert [r.x for r in rows] == list(cases.values())


def test_sums_largest_and_order(spark):
    values = numbers(500, 2)
    frame = texts_of(spark, [hex(n) if n % 2 else str(n) for n in values] + ["broken"]).repartition(5)
    total, largest, least = frame.agg(
        W.wide_text(W.wide_sum(F.col("w"))), W.wide_text(F.max("w")), W.wide_text(F.min("w"))
    ).first()
    assert (total, largest, least) == (str(sum(values)), str(max(values)), str(min(values)))
    ordered = frame.filter("w IS NOT NULL").orderBy("w").select(W.wide_text(F.col("w")).alias("x")).collect()
    assert [int(r.x) for r in ordered] == sorted(values)
    assert frame.filter("w IS NULL").agg(W.wide_sum(F.col("w"))).first()[0] is None


def test_adding_comparing_and_units(spark):
    left, right = numbers(200, 3), numbers(200, 4)
    random.Random(5).shuffle(right)
    frame = spark.createDataFrame([(str(a), str(b)) for a, b in zip(left, right)], "a string, b string").select(
        W.parse_wide(F.col("a")).alias("a"), W.parse_wide(F.col("b")).alias("b")
    )
    rows = frame.select(
        W.wide_text(W.wide_add(F.col("a"), F.col("b"))).alias("total"),
        (F.col("a") < F.col("b")).alias("less"),
        W.wide_units(F.col("a"), 6).alias("units"),
    ).collect()
    for row, a, b in zip(rows, left, right):
        assert (row.total, row.less, row.units) == (str(a + b), a < b, float(f"{a}e-6"))


def test_decimals_become_wide(spark):
    frame = spark.createDataFrame([("0",), ("9" * 38,), ("-1",), (None,)], "t string")
    rows = frame.select(W.wide_text(W.wide_of(F.col("t").cast("decimal(38,0)"))).alias("x")).collect()
    assert [r.x for r in rows] == ["0", "9" * 38, None, None]


def test_token_amounts_beyond_38_digits_are_kept(spark):
    names = [part.split()[0].strip("`") for part in schemas.API_TOKEN_TRANSFER.split(", ")]

    def row(contract, value):
        given = {"hash": "0xA", "blockNumber": "1", "timeStamp": "5", "contractAddress": contract, "value": value}
        return tuple(given.get(n) for n in names)

    pages = spark.createDataFrame(
        [row("0xC", str(10**50)), row("0xc", hex(2**255)), row("0xc", "x"), row("0xc", None), row("0xd", "12")],
        schemas.API_TOKEN_TRANSFER,
    )
    found = {r.contract_address: r for r in landing.token_totals(landing.token_transfers_landing(pages)).collect()}
    assert found["0xc"].total_amount == str(10**50 + 2**255) and found["0xc"].largest_amount == str(2**255)
    assert (found["0xc"].transfers, found["0xc"].over_38_digits, found["0xc"].unreadable) == (4, 2, 1)
    assert (found["0xd"].total_amount, found["0xd"].over_38_digits, found["0xd"].unreadable) == ("12", 0, 0)
