"""Registered queries against their SQL checks.

By default a few per section; BARLINE_ALL=1 runs every query.
"""

import os

import __spark_entry__ as entry
import pytest
from oracle import compare, connect

SOME = """A01 A06 A08 A16 B08 B10 B17 B18 C01 C02 C03 C12 C16 C20 C24 D01 D03 D11 D22 D32 D45 D51 D54 E05 E06 E14 E15 E25 E29
E34 E36 F03 F09 G03 G04 H02 H13 H17 H19 H21 I01 I04 I09 I14 I21 I24 I30 I33 J02 J04 J05 J06 J09 J16 J19 J21 J25 J27 J29 J32 K13 K22 L01
L05 L06 M01 M02 M09 flagship""".split()
CHECKS = entry.oracle_sql()
PLANS = entry.queries()
ALL = os.environ.get("BARLINE_ALL") == "1"
NAMES = [n for n in PLANS if ALL or any(n.startswith(p) for p in SOME)]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf_dir, con):
    df = PLANS[name](spark, sf_dir)
    if name in CHECKS:
        assert compare(df, con, CHECKS[name]) is None
    else:
        rows = df.collect()
        assert rows and any(v is not None for v in rows[0])


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(PLANS)


def test_entry(spark):
    df = entry.entry(spark)
    assert "profit_factor" in df.columns and df.count() > 0


def test_cells_without_a_label_get_the_sentinel(spark, sf_dir):
    from barline.plans.rows import cells

    got = {r.bucket: r.n for r in PLANS["C10_left_join_sentinel"](spark, sf_dir).collect()}
    c = cells(spark, sf_dir)
    assert "VOL_NONE" not in got and got["VOL_NA"] == c.filter("wo % 4 = 3").count() > 0
    assert sum(got.values()) == c.count()
