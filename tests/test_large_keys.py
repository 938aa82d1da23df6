"""Registered queries on tables whose keys are those of larger ones, against their SQL."""

import datetime as dt
import ipaddress

import duckdb
from pyspark.sql import functions as F

from marlstone import catalog
from marlstone.functions import net


def compare(spark, folder, name, table, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(f"{folder}/{table}.parquet")
    got = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_dates_of_five_digit_years(spark, tmp_path):
    keys = [1, 146_645, 146_646, 146_647, 899_999, 107_374_182]
    compare(spark, tmp_path, "date_fields", "orders", [(k, k, dt.datetime(1996, 2, 29)) for k in keys], "o_orderkey long, o_custkey long, o_orderdate timestamp")


WIDE_KEYS = [1, 2, 9, 65_534, 65_535, 65_536, 65_537, 65_538, 131_071, 1_048_575, 1_048_576, 1 << 31, (1 << 32) - 1, 1 << 32, (1 << 48) + 6]


def test_addresses_of_several_groups(spark, tmp_path):
    compare(spark, tmp_path, "formats_net", "customer", [(k,) for k in WIDE_KEYS], "c_custkey long")


def test_names_of_several_groups(spark, tmp_path):
    compare(spark, tmp_path, "net_names", "customer", [(k,) for k in WIDE_KEYS], "c_custkey long")


def test_groups_of_an_address(spark):
    numbers = [0, 65_535, 65_536, 900_000, (1 << 32) + 1, (1 << 48) + 6]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", net.ipv6_canonical(F.concat(F.lit("fe80::"), net.ipv6_groups(F.col("n")))).alias("t")).collect()
    assert [(r["n"], r["t"]) for r in rows] == [(n, str(ipaddress.IPv6Address((0xFE80 << 112) + n))) for n in numbers]
