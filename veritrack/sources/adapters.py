"""The position tables of the domain, made from the driver's star-schema tables.

Positions are built as integers and divided once, so that other engines give
the same doubles. Every tenth vessel stays in place; the others follow a
triangle wave of 96 hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LAT = "2550 + ((user_id*7919)%1000)*120 div 1000 + CASE WHEN user_id%10=0 THEN 0 ELSE 30*abs((user_id*37+h)%96-48) div 48 END"
_LON = "5550 + ((user_id*104729)%1000)*160 div 1000 + CASE WHEN user_id%10=0 THEN 0 ELSE 40*abs((user_id*53+h)%96-48) div 48 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "ts", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS us")
    return e.selectExpr("*", "us div 3600000000 AS h").selectExpr("*", f"{_LAT} AS lat_c", f"{_LON} AS lon_c")


def ais_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, mmsi, t, hour, lat, lon, vessel_type, ship_name``: one row for each vessel, cell and hour."""
    return _events(spark, sf_dir).where("event_type <> 'view'").selectExpr(
        "event_id", "user_id AS mmsi", "h*3600000000 AS t", "h AS hour",
        "CAST(lat_c + CASE WHEN event_type='error' AND event_id%11=0 THEN 80 ELSE 0 END AS DOUBLE)/100 AS lat", "CAST(lon_c AS DOUBLE)/100 AS lon",
        "CASE WHEN user_id%7=0 THEN 'FISHING' WHEN user_id%5=0 THEN 'OTHER' WHEN user_id%3=0 THEN 'TANKER' ELSE 'CARGO' END AS vessel_type",
        "CASE WHEN user_id%10=5 THEN concat('NET BUOY ', user_id) ELSE concat('VESSEL ', user_id) END AS ship_name")


def sar_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sar_id, t, hour, mmsi, lat, lon``: radar detections; every fifth has no vessel."""
    return _events(spark, sf_dir).where("event_type = 'view'").selectExpr(
        "event_id AS sar_id", "us AS t", "h AS hour", "CASE WHEN event_id%5=0 THEN NULL ELSE user_id END AS mmsi",
        "CAST(lat_c*20 + (event_id*31)%41-20 + CASE WHEN event_id%13=0 THEN 600 ELSE 0 END AS DOUBLE)/2000 AS lat",
        "CAST(lon_c*20 + (event_id*17)%41-20 AS DOUBLE)/2000 AS lon")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mmsi, name, flag, segment, built_year``."""
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name AS flag")
    return (table(spark, sf_dir, "customer").join(nation, "c_nationkey", "left")
            .selectExpr("c_custkey AS mmsi", "c_name AS name", "flag", "c_mktsegment AS segment", "1990 + c_custkey%35 AS built_year"))


def port_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mmsi, t, duration_hrs, port, lat, lon`` from orders."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS visit_id", "o_custkey AS mmsi", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) AS t", "o_totalprice/1000 AS duration_hrs", "o_orderpriority AS port",
        "CAST(2000 + (o_orderkey*37)%1500 AS DOUBLE)/100 AS lat", "CAST(5000 + (o_orderkey*91)%2500 AS DOUBLE)/100 AS lon")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``facility, lat, lon, flagged`` from suppliers."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS facility", "CAST(2550 + (s_suppkey*7919)%120 AS DOUBLE)/100 AS lat", "CAST(5550 + (s_suppkey*104729)%160 AS DOUBLE)/100 AS lon", "s_suppkey%5 = 0 AS flagged")


_FLAG = "element_at(array('GAB', 'PAN', 'USA', 'CHN', 'CMR', 'LBR', 'IND'), CAST(1 + {}%7 AS INT))"


def particulars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mmsi, flag, vessel_type, built_year, cached_built_year``: flag codes, utility craft and unknown years among them."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS mmsi", f"{_FLAG.format('c_nationkey')} AS flag", "CASE WHEN c_custkey%6=0 THEN 'Tug' WHEN c_custkey%6=1 THEN 'Patrol Vessel' ELSE 'CARGO' END AS vessel_type",
        "CASE WHEN c_custkey%4<>0 THEN 1990 + c_custkey%35 END AS built_year", "CASE WHEN c_custkey%8=0 THEN 2000 END AS cached_built_year")


def vessel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, mmsi, event_type, t_start, t_end, lat, lon, duration_hrs, country``: events of four kinds from orders."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS m", "o_totalprice AS p", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) AS us")
    return o.selectExpr(
        "k AS event_id", "m AS mmsi",
        "CASE WHEN m%4=1 THEN CASE WHEN k%2=0 THEN 'port_visit' ELSE 'loitering' END WHEN k%6=3 THEN 'loitering' WHEN k%6=4 THEN 'ais_gap' WHEN k%6=5 THEN 'encounter' ELSE 'port_visit' END AS event_type",
        "us AS t_start", "us + CAST(floor(p*7200000) AS BIGINT) AS t_end",
        "CAST(CASE WHEN m%3=0 THEN 2500 + (k*37)%400 ELSE 500 + (k*37)%4500 END AS DOUBLE)/100 AS lat", "CAST(CASE WHEN m%3=0 THEN 5500 + (k*91)%500 ELSE 3000 + (k*91)%6000 END AS DOUBLE)/100 AS lon",
        "p/500 AS duration_hrs", "concat('C', k%(m%5+1)) AS country")


def identity_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mmsi, json``: an identity payload of each vessel, with changing flags and names, foreign numbers and stubs among its reports."""
    iso = lambda us: f"date_format(timestamp_micros({us}), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\")"
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS m", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) AS us")
    r = o.selectExpr("m AS mmsi", f"""named_struct('id', concat('r', k), 'ssvid', CAST(CASE WHEN k%11=0 THEN m+1 ELSE m END AS STRING),
        'flag', CASE WHEN k%10=0 THEN NULL WHEN k%13=0 THEN 'PAN' ELSE {_FLAG.format('m')} END, 'shipname', CASE WHEN k%6=0 THEN NULL WHEN k%17=0 THEN concat('RENAMED ', m) ELSE concat('VESSEL ', m) END,
        'imo', CAST(m*10 AS STRING), 'transmissionDateFrom', {iso('us')}, 'transmissionDateTo', {iso('us + (k%40)*86400000000')}, 'positionsCounter', k*7919%3000) AS r""")
    return r.groupBy("mmsi").agg(F.to_json(F.struct(F.array(F.struct(F.collect_list("r").alias("selfReportedInfo"))).alias("entries"))).alias("json"))
