"""The TPC-H-like test tables as events of the model, tags and all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schema import DEV_FEE, DISPUTE, INFO, ORDER, SUBTYPE

MARKER = "demo"
#: 2000-07-01 and 2024-01-25 12:00:00 UTC, both inside the data, so the clock rule is exercised.
AS_OF_ORDERS, AS_OF_EVENTS = 962_409_600, 1_706_184_000


#: Nodes that keys are folded to, so that each node has many events; None keeps every key.
NODES = 50


def padded(c: Column, n: int = 64) -> Column:
    """Numbers as text whose order is that of the numbers."""
    return F.lpad(c.cast("string"), n, "0")


def node(key: str, nodes: int | None) -> Column:
    return padded(F.col(key) % nodes if nodes else F.col(key))


def epoch(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def tags(kind: int, *pairs: tuple[str, Column], extra: Column | None = None) -> Column:
    made = [F.array(F.lit("z"), F.lit(SUBTYPE[kind])), F.array(F.lit("y"), F.lit(MARKER), F.lit("x"))]
    made += [F.when(v.isNotNull(), F.array(F.lit(n), v)) for n, v in pairs]
    return F.array_compact(F.array(*made, *([extra] if extra is not None else [])))


def events_frame(df: DataFrame, kind: int, id_: Column, pubkey: Column, at: Column, tagged: Column) -> DataFrame:
    return df.select(id_.alias("id"), pubkey.alias("pubkey"), F.lit(kind).alias("kind"), at.cast("bigint").alias("created_at"), tagged.alias("tags"), F.lit("table").alias("relay"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_events(spark: SparkSession, sf_dir: str, nodes: int | None = NODES) -> DataFrame:
    """Orders as order events; some amounts and premiums are malformed or missing on purpose."""
    k = F.col("o_orderkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment")).alias("fiat"))
    df = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "pending").otherwise("canceled")
    amount = F.when(k % 17 == 0, "5.7").when(k % 19 != 0, F.floor("o_totalprice").cast("string"))
    premium = F.when(k % 13 == 0, "1.5").when(k % 7 != 0, (k % 11 - 5).cast("string"))
    methods = F.concat(F.array(F.lit("pm")), F.split("o_orderpriority", "-"))
    tagged = tags(ORDER, ("d", padded(k)), ("s", status), ("amt", amount), ("f", F.col("fiat")), ("premium", premium), extra=methods)
    return events_frame(df, ORDER, padded(k), node("o_custkey", nodes), epoch("o_orderdate"), tagged)


def state_events(spark: SparkSession, sf_dir: str, day_ties: bool = False) -> DataFrame:
    """The events table as orders with several states each; ``day_ties`` cuts times to days."""
    df = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    at = epoch("ts")
    if day_ties:
        at = F.floor(at / 86_400) * 86_400
    status = F.when(F.col("event_type") == "purchase", "success").otherwise(F.col("event_type"))
    d = F.concat_ws(":", F.col("user_id").cast("string"), "k")
    tagged = tags(ORDER, ("d", d), ("s", status), ("amt", F.floor(F.col("value") * 100).cast("string")))
    return events_frame(df, ORDER, padded(F.col("event_id")), padded(F.col("user_id") % 16), at, tagged)


def dispute_events(spark: SparkSession, sf_dir: str, nodes: int | None = NODES) -> DataFrame:
    """Each line as a dispute; its flags name five known statuses and an unknown one."""
    df = table(spark, sf_dir, "lineitem")
    pair = F.concat("l_returnflag", "l_linestatus")
    known = {"AF": "settled", "AO": "seller-refunded", "NF": "released", "NO": "initiated", "RF": "in-progress"}
    status = F.lit("other")
    for flags, s in known.items():
        status = F.when(pair == flags, s).otherwise(status)
    id_ = F.concat(padded(F.col("l_orderkey"), 20), padded(F.col("l_linenumber"), 8), padded(F.col("l_suppkey"), 16), padded(epoch("l_shipdate"), 20))
    return events_frame(df, DISPUTE, id_, node("l_suppkey", nodes), epoch("l_shipdate"), tags(DISPUTE, ("d", padded(F.col("l_orderkey"))), ("s", status)))


def fee_events(spark: SparkSession, sf_dir: str, nodes: int | None = NODES) -> DataFrame:
    """Each line as a dev-fee payment."""
    df = table(spark, sf_dir, "lineitem")
    id_ = F.concat(padded(F.col("l_orderkey"), 20), padded(F.col("l_linenumber"), 8), padded(F.col("l_suppkey"), 16), padded(epoch("l_shipdate"), 20))
    return events_frame(df, DEV_FEE, id_, node("l_suppkey", nodes), epoch("l_shipdate"), tags(DEV_FEE))


def info_events(spark: SparkSession, sf_dir: str, nodes: int | None = NODES) -> DataFrame:
    """Customers as info events; every third is about another node and so never chosen."""
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer")
    own = node("c_custkey", nodes)
    about = F.when(k % 3 == 0, F.lit("other")).otherwise(own)
    bond = F.when(F.col("c_acctbal") > 5000, "true").when(F.col("c_acctbal") > 0, "false").otherwise("yes")
    return events_frame(df, INFO, padded(k), own, F.lit(900_000_000) + k % 100, tags(INFO, ("d", about), ("bond_enabled", bond)))


def all_events(spark: SparkSession, sf_dir: str, nodes: int | None = NODES) -> DataFrame:
    out = order_events(spark, sf_dir, nodes)
    for made in (dispute_events, fee_events, info_events):
        out = out.unionByName(made(spark, sf_dir, nodes))
    return out
