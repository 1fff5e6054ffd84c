"""Derived inputs over the test tables: the event-study tables every registered query runs on (definitions in FIXTURES.md).

`oracle_views.py` states the same views in SQL.
"""
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import sessions as cal
from tidemark.runtime import literal_table

ZONE = "America/New_York"
CALENDAR = {"start": "2024-01-01", "end": "2024-01-31", "timezone": ZONE,
            "holidays": ["2024-01-01", "2024-01-15"], "early_closes": {"2024-01-26": "13:00"}}
AS_OF = "2024-01-30 12:00:00"
SECURITIES = 10


_SEEN = {}


def _once(spark, key, build):
    """A plan that many queries start from is resolved once per application."""
    key = (spark.sparkContext.applicationId, id(spark._jsparkSession), *key)
    if key not in _SEEN:
        _SEEN[key] = (spark, build())  # the session is kept, so that its id is not used again
    return _SEEN[key][1]


def table(spark, sf, name) -> DataFrame:
    return _once(spark, ("table", sf, name), lambda: read_table(spark, sf, name))


def read_table(spark, sf, name) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def ts(text):
    return F.lit(text).cast("timestamp")


def as_of():
    return ts(AS_OF)


def calendar(spark):
    return _once(spark, ("calendar",), lambda: cal.Calendar(spark, CALENDAR))


def minutes(col):
    return F.make_dt_interval(mins=col.cast("int"))


def security_id(user="user_id", n=SECURITIES):
    return (F.col(user) % n).cast("string")


def providers(spark):
    rows = [("P1", "https://p1.example/terms", "regular", True, ["sip"]),
            ("P2", "https://p2.example/terms", "regular", False, ["sip"]),
            ("P3", "https://p3.example/terms", "extended", True, ["sip"])]
    return literal_table(spark, rows, "provider_id string, terms_url string, session_scope string, research_permitted boolean, feeds array<string>")


def bars(spark, sf, n=SECURITIES) -> DataFrame:
    """Daily bars from the events of each security and session, with a few quality faults by modulo."""
    s = F.broadcast(calendar(spark).sessions.select("session", "idx", "close_utc"))
    at = F.struct("ts", "event_id")
    base = (table(spark, sf, "events").filter(F.col("value") > 0)
            .select(security_id(n=n).alias("security_id"), F.to_date("ts").alias("session"), "ts", "event_id", "value")
            .groupBy("security_id", "session")
            .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
                 F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
            .join(s, "session"))
    h = F.col("security_id").cast("int") * 31 + F.dayofmonth("session")
    sec = F.col("security_id").cast("int")
    return base.select(
        F.concat_ws("-", F.lit("B"), "security_id", F.date_format("session", "yyyyMMdd")).alias("price_id"), "security_id", "session", "idx",
        "open", "high", "low", "close", "volume",
        F.when(sec == 6, "P2").when(sec == 5, "P3").otherwise("P1").alias("provider_id"),
        F.when(h % 61 == 0, "iex").otherwise("sip").alias("feed"), F.lit("raw").alias("price_basis"),
        (h % 59 != 0).alias("complete"), (h % 83 == 0).alias("halted"), (h % 97 != 0).alias("corporate_actions_verified"),
        (F.col("close_utc") + F.expr("interval 1 minute")).alias("available_at"),
        (F.col("close_utc") + F.expr("interval 1 minute") + minutes(sec % 3)).alias("first_seen_at"))


def news(spark, sf) -> DataFrame:
    return news_of(table(spark, sf, "events"))


def news_of(events) -> DataFrame:
    e = events.filter(F.col("event_type") == "signup")
    n = F.col("event_id")
    seen = F.date_trunc("minute", "ts") + minutes(1 + n % 9)
    return e.select(
        F.concat(F.lit("E"), F.lpad(n.cast("string"), 10, "0")).alias("event_id"), n.alias("event_no"),
        F.concat_ws("-", F.lit("K"), F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("cluster_id"),
        security_id().alias("security_id"), F.concat(F.lit("S"), F.lpad(n.cast("string"), 10, "0")).alias("source_id"),
        F.lpad(F.col("user_id").cast("string"), 10, "0").alias("cik"),
        F.lpad((100 * (1 + F.col("user_id") % 90) + 11).cast("string"), 4, "0").alias("sic"),
        F.date_trunc("minute", "ts").alias("published_at"),
        F.when(n % 23 == 0, "day").when(n % 7 == 0, "second").otherwise("minute").alias("precision"),
        (F.date_trunc("minute", "ts") + F.expr("interval 5 minutes")).alias("cutoff"),
        (n % 19 != 0).alias("first_public_verified"), seen.alias("first_seen_at"),
        F.when(n % 3 == 0, "earnings").otherwise("guidance").alias("category"), F.col("user_id"))


def sources(spark, sf) -> DataFrame:
    e = news(spark, sf)
    n = F.col("event_no")
    stamp = F.date_format(F.from_utc_timestamp("published_at", ZONE), "yyyy-MM-dd HH:mm")
    text = F.concat(F.lit("Release of "), F.col("event_id"), F.lit(" at "), F.when(n % 31 == 0, F.lit("noon")).otherwise(stamp), F.lit(" ET"))
    return (e.withColumn("text", text).withColumn("timestamp_evidence", stamp)
            .select("source_id", "event_id", "timestamp_evidence", F.when(n % 43 == 0, "http://x.example/").otherwise("https://x.example/").alias("url"), "text",
                    F.when(n % 37 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"), "first_seen_at",
                    (F.col("first_seen_at") + F.when(n % 41 == 0, F.expr("interval -1 minute")).otherwise(F.expr("interval 1 minute"))).alias("retrieved_at")))


def securities(spark, sf) -> DataFrame:
    s = table(spark, sf, "events").select(security_id().alias("security_id")).distinct()
    k = F.col("security_id").cast("int")
    return s.select(
        "security_id", F.concat(F.lit("C"), "security_id").alias("company_id"), F.concat(F.lit("T"), "security_id").alias("ticker"),
        F.when(k == 7, "OTC").when(k % 2 == 0, "NASDAQ").otherwise("NYSE").alias("exchange"),
        F.when(k == 8, "etf").otherwise("common_stock").alias("security_type"),
        ts("2023-01-01 00:00:00").alias("valid_from"), F.when(k == 9, ts("2024-01-20 00:00:00")).alias("valid_to"),
        F.when(k == 4, ts("2024-01-05 00:00:00")).otherwise(ts("2023-01-01 00:00:00")).alias("available_at"))


def actions(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").filter((F.col("event_type") == "error") & (F.col("event_id") % 97 == 0))
    return e.select(F.concat(F.lit("A"), F.col("event_id").cast("string")).alias("action_id"), security_id().alias("security_id"),
                    F.when(F.col("event_id") % 2 == 0, "split").otherwise("dividend").alias("type"),
                    F.to_date("ts").alias("effective_date"), F.col("ts").alias("available_at"))


def features(spark, sf) -> DataFrame:
    return features_of(table(spark, sf, "events"))


def features_of(events) -> DataFrame:
    e = events.filter(F.col("event_type") == "view")
    n = F.col("event_id")
    return e.select(security_id().alias("security_id"), F.concat(F.lit("f"), (n % 5).cast("string")).alias("name"),
                    F.lpad(n.cast("string"), 10, "0").alias("revision_id"), F.col("value"), F.col("ts").alias("available_at"),
                    (F.col("ts") + minutes(n % 60)).alias("first_seen_at"), (F.col("ts") - F.expr("interval 1 hour")).alias("valid_from"),
                    F.when(n % 3 != 0, F.col("ts") + F.expr("interval 3 days")).alias("valid_to"),
                    F.when(n % 11 == 0, F.col("ts") + F.expr("interval 2 hours")).alias("label_available_at"))


def long_bars(spark, sf) -> DataFrame:
    """A long daily series from line items: 5 symbols over every weekday that ships anything."""
    at = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return (table(spark, sf, "lineitem").withColumn("session", F.to_date("l_shipdate")).filter(F.weekday("session") < 5)
            .withColumn("price", price).withColumn("security_id", (F.col("l_suppkey") % 5).cast("string"))
            .groupBy("security_id", "session")
            .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", at).alias("close"), F.sum("l_quantity").alias("volume")))


def filings(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    pri = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-"), F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0"),
                 F.lit("-"), F.lpad((k % 1000000).cast("string"), 6, "0")).alias("accession"),
        F.col("o_custkey").alias("cik_no"), F.to_date("o_orderdate").alias("filing_date"),
        F.when(F.col("o_orderstatus") == "F", "8-K/A").when(k % 7 == 0, "10-Q").otherwise("8-K").alias("form"),
        F.when(pri == "1", "2.02,9.01").when(pri == "2", "5.02, 7.01").when(pri == "3", "8.01,9.01")
         .when((pri == "4") & (k % 2 == 0), "Item 2.02 and 8.01").when(pri == "4", "3.99").alias("items_text"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(13 + k % 12).cast("int"), mins=(k % 60).cast("int"))).alias("accepted_at"),
        F.when(k % 29 == 0, "../bad path.htm").otherwise(F.concat(F.lit("doc"), k.cast("string"), F.lit(".htm"))).alias("primary_document"),
        k.alias("order_no"), F.col("o_totalprice").alias("amount"))


def facts(spark, sf) -> DataFrame:
    """Quarterly figures by nation; a third of them are repeated by the next year's filing with a restated value."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity")), "o_custkey")
    q = (o.withColumn("start", F.trunc("o_orderdate", "quarter").cast("date")).groupBy("entity", "start")
         .agg(F.round(F.sum("o_totalprice"), 2).alias("val")).withColumn("end", F.date_sub(F.add_months("start", 3), 1)))
    accn = lambda e, d: F.concat_ws("-", F.lit("Q"), F.lpad(e.cast("string"), 3, "0"), F.date_format(d, "yyyyMMdd"))
    own = q.select("entity", "start", "end", "val", accn(F.col("entity"), F.col("end")).alias("accn"), F.date_add("end", 30).alias("filed"))
    later = F.last_day(F.add_months("end", 12))
    again = q.filter(F.col("entity") % 3 == 0).select("entity", "start", "end", F.round(F.col("val") * 1.01, 2).alias("val"),
                                                     accn(F.col("entity"), later).alias("accn"), F.date_add(later, 30).alias("filed"))
    return own.unionByName(again).withColumn("form", F.lit("10-Q")).withColumn("tag", F.lit("Revenues"))


def trades(spark, sf) -> DataFrame:
    return trades_of(table(spark, sf, "events"))


def trades_of(events) -> DataFrame:
    e = events.filter(F.col("event_type") == "click")
    n = F.col("event_id")
    day, odd = F.to_date("ts"), F.col("user_id") % 2 == 1
    opening = F.to_utc_timestamp(F.to_timestamp(F.concat(day.cast("string"), F.lit(" 09:30:00"))), ZONE)
    t = opening + F.make_dt_interval(secs=(n % 90).cast("decimal(18,6)"))
    return e.select(F.col("user_id").alias("symbol"), day.alias("session"), t.alias("t"), F.col("value").alias("price"), n.alias("trade_id"),
                    F.when(n % 5 == 0, "X").when(odd, "N").otherwise("Q").alias("print_venue"), F.when(n % 7 == 0, "B").when(odd, "A").otherwise("C").alias("print_tape"),
                    F.when(n % 4 == 0, F.array(F.lit("@"))).otherwise(F.array(F.lit("@"), F.lit("Q"))).alias("conditions"),
                    F.when(n % 53 == 0, "X").alias("correction"), (t + F.make_dt_interval(secs=(n % 8).cast("decimal(18,6)"))).alias("received_at"))


def listings(spark, sf) -> DataFrame:
    """Every symbol that trades (a user) with the exchange of its security."""
    own = table(spark, sf, "events").select(F.col("user_id").alias("symbol"), security_id().alias("security_id")).distinct()
    return own.join(securities(spark, sf), "security_id").select("symbol", "exchange")


def event_stream(session, sf) -> DataFrame:
    """The events table as a file stream, with timestamps a watermark accepts."""
    path = f"{sf}/events.parquet"
    schema = session.read.parquet(path).schema
    s = session.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))
