"""Store-sales tables derived by Spark from the driver's TPC-H-style tables.

Mapping (one store per nation, numbered nation key + 1; one product family per part type):

* sales          lineitem x part x supplier summed per (ship date, supplier nation, part type)
* stores         nation x region; city = nation, state = region
* oil            order-price average per weekday; weekend orders count for the Friday before
* transactions   order count per (order date, customer nation)
* holidays       calendar rules expanded over the years the sales cover, plus one
                 regional event per region and one local event per nation
* future         the 16 days after the internal test window for every observed pair
* request_log    the events table read as a service request log

Every table is a lazy DataFrame over the parquet inputs, so its work grows
with them. ``oracle.py`` next to this module holds the same definitions in SQL.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfcast.operators.splits import Windows
from shelfcast.session import written_lookup


def windows_ending(last: dt.date) -> Windows:
    """Future, internal test and validation: three windows of WINDOW_DAYS up to ``last``; training before."""
    def back(days: int) -> dt.date:
        return last - dt.timedelta(days=days)

    n = WINDOW_DAYS
    return Windows(
        train_end=back(3 * n), validation_start=back(3 * n - 1), validation_end=back(2 * n),
        internal_test_start=back(2 * n - 1), internal_test_end=back(n), future_start=back(n - 1), future_end=last,
    )

# --- fixed values: start of the id count, promotion rule ---------------------
ID_EPOCH = dt.date(1995, 1, 1)
PROMO_DISCOUNT = 0.08

#: Days of each evaluation window; they are counted back from the last ship date, so every row has a place.
WINDOW_DAYS = 16

# --- fixed values: national calendar rules ----------------------------------
# (month, day, type, locale, locale_name, description, transferred)
CALENDAR_RULES = [
    (1, 1, "Holiday", "National", "Ecuador", "Primer dia del ano", False),
    (1, 5, "Work Day", "National", "Ecuador", "Recupero puente primer dia del ano", False),
    (2, 14, "Observance", "National", "Ecuador", "San Valentin", False),
    (3, 3, "Holiday", "Local", "Atlantis", "Fundacion de Atlantis", False),
    (4, 16, "Event", "National", "Ecuador", "Terremoto Manabi", False),
    (5, 10, "Event", "National", "Ecuador", "Dia de la Madre", False),
    (6, 20, "Event", "National", "Ecuador", "Mundial de futbol Brasil", False),
    (8, 10, "Holiday", "National", "Ecuador", "Primer Grito de Independencia", True),
    (8, 11, "Transfer", "National", "Ecuador", "Traslado Primer Grito de Independencia", False),
    (11, 24, "Event", "National", "Ecuador", "Black Friday", False),
    (11, 27, "Event", "National", "Ecuador", "Cyber Monday", False),
    (12, 24, "Additional", "National", "Ecuador", "Navidad-1", False),
    (12, 25, "Holiday", "National", "Ecuador", "Navidad", False),
    (12, 26, "Bridge", "National", "Ecuador", "Puente Navidad", False),
]
RULE_SCHEMA = T.StructType([
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("locale", T.StringType()),
    T.StructField("locale_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("transferred", T.BooleanType()),
])

# Request-log mapping of event types to service paths (fixed values).
EVENT_PATHS = {
    "view": "/forecast",
    "purchase": "/forecast",
    "click": "/health",
    "signup": "/metrics",
    "error": "/admin",
}


def d(value: dt.date):
    return F.lit(value).cast("date")


@dataclass
class Source:
    """Lazy access to the parquet tables of one scale-factor folder."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        self._daily: DataFrame | None = None
        self._raw: dict[str, DataFrame] = {}
        self._windows: Windows | None = None
        self._id_sizes: tuple[int, int] | None = None

    @property
    def windows(self) -> Windows:
        """Evaluation windows that end with the last ship date (one aggregate over one column)."""
        if self._windows is None:
            last = self.raw("lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).first()[0]
            self._windows = windows_ending(last or ID_EPOCH)
        return self._windows

    def daily_sales(self) -> DataFrame:
        """All daily sales, derived once per source and cached (one lineitem scan)."""
        if self._daily is None:
            self._daily = self.sales_all().cache()
        return self._daily

    def raw(self, name: str) -> DataFrame:
        """One DataFrame per input table (file listing and footer reads happen once)."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        return self._raw[name]

    # -- dimensions -----------------------------------------------------------
    def stores_raw(self) -> DataFrame:
        """stores.csv shape: store_nbr, city, state, type, cluster."""
        nation = self.raw("nation")
        region = self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            (F.col("n_nationkey") + 1).cast("int").alias("store_nbr"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            F.expr("chr(65 + n_nationkey % 5)").alias("type"),
            (F.col("n_regionkey") + 1).cast("int").alias("cluster"),
        )

    def stores(self) -> DataFrame:
        return self.stores_raw().withColumnsRenamed({"type": "store_type", "cluster": "store_cluster"})

    def families(self) -> DataFrame:
        """family -> stable 0-based rank; bounded by the number of part types."""
        fam = self.raw("part").select(F.col("p_type").alias("family")).distinct()
        w = Window.orderBy("family")
        return fam.withColumn("family_rank", (F.row_number().over(w) - 1).cast("int"))

    # -- facts ------------------------------------------------------------------
    def sales_all(self, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """Daily sales per (date, store, family); optional inclusive date range.

        The range filter is written on the raw timestamp so it reaches the
        parquet scan as a pushed filter.
        """
        li = self.raw("lineitem")
        if start is not None:
            li = li.filter(F.col("l_shipdate") >= F.lit(dt.datetime.combine(start, dt.time())).cast("timestamp_ntz"))
        if end is not None:
            nxt = end + dt.timedelta(days=1)
            li = li.filter(F.col("l_shipdate") < F.lit(dt.datetime.combine(nxt, dt.time())).cast("timestamp_ntz"))
        li = li.select(
            F.col("l_shipdate").cast("date").alias("date"),
            "l_partkey",
            "l_suppkey",
            (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).cast("decimal(18,4)").alias("amount"),
            F.when(F.col("l_discount") >= F.lit(PROMO_DISCOUNT), 1).otherwise(0).alias("promo"),
        )
        part = self.raw("part").select("p_partkey", F.col("p_type").alias("family"))
        supp = self.raw("supplier").select("s_suppkey", (F.col("s_nationkey") + 1).cast("int").alias("store_nbr"))
        # Parts grow with the lines: both are dealt by key, so that no copy of them passes through the driver.
        joined = li.join(part.hint("merge"), li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
        return joined.groupBy("date", "store_nbr", "family").agg(
            F.sum("amount").cast("double").alias("sales"),
            F.sum("promo").cast("long").alias("onpromotion"),
        )

    def id_sizes(self) -> tuple[int, int]:
        """Store numbers (largest + 1) and families: the places an id needs for each."""
        if self._id_sizes is None:
            stores = self.raw("nation").agg(F.max("n_nationkey") + 2).first()[0]
            families = self.raw("part").agg(F.count_distinct("p_type")).first()[0]
            self._id_sizes = (int(stores or 1), max(1, int(families)))
        return self._id_sizes

    def with_id(self, df: DataFrame) -> DataFrame:
        """``id`` = (day * stores + store) * families + family: one value for each key, whatever the sizes."""
        if "_fam" not in self._raw:
            self._raw["_fam"] = written_lookup(self.families(), "families")
        stores, families = self.id_sizes()
        day = F.datediff("date", d(ID_EPOCH)).cast("long")
        place = (day * F.lit(stores) + F.col("store_nbr")) * F.lit(families) + F.col("family_rank")
        return df.join(self._raw["_fam"], "family").withColumn("id", place).drop("family_rank")

    def sales(self, end: dt.date | None = None) -> DataFrame:
        """Labeled base table (train.csv shape) up to ``end``, by default the internal test's."""
        daily = self.daily_sales().filter(F.col("date") <= d(end or self.windows.internal_test_end))
        return self.with_id(daily).select(
            "id", "date", "store_nbr", "family", "sales", "onpromotion"
        )

    def future(self, start: dt.date | None = None, days: int = WINDOW_DAYS) -> DataFrame:
        """Future base (test.csv shape): every observed pair on each of ``days`` days."""
        start = start or self.windows.future_start
        end = start + dt.timedelta(days=days - 1)
        daily = self.daily_sales()
        pairs = daily.filter(F.col("date") < d(start)).select("store_nbr", "family").distinct()
        grid = pairs.withColumn("date", F.explode(F.sequence(d(start), d(end))))
        promo = daily.filter(F.col("date").between(d(start), d(end))).select("date", "store_nbr", "family", "onpromotion")
        base = grid.join(promo, ["date", "store_nbr", "family"], "left").withColumn(
            "onpromotion", F.coalesce("onpromotion", F.lit(0).cast("long"))
        )
        return self.with_id(base).select("id", "date", "store_nbr", "family", "onpromotion")

    def template(self) -> DataFrame:
        """sample_submission shape: future ids with a zero sales column."""
        return self.future().select("id", F.lit(0.0).alias("sales"))

    def oil(self) -> DataFrame:
        day = F.col("o_orderdate").cast("date")
        orders = self.raw("orders").select(
            F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0))).alias("date"), "o_totalprice"
        )
        return (
            orders.groupBy("date")
            .agg(
                (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
                 / F.count(F.lit(1)).cast("double")).alias("dcoilwtico")
            )
        )

    def transactions(self) -> DataFrame:
        orders = self.raw("orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"))
        cust = self.raw("customer").select("c_custkey", (F.col("c_nationkey") + 1).cast("int").alias("store_nbr"))
        return (
            orders.join(cust.hint("merge"), orders.o_custkey == cust.c_custkey)  # customers grow with the orders
            .groupBy("date", "store_nbr")
            .agg(F.count(F.lit(1)).cast("int").alias("transactions"))
        )

    def _years(self) -> tuple[int, int]:
        row = self.daily_sales().agg(F.min(F.year("date")).alias("y0"), F.max(F.year("date")).alias("y1")).first()
        return int(row.y0), int(row.y1)

    def holidays(self) -> DataFrame:
        """holidays_events.csv shape, expanded over the years the sales cover."""
        y0, y1 = self._years()
        years = F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("year")
        rules = self.spark.createDataFrame(CALENDAR_RULES, RULE_SCHEMA)
        national = rules.select("*", years)
        region = self.raw("region").select(
            (F.lit(1) + F.col("r_regionkey") * 2).cast("int").alias("month"),
            F.lit(12).alias("day"),
            F.lit("Holiday").alias("type"),
            F.lit("Regional").alias("locale"),
            F.col("r_name").alias("locale_name"),
            F.concat(F.lit("Provincializacion de "), F.col("r_name")).alias("description"),
            F.lit(False).alias("transferred"),
            years,
        )
        nation = self.raw("nation").select(
            (F.lit(1) + F.col("n_nationkey") % 12).cast("int").alias("month"),
            (F.lit(1) + F.col("n_nationkey")).cast("int").alias("day"),
            F.lit("Holiday").alias("type"),
            F.lit("Local").alias("locale"),
            F.col("n_name").alias("locale_name"),
            F.concat(F.lit("Fundacion de "), F.col("n_name")).alias("description"),
            F.lit(False).alias("transferred"),
            years,
        )
        return (
            national.unionByName(region).unionByName(nation)
            .select(
                F.make_date("year", "month", "day").alias("date"),
                "type", "locale", "locale_name", "description", "transferred",
            )
        )

    def request_log(self) -> DataFrame:
        """events read as the service's JSON request log."""
        return request_log_from(self.raw("events"))

    def events_stream(self) -> DataFrame:
        """The events table, one file or a folder of files, as a file-source stream."""
        schema = self.raw("events").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir.rstrip('/')}/events.parquet*")

    # -- evaluation frame ---------------------------------------------------------
    def forecast_eval(self) -> DataFrame:
        """Internal-test rows with a deterministic stand-in forecast per store."""
        w = self.windows
        s = self.sales().filter(F.col("date").between(d(w.internal_test_start), d(w.internal_test_end)))
        pred = F.col("sales") * (F.lit(80) + F.lit(5) * (F.col("store_nbr") % 9)).cast("double") / F.lit(100.0)
        return s.withColumn("predicted_sales", pred)


def request_log_from(ev: DataFrame) -> DataFrame:
    """Map raw events (batch or stream) to request-log records."""
    k = F.get_json_object("props", "$.k").cast("int")
    path = F.lit("/admin")
    for event_type, event_path in EVENT_PATHS.items():
        path = F.when(F.col("event_type") == event_type, F.lit(event_path)).otherwise(path)
    status = (
        F.when(k % 10 <= 5, 200).when(k % 10 == 6, 422).when(k % 10 == 7, 401)
        .when(k % 10 == 8, 503).otherwise(500)
    )
    frame = ev.select(
        F.lit("http_request").alias("event"),
        # the log's wall-clock times are UTC: build the instant independently of the session zone
        F.to_timestamp(
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")),
            "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX",
        ).alias("timestamp_utc"),
        F.col("event_id").cast("string").alias("request_id"),
        F.when(path == "/forecast", "POST").otherwise("GET").alias("method"),
        path.alias("path"),
        status.cast("int").alias("status_code"),
        F.col("value").alias("latency_ms"),
        k.alias("k"),
    )
    rows = (
        F.when((F.col("path") == "/forecast") & (F.col("status_code") == 200), (F.col("k") % 3 + 1) * 16)
        .when((F.col("path") == "/forecast") & (F.col("status_code") != 401), (F.col("k") % 3) * 16)
        .otherwise(0)
    )
    return frame.withColumn("row_count", rows.cast("long")).drop("k")
