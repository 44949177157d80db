"""Holiday normalisation (H1-H3) without expanding national events to every store.

A national event applies to every store, a regional one to the stores of its
state, a local one to the stores of its city. Instead of materialising
events x stores, the flags are reduced to three small lookups keyed by
``date`` / ``(date, state)`` / ``(date, city)`` (bounded by calendar days x
locales, independent of the fact table) and joined onto rows that already
carry ``city`` and ``state``; a row's flag is the max over the three scopes.
With the lookups broadcast (size checked), attaching flags to the base never
shuffles the base.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.functions.columns import count_if
from shelfcast.operators.contracts import ContractError, duplicate_counts
from shelfcast.session import written_lookup


def classify_events(holidays: DataFrame) -> DataFrame:
    """Add ntype / planned / earthquake / unknown / scheduled / active columns (H2)."""
    ntype = F.regexp_replace(F.lower("type"), " ", "_")
    ndesc = F.lower("description")
    is_event = ntype == "event"
    planned = is_event & ndesc.rlike(S.PLANNED_EVENT_PATTERN)
    quake = is_event & ndesc.contains(S.EARTHQUAKE_TEXT)
    return holidays.select(
        "*",
        ntype.alias("ntype"),
        planned.alias("is_planned"),
        quake.alias("is_earthquake"),
        (is_event & ~planned & ~quake).alias("is_unknown_event"),
        (ntype.isin(*S.SCHEDULED_TYPES) | planned).alias("is_scheduled"),
        (~F.col("transferred")).alias("is_active"),
    )


def raise_on_unknown_events(classified: DataFrame) -> None:
    """Fail closed: an Event without an accepted classification raises (sorted list)."""
    unknown = (
        classified.filter("is_unknown_event").select("description").distinct().orderBy("description")
    ).collect()
    if unknown:
        names = [r.description for r in unknown]
        raise ContractError(
            "holidays contain Event descriptions without an accepted availability classification: " + str(names)
        )


def _flag_exprs():
    active = F.col("is_active")
    nt = F.col("ntype")
    flag = {
        "is_holiday": active & nt.isin(*S.HOLIDAY_LIKE_TYPES),
        "is_special_work_day": active & (nt == "work_day"),
        "is_holiday_transfer_source": (nt == "holiday") & F.col("transferred"),
        "is_holiday_transfer_destination": active & (nt == "transfer"),
        "is_planned_event": active & (nt == "event"),
        "is_national_schedule": active & (F.col("locale") == "National"),
        "is_regional_schedule": active & (F.col("locale") == "Regional"),
        "is_local_schedule": active & (F.col("locale") == "Local"),
    }
    return [F.max(F.when(c, 1).otherwise(0)).cast("int").alias(n) for n, c in flag.items()]


def scoped_lookups(holidays: DataFrame, check: bool = True) -> dict[str, DataFrame]:
    """Flag lookups per scope: national by date, regional by (date, state), local by (date, city).

    Each lookup also carries ``n_active`` (active events in that scope).
    """
    ev = classify_events(holidays)
    if check:
        raise_on_unknown_events(ev)
    sched = ev.filter("is_scheduled")
    aggs = _flag_exprs() + [count_if(F.col("is_active")).alias("n_active"), F.count(F.lit(1)).alias("n_events")]
    nat = sched.filter(F.col("locale") == "National").groupBy("date").agg(*aggs)
    reg = sched.filter(F.col("locale") == "Regional").groupBy("date", F.col("locale_name").alias("state")).agg(*aggs)
    loc = sched.filter(F.col("locale") == "Local").groupBy("date", F.col("locale_name").alias("city")).agg(*aggs)
    return {"national": nat, "regional": reg, "local": loc}


def prepared_lookups(holidays: DataFrame, check: bool = True) -> dict[str, DataFrame]:
    """Scoped lookups with prefixed flag columns, written once for reuse, all three as one table."""
    keys = {"national": [], "regional": ["state"], "local": ["city"]}
    parts = []
    for scope, df in scoped_lookups(holidays, check=check).items():
        place = F.col(keys[scope][0]) if keys[scope] else F.lit(None).cast("string")
        parts.append(df.select(F.lit(scope).alias("scope"), "date", place.alias("place"), *_LOOKUP_FLAGS))
    written = written_lookup(reduce(DataFrame.unionByName, parts), "holidays")
    out = {}
    for scope, p in _PREFIX.items():
        names = [F.col("place").alias(k) for k in keys[scope]] + [F.col(f).alias(f"{p}{f}") for f in _LOOKUP_FLAGS]
        out[scope] = written.where(F.col("scope") == scope).select("date", *names)
    return out


_PREFIX = {"national": "_n_", "regional": "_r_", "local": "_l_"}
_LOOKUP_FLAGS = S.HOLIDAY_FEATURE_COLUMNS + ["n_active", "n_events"]


def attach_holiday_flags(
    rows: DataFrame, holidays: DataFrame | dict, check: bool = True, with_active_count: bool = False
) -> DataFrame:
    """J11 + H1: left-join the scoped flags onto rows carrying date, city, state; absent -> 0.

    ``holidays`` is the raw calendar or the result of ``prepared_lookups``.
    """
    lk = holidays if isinstance(holidays, dict) else prepared_lookups(holidays, check=check)
    out = (
        rows.join(lk["national"], ["date"], "left")
        .join(lk["regional"], ["date", "state"], "left")
        .join(lk["local"], ["date", "city"], "left")
    )
    prefixes = list(_PREFIX.values())
    for f in S.HOLIDAY_FEATURE_COLUMNS:
        out = out.withColumn(
            f, F.greatest(*[F.coalesce(F.col(f"{p}{f}"), F.lit(0)) for p in prefixes]).cast("int")
        )
    if with_active_count:
        for f in ("n_active", "n_events"):
            out = out.withColumn(
                f, reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{p}{f}"), F.lit(0)) for p in prefixes]).cast("long")
            )
    return out.drop(*[f"{p}{f}" for p in prefixes for f in _LOOKUP_FLAGS])


def holiday_flags(holidays: DataFrame, stores: DataFrame, store_dates: DataFrame) -> DataFrame:
    """H1 as a table: (date, store_nbr, 8 flags) for store-dates touched by a scheduled event.

    ``store_dates``: the (date, store_nbr) population that needs flags (e.g.
    the distinct store-dates of the base tables). Only rows with at least one
    mapped scheduled event are returned, like the original normalised table.
    """
    sd = store_dates.select("date", "store_nbr").distinct().join(
        stores.select("store_nbr", "city", "state"), "store_nbr"
    )
    flagged = attach_holiday_flags(sd, holidays, with_active_count=True)
    return flagged.filter(F.col("n_events") > 0).select("date", "store_nbr", *S.HOLIDAY_FEATURE_COLUMNS)


def event_classes(holidays: DataFrame) -> DataFrame:
    """H2 report: class counts per (ntype, class)."""
    ev = classify_events(holidays)
    cls = (
        F.when(F.col("is_planned"), "planned_event")
        .when(F.col("is_earthquake"), "earthquake_excluded")
        .when(F.col("is_unknown_event"), "unknown_event")
        .when(F.col("is_scheduled"), "scheduled")
        .otherwise("dropped_type")
    )
    return ev.groupBy("ntype", cls.alias("event_class")).agg(F.count(F.lit(1)).alias("rows"))


def holiday_evidence(holidays: DataFrame, stores: DataFrame) -> DataFrame:
    """H3: the twelve counters of the normalisation, as one row.

    Counted per scope, never by expanding national events to all stores:
    national reach = events x store count; regional / local reach comes from
    an equi-join on the locale. The max active events on one store-date is
    ``national(date) + max over stores of (regional + local)``.
    """
    ev = classify_events(holidays)
    st = stores.select("store_nbr", "city", "state")
    n_stores = stores.count()
    src = ev.agg(
        F.count(F.lit(1)).alias("source_calendar_rows"),
        count_if(F.col("ntype") == "event").alias("source_type_event_rows"),
        count_if(F.col("is_scheduled")).alias("scheduled_source_rows"),
        count_if(F.col("is_planned")).alias("planned_type_event_rows"),
        count_if(F.col("is_earthquake")).alias("earthquake_event_rows_excluded"),
        count_if(F.col("is_unknown_event")).alias("unknown_type_event_rows"),
        count_if(F.col("transferred")).alias("source_rows_with_transferred_true"),
    ).first().asDict()
    sched = ev.filter("is_scheduled")
    per_state = stores.groupBy(F.col("state").alias("locale_name")).agg(F.count(F.lit(1)).alias("n"))
    per_city = stores.groupBy(F.col("city").alias("locale_name")).agg(F.count(F.lit(1)).alias("n"))
    nat = sched.filter(F.col("locale") == "National")
    reached = (
        nat.withColumn("n", F.lit(n_stores).cast("long"))
        .unionByName(sched.filter(F.col("locale") == "Regional").join(per_state, "locale_name", "left"))
        .unionByName(sched.filter(F.col("locale") == "Local").join(per_city, "locale_name", "left"))
    )
    mapped = reached.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("mapped_scheduled_store_rows"),
        count_if(F.col("n").isNull()).alias("unmapped_scheduled_source_rows"),
    ).first().asDict()
    reg = sched.filter(F.col("locale") == "Regional").withColumnRenamed("locale_name", "state").join(st.drop("city"), "state")
    loc = sched.filter(F.col("locale") == "Local").withColumnRenamed("locale_name", "city").join(st.drop("state"), "city")
    rl = reg.select("date", "store_nbr", "is_active").unionByName(loc.select("date", "store_nbr", "is_active"))
    rl_sd = rl.groupBy("date", "store_nbr").agg(count_if(F.col("is_active")).alias("a"))
    nat_d = nat.groupBy("date").agg(count_if(F.col("is_active")).alias("a_nat"))
    n_nat_dates = nat_d.count()
    n_rl_only = rl_sd.join(nat_d, "date", "left_anti").count()
    per_date = (
        rl_sd.groupBy("date").agg(F.max("a").alias("a_rl"))
        .join(nat_d, "date", "full")
        .select((F.coalesce("a_nat", F.lit(0)) + F.coalesce("a_rl", F.lit(0))).alias("a"))
    )
    mx = per_date.agg(F.max("a")).first()[0]
    repeated = duplicate_counts(rl_sd, ["date", "store_nbr"]).first().extra_rows
    repeated += duplicate_counts(nat_d, ["date"]).first().extra_rows * n_stores
    out = {
        **src,
        **mapped,
        "normalized_store_date_rows": n_nat_dates * n_stores + n_rl_only,
        "normalized_duplicate_store_date_rows": repeated,
        "maximum_active_events_on_one_store_date": int(mx or 0),
    }
    spark = holidays.sparkSession
    return spark.createDataFrame([tuple(int(out[k]) for k in EVIDENCE_ORDER)], ", ".join(f"{k} long" for k in EVIDENCE_ORDER))


EVIDENCE_ORDER = [
    "source_calendar_rows", "source_type_event_rows", "scheduled_source_rows",
    "planned_type_event_rows", "earthquake_event_rows_excluded", "unknown_type_event_rows",
    "mapped_scheduled_store_rows", "unmapped_scheduled_source_rows", "normalized_store_date_rows",
    "source_rows_with_transferred_true", "normalized_duplicate_store_date_rows",
    "maximum_active_events_on_one_store_date",
]
