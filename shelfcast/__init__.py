"""shelfcast: leak-safe retail demand-forecast data engine on PySpark.

Every operator is a ``DataFrame -> DataFrame`` function built from the
DataFrame API so Catalyst can prune, push down and plan it. Sub-packages:

* ``sources``   typed readers, sinks, JSON record ingest, driver-table views
* ``functions`` column-expression helpers (calendar, finite checks, clipping)
* ``operators`` joins, as-of / exact lags, holidays, contracts, profiles,
                 exploration aggregates, metrics, splits, ML stages
* ``plans``     composed jobs: feature table, experiment, batch inference
* ``streaming`` request-log rollups and file-stream batch scoring
"""

from shelfcast.session import checkpoint, get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir", "checkpoint"]
