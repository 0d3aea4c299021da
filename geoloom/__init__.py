"""geoloom: a Spark-first engine for geo-referenced feature queries."""
