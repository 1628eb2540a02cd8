"""Trawl: a Spark-first search and text-analytics engine over file and document corpora."""
