"""Search and recommendation analytics on Spark: tables in, tables out."""
