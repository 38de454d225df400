"""mailsift: mail indexing and search on Spark.

Entry points: `operators.ingest.rebuild_index` / `load_index` (build and open an index),
`Index.search` and `operators.search.search` (criteria from `operators.criteria`),
`operators.batch.search_batch`, `operators.maintain` (change logs), `streaming.stream`.
"""
