"""corpusflow: corpus preparation as Spark DataFrame and Structured Streaming jobs.

Every operator is a function ``(DataFrame, params) -> DataFrame``; nothing is
collected to the driver.  Sub-packages:

* ``sources``   - readers and writers (parquet tables, JSONL, archives, shards)
* ``functions`` - column expressions (text, URL, dates, arrays, hashing)
* ``operators`` - relational operators built from those (gates, windows,
                  similarity join, star cover, ordinals, batching, BPE, ...)
* ``plans``     - the registered queries over the driver's test tables
* ``streaming`` - incremental ingest with Structured Streaming
"""

__version__ = "0.1.0"
