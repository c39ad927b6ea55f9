"""corpusbrief: summarise document corpora and query the summary catalog on Spark.

Every public operator is a function from DataFrame(s) to DataFrame(s); nothing
is collected to the driver.  Main entry points:

* ``session.get_session``: session defaults (UTC, AQE, measured broadcasts)
* ``sources.files.ingest_files`` / ``file_identity``: files → rows with hash
* ``plans.corpus_run.run_corpus``: extract, prompt, summarise → catalog rows + failures
* ``operators.extractive.extractive_summary``: the Spark-SQL summariser
* ``plans.chunked.summarize_chunked``: recursive map-and-combine with a user summariser
* ``sources.store``: ``read_catalog`` / ``append`` / ``delete`` / ``compact``
* ``operators.catalog`` and ``operators.views``: lookups, deletes, latest, roll-up, views
* ``plans.commands``: the summarize / list / show / delete commands over a store folder
* ``streaming.ingest.start_ingest``: incremental ingest with Structured Streaming

See README.md for the module map and the scale design.
"""

__version__ = "0.1.0"
