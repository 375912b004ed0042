"""ragtally: retrieval-augmented multiple-choice evaluation as Spark jobs.

Sub-packages
------------
sources    table readers, run-file scans, sinks and the fixture views
functions  Column expressions (answer parsing, metrics, statistics, vectors)
operators  DataFrame -> DataFrame jobs (retrieval, scoring, summaries, ingestion)
plans      run plans and report composition
streaming  incremental (Structured Streaming) loads
"""

__version__ = "0.1.0"
