"""insight: news-engagement, bibliography and coded-survey analytics as Spark jobs.

Every public operator is a function ``DataFrame -> DataFrame`` (or a small tuple
of DataFrames) built from Spark SQL / DataFrame / Spark ML primitives.  Columns
are parameters; nothing is hard-wired to a publisher's field names beyond the
documented defaults.

Layout
------
``sources``    scans and sinks (JSON lines, CSV, bibliography text, file ids)
``functions``  column-expression builders (flags, identity, casing, dates)
``operators``  the operators themselves (events, nested, bibliography, coding,
               trends, matrix, features) plus the distributed ranking helper
``plans``      stand-in views over the driver tables and the query catalogue
``streaming``  the stateless event reducers run under Structured Streaming
"""

from insight.session import build_session, checkpoint_root, land, remove_scratch, scratch_path

__all__ = ["build_session", "checkpoint_root", "land", "remove_scratch", "scratch_path"]
