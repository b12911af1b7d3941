"""Jobs that run from the command line: ``python -m jobs.library_feed`` and ``python -m jobs.retrieval_report``."""
