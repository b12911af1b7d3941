"""docketry: retrieval and analytics over large document corpora, on Spark."""
