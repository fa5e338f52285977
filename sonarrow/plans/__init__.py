"""Named queries: importing the modules below registers them in `catalog`."""

from . import decoding_queries, linalg_queries, render_queries, sequential_queries, signal_queries, storage_queries, text_queries, timeline_queries  # noqa: F401
