"""Incremental forms: events as three-hour windows with a watermark, histograms by merged batches."""
