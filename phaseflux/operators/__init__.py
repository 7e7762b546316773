"""Frames in, frames out: ingestion, clustering, labelling, funnel, report tables, evaluation."""
