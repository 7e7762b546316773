"""Readers, sinks and the adapter that views the star-schema tables as trials."""
