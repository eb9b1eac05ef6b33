"""Readers and writers: driver test tables, raw CSV, warehouse tables, factor tables."""
