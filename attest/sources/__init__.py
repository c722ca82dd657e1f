"""Readers: tables with verified digests, job logs, run-record stores, folders."""
