"""Composite jobs: resolve, compute, detect, report, analyse."""
