"""Readers of manifests, settings, source files and fact tables; writers of reports."""
