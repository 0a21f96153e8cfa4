"""Typed readers, file manifests and sinks."""
