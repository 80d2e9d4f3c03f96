"""Readers, schema conformance, sinks and the bindings of the sample star schema."""
