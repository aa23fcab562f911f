"""Operators for preparing training corpora at scale. Nothing outside this subpackage imports it."""
