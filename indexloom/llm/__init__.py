"""Operators for preparing text for language models; nothing outside this subpackage imports it."""
