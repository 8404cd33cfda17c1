"""Tests of the subpackage llm."""
