"""Streaming forms of the line operators, an extension beyond batch analysis."""
