"""Operators over files, lines, symbols, edges and logs; each takes and returns DataFrames."""
