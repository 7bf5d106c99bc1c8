"""Operators on tables of spans, regions, blocks, pages, fields and vectors."""
