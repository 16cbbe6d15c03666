"""Readers: tables, JSON documents, JSON Lines, repository files and pages."""
