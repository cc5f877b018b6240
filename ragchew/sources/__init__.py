"""Readers and writers: files, contest-log text, spot archives, catalogue."""
