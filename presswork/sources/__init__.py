"""Readers and writers; every read has an explicit schema."""
