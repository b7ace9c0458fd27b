"""Readers and writers of annotation sets, sheets, lists and descriptive texts."""
