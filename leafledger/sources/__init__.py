"""Readers and writers of vault tables and file trees."""
