"""Readers and writers of event logs, task tables and predictions."""
