"""Readers: tables, filing folders, statement payloads, the metric dictionary, remote endpoints."""
