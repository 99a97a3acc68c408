"""Scans: structured payloads, raw text, rules, credentials, generators."""
