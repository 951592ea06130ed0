"""Structured Streaming: triage, dedup, outbox state, sweeps, sinks."""
