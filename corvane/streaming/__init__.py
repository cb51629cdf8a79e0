"""Streams of envelopes and events: decoding, deduplication, interest matches, rate limits, sinks."""
