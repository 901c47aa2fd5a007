"""Imports every module that registers queries."""

from tidemark.plans import aggregates, binaries, broadcasts, carried, decoded, effects, further, machines, more, options, parallel, sequences, sourced, spanning, streams, texts, timed, times  # noqa: F401
