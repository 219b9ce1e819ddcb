"""Stateful and windowed queries over streams, each with a batch twin it is compared with."""
