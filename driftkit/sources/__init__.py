"""Readers and writers: table sets, catalogs, snapshots, history, specs, registries."""
