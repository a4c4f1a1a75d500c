"""Packet-capture forensics as Spark jobs."""
