"""Packet-capture sanitising and TLS/HTTP flow analytics as Spark DataFrame operators."""
