"""The channels as stateful streaming operators."""
