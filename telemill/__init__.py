"""Device-event analytics on Spark: decode, check, normalise, store, quarantine, read, measure."""
