"""Training-data operators: mixing, language ID, URL filters, quality, near
duplicates, repeated passages, sharding, media columns, toxicity and benchmark
decontamination.  Nothing outside this subpackage imports it."""
