"""Training-data operators: media columns, quality, deduplication, licences, tokens, URL rules, decontamination, mixing, toxicity."""
