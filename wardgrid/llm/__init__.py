"""Training-data operators: near-duplicates, language, mixing, decontamination, extraction, privacy, chat format."""
