"""Training-data operators: mixing, near-duplicates, language, decontamination, quality,
personal data, language models, repeated passages, WARC archives and secret scans."""
