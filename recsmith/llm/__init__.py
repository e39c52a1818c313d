"""Operators for training-data pipelines: near-duplicate removal, language
identification, packing, WARC archives, quality rules, benchmark
decontamination, URL rules, language-model scoring, license scans and HTML
extraction. Nothing outside this subpackage imports it."""
