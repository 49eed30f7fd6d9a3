"""Training-data operators: decontamination, mixing, secret scans, near and exact deduplication,
quality rules and models, chat formatting, HTML extraction and WARC archives.

Nothing outside this subpackage imports it.
"""
