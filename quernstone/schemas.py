"""Schemas of the store's tables and of its reports, as DDL."""

FILES = "file_name string, write_seq long, bytes binary"
#: What was done, in order of ``commit``: files created, and writes with the sequence numbers, spans and bytes they added.
LEDGER = "kind string, file_name string, generation long, first_seq long, next_seq long, spans long, size long, n_bytes long, commit long"
SPANS = "file_name string, generation long, span_idx long, write_seq long, hash binary, offset long, len long, commit long"
CHUNKS = "hash binary, length long, data binary, target_keys array<binary>"
TARGET = "key binary, data binary"
MEASURE = (
    "date timestamp, name string, chunker string, size long, dedup_ratio double, full_dedup_ratio double, "
    "avg_chunk_size long, chunk_count long, write_time double, read_time double, chunk_time double, hash_time double, "
    "chunk_throughput double, hash_throughput double, write_throughput double, read_throughput double, path string"
)
