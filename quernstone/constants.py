"""Unit sizes in bytes."""

KB = 1 << 10
MB = 1 << 20
GB = 1 << 30
#: A segmented read returns whole spans of about this many bytes at most.
SEGMENT = MB
