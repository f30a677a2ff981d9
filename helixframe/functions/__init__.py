"""Scalar functions over k-mers."""

from .kmers import U32_MAX, base_count, canonical, canonical_acgt, decode, encode, hpc, reverse_complement, run_score, saturate, sort_key, windows
from .codes import key_columns, keys_of, pack, packed, packed_counts, packed_windows, sieve, unpack, unpacked

__all__ = ["U32_MAX", "base_count", "canonical", "canonical_acgt", "decode", "encode", "hpc", "key_columns", "keys_of", "pack", "packed", "packed_counts", "packed_windows", "reverse_complement", "run_score", "saturate", "sieve", "sort_key", "unpack", "unpacked", "windows"]
