"""Tables of texts."""

from raregram.sources.text import parquet_table, scratch_dir, spread, text_lines, write_lines

__all__ = ["parquet_table", "scratch_dir", "spread", "text_lines", "write_lines"]
