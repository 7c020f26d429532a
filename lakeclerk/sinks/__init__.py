from lakeclerk.sinks.files import (
    merge_files,
    overwrite,
    overwrite_partitions,
    write_csv,
)

__all__ = ["merge_files", "overwrite", "overwrite_partitions", "write_csv"]
